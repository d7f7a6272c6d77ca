"""Errors raised while a plan is built or a model fitted, never inside executors."""


class EngineError(ValueError):
    """Base of all errors of this library."""


class EmptyInputError(EngineError):
    """There are no rows, features or classes to work on."""


class DimensionError(EngineError):
    """Vectors or targets have lengths other than expected."""


class ConfigError(EngineError):
    """A setting is out of its range or unknown."""


class UnknownClassError(EngineError):
    """Evaluation data have a class that training data lack."""


class UnsupportedCorrectionError(EngineError):
    """Ratio correction has no batch form."""
