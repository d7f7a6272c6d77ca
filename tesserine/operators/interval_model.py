"""Additive interval-weight classifiers: inference, online and batch error correction."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..errors import ConfigError, DimensionError, EmptyInputError, UnsupportedCorrectionError
from ..functions.vectors import EPSILON, argmax_last
from .intervals import Distributor, Intervals, encode_array, fit_intervals, triangular_array

#: Weights of a step from which on a group of outputs is worth a copy of the samples.
STEP_WEIGHTS = 50_000
#: Samples of a block whose errors are solved together, and cells of their activations, at most.
BLOCK_SAMPLES, BLOCK_CELLS = 256, 1 << 22
#: Values that are encoded at once.
CACHED = 1 << 14

_BLOCK_NAMES = ["first", "labels", "x", "dens", "inverse", "usage", "proportional"]
_BLOCKS = "first bigint, labels binary, x binary, dens binary, inverse binary, usage binary, proportional boolean"
CORRECTIONS = ("least-squares", "proportional", "ratio")


@dataclass(frozen=True)
class Correction:
    """How an error changes the active weights; ratio multiplies, within +-max_factor, unless the output is within epsilon of 0."""

    mode: str = "least-squares"
    epsilon: float = 1e-9
    max_factor: float = 100.0
    freeze_after: int | None = None  # plasticity: halved with each access, frozen from this count on

    def __post_init__(self):
        if self.mode not in CORRECTIONS:
            raise ConfigError(f"unknown correction {self.mode}")


def as_matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    lists = lists.cast(pa.list_(pa.float64()))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def step(weights: np.ndarray, counts: np.ndarray, at: np.ndarray, c: np.ndarray, valid: np.ndarray, target: np.ndarray, correction: Correction) -> np.ndarray:
    """Correct ``weights`` (features, intervals, outputs) in place by one sample; the errors before.

    Entries are applied one place of the encoding after the other, so an
    interval that is active twice is corrected twice, with its count in between.
    """
    feature = np.arange(len(at))
    output = sum((c[:, j, None] * valid[:, j, None] * weights[feature, at[:, j]]).sum(axis=0) for j in range(at.shape[1]))
    error = target - output
    if correction.mode == "proportional":
        share = error / max(float(valid.sum()), 1.0)
    else:
        den = max(float((c * c * valid).sum()), EPSILON)
        share = error / den
    if correction.mode == "ratio":
        near = np.abs(output) <= correction.epsilon
        bound = abs(correction.max_factor)
        factor = np.clip(target / np.where(near, 1.0, output), -bound, bound)
        share = target / den
    for j in range(at.shape[1]):
        f = feature[valid[:, j]]
        i = at[f, j]
        delta = c[f, j, None] * share
        if correction.mode == "ratio":
            own = weights[f, i]
            delta = np.where(near, delta, own * factor - own)
        if correction.freeze_after is not None:
            n = counts[f, i]
            delta = delta * np.where(n >= correction.freeze_after, 0.0, 0.5 ** np.minimum(n, 1000))
        weights[f, i] += delta
        counts[f, i] += 1
    return error


@dataclass
class IntervalModel:
    """Weights (features, intervals, outputs) over fitted intervals. The model is as large as features * intervals * outputs, whatever the data."""

    intervals: Intervals
    outputs: int
    weights: np.ndarray = None
    counts: np.ndarray = None
    correction: Correction = Correction()

    def __post_init__(self):
        if self.outputs < 1 or self.intervals.features < 1:
            raise ConfigError("a model needs features and outputs")
        if any(not (np.isfinite(a) and np.isfinite(b)) or a > b for a, b in zip(self.intervals.low, self.intervals.high)):
            raise ConfigError("ranges must be finite and rise")
        shape = (self.intervals.features, self.intervals.count, self.outputs)
        self.weights = np.zeros(shape) if self.weights is None else np.asarray(self.weights, dtype=float)
        self.counts = np.zeros(shape, np.int64) if self.counts is None else np.asarray(self.counts, dtype=np.int64)
        if self.weights.shape != shape or self.counts.shape != shape:
            raise DimensionError(f"weights of shape {self.weights.shape}, expected {shape}")

    # constructors

    @classmethod
    def with_unit_ranges(cls, features: int, intervals: int, outputs: int, distributor: Distributor = Distributor(), **options) -> IntervalModel:
        return cls(Intervals(intervals, (0.0,) * features, (1.0,) * features, None, distributor), outputs, **options)

    @classmethod
    def from_training_data(cls, samples: DataFrame, intervals: int, outputs: int, strategy: str = "uniform", distributor: Distributor = Distributor(), vector: str = "features", **options) -> IntervalModel:
        return cls(fit_intervals(samples, intervals, strategy, vector=vector, distributor=distributor), outputs, **options)

    # inference

    def _scores(self):
        weights, intervals = self.weights, self.intervals

        @arrow_udf(T.ArrayType(T.DoubleType()))
        def scores(vectors: pa.Array) -> pa.Array:
            x = as_matrix(vectors)
            if x.size and x.shape[1] != intervals.features:
                raise DimensionError(f"{x.shape[1]} features, expected {intervals.features}")
            out = forward_array(x, weights, intervals) if x.size else np.empty((0, weights.shape[2]))
            return pa.array(list(out), pa.list_(pa.float64()))

        return scores

    def forward(self, samples: DataFrame, vector: str = "features", out: str = "scores") -> DataFrame:
        """Add the outputs for each sample, as array<double>."""
        return samples.withColumn(out, self._scores()(F.col(vector).cast("array<double>")))

    def predict(self, samples: DataFrame, vector: str = "features", out: str = "predicted") -> DataFrame:
        """Add scores and the index of the largest, the last on ties."""
        return self.forward(samples, vector).withColumn(out, argmax_last(F.col("scores")))

    def accuracy(self, samples: DataFrame, label: str = "label", vector: str = "features") -> float:
        """Share of right predictions; 0 without samples."""
        return self.predict(samples, vector).agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] or 0.0

    def mean_mse(self, samples: DataFrame, label: str = "label", vector: str = "features") -> float:
        """Mean over samples and outputs of squared errors against one-hot targets; 0 without samples."""
        target = F.transform("scores", lambda s, i: F.pow(F.when(i == F.col(label), 1.0).otherwise(0.0) - s, 2))
        return self.forward(samples, vector).agg(F.avg(F.aggregate(target, F.lit(0.0), lambda a, x: a + x) / self.outputs)).first()[0] or 0.0

    # training

    def train_one(self, x: list[float], target: list[float], honour_mode: bool = True) -> dict:
        """One correction on the driver; ``honour_mode`` off always uses least squares."""
        if len(x) != self.intervals.features or len(target) != self.outputs:
            raise DimensionError("input or target of the wrong length")
        at, c, valid = encode_array(np.array([x], dtype=float), self.intervals)
        before = forward_array(np.array([x], dtype=float), self.weights, self.intervals)[0]
        mode = self.correction if honour_mode else replace(self.correction, mode="least-squares")
        error = step(self.weights, self.counts, at[0], c[0], valid[0], np.array(target, dtype=float), mode)
        after = forward_array(np.array([x], dtype=float), self.weights, self.intervals)[0]
        return {"output_before": before.tolist(), "output_after": after.tolist(), "error_before": error.tolist(), "mse_before": float(np.mean(error**2)), "active_count": int(valid.sum())}

    def _groups(self, spark: SparkSession) -> int:
        return max(1, min(self.outputs, spark.sparkContext.defaultParallelism, self.intervals.features * self.outputs // STEP_WEIGHTS))

    def _plain(self, epoch_mode: str) -> tuple[bool, bool]:
        """(whether each step adds its error alone, whether it shares that by the number of activations) in an epoch mode."""
        plain = self.correction.mode != "ratio" and self.correction.freeze_after is None
        return plain, self.correction.mode == "proportional" and epoch_mode != "reference"

    def prepare(self, samples: DataFrame, label: str = "label", order: str = "ord", vector: str = "features", epoch_mode: str = "reference") -> DataFrame:
        """Samples in training order, for ``train_epoch`` in that mode; cache it when several epochs follow.

        Where each step adds its error alone, errors are affine in the
        weights before: of a block of samples they solve a triangular system
        whose matrix has no weights in it. So tasks make and
        invert these matrices side by side, once for all epochs, and what is
        left to be done in order are a few products a block. Else samples
        are only put in order. Outputs are dealt out by groups where a step
        corrects many weights.
        """
        groups, spark = self._groups(samples.sparkSession), samples.sparkSession
        plain, proportional = self._plain(epoch_mode)
        rows = samples.select(F.col(order).alias("ord"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
        parts = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
        if not plain:
            return rows.select("*", parts).repartitionByRange(groups, "part").sortWithinPartitions("part", "ord")
        dealt = rows.repartitionByRange(spark.sparkContext.defaultParallelism, "ord").sortWithinPartitions("ord")
        blocks = dealt.select("label", "x").mapInArrow(_blocks_of(self.intervals, proportional), _BLOCKS)
        return blocks.select("*", parts).repartitionByRange(groups, "part").sortWithinPartitions("part", "first")

    def train_epoch(self, prepared: DataFrame, epoch_mode: str = "reference") -> float:
        """One pass over ``prepare``d samples in order; the mean squared error before each correction.

        The error of an output depends on its own weights alone, so outputs
        train side by side with the results of one sequential loop; each task
        streams the samples and holds only its outputs' weights. In mode
        ``reference`` every correction but ratio is least squares, as the
        original loop has it; ``honour`` follows the configured one.
        """
        correction, (plain, proportional) = self.correction, self._plain(epoch_mode)
        if epoch_mode == "reference" and correction.mode != "ratio":
            correction = replace(correction, mode="least-squares")
        if plain != ("inverse" in prepared.columns):
            raise ConfigError("the samples were prepared for another correction")
        groups = self._groups(prepared.sparkSession)
        weights, counts, intervals, outputs = self.weights, self.counts, self.intervals, self.outputs

        def by_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, state = None, None
            cells = np.empty((0, 0))
            for batch in batches:
                of = lambda c, i, kind=float: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                for i in range(batch.num_rows):
                    if batch.column("proportional")[i].as_py() != proportional:
                        raise ConfigError("the samples were prepared for another epoch mode")
                    if batch.column("part")[i].as_py() != part:
                        if state is not None:
                            yield _emit(part, *state)
                        part = batch.column("part")[i].as_py()
                        own = np.arange(part, outputs, groups)
                        state = [own, weights[:, :, own].reshape(-1, len(own)).copy(), counts[:, :, own].reshape(-1, len(own)).copy(), 0.0, 0]
                    own, w, count, _, _ = state
                    labels, den, usage = of("labels", i, np.int64), of("dens", i), of("usage", i, np.int64)
                    if len(cells) < len(labels):
                        cells = np.empty((len(labels), len(usage)))
                    a = _fill(cells, of("x", i).reshape(len(labels), -1), intervals)
                    error = of("inverse", i).reshape(len(labels), -1) @ ((own == labels[:, None]) - a @ w)
                    w += a.T @ (error / den[:, None])
                    count += usage[:, None]
                    state[3] += float((error**2).sum())
                    state[4] += len(labels)
            if state is not None:
                yield _emit(part, *state)

        def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, state = None, None
            for batch in batches:
                parts = batch.column("part").to_numpy()
                x, labels = as_matrix(batch.column("x")), batch.column("label").to_numpy(zero_copy_only=False)
                at, c, valid = encode_array(x, intervals)
                for i in range(batch.num_rows):
                    if parts[i] != part:
                        if state is not None:
                            yield _emit(part, *state)
                        part = parts[i]
                        own = np.arange(part, outputs, groups)
                        state = [own, weights[:, :, own].copy(), counts[:, :, own].copy(), 0.0, 0]
                    own, w, n, _, _ = state
                    error = step(w, n, at[i], c[i], valid[i], (own == labels[i]).astype(float), correction)
                    state[3] += float((error**2).sum())
                    state[4] += 1
            if state is not None:
                yield _emit(part, *state)

        schema = "part int, outputs array<int>, weights binary, counts binary, squares double, n bigint"
        found = prepared.mapInArrow(by_blocks if plain else one_by_one, schema).collect()
        if not found:
            raise EmptyInputError("no training samples")
        for r in found:
            shape = (*self.weights.shape[:2], len(r["outputs"]))
            self.weights[:, :, r["outputs"]] = np.frombuffer(r["weights"], float).reshape(shape)
            self.counts[:, :, r["outputs"]] = np.frombuffer(r["counts"], np.int64).reshape(shape)
        return sum(r["squares"] for r in found) / (found[0]["n"] * self.outputs)

    def train_epoch_batch(self, samples: DataFrame, label: str = "label", vector: str = "features") -> float:
        """One batch epoch: errors of all samples under the same weights, averaged over the samples that use a weight. The mean squared error before.

        Each task sums its samples' corrections into one model-sized table;
        only these partial sums are shuffled.
        """
        if self.correction.mode == "ratio":
            raise UnsupportedCorrectionError("ratio correction has no batch form")
        weights, intervals, outputs, proportional = self.weights, self.intervals, self.outputs, self.correction.mode == "proportional"
        columns = intervals.features * intervals.count

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            change, usage, squares, n = np.zeros((columns, outputs)), np.zeros(columns, np.int64), 0.0, 0
            for batch in batches:
                for begin in range(0, batch.num_rows, 1024):
                    part = batch.slice(begin, 1024)
                    a = activation_array(as_matrix(part.column("x")), intervals)
                    labels = part.column("label").to_numpy(zero_copy_only=False)
                    error = (np.arange(outputs)[None, :] == labels[:, None]) - a @ weights.reshape(columns, outputs)
                    squares += float((error**2).sum())
                    n += len(a)
                    used = np.abs(a) > EPSILON
                    den = used.sum(axis=1) if proportional else (a * a).sum(axis=1)
                    change += a.T @ (error / np.maximum(den, EPSILON)[:, None])
                    usage += used.sum(axis=0)
            if n:
                k = np.flatnonzero(usage)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array([*map(list, change[k]), [squares]], pa.list_(pa.float64())), pa.array(np.append(usage[k], n))], names=["k", "change", "usage"])

        rows = samples.select(F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(sums, "k bigint, change array<double>, usage bigint")
        flat = rows.select("k", "usage", F.posexplode("change").alias("o", "c")).groupBy("k", "o").agg(F.sum("c").alias("c"), F.sum("usage").alias("usage"))
        found = flat.toArrow()
        if not found.num_rows:
            raise EmptyInputError("no training samples")
        k, o, c, usage = (found.column(x).to_numpy() for x in ("k", "o", "c", "usage"))
        mse = float(c[k < 0][0] / (usage[k < 0][0] * outputs))
        k, o, c, usage = k[k >= 0], o[k >= 0], c[k >= 0], usage[k >= 0]
        f, i = np.divmod(k, intervals.count)
        scale = 1.0
        if self.correction.freeze_after is not None:
            n = self.counts[f, i, o]
            scale = np.where(n >= self.correction.freeze_after, 0.0, 0.5 ** np.minimum(n, 1000))
        self.weights[f, i, o] += c / usage * scale
        self.counts[f, i, o] += usage
        return mse

    def fit(self, samples: DataFrame, epochs: int = 12, epoch_mode: str = "reference", batch: bool = False, **columns) -> list[float]:
        """Several epochs; the mean squared error before each."""
        if batch:
            return [self.train_epoch_batch(samples, **{k: v for k, v in columns.items() if k != "order"}) for _ in range(epochs)]
        prepared = self.prepare(samples, **columns, epoch_mode=epoch_mode).persist()
        try:
            return [self.train_epoch(prepared, epoch_mode) for _ in range(epochs)]
        finally:
            prepared.unpersist()

    # the model as data

    def weights_frame(self, spark: SparkSession) -> DataFrame:
        """(feature, interval, output, weight, access_count)."""
        f, d, n = np.indices(self.weights.shape).reshape(3, -1)
        table = pa.table({"feature": f, "interval": d, "output": n, "weight": self.weights.ravel(), "access_count": self.counts.ravel()})
        return spark.createDataFrame(table)

    def memory_bytes(self) -> int:
        """12 bytes for each weight and its count."""
        return 12 * self.weights.size

    def weight(self, feature: int, interval: int, output: int) -> float | None:
        """One weight, None out of range."""
        inside = all(0 <= i < n for i, n in zip((feature, interval, output), self.weights.shape))
        return float(self.weights[feature, interval, output]) if inside else None

    def access_count(self, feature: int, interval: int, output: int) -> int | None:
        return None if self.weight(feature, interval, output) is None else int(self.counts[feature, interval, output])

    def save(self, spark: SparkSession, path: str, **meta) -> None:
        """Weights as Parquet, all else as one row of JSON."""
        i = self.intervals
        info = {"version": 1, "kind": "interval", "outputs": self.outputs, "count": i.count, "low": i.low, "high": i.high, "edges": i.edges, "distributor": vars(i.distributor), "correction": vars(self.correction), "meta": meta}
        self.weights_frame(spark).write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/info")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IntervalModel:
        """The saved model; raises on another version or a wrong number of weights."""
        info = json.loads("".join(r[0] for r in spark.read.text(f"{path}/info").collect()))
        if info["version"] != 1 or info["kind"] != "interval":
            raise ConfigError(f"not an interval model of version 1: {info['kind']} {info['version']}")
        edges = info["edges"] and tuple(map(tuple, info["edges"]))
        intervals = Intervals(info["count"], tuple(info["low"]), tuple(info["high"]), edges, Distributor(**info["distributor"]))
        table = spark.read.parquet(f"{path}/weights").orderBy("feature", "interval", "output").toArrow()
        shape = (intervals.features, intervals.count, info["outputs"])
        if table.num_rows != np.prod(shape):
            raise DimensionError(f"{table.num_rows} weights, expected {np.prod(shape)}")
        get = lambda c: table.column(c).to_numpy().reshape(shape).copy()
        return cls(intervals, info["outputs"], get("weight"), get("access_count"), Correction(**info["correction"]))


def _fill(cells: np.ndarray, x: np.ndarray, intervals: Intervals) -> np.ndarray:
    """The dense activations of samples, in a buffer; entries of one place are summed. Few samples are encoded at once, so that what that takes stays in the cache."""
    a = cells[: len(x)]
    a[:] = 0.0
    flat, feature = a.reshape(-1), np.arange(intervals.features) * intervals.count
    plain = intervals.distributor.kind == "triangular" and intervals.edges is None and intervals.count > 1
    some = max(1, CACHED // max(intervals.features, 1))
    for begin in range(0, len(x), some):
        part = x[begin : begin + some]
        first = (np.arange(begin, begin + len(part)) * a.shape[1])[:, None] + feature
        if plain:
            left, c, right, d = triangular_array(part, intervals)
            left += first
            right += first
            flat[left.ravel()] = c.ravel()
            flat[right.ravel()] += d.ravel()
        else:
            at, c, valid = encode_array(part, intervals)
            for j in range(at.shape[2]):  # a place of the encoding has each column once
                flat[(first + at[:, :, j]).ravel()] += (c[:, :, j] * valid[:, :, j]).ravel()
    return a


def _blocks_of(intervals: Intervals, proportional: bool):
    """Turns samples in order into blocks, each with the inverse of its triangular matrix.

    The errors e of a block, under the weights w before it, are such that
    e_i + sum over j < i of <a_i, a_j> e_j / d_j = t_i - <a_i, w>, with d what
    a step divides its error by.
    """
    size = max(1, min(BLOCK_SAMPLES, BLOCK_CELLS // (intervals.features * intervals.count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, labels = TaskContext.get().partitionId() << 32, [], []

        def block() -> pa.RecordBatch:
            nonlocal number, held, labels
            x = np.concatenate(held)
            at, c, valid = encode_array(x, intervals)
            a = _fill(np.empty((len(x), intervals.features * intervals.count)), x, intervals)
            den = np.maximum(valid.sum(axis=(1, 2)), 1.0) if proportional else np.maximum((c * c * valid).sum(axis=(1, 2)), EPSILON)
            inverse = np.linalg.inv(np.eye(len(x)) + np.tril(a @ a.T, -1) / den[None, :])
            usage = np.bincount((np.arange(intervals.features)[None, :, None] * intervals.count + at)[valid], minlength=a.shape[1])
            raw = [np.concatenate(labels).astype(np.int64), x, den.astype(float), np.tril(inverse), usage.astype(np.int64)]
            out = pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in raw), pa.array([proportional])], names=_BLOCK_NAMES)
            number, held, labels = number + 1, [], []
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = as_matrix(batch.column("x")), batch.column("label").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(x):
                take = min(size - sum(map(len, held)), len(x) - at)
                held.append(x[at : at + take])
                labels.append(own[at : at + take])
                at += take
                if sum(map(len, held)) == size:
                    yield block()
        if held:
            yield block()

    return run


def _emit(part: int, own: np.ndarray, w: np.ndarray, n: np.ndarray, squares: float, count: int) -> pa.RecordBatch:
    raw = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (w, n)]
    return pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([own.tolist()], pa.list_(pa.int32())), *raw, pa.array([squares]), pa.array([count], pa.int64())], names=["part", "outputs", "weights", "counts", "squares", "n"])


def activation_array(x: np.ndarray, intervals: Intervals) -> np.ndarray:
    """Dense (samples, features * count) matrix; entries of one place are summed."""
    return _fill(np.empty((len(x), intervals.features * intervals.count)), x, intervals)


def forward_array(x: np.ndarray, weights: np.ndarray, intervals: Intervals) -> np.ndarray:
    """Outputs of samples, each summed over the features by itself, whatever samples it comes with."""
    out, feature = np.zeros((len(x), weights.shape[2])), np.arange(intervals.features)[None, :]
    some = max(1, CACHED // max(intervals.features, 1))
    for begin in range(0, len(x), some):
        at, c, valid = encode_array(x[begin : begin + some], intervals)
        for j in range(at.shape[2]):
            out[begin : begin + some] += (weights[feature, at[:, :, j]] * (c[:, :, j] * valid[:, :, j])[:, :, None]).sum(axis=1)
    return out


def learning_curve(model: IntervalModel, train: DataFrame, test: DataFrame, epochs: int, target_mse: float | None = None, label: str = "label", order: str = "ord", vector: str = "features") -> list[dict]:
    """Per epoch: errors before and after, accuracies; stops once the error after is at most ``target_mse``."""
    prepared, rows = model.prepare(train, label, order, vector).persist(), []
    try:
        for epoch in range(1, epochs + 1):
            before = model.train_epoch(prepared)
            after = model.mean_mse(train, label, vector)
            rows.append({"epoch": epoch, "mean_mse_before": before, "mean_mse_after": after, "train_accuracy": model.accuracy(train, label, vector), "test_accuracy": model.accuracy(test, label, vector)})
            if target_mse is not None and after <= target_mse:
                break
    finally:
        prepared.unpersist()
    return rows


def relational_forward(activation_rows: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, output, score) from a long activation matrix and weights (k, output, weight), as a join and a sum."""
    joined = activation_rows.join(weights, "k")
    return joined.groupBy(key, "output").agg(F.sum(F.col("a") * F.col("weight")).alias("score"))


def predict_scores(scores: Column) -> Column:
    return argmax_last(scores)
