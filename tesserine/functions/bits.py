"""Columns over packed bit vectors: array<bigint>, bit i in word i / 64 at place i % 64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import safe_div

BLOCKS = 16
ALL_BLOCKS = (1 << BLOCKS) - 1


def pack(values: Column, threshold: float) -> Column:
    """Words of the bits v >= threshold."""
    words = F.greatest(F.ceil(F.size(values) / 64).cast("int"), F.lit(0))
    bit = lambda v, i: F.when(v >= threshold, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(
        F.transform(F.slice(values, w * 64 + 1, 64), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)
    )
    return F.when(words > 0, F.transform(F.sequence(F.lit(0), words - 1), word)).otherwise(F.array().cast("array<bigint>"))


def count_bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def _masked(words: Column, mask: list[int] | None) -> Column:
    if mask is None:
        return words
    return F.zip_with(words, F.array(*(F.lit(m).cast("long") for m in mask)), lambda w, m: w.bitwiseAND(m))


def bit_hamming(a: Column, b: Column, length: int | Column, mask: list[int] | None = None) -> Column:
    """Share of equal bits among those compared; 0 where none are."""
    chosen = F.lit(sum(m.bit_count() if m >= 0 else (m + 2**64).bit_count() for m in mask)) if mask is not None else (F.lit(length) if isinstance(length, int) else length)
    differ = count_bits(_masked(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), mask))
    return F.when(chosen > 0, 1.0 - differ / F.when(chosen > 0, chosen).otherwise(1)).otherwise(F.lit(0.0))


def bit_jaccard(a: Column, b: Column, mask: list[int] | None = None) -> Column:
    """Shared set bits over all set bits; 1 for an empty union."""
    both = count_bits(_masked(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), mask))
    either = count_bits(_masked(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)), mask))
    return safe_div(both.cast("double"), either.cast("double"), 1.0)


def blended(a: Column, b: Column, length: int, weight: float, mask: list[int] | None = None) -> Column:
    """Hamming * (1 - weight) + Jaccard * weight."""
    return bit_hamming(a, b, length, mask) * (1.0 - weight) + bit_jaccard(a, b, mask) * weight


def get_bit(words: Column, i: Column) -> Column:
    """Bit i, false out of range."""
    word = F.get(words, (i / 64).cast("int"))
    return F.coalesce(word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))) != 0, F.lit(False))


def bit_contributions(a: Column, b: Column, length: int) -> Column:
    """1.0 where both bits are set, 0.5 where neither is, else 0."""
    pick = lambda i: F.when(get_bit(a, i) & get_bit(b, i), 1.0).when(~get_bit(a, i) & ~get_bit(b, i), 0.5).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), pick)


def normal_blocks(mask: int) -> int:
    """The 16 block bits of a mask; none set means all."""
    return mask & ALL_BLOCKS or ALL_BLOCKS


def block_mask_words(length: int, blocks: int) -> list[int]:
    """Signed words with the bits of the chosen blocks; block b covers length*b/16 to length*(b+1)/16."""
    words = [0] * -(-length // 64)
    for b in range(BLOCKS):
        if normal_blocks(blocks) >> b & 1:
            for i in range(length * b // BLOCKS, length * (b + 1) // BLOCKS):
                words[i // 64] |= 1 << i % 64
    return [w - 2**64 if w >= 2**63 else w for w in words]


def format_blocks(mask: int) -> str:
    return f"0x{normal_blocks(mask):04x}"


def similarity_name(weight: float) -> str:
    """What a blend weight amounts to."""
    return "hamming" if weight <= 0.05 else "jaccard" if weight >= 0.95 else "hamming_jaccard_blend"
