"""Best-fit packing of token pieces under several capacities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bpe import token_pieces
from .ranks import bucket_count, exact_rank
from .store import materialize, read_table


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold: tokens, documents, and attention cost (the sum of squared lengths)."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.cost], dtype=np.int64)


def plan_packing(
    lengths: np.ndarray, counts: np.ndarray, capacity: Capacity = Capacity(), score: str = "residual", weights: tuple[float, ...] = (1.0, 1e-3, 1e-3)
) -> np.ndarray:
    """Place ``counts`` pieces of each length, longest first, into bins; alike bins are handled together.

    A bin's state is its residual vector. Of all groups of bins with the same
    history that have room in every dimension, the next pieces of a length go
    to the one with the least weighted norm of what would be left
    (``residual``) or the greatest weighted dot product of the piece with
    what is free (``dot``); the oldest on ties. Each of its bins takes as
    many as fit. A length splits at most one group and opens one kind of new
    bins, so the number of groups and of placements depends on the number of
    lengths, not on the number of pieces.

    Returns rows (length, first rank, pieces, first bin, pieces per bin, offset in the bin).
    """
    full = capacity.vector()
    scale = np.sqrt(np.array(weights)) / full
    first, size = np.empty(0, np.int64), np.empty(0, np.int64)
    left = np.empty((0, 3), np.int64)
    bins, out = 0, []
    for length, count in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        item = np.array([length, 1, length * length], dtype=np.int64)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        rank, skip = 0, np.zeros(len(first), bool)
        while rank < count:
            fits = (left >= item).all(axis=1) & ~skip
            if fits.any():
                at = np.flatnonzero(fits)
                if score == "dot":
                    value = -((left[at] * scale) @ (item * scale))
                else:
                    value = (((left[at] - item) * scale) ** 2).sum(axis=1)
                g = int(at[np.argmin(value)])
            else:
                g = len(first)
                per = int((full // item).min())
                need = -(-(count - rank) // per)
                first, size = np.append(first, bins), np.append(size, need)
                left, skip = np.vstack([left, full]), np.append(skip, False)
                bins += need
            per = int((left[g] // item).min())
            placed = min(count - rank, per * int(size[g]))
            whole, rest = divmod(placed, per)
            out.append((length, rank, placed, int(first[g]), per, capacity.tokens - int(left[g, 0])))
            parts = [(int(first[g]), whole, left[g] - per * item, True)]
            if rest:
                parts.append((int(first[g]) + whole, 1, left[g] - rest * item, False))
            parts.append((int(first[g]) + whole + bool(rest), int(size[g]) - whole - bool(rest), left[g].copy(), False))
            parts = [p for p in parts if p[1]]
            first[g], size[g], left[g], skip[g] = parts[0]
            for a, n, v, s in parts[1:]:
                first, size, left, skip = np.append(first, a), np.append(size, n), np.vstack([left, v]), np.append(skip, s)
            rank += placed
        open_ = (left[:, 0] > 0) & (left[:, 1] > 0) & (left[:, 2] > 0)
        first, size, left = first[open_], size[open_], left[open_]
    return np.array(out, dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), order: tuple[str, ...] = ("doc_id", "piece"), **options) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (both long) to pieces with a ``length`` of 1 to the capacity's tokens.

    Only the histogram of lengths, as many rows as there are lengths, comes
    to the driver; the plan made from it says which ranks of each length go
    where, and each piece finds its place from its rank within its length.
    ``pieces`` should be a stored table: it is read three times. Pieces that
    repeat are placed one by one; an empty table stays empty.
    """
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    lengths, counts = (np.array([r[c] for r in histogram], dtype=np.int64) for c in ("length", "n"))
    plan = plan_packing(lengths, counts, capacity, **options)
    buckets = bucket_count(int(counts.sum()))
    keyed = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    ties = [*order, *(c for c in pieces.columns if c not in order)]
    ranked = exact_rank(keyed, ["length"], "__bucket", ties, "__rank").drop("__bucket")
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    span = int(plan[:, 2].max(initial=1)) + int(plan[:, 1].max(initial=0)) + 1
    if (capacity.tokens + 1) * span >= 2**62:
        raise ValueError("too many pieces of one length")
    keys = plan[:, 0] * span + plan[:, 1]

    @arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        own = plan[np.searchsorted(keys, n * span + r, side="right") - 1]
        into, nth = np.divmod(r - own[:, 1], own[:, 4])
        return pa.StructArray.from_arrays([pa.array(own[:, 3] + into), pa.array(own[:, 5] + nth * n)], names=["sequence_id", "offset"])

    placed = ranked.withColumn("__at", place("length", "__rank"))
    return placed.select(*pieces.columns, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), end_id: int = 0, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece of each document's whole text, with its sequence and its place there; null and empty texts are one token."""
    cut = docs.select(F.col(key).alias("doc_id"), token_pieces(F.col(text), capacity.tokens, end_id, path).alias("__p"))
    pieces = cut.select("doc_id", F.explode("__p").alias("__p")).select("doc_id", "__p.piece", "__p.start", "__p.length", "__p.ids_crc32")
    return pack(materialize(pieces, "pieces"), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens. The two other capacities are as wide as the tokens allow, so that as few sequences as possible are used."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
