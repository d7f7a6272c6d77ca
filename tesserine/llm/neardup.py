"""Near duplicates by bottom-k sketches."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .store import materialize, plain_names, read_table, scratch
from .words import give_back

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: The chance of missing a pair in a round of pruning.
MISS = 1e-9
#: Members of an inverted list in a block; 64-bit words of a parity sketch.
LIST_BLOCK, WORDS_OF_PARITY = 64, 16


@dataclass(frozen=True)
class Sketches:
    """Values that are retained of the sets of all texts, and of those that the rounds of pruning leave."""

    first: int = 32
    middle: int = 128
    last: int = 512


#: Nothing is left to chance: whole sets are their own sketches.
WHOLE = 2**31 - 1
EXACT = Sketches(WHOLE, WHOLE, WHOLE)

# --- shingle sets ---------------------------------------------------------------------------------

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_REMEMBERED = 50_000
_words: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes (as signed numbers) of the distinct five-word shingles of a whole text.

    With fewer words, the whole sequence is one shingle; without words, none.
    bytes.lower() and bytes.split() know ASCII letters and white space only.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(_words) > _REMEMBERED:
        _words.clear()
    try:
        hashes = [_words[w] for w in words]
    except KeyError:
        for w in words:
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        hashes = [_words[w] for w in words]
    h = np.array(hashes, np.uint64)
    n = max(1, len(h) - WORDS + 1)
    x = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(h))):
        x = _mixed(x + _MIX[2] + h[i : i + n])
    return np.unique(x.view(np.int64))


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of values falls on each of so many bits. Bits that differ between two sketches are at most the values that differ between their sets."""
    bits = 64 * WORDS_OF_PARITY
    at = (s.view(np.uint64) * _MIX[2]) >> np.uint64(64 - bits.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) % 2).astype(np.uint8)).view(np.int64)


_LONGS = T.ArrayType(T.LongType())
_SKETCH_TYPE = T.StructType().add("n", T.LongType()).add("digest", T.BinaryType()).add("sketch", _LONGS)


def _sketches(texts: pa.Array, k: int, parity: bool) -> pa.Array:
    fields = [("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))] + [("parity", pa.list_(pa.int64()))] * parity
    rows = []
    for t in texts:
        s = shingle_set(t.as_py())
        row = {"n": len(s), "digest": hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "sketch": s[:k].copy()}
        rows.append(row | {"parity": parity_sketch(s)} if parity else row)
    give_back()
    return pa.array(rows, pa.struct(fields))


def _sketch(text, k: int, parity: bool = False):
    """A column with the size, the digest and the k least values of a text's set, and its parity sketch if asked for."""

    @arrow_udf(T.StructType([*_SKETCH_TYPE.fields, T.StructField("parity", _LONGS)]) if parity else _SKETCH_TYPE)
    def sketch(texts: pa.Array) -> pa.Array:
        return _sketches(texts, k, parity)

    return sketch.asNondeterministic()(text)


@arrow_udf(T.ArrayType(T.LongType()))
def _full_set(texts: pa.Array) -> pa.Array:
    give_back()
    return pa.array([shingle_set(t.as_py()) for t in texts], pa.list_(pa.int64()))


@arrow_udf(T.BooleanType())
def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b):
        p, q = x.values.to_numpy(), y.values.to_numpy()
        both = len(np.intersect1d(p, q, assume_unique=True))
        out.append(100 * both >= PERCENT * (len(p) + len(q) - both))
    return pa.array(out, pa.bool_())


# --- bounds ---------------------------------------------------------------------------------------


@cache
def least_shared(k: int) -> int:
    """Of the k least values of a union with similarity PERCENT, so many are shared but for a chance of MISS."""
    p, q, chance, x = PERCENT, 100 - PERCENT, 0.0, 0
    while True:
        chance += comb(k, x) * p**x * q ** (k - x) / 100**k
        if chance > MISS:
            return x
        x += 1


def needed_overlap(n: str, k: int) -> str:
    """SQL for the values that the sketches of k of a set of n and of any linked set share. Exact where no union exceeds k."""
    return _bounded(n, k, f"({PERCENT} * {n} + 99) div 100")


def needed_by_smaller(n: str, k: int) -> str:
    """The same for linked sets that are at least as large: they share PERCENT / (100 + PERCENT) of both sizes."""
    return _bounded(n, k, f"({2 * PERCENT} * {n} + {99 + PERCENT}) div {100 + PERCENT}")


def _bounded(n: str, k: int, exact: str) -> str:
    return exact if k >= WHOLE else f"if(100 * {n} <= {PERCENT * k}, {exact}, least({exact}, {least_shared(k)}))"


# --- candidates -----------------------------------------------------------------------------------


def _survivors(nodes: DataFrame, k: int) -> DataFrame:
    """(node, n, shared): nodes whose k least values are shared often enough for a link, with the shared ones as (df, v) by rising frequency."""
    values = nodes.select("node", "n", F.explode(F.slice("sketch", 1, k)).alias("v"))
    df = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(df, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("shared"))
    return shared.where(f"size(shared) >= {needed_overlap('n', k)}")


def inverted_lists(nodes: DataFrame, k: Sketches = Sketches()) -> DataFrame:
    """(v, node, n, as_smaller): the retained values through which every linked pair meets.

    Two linked sets share at least o of the s retained values of either, so
    they meet in the s - o + 1 least frequent. o is larger for the smaller
    of the two: so each pair is looked for among the values that its smaller
    set has ``as_smaller`` and its larger set has at all. Values that one
    node alone retains come first in the order and need no list; nodes that
    share fewer than o values with any others are gone. So a passage that
    many texts share takes part only where it makes up most of a text.
    """
    left = materialize(_survivors(nodes, k.middle).select("node", "n"), "survivors")
    last = materialize(_survivors(nodes.join(left, ["node", "n"], "left_semi"), k.last), "survivors")
    length = lambda o: f"int(least(n, {k.last}) - ({o}) + 1 - (least(n, {k.last}) - size(shared)))"
    cut = last.withColumns({"larger": F.expr(length(needed_overlap("n", k.last))), "smaller": F.expr(length(needed_by_smaller("n", k.last)))})
    lists = cut.where("larger > 0").select("node", "n", "smaller", F.posexplode(F.slice("shared", F.lit(1), F.col("larger"))).alias("at", "x"))
    lists = lists.groupBy(F.col("x.v").alias("v"), "node", "n").agg(F.max(F.col("at") < F.col("smaller")).alias("as_smaller"))
    return materialize(lists, "lists")


def _union_sketch_passes(a: str, b: str, k: int) -> str:
    """SQL: whether as many of the union's k least values are shared as a linked pair has."""
    union = f"slice(array_sort(array_union({a}, {b})), 1, {k})"
    shared = f"size(array_intersect(array_intersect({union}, {a}), {b}))"
    return f"{shared} >= {needed_overlap(f'size({union})', k)}"


def _estimated(pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) whose union's sketch lets a link be possible."""
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"))
    return pairs.join(at("a"), "a").join(at("b"), "b").where(_union_sketch_passes("sa", "sb", k)).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets are linked. Sets are made from the whole texts of the documents in question only."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(docs.join(need, docs["__id"] == need["node"], "left_semi").select("__id", _full_set.asNondeterministic()("__text").alias("set")), "sets")
    at = lambda c: sets.select(F.col("__id").alias(c), F.col("set").alias(f"s{c}"))
    return pairs.join(at("a"), "a").join(at("b"), "b").where(_linked("sa", "sb")).select("a", "b").distinct()


# --- components -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component, by alternating large-star and small-star steps.

    All neighbours are linked to the least one in each step; minima are taken
    before the shuffle and joins can be split, so stars of any size are dealt
    out. Each round is stored.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = materialize(large, "stars")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        edges = materialize(small.distinct(), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def _apart(lists: DataFrame, parts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) that meet in a list and could be linked, but are in different components so far.

    In each list, all but the members of its most frequent component are
    paired with all members; these are dealt out in blocks, so that neither
    a list nor a pairing has to fit in one task. The join itself drops pairs
    whose parity sketches differ in more bits than linked sets can.
    """
    member = lists.join(parts, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    of = member.groupBy("v", "c").agg(F.count(F.lit(1)).alias("size"))
    open_ = of.groupBy("v").agg(F.max_by("c", F.struct("size", "c")).alias("major"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = F.expr(f"int((size + {LIST_BLOCK - 1}) div {LIST_BLOCK})")
    words = [f"w{i}" for i in range(WORDS_OF_PARITY)]
    parity = sketches.select("node", *(F.col("parity")[i].alias(w) for i, w in enumerate(words)))
    member = materialize(member.join(open_.select("v", "major", blocks.alias("blocks")), "v").join(parity, "node"), "apart")
    named = lambda df, end: df.select("v", "block", *(F.col(c).alias(f"{c}_{end}") for c in ("node", "n", "c", "as_smaller", *words)))
    every = named(member.withColumn("block", F.expr("int(pmod(xxhash64(node), blocks))")), "b")
    minor = named(member.where("c <> major").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))), "a")
    possible = f"""c_a <> c_b and ((n_a <= n_b and as_smaller_a and 100 * n_a >= {PERCENT} * n_b)
        or (n_b <= n_a and as_smaller_b and 100 * n_b >= {PERCENT} * n_a))
        and {100 + PERCENT} * ({" + ".join(f"bit_count({w}_a ^ {w}_b)" for w in words)}) <= {100 - PERCENT} * (n_a + n_b)"""
    meet = minor.join(every, ["v", "block"]).where(possible)
    return meet.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: Sketches = Sketches()) -> DataFrame:
    """(__id, __n_shingles, __component) for every row of ``docs``.

    1. Each text becomes a set of shingle hashes and its k.first least values.
       Equal sets, by a 128-bit digest, are one node under the least id.
       Only nodes whose values are shared enough get sketches of k.last values.
    2. Inverted lists of retained values, only those that a linked pair must
       meet in (``inverted_lists``).
    3. Each member of a list is paired with the list's least node, the union's
       sketch filters, full sets verify, and components are formed.
    4. In lists whose members are not all in one component yet, the pairs
       that are still apart go through the same filter and check. So every
       pair that meets is either linked through others or checked itself,
       without all pairs within a group of copies.

    A linked pair of sets too large for the sketches is missed with a chance
    of a few MISS at most, and with ``EXACT``, which retains whole sets, never;
    links themselves are confirmed on full sets. Null and empty texts have no
    shingles and are alone. Rows that share an id count as one document; a
    row with a null id is alone, with a null component. An empty table stays
    empty; texts of any length count whole. What is stored on the way goes at the end.
    """
    with scratch(docs.sparkSession):
        slim = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
        seen = slim.select("__id", _sketch("__text", k.first).alias("s")).select("__id", "s.*")
        seen = materialize(seen, "sketches")
        full = seen.where("__id is not null and n > 0")
        nodes = full.groupBy("digest").agg(F.min(F.struct("__id", "n", "sketch")).alias("x"))
        nodes = materialize(nodes.select(F.col("x.__id").alias("node"), "x.n", "x.sketch", "digest"), "nodes")
        left = materialize(nodes.join(_survivors(nodes, k.first).select("node", "n"), ["node", "n"], "left_semi").select("node", "digest"), "survivors")
        again = slim.join(left, slim["__id"] == left["node"], "left_semi").select("__id", _sketch("__text", k.last, True).alias("s"))
        again = again.select(F.col("__id").alias("node"), "s.*").join(left, ["node", "digest"], "left_semi").dropDuplicates(["node", "digest"])
        sketches = materialize(again.select("node", "n", "sketch", "parity"), "sketches")
        lists = inverted_lists(sketches, k)

        pivots = lists.groupBy("v").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
        stars = lists.join(pivots, "v").where("node <> a").select("a", F.col("node").alias("b")).distinct()
        edges = materialize(_verified(materialize(_estimated(stars, sketches, k.last), "pairs"), slim), "edges")
        parts = materialize(components(edges), "parts")

        apart = materialize(_estimated(_apart(lists, parts, sketches), sketches, k.last), "pairs")
        edges = edges.union(_verified(apart, slim))
        same_id = full.groupBy("__id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("__id")
        copies = nodes.select("digest", "node")
        versions = full.join(same_id, "__id", "left_semi").join(copies, "digest").select(F.col("__id").alias("a"), F.col("node").alias("b"))
        parts = materialize(components(edges.union(versions)), "parts")

        of = nodes.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("c"))
        rows = seen.select("__id", "n", "digest").join(of, "digest", "left")
        part = F.when(F.col("__id").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("c")).otherwise(F.col("__id"))
        return materialize(rows.select("__id", F.col("n").alias("__n_shingles"), part.alias("__component")), "components", outlive=True)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, that with the least id, with the columns they came with, of any names.

    Rows that share that id all stay, as do rows with a null id, and null and
    empty texts, which are in no group. An empty table stays empty.
    """
    plain, names = plain_names(docs)
    with scratch(docs.sparkSession):
        gone = near_duplicates(docs, doc_id, text).where("__component <> __id").select("__id").distinct()
        gone = materialize(gone, "gone", outlive=True)
    return plain.join(gone, F.col(names[doc_id]) == F.col("__id"), "left_anti").toDF(*docs.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set, component and verdict of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("__id").alias("doc_id"),
        F.col("__n_shingles").alias("n_shingles"),
        F.col("__component").alias("component_id"),
        F.coalesce(F.col("__id") == F.col("__component"), F.lit(True)).alias("kept"),
    )


#: All pairs that share a shingle, and what they reach; for tables that bear it.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w
), n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM n JOIN r USING (doc_id) GROUP BY doc_id, n
"""
