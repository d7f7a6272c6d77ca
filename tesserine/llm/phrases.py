"""Phrase collocations, mined in partitions of pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import lower_ascii
from .store import materialize, plain_names, read_table
from .words import Words, text_bytes

#: Words of the longest phrase.
LONGEST = 5
SIDE = LONGEST - 1
#: Counters that tell how rare a word is: what is broadcast, at any size of the corpus.
COUNTERS = 1 << 20
#: Occurrences of pivots that are mined together on average, and a pivot's fragments are dealt out anew beyond.
LOAD = 500_000
#: Distinct fragments, and distinct words, of a language that a task holds before it sends them on; occurrences looked at at once.
HELD, HELD_WORDS, AT_ONCE = 300_000, 400_000, 1 << 17
#: Numbers in each 64-bit word of a key, of a fragment's words, of which a task holds less than 2^21.
IN_FRAGMENT = 3
#: Languages that a task holds at once.
LANGUAGES = 16
#: Ranks that are taken in each of so many parts of a language before they are taken in it.
PARTS = 64

ROUTED = "bucket bigint, salt int, salted boolean, lang string, words string, slots binary, counts binary"
MINED = "lang string, phrase string, f bigint"

#: By byte: 1 between words of a piece, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPLIT = r"[\x20\x09-\x0D.,;:!?]+"


def word_key(lang: bytes, word: bytes) -> int:
    """The number that a word's counter, and its place in the order of equally rare words, are read off; as ``xxhash64`` has it in Spark."""
    return xxhash.xxh64_intdigest(lang + b"\t" + word, 42)


def word_counts(docs: DataFrame, lang: str, text: str, least: int) -> DataFrame:
    """(lang, word, f) of the words found ``least`` times or more, and with a null word the sum of all others."""
    words = docs.select(F.col(lang).alias("lang"), F.explode(F.split(lower_ascii(F.col(text)), _SPLIT, -1)).alias("word")).where("word <> ''")
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))
    return counts.groupBy("lang", F.when(F.col("f") >= least, F.col("word")).alias("word")).agg(F.sum("f").alias("f"))


def rarity(counts: DataFrame) -> np.ndarray:
    """By counter, the occurrences of all frequent words that share it: COUNTERS numbers at most come to the driver."""
    key = F.xxhash64(F.concat("lang", F.lit("\t"), "word"))
    sums = counts.where("word IS NOT NULL").groupBy(F.pmod(key, F.lit(COUNTERS)).cast("int").alias("at")).agg(F.sum("f").alias("f")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[sums["at"].to_numpy()] = sums["f"].to_numpy()
    return out


class Tally(Words):
    """Sums by keys of three words."""

    def clear(self) -> None:
        super().clear()
        self.sums = np.zeros(1 << 12, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        found = self._find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            missing = keys[:, new]
            order = np.lexsort(missing)
            ordered = missing[:, order]
            first = np.ones(len(order), bool)
            first[1:] = (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)
            found[new[order]] = self._insert(ordered[:, first])[np.cumsum(first) - 1]
        if self.n > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros(max(self.n, 2 * len(self.sums)) - len(self.sums), np.int64)])
        np.add.at(self.sums, found, counts)


def packed(slots: np.ndarray, each: int) -> np.ndarray:
    """Keys of rows of numbers, ``each`` of which share a 64-bit word of the three."""
    out = np.zeros((3, len(slots)), np.uint64)
    for i in range(slots.shape[1]):
        out[i // each] |= slots[:, i].astype(np.uint64) << np.uint64(64 // each * (i % each))
    return out


def unpacked(keys: np.ndarray, each: int, width: int) -> np.ndarray:
    bits = 64 // each
    mask = np.uint64((1 << bits) - 1)
    return np.stack([(keys[i // each] >> np.uint64(bits * (i % each))) & mask for i in range(width)], axis=1).astype(np.int64)


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, lengths, numbers of pieces that rise) of the words of texts, A-Z lower-cased."""
    raw, ends = text_bytes(texts)
    raw = _LOWER[raw]
    size = int(ends[-1])
    kind = _KIND[raw[:size]]
    begins = np.zeros(size + 1, bool)
    begins[ends] = True
    inside = kind == 0
    after = np.zeros(size, bool)
    after[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~after | begins[:-1]))
    goes_on = np.zeros(size, bool)
    goes_on[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~goes_on | begins[1:])) + 1
    pieces = np.cumsum((kind == 2) | begins[:-1], dtype=np.int32)[starts]
    return raw, starts, stops - starts, pieces


class _Language:
    """What a task knows of a language's words, and the fragments that it holds."""

    def __init__(self, name: str, counters: np.ndarray, least: int, load: int, buckets: int):
        self.name, self.raw, self.counters, self.least, self.load, self.buckets = name, name.encode(), counters, least, load, buckets
        self.words, self.fragments = Words(), Tally()
        self.clear()

    def clear(self) -> None:
        self.words.clear()
        self.fragments.clear()
        self.known: list[bytes] = []
        self.rare = np.zeros(1 << 12, np.int64)  # by word: how often its counter was hit
        self.keys = np.zeros(1 << 12, np.uint64)

    def _learn(self, raw: np.ndarray):
        def learn(starts: np.ndarray, lengths: np.ndarray) -> None:
            view, first = memoryview(raw), len(self.known)
            self.known += [bytes(view[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist())]
            if len(self.known) > len(self.rare):
                more = max(len(self.known), 2 * len(self.rare)) - len(self.rare)
                self.rare, self.keys = np.concatenate([self.rare, np.zeros(more, np.int64)]), np.concatenate([self.keys, np.zeros(more, np.uint64)])
            keys = np.array([word_key(self.raw, w) for w in self.known[first:]], np.uint64)
            self.keys[first : len(self.known)] = keys
            self.rare[first : len(self.known)] = self.counters[(keys % np.uint64(len(self.counters))).astype(np.int64)]

        return learn

    def take(self, texts: pa.Array) -> Iterator[tuple]:
        """Hold the fragments of texts; gives rows to send whenever enough are held."""
        raw, starts, lengths, pieces = words_of(texts)
        for start in range(0, len(starts), AT_ONCE):
            stop = min(start + AT_ONCE, len(starts))
            a, b = max(0, start - SIDE), min(len(starts), stop + SIDE)
            numbers = self.words.numbers(raw, starts[a:b], lengths[a:b], self._learn(raw))
            self._fragments(numbers, pieces[a:b], start - a, stop - a)
            if self.fragments.n > HELD or self.words.n > HELD_WORDS or self.words.long_bytes > 8 << 20:
                yield from self.sent()

    def _fragments(self, numbers: np.ndarray, pieces: np.ndarray, start: int, stop: int) -> None:
        """Around every occurrence from start to stop, the words of its piece up to the first rarer one: n-grams beyond that are another pivot's.

        Rarer is what has a smaller counter, then key; of those that are the same in both, the first is the pivot.
        """
        no, piece = (np.pad(x, SIDE, constant_values=-1) for x in (numbers, pieces))
        rare, key = np.where(no < 0, -1, self.rare[no]), self.keys[no]
        pivots = np.arange(start, stop) + SIDE
        pivots = pivots[rare[pivots] >= self.least]
        slots = np.zeros((len(pivots), LONGEST + SIDE), np.int64)
        slots[:, SIDE] = no[pivots] + 1
        for side in (-1, 1):
            rows, own = np.arange(len(pivots)), pivots
            for step in range(1, SIDE + 1):
                at = own + side * step
                later = (key[at] > key[own]) | ((key[at] == key[own]) & (side > 0))
                more = (piece[at] == piece[own]) & ((rare[at] > rare[own]) | ((rare[at] == rare[own]) & later))
                rows, own = rows[more], own[more]
                slots[rows, SIDE + side * step] = no[at[more]] + 1
        slots = slots[(slots[:, SIDE - 1] > 0) | (slots[:, SIDE + 1] > 0)]
        if len(slots):
            self.fragments.add(packed(slots, IN_FRAGMENT), np.ones(len(slots), np.int64))

    def sent(self) -> Iterator[tuple]:
        """The fragments by the bucket, and salt, of their pivots, with the words that they are made of."""
        n = self.fragments.n
        if n:
            keys = self.fragments.keys[:, :n]
            slots, counts = unpacked(keys, IN_FRAGMENT, LONGEST + SIDE), self.fragments.sums[:n]
            pivots = slots[:, SIDE] - 1
            bucket = (self.keys[pivots] // np.uint64(len(self.counters)) % np.uint64(self.buckets)).astype(np.int64)
            salts = -(-self.rare[pivots] // self.load)
            mixed = np.zeros(n, np.uint64)  # of words, not of their numbers, so that equal fragments of all tasks have the same salt
            for i in range(slots.shape[1]):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.where(slots[:, i] > 0, self.keys[slots[:, i] - 1], np.uint64(1))
            salt = ((mixed >> np.uint64(33)) % salts.astype(np.uint64)).astype(np.int64)
            salt[salts == 1] = -1  # many pivots share a bucket; a salted one has its own
            bucket[salts > 1] = -1 - (self.keys[pivots[salts > 1]] >> np.uint64(1)).astype(np.int64)
            order = np.lexsort((salt, bucket))
            bucket, salt, slots, counts = bucket[order], salt[order], slots[order], counts[order]
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(salt) != 0)) + 1
            there, place = np.zeros(len(self.known) + 1, bool), np.zeros(len(self.known) + 1, np.int64)
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
                there[slots[x:y]] = True
                used = np.flatnonzero(there[1:]) + 1
                place[used] = np.arange(1, len(used) + 1)
                there[used] = False
                own = place[slots[x:y]]
                words = b" ".join(self.known[i - 1] for i in used.tolist())
                small = np.uint16 if len(used) < 1 << 16 else np.uint32
                yield int(bucket[x]), int(salt[x]), bool(salt[x] >= 0), self.name, words.decode(), own.astype(small).tobytes(), counts[x:y].tobytes()
        self.clear()


def _route(counters, least: int, load: int, buckets: int):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        names = ["bucket", "salt", "salted", "lang", "words", "slots", "counts"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def sent(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in found:
            rows.append(row)
            if len(rows) == 256:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, _Language] = {}
        for rows in batches:
            langs = rows.column(0).dictionary_encode()
            index = langs.indices.to_numpy()
            for i, name in enumerate(langs.dictionary.to_pylist()):
                if name not in languages:
                    if len(languages) >= LANGUAGES:  # those seen so far make room
                        for language in languages.values():
                            yield from sent(language.sent())
                        languages.clear()
                    languages[name] = _Language(name, counters.value, least, load, buckets)
                yield from sent(languages[name].take(rows.column(1).filter(pa.array(index == i))))
        for language in languages.values():
            yield from sent(language.sent())

    return route


def _fragments_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words by place, from 1 and 0 where there is none, of all fragments of rows; their counts; the words)."""
    words = pc.split_pattern(rows["words"], " ")
    numbered = pc.list_flatten(words).dictionary_encode().unify_dictionaries()
    numbers = np.concatenate([c.indices.to_numpy() for c in numbered.chunks]) + 1
    ends = np.cumsum(pc.list_value_length(words).to_numpy(), dtype=np.int64)
    ids, counts = [], []
    for begin, end, slots, n in zip([0, *ends[:-1].tolist()], ends.tolist(), rows["slots"], rows["counts"]):
        raw = slots.as_py()
        counts.append(np.frombuffer(n.as_py(), np.int64))
        places = np.frombuffer(raw, np.uint16 if len(raw) == 2 * (LONGEST + SIDE) * len(counts[-1]) else np.uint32)
        ids.append(np.append(np.int32(0), numbers[begin:end])[places].reshape(-1, LONGEST + SIDE))
    return np.concatenate(ids).T.copy(), np.concatenate(counts), numbered.chunk(0).dictionary


def _mine(least: int):
    """Counts, of the fragments of some pivots, the n-grams of two words or more that hold the pivot.

    An n-gram is looked at only in fragments whose n-grams of a word less
    are frequent, the one without its first word and the one without its last.
    """

    def mine(table: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64())], names=["lang", "phrase", "f"])]
        enough = 1 if table.num_rows and table["salted"][0].as_py() else least
        for lang in table["lang"].unique().to_pylist():
            ids, counts, words = _fragments_of(table.filter(pc.equal(table["lang"], lang)))
            shorter = {0: ids[SIDE].astype(np.int64)}  # by words left of the pivot, the number of each fragment's n-gram, -1 where it isn't frequent
            for more in range(1, LONGEST):
                grams: dict[int, np.ndarray] = {}
                for left in range(more + 1):
                    right = more - left
                    within, word = (shorter[left], ids[SIDE + right]) if right else (shorter[left - 1], ids[SIDE - left])
                    there = (within >= 0) & (word > 0)
                    if left and right:
                        there &= shorter[left - 1] >= 0
                    at = np.flatnonzero(there)
                    grams[left] = np.full(len(counts), -1, np.int64)
                    if not len(at):
                        continue
                    keys = within[at] * (len(words) + 1) + word[at]
                    order = np.argsort(keys)
                    keys, at = keys[order], at[order]
                    new = np.append(True, keys[1:] != keys[:-1])
                    first = np.flatnonzero(new)
                    sums = np.add.reduceat(counts[at], first)
                    often = sums >= enough
                    grams[left][at] = np.where(often, np.cumsum(often) - 1, -1)[np.cumsum(new) - 1]
                    found = ids[SIDE - left : SIDE + right + 1, at[first[often]]].T - 1
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * (more + 1)), words.take(pa.array(found.ravel())))
                    out.append(pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(found)), "phrase": pc.binary_join(lists, " ").cast(pa.string()), "f": sums[often]}))
                shorter = grams
        return pa.concat_tables(out).combine_chunks()

    return mine


def frequent_phrases(docs: DataFrame, least: int = 100, lang: str = "lang", text: str = "text", load: int = LOAD) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases of 1 to LONGEST words found ``least`` times or more, (lang, n) of all words), both stored.

    Each occurrence of a word sends, to the partition of that word as a
    pivot, the words around it up to the first rarer one; so every n-gram
    is counted in the partition of its rarest word only, its first such one
    if there are several. Equal fragments are brought together before they
    are shuffled, and the fragments of a pivot with more occurrences than
    ``load`` are dealt out over several tasks, whose counts are added up.

    How rare a word is comes from COUNTERS sums, which are broadcast; words
    that share one are told apart by a hash, so it only matters for the size
    of partitions. A word whose counter stays below ``least`` ends fragments.
    """
    plain, names = plain_names(docs)
    rows = plain.select(F.coalesce(F.col(names[lang]).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(names[text]), F.lit("")).alias("text"))
    counts = materialize(word_counts(rows, "lang", "text", least), "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.where("word IS NOT NULL")
    counters = rarity(counts)
    sent = docs.sparkSession.sparkContext.broadcast(counters)
    buckets = max(1, int(-(-counters.sum() // load)))
    routed = rows.where("text <> ''").mapInArrow(_route(sent, least, load, buckets), ROUTED)
    mined = routed.groupBy("bucket", "salt").applyInArrow(_mine(least), MINED)
    grams = mined.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    size = F.size(F.split("phrase", " ", -1))
    both = frequent.select("lang", F.col("word").alias("phrase"), "f").unionByName(grams)
    return materialize(both.select("lang", "phrase", size.alias("words"), "f"), "phrases"), totals


def _part(phrase: str, start: Column | int, n: Column | int) -> Column:
    as_int = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.array_join(F.slice(F.split(phrase, " ", -1), as_int(start), as_int(n)), " ")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, absorb: int = 100, scale: int = 1000, lang: str = "lang", text: str = "text", load: int = LOAD) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to LONGEST words that is found a >= ``least`` times scores
    floor(scale * a * n / (l * r)) at the cut, of all its cuts, where that
    is least (then the first), l and r being the counts of its two parts and
    n of all words. It is dropped if its words lie within a longer phrase
    found at least as often as ``absorb`` % of a, dropped or not. Ranks go
    by score, then a, both falling, then by the phrase's bytes.

    Everything is per language; a null one is ``und``, a null text empty.
    A-Z is lower-cased, and phrases don't cross punctuation or line ends.
    Rows that repeat count as often as they are there. An empty table has no
    phrases. Texts are read whole. Sums are in decimals of 38 digits, and an
    overflow of these is an error.
    """
    phrases, totals = frequent_phrases(docs, least, lang, text, load)
    longer = phrases.where("words > 2").select("lang", "f", "words", "phrase")
    inner = [F.struct(F.lit(i + 1).alias("at"), F.lit(n).alias("n")) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    within = longer.withColumn("x", F.explode(F.filter(F.array(*inner), lambda x: (x["n"] < F.col("words")) & (x["at"] + x["n"] - 1 <= F.col("words")))))
    within = within.select("lang", _part("phrase", F.col("x.at"), F.col("x.n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = phrases.where("words > 1").withColumnRenamed("f", "a").join(within, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(absorb).cast("decimal(20,0)") * F.col("a"))).drop("longer")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumns({"left": _part("phrase", 1, F.col("k")), "right": _part("phrase", F.col("k") + 1, F.col("words") - F.col("k"))})
    part = lambda of, f: phrases.select("lang", F.col("phrase").alias(of), F.col("f").alias(f))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    big = lambda x: f"CAST({x} AS DECIMAL(19, 0))"
    score = F.expr(f"{big(scale)} * {big('a')} * {big('n')} div ({big('l')} * {big('r')})")
    cut = cut.withColumn("score", F.coalesce(score, F.raise_error(F.lit("a score's product has more than 38 digits")).cast("long")))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    scored = best.select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    few = scored.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


OP12_SQL = r"""
WITH w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)
  GROUP BY ALL HAVING count(*) >= 100
), n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1
), inner_ AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[i:i + k - 1], ' ') AS part FROM (
      SELECT lang, a, ws, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM c WHERE m > 2)))
  GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN inner_ ON inner_.lang = c.lang AND part = phrase WHERE longer IS NULL OR longer < a
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lw, array_to_string(ws[k + 1:], ' ') AS rw FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)
), s AS (
  SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = lw JOIN f AS r ON r.lang = cut.lang AND r.phrase = rw JOIN n ON n.lang = cut.lang
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""
