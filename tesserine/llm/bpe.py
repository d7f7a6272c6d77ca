"""Token ids of whole texts in Arrow functions, through a memory of the pieces between safe cuts.

The pre-tokenizer never joins a non-space character with white space that
follows it, and looks ahead only past white space. So where a single space
or line feed stands between characters that aren't white space, the ids of
a text are those of what is before it and of the rest. Texts are cut at all
such places; each distinct piece is encoded once and remembered. Batches
are of so many bytes; cutting, finding pieces and putting ids together are
done for a whole batch at once (``words``).

New pieces go to the library, many in one string. Those of Latin-1
characters go through an encoder that works by ranks, made from the same
file, which takes a third of the time. It is used only if the file's merges
make up its ids in order, so that a token's id is its rank, and not for
strings of special tokens.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .store import read_table
from .words import Words, give_back, last_bytes, ragged, text_bytes, white_space

#: Pieces, and bytes of the longer ones, that a worker remembers; bytes of the texts in a batch, and of the new pieces in a string for the library.
REMEMBERED, REMEMBERED_BYTES, BATCH_BYTES, STRING_BYTES = 300_000, 1 << 24, 1 << 19, 1 << 14
#: Batches after which freed memory goes back to the system.
GIVE_BACK = 4
#: Fixed value: the pattern of the pre-tokenizer, byte-level without an added space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that is too long for the encoder by ranks.
LONG_SPACE = re.compile(r"\s{1000}")
SPACE, LINE_FEED, BEYOND_LATIN = 32, 10, 0xC4


def rank_encoder(path: str):
    """(encoder of ordinary text by the ranks of the file's vocabulary, strings of special tokens, vocabulary); None for the encoder if ids aren't the order of the merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, special = file["model"], [t["content"] for t in file.get("added_tokens", ())]
    vocabulary = model["vocab"]
    merges = (m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ()))
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None, special, vocabulary
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(model["merges"])}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special, vocabulary


def safe_cuts(raw: np.ndarray, white: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of pieces by text, starts, lengths): all texts cut before each single space or line feed between characters that aren't white space."""
    total = int(ends[-1])
    last, edge = last_bytes(white, raw), np.zeros(total + 1, bool)
    edge[ends] = True
    at = np.flatnonzero((raw[:total] == SPACE) | (raw[:total] == LINE_FEED))
    at = at[~edge[at] & ~edge[at + 1]]
    at = at[~last[at - 1] & ~white[at + 1]]
    places = np.searchsorted(at, ends)
    counts = np.diff(places) + 1
    heads = np.cumsum(counts) - counts
    starts, stops = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
    head, tail = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    head[heads], tail[heads + counts - 1] = True, True
    starts[head], starts[~head] = ends[:-1], at
    stops[tail], stops[~tail] = ends[1:], at
    return counts, starts, stops - starts


class Pool:
    """Runs of ids, each with a number, one after the other in one array; or only their lengths."""

    def __init__(self, lengths_only: bool = False):
        self.lengths_only = lengths_only
        self.ids, self.starts, self.lengths, self.uses = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.n = self.used = 0

    def _room(self, name: str, most: int) -> None:
        old = getattr(self, name)
        if most > len(old):
            new = np.zeros(max(most, 2 * len(old), 1 << 12), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New runs, given one after the other; their numbers come next."""
        first, n = self.n, self.n + len(lengths)
        for name in ("starts", "lengths", "uses"):
            self._room(name, n)
        self.lengths[first:n], self.uses[first:n] = lengths, 0
        if not self.lengths_only:
            self._room("ids", self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[first:n] = self.used + np.cumsum(lengths) - lengths
        self.n, self.used = n, self.used + len(ids)

    def at(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of runs, one run after the other."""
        return self.ids[ragged(self.starts[numbers], lengths)]

    def keep(self, picked: np.ndarray) -> None:
        """Only the picked runs stay, with new numbers in their order."""
        lengths = self.lengths[picked]
        ids = np.empty(0, "<u4") if self.lengths_only else self.at(picked, lengths)
        self.n = self.used = 0
        self.add(ids, lengths)


class Encoder:
    """Encodes texts with a tokenizer file whose pre-tokenizer keeps the rule above (byte-level BPE)."""

    _known: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, lengths_only: bool = False):
        self.path, self.library = path, None
        self.ranked, self.special, vocabulary = rank_encoder(path)
        self.opens = np.zeros(max([*vocabulary.values(), 0]) + 1 + len(self.special), bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] in "ĠĊ"]] = True  # these stand for a space and a line feed
        self.words, self.pool, self.batches = Words(), Pool(lengths_only), 0

    @classmethod
    def at(cls, path: str, lengths_only: bool = False) -> Encoder:
        """One for each worker and file."""
        if (path, lengths_only) not in cls._known:
            cls._known[path, lengths_only] = cls(path, lengths_only)
        return cls._known[path, lengths_only]

    @property
    def tokenizer(self):
        """The library's, loaded when it is first needed."""
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
            if resize := getattr(self.library.model, "_resize_cache", None):
                resize(0)  # what recurs is remembered here
        return self.library

    def _shrink(self) -> None:
        """Of too many pieces only those stay that were used again, or none if these are too many too."""
        if self.words.n <= REMEMBERED and self.words.long_bytes <= REMEMBERED_BYTES:
            return
        picked = np.flatnonzero(self.pool.uses[: self.pool.n] > 1)
        if 2 * len(picked) > REMEMBERED:
            picked = picked[:0]
        self.words.keep(picked)
        self.pool.keep(picked)
        if 2 * self.words.long_bytes > REMEMBERED_BYTES:
            self.words.keep(picked[:0])
            self.pool.keep(picked[:0])

    def _strings(self, strings: list[str], latin: bool) -> list[np.ndarray]:
        """The ids of strings."""
        by_rank = [latin and self.ranked is not None and not LONG_SPACE.search(s) and not any(x in s for x in self.special) for s in strings]
        others = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if (rest := [s for s, r in zip(strings, by_rank) if not r]) else ())
        return [self.ranked.encode_to_numpy(s, disallowed_special=()) if r else np.array(next(others).ids, "<u4") for s, r in zip(strings, by_rank)]

    def _joined(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, latin: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by piece) of pieces with white space at their start and nowhere else: many make one string, in which it shows where each begins."""
        data, ends = raw[ragged(starts, lengths)].tobytes(), np.cumsum(lengths)
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(STRING_BYTES, ends[-1], STRING_BYTES)), len(ends)])
        at = np.concatenate([[0], ends])[cuts]
        found = self._strings([data[a:b].decode() for a, b in zip(at, at[1:])], latin)
        sizes = []
        for ids, n in zip(found, np.diff(cuts)):
            opens = np.flatnonzero(self.opens[ids])
            if len(opens) != n or opens[0]:
                raise ValueError("this tokenizer doesn't keep pieces apart at white space")
            sizes.append(np.diff(opens, append=len(ids)))
        return np.concatenate(found).astype("<u4", copy=False), np.concatenate(sizes)

    def _learner(self, raw: np.ndarray, white_start: np.ndarray):
        """What ``Words.numbers`` calls with the new pieces."""
        sums: list[np.ndarray] = []

        def learn(starts: np.ndarray, lengths: np.ndarray) -> None:
            if not sums:
                for x in (white_start, raw >= BEYOND_LATIN):
                    sums.append(np.zeros(len(raw) + 1, np.int32))
                    np.cumsum(x, out=sums[-1][1 : len(x) + 1])
            white, beyond = (x[starts + lengths] - x[starts] for x in sums)
            joins = (white == 1) & ((raw[starts] == SPACE) | (raw[starts] == LINE_FEED)) & (lengths > 1)
            found, sizes = [], np.zeros(len(starts), np.int64)
            order = []
            for latin in (True, False):
                same = (beyond == 0) == latin
                own = np.flatnonzero(joins & same)
                if len(own):
                    ids, n = self._joined(raw, starts[own], lengths[own], latin)
                    found.append(ids)
                    sizes[own] = n
                    order.append(own)
                own = np.flatnonzero(~joins & same)
                if len(own):
                    ids = self._strings([bytes(raw[a : a + n]).decode() for a, n in zip(starts[own], lengths[own])], latin)
                    found.extend(ids)
                    sizes[own] = [len(x) for x in ids]
                    order.append(own)
            order = np.concatenate(order)
            by_group = sizes[order]
            at = np.empty(len(starts), np.int64)
            at[order] = np.cumsum(by_group) - by_group
            self.pool.add(np.concatenate(found)[ragged(at, sizes)], sizes)

        return learn

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each batch of texts in their order: (number of ids by text, numbers of runs, their lengths). A null text is empty; ``pool.at`` gives the ids."""
        raw, ends = text_bytes(texts)
        begin = 0
        while begin < len(ends) - 1:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + BATCH_BYTES, side="right")) - 1)
            self.batches += 1
            if self.batches % GIVE_BACK == 0:
                give_back()
            self._shrink()
            own = np.zeros(ends[end] - ends[begin] + 32, np.uint8)
            own[:-32] = raw[ends[begin] : ends[end]]
            white = white_space(own[:-32])
            counts, starts, lengths = safe_cuts(own, white, ends[begin : end + 1] - ends[begin])
            numbers = self.words.numbers(own, starts, lengths, self._learner(own, white))
            self.pool.uses[: self.pool.n] += np.bincount(numbers, minlength=self.pool.n)
            sizes = self.pool.lengths[numbers]
            yield np.add.reduceat(sizes, np.cumsum(counts) - counts), numbers, sizes
            begin = end

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        found = [n for n, _, _ in self.encode(texts)]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        for counts, numbers, sizes in self.encode(pa.array([*texts], pa.string())):
            raw, ends = self.pool.at(numbers, sizes).tobytes(), 4 * np.cumsum(counts)
            yield from (raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_count(text, path: str | None = None):
    """A column with the number of tokens of a text column; only lengths leave Python.

    Null and empty texts have none. Texts of any length are encoded whole, cut
    at safe places; a text without such a place is one piece. Rows that
    repeat are counted alike, and an empty table stays empty. ``path``: of a
    file that every worker has; unset: the default's there.
    """

    @arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(Encoder.at(path or default_path(), lengths_only=True).counts(texts), pa.int64())

    return count.asNondeterministic()(text)


PIECES = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(text, most: int, end_id: int, path: str | None = None):
    """A column with the pieces of at most ``most`` ids of each text, ``end_id`` put after its ids.

    A longer document has only full pieces but for the first. Of the ids
    themselves only a checksum leaves Python. Null and empty texts have one
    piece with the end alone; texts of any length are encoded whole.
    """

    @arrow_udf("array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>")
    def pieces(texts: pa.Array) -> pa.Array:
        encoder, last = Encoder.at(path or default_path()), array("I", [end_id]).tobytes()
        per_text, columns = [np.empty(0, np.int64)], [(np.empty(0, np.int64),) * 4]
        for counts, numbers, lengths in encoder.encode(texts):
            raw = memoryview(encoder.pool.at(numbers, lengths)).cast("B")
            n = (counts // most) + 1
            piece = ragged(np.zeros(len(n), np.int64), n)
            size, short = np.repeat(counts + 1, n), np.repeat(counts + 1 - (n - 1) * most, n)
            start = np.where(piece > 0, short + (piece - 1) * most, 0)
            length = np.where(piece > 0, most, short)
            at = np.repeat(np.cumsum(counts) - counts, n) + start
            ends = start + length == size
            sums = [zlib.crc32(last, zlib.crc32(raw[4 * a : 4 * (a + k - 1)])) if e else zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k, e in zip(at.tolist(), length.tolist(), ends.tolist())]
            per_text.append(n)
            columns.append((piece, start, length, np.array(sums, np.int64)))
        arrays = [pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*columns), PIECES)]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(per_text))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, fields=[*PIECES]))

    return pieces.asNondeterministic()(text)  # so that it is run once, where it stands


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document's whole text; a null or empty text has none. Rows that repeat are counted one by one."""
    docs = read_table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    counted = docs.select("doc_id", size.alias("n_bytes"), token_count(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
