"""SentencePiece encoding and decoding as shortest paths of a composed transducer.

The model file is compiled into automata: a normaliser, whose arcs read a
rule's longest match, or one character, and write what it becomes (spaces
become a mark, one mark goes in front); a trie of pieces, whose arcs read
the characters of a piece and whose final states write its id at the weight
of its score; and arcs that read a character without a piece and write the
ids of its bytes, or the unknown piece. An input is composed with them, its
states being positions, and the path of least weight in the tropical
semiring is taken.

For a unigram model the weight of a piece is its score's negative, and the
shortest path over the whole text is the library's segmentation. For a
model of merges (BPE) no sum of scores gives it; but a segmentation is the
library's exactly if each two neighbours are its result for their joined
text. So a third automaton is composed, whose states are pieces and whose
arcs, from a piece to one that stays apart from it, have weight 0, all
others being missing. Every prefix of a text has one such path, so a state
of the composition is a position and the piece that leads to it.

Whether two pieces stay apart is read off the trees by which they are
merged: of the symbols at the border that exist at the same time, none may
merge before one of them is used up within its own piece. In a model of
merges no piece has a mark behind another character, so texts are cut
before each run of marks, and the shortest paths of all distinct new parts
of a batch are found at once, position by position, and remembered.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf

from .bpe import BATCH_BYTES, GIVE_BACK, REMEMBERED, REMEMBERED_BYTES, Pool, default_path
from .store import read_table
from .words import Table, Words, give_back, ragged, text_bytes

MARK = "▁"
#: Pairs of neighbours that a worker remembers; characters of the parts whose paths are found at once, and of the longest such part.
PAIRS, CELLS, LONG = 4_000_000, 1 << 20, 64
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: In place of a piece's id: none leads here, and one character without a piece does.
NONE, LONE = -1, -2
SPACE = 32
#: What a character without a piece costs below the least score.
PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, raw[at : at + size]
            at += size


class Rules:
    """The compiled rules of a normaliser: a double array over UTF-8 bytes, whose values are places of what is written instead."""

    def __init__(self, raw: bytes):
        size = struct.unpack_from("<I", raw)[0]
        self.units, self.written = struct.unpack_from(f"<{size // 4}I", raw, 4), raw[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """(what is written, bytes read) of the longest rule that matches at a place."""
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = offset(self.units[0]), None
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = self.units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= offset(unit)
            if unit & 256:
                found = self.units[node] & 0x7FFFFFFF, i + 1 - at
        return found and (self.written[found[0] : self.written.index(0, found[0])], found[1])


class Merges:
    """The third automaton, for a model of merges: which pieces stay apart as neighbours.

    Symbols are pieces and the characters within pieces that aren't pieces
    themselves. ``rank`` rises as merges come later, equal scores having equal
    ranks; single characters have -1. ``left`` and ``right`` are the symbols
    that a piece is made of last. Pieces that merging never makes are
    ``lost``; those whose tree isn't made in the order of ranks are ``odd``,
    and their pairs are merged in full.
    """

    def __init__(self, ids: dict[str, int], scores: dict[str, float], n: int):
        self.ids, self.scores, self.symbols = ids, scores, dict(ids)
        for c in sorted({c for t in ids for c in t}.difference(ids)):
            self.symbols[c] = n + len(self.symbols) - len(ids)
        order = {s: i for i, s in enumerate(sorted({*scores.values()}, reverse=True))}
        size = max([*self.symbols.values(), 0]) + 1
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, NONE), np.full(size, NONE)
        self.lost, self.odd = np.zeros(size, bool), np.zeros(size, bool)
        pairs = {}
        for text, i in ids.items():
            self.rank[i] = order[scores[text]] if len(text) > 1 else -1
        for text, i in ids.items():
            if len(text) > 1:
                ends, ranks = self.merged(text)
                if len(ends) > 1:
                    self.lost[i] = True
                elif ranks != sorted(ranks):
                    self.odd[i] = True
                for k in range(1, len(text)):
                    a, b = self.symbols.get(text[:k]), self.symbols.get(text[k:])
                    if a is not None and b is not None:
                        pairs[a << 32 | b] = self.rank[i]
        self.joined = Table([*pairs], [*pairs.values()]) if pairs else Table()
        self.known = Table()

    def merged(self, text: str, border: int | None = None) -> tuple[list[str], list[int]]:
        """(symbols left by merging, best score and then leftmost first; ranks in the order of merges). Ends early where a merge crosses the border. Notes what a whole piece is made of last."""
        symbols, scores, ranks = [*text], self.scores, []
        while len(symbols) > 1:
            merges = [(-scores[m], i) for i, m in enumerate(map("".join, zip(symbols, symbols[1:]))) if m in scores]
            if not merges:
                break
            _, i = min(merges)
            if border is not None and sum(map(len, symbols[: i + 1])) == border:
                break
            whole = symbols[i] + symbols[i + 1]
            if whole == text:
                self.left[self.ids[text]], self.right[self.ids[text]] = self.symbols[symbols[i]], self.symbols[symbols[i + 1]]
            ranks.append(int(self.rank[self.ids[whole]]) if border is None else 0)
            symbols[i : i + 2] = [whole]
        return symbols, ranks

    def _found_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Walks back in time from two whole pieces: the symbol at the border that was made last gives way to the part of it that is there."""
        apart = np.ones(len(a), bool)
        rows, never = np.arange(len(a)), np.iinfo(np.int64).max
        used_a, used_b = np.full(len(a), never), np.full(len(a), never)  # the ranks at which the two symbols are used up
        while len(rows):
            both = self.joined.find(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
            crossed = (both >= 0) & (both < used_a) & (both <= used_b)
            apart[rows[crossed]] = False
            made_a, made_b = self.rank[a], self.rank[b]
            more = ~crossed & ((made_a >= 0) | (made_b >= 0))
            rows, a, b, used_a, used_b, made_a, made_b = (x[more] for x in (rows, a, b, used_a, used_b, made_a, made_b))
            back_a = made_a > made_b
            used_a, used_b = np.where(back_a, made_a, used_a), np.where(back_a, used_b, made_b)
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
        return apart

    def stay_apart(self, a: np.ndarray, b: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether two pieces, by id, are the result of merging their joined text."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        found = self.known.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, at = np.unique(keys[new], return_inverse=True)
            x, y = (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
            told = self._found_apart(x, y)
            for i in np.flatnonzero(self.odd[x] | self.odd[y]):
                told[i] = self.merged(texts[x[i]] + texts[y[i]], len(texts[x[i]]))[0] == [texts[x[i]], texts[y[i]]]
            if self.known.n > PAIRS:
                self.known.clear()
            self.known.insert(distinct, told.astype(np.int64))
            found[new] = told[at]
        return found == 1


class Transducer:
    """A compiled model."""

    _known: dict[str, Transducer] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = [*_fields(f.read())]
        self.texts: list[str] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}  # by id
        self.unknown, kinds = 0, set()
        for _, raw in (x for x in fields if x[0] == 1):
            piece = dict(_fields(raw))
            text, kind = piece.get(1, b"").decode(), piece.get(3, NORMAL)
            if kind == BYTE:
                self.bytes[len(self.texts)] = int(text[3:5], 16)
            elif kind == NORMAL:
                self.ids[text] = len(self.texts)
                self.scores[text] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            elif kind == UNKNOWN:
                self.unknown = len(self.texts)
            kinds.add(kind)
            self.texts.append(text)
        self.of_byte = {b: i for i, b in self.bytes.items()}
        trainer, normaliser = (dict(_fields(next((v for n, v in fields if n == k), b""))) for k in (2, 3))
        self.unigram = trainer.get(3, UNIGRAM) == UNIGRAM
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, MERGES) or not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only unigram models and models of merges that write spaces as marks in front are compiled")
        if USER in kinds:
            raise ValueError("models with user-defined pieces aren't compiled")
        if not self.unigram and (UNUSED in kinds or any(MARK in t.lstrip(MARK) for t in self.ids)):
            raise ValueError("models of merges with unused pieces, or with marks within pieces, aren't compiled")
        if any(dict(_fields(v)).get(2) for n, v in fields if n == 5):
            raise ValueError("models that rewrite what they decode aren't compiled")
        self.front, self.trims = normaliser.get(3, 1), normaliser.get(4, 1)
        self.rules = Rules(normaliser[2]) if normaliser.get(2) else None
        self.surface = trainer.get(44, " ⁇ ".encode()).decode()
        if self.unigram:
            self.lack = struct.unpack("<f", struct.pack("<f", min(self.scores.values(), default=0.0) - PENALTY))[0]
        else:
            self.merges = Merges(self.ids, self.scores, len(self.texts))
        self._compile_trie()
        shown = [b"" if i in self.bytes or i == self.unknown else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
        self.special = np.zeros(len(shown), bool)
        self.special[[self.unknown, *self.bytes]] = True
        self.shown, self.sizes = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.inside = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}  # neighbours within pieces: nothing joins any others
        self.near: dict[tuple[int, int], bool] = {}
        self.apart = np.full(256, bool(self.of_byte))  # ASCII characters that no piece has: each is a part of its own
        self.apart[[*range(128, 256), SPACE, *{ord(c) for t in self.ids for c in t if c < "\x80"}]] = False
        self.words, self.pool, self.batches = Words(), Pool(), 0
        self.whole = np.empty(0, bool)  # by a part's number: whether decoding gives it back

    @classmethod
    def at(cls, path: str) -> Transducer:
        """One for each worker and file."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _compile_trie(self) -> None:
        """States of the trie of pieces: ``arcs`` by state and character, and the piece that a state writes, if any."""
        arcs, self.final = {}, [NONE]
        for text, i in self.ids.items():
            if not self.unigram and self.merges.lost[i]:
                continue
            state = 0
            for c in text:
                key = state << 32 | ord(c)
                state = arcs.setdefault(key, len(self.final))
                if state == len(self.final):
                    self.final.append(NONE)
            self.final[state] = i
        self.symbols = self.texts
        if not self.unigram:  # characters that only longer pieces have may merge too
            lone = {i: c for c, i in self.merges.symbols.items() if i >= len(self.texts)}
            self.symbols = self.texts + [lone[i] for i in sorted(lone)]
            for i, c in lone.items():
                state = arcs.setdefault(ord(c), len(self.final))
                if state == len(self.final):
                    self.final.append(NONE)
                self.final[state] = i
        self.step = arcs
        self.arcs = Table([*arcs], [*arcs.values()]) if arcs else Table()
        self.finals = np.array(self.final)

    # --- the normaliser ---

    def _rewritten(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """(what the text at a place becomes, bytes read): by the longest rule, else one character."""
        if self.rules and (found := self.rules.longest(raw, at)):
            return found
        size = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        return raw[at : at + size], size

    def normalise(self, text: str) -> str:
        """The text that the normaliser writes."""
        if self.rules or self.trims:
            raw, out, at, space = text.encode("utf-8", "replace"), [], 0, bool(self.trims)
            while at < len(raw):
                new, size = self._rewritten(raw, at)
                at += size
                if space:
                    new = new.lstrip(b" ")
                out.append(new)
                space = bool(self.trims) and (new.endswith(b" ") if new else space)
            text = b"".join(out).decode("utf-8", "replace")
            if self.trims:
                text = text.replace(" ", MARK).rstrip(MARK)
        text = text.replace(" ", MARK)
        return MARK + text if text and self.front else text

    def _normalised(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all normalised texts, marks written as spaces; their ends). With no rules that is each text behind one space."""
        if self.rules or self.trims:
            return text_bytes(pa.array([self.normalise(t.as_py() or "").replace(MARK, " ") for t in texts], pa.string()))
        raw, ends = text_bytes(texts)
        full = np.diff(ends) > 0
        front = full * bool(self.front)
        out = np.zeros(len(raw) + int(front.sum()), np.uint8)
        shifted = np.concatenate([[0], np.cumsum(front)])
        place = np.repeat(shifted[1:], np.diff(ends)) + np.arange(ends[-1])
        out[place] = raw[: ends[-1]]
        out[(ends + shifted)[:-1][front > 0]] = SPACE
        return out, ends + shifted

    # --- shortest paths ---

    def _paths(self, chars: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by part): the shortest path through each part for a model of merges, all parts position by position.

        ``chars`` has the code points of a part in a row, ``n`` their numbers.
        """
        width, high = chars.shape[1], np.uint64(32)
        chars = chars.astype(np.uint64)
        last, came = np.full((len(n), width + 1), NONE, np.int32), np.zeros((len(n), width + 1), np.int32)
        for i in range(width):
            rows = np.flatnonzero((n > i) & ((last[:, i] != NONE) if i else True))
            before, state, own = last[rows, i].astype(np.int64), np.zeros(len(rows), np.int64), rows
            single, at = np.zeros(len(rows), bool), np.arange(len(rows))
            for j in range(i, width):
                state = self.arcs.find(state.astype(np.uint64) << high | chars[own, j])
                on = np.flatnonzero((state >= 0) & (n[own] > j))
                own, at, state = own[on], at[on], state[on]
                if not len(own):
                    break
                piece = self.finals[state]
                ends = piece >= 0
                if j == i:
                    single[at[ends]] = True
                fits = np.flatnonzero(ends & (last[own, j + 1] == NONE))
                if i and len(fits):
                    lead = before[at[fits]]
                    free = lead == LONE
                    free[~free] = self.merges.stay_apart(lead[~free], piece[fits][~free], self.symbols)
                    fits = fits[free]
                last[own[fits], j + 1], came[own[fits], j + 1] = piece[fits], i
            lone = rows[~single]  # written as bytes; nothing merges with it
            last[lone, i + 1], came[lone, i + 1] = LONE, i
        found, place, rows = np.full((len(n), width), NONE, np.int32), n.copy(), np.arange(len(n))
        sizes = np.zeros(len(n), np.int64)
        while len(rows):
            found[rows, sizes[rows]] = last[rows, place[rows]]
            sizes[rows] += 1
            place[rows] = came[rows, place[rows]]
            rows = rows[place[rows] > 0]
        of_row = np.repeat(np.arange(len(n)), sizes)
        ids = found[of_row, np.repeat(sizes, sizes) - 1 - ragged(np.zeros(len(sizes), np.int64), sizes)]
        starts, extra = np.cumsum(sizes) - sizes, [ids]
        used = len(ids)
        for r in np.unique(of_row[(ids == LONE) | (ids >= len(self.texts))]):  # the few parts with characters that have no piece are written one by one
            text, at, own = "".join(map(chr, chars[r, : n[r]].tolist())), 0, []
            for i in ids[starts[r] : starts[r] + sizes[r]].tolist():
                size = 1 if i == LONE else len(self.symbols[i])
                own.append(text[at : at + size])
                at += size
            extra.append(self._written(own).astype(np.int32))
            starts[r], sizes[r] = used, len(extra[-1])
            used += len(extra[-1])
        return np.concatenate(extra)[ragged(starts, sizes)].astype("<u4"), sizes

    def _long_path(self, text: str) -> np.ndarray:
        """The ids on the shortest path through one long part for a model of merges, from one place that nothing joins to the next."""
        found, step, final, begin = [], self.step, self.final, 0
        cuts = [*(i + 1 for i in range(len(text) - 1) if text[i : i + 2] not in self.inside), len(text)]
        if len(self.near) > PAIRS:
            self.near.clear()
        for end in cuts:
            part, begin = text[begin:end], end
            last: list[tuple[int, int] | None] = [None] * (len(part) + 1)  # (piece, where it begins)
            for i in range(len(part)):
                if i and last[i] is None:
                    continue
                before, state, single = last[i][0] if i else LONE, 0, False
                for j in range(i, len(part)):
                    state = step.get(state << 32 | ord(part[j]))
                    if state is None:
                        break
                    piece = final[state]
                    if piece < 0:
                        continue
                    single = single or j == i
                    if last[j + 1] is None:
                        free = before == LONE or self.near.get((before, piece))
                        if free is None:
                            free = self.near[before, piece] = bool(self.merges.stay_apart(np.array([before]), np.array([piece]), self.symbols)[0])
                        if free:
                            last[j + 1] = piece, i
                if not single:
                    last[i + 1] = LONE, i
            own, at = [], len(part)
            while at:
                own.append(part[last[at][1] : at])
                at = last[at][1]
            found += reversed(own)
        return self._written(found)

    def _written(self, pieces: Iterable[str]) -> np.ndarray:
        """The ids of pieces; a character without one is written as bytes, or a run of them as one unknown piece where the model has no bytes."""
        ids, lacking = [], False
        for piece in pieces:
            known = self.ids.get(piece)
            if known is not None:
                ids.append(known)
            elif self.of_byte:
                ids += [self.of_byte[b] for b in piece.encode("utf-8", "replace")]
            elif not lacking:
                ids.append(self.unknown)
            lacking = known is None
        return np.array(ids, "<u4")

    def _best_path(self, text: str) -> np.ndarray:
        """The ids on the shortest path through a normalised text for a unigram model; sums are rounded to 32 bits at each position, as the library's are."""
        n = len(text)
        best, last = array("f", [0.0]) * (n + 1), [0] * (n + 1)  # the length of the piece that leads to a position
        step, final, sum_ = self.step, self.final, array("f", [0.0])
        for i in range(n):
            here, single, state = best[i], False, 0
            for j in range(i, n):
                state = step.get(state << 32 | ord(text[j]))
                if state is None:
                    break
                if final[state] >= 0:
                    sum_[0] = self.scores[text[i : j + 1]] + here
                    if not last[j + 1] or sum_[0] > best[j + 1]:
                        best[j + 1], last[j + 1] = sum_[0], j + 1 - i
                    single = single or j == i
            if not single:
                sum_[0] = self.lack + here
                if not last[i + 1] or sum_[0] > best[i + 1]:
                    best[i + 1], last[i + 1] = sum_[0], 1
        found = []
        while n:
            found.append(text[n - last[n] : n])
            n -= last[n]
        return self._written(reversed(found))

    def _learn(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Find and remember the paths of new parts, and whether decoding gives a part back."""
        data = raw[ragged(starts, lengths)]
        text = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        text[text == SPACE] = ord(MARK)
        firsts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        ends = np.cumsum(lengths)
        sizes, at = firsts[ends] - firsts[ends - lengths], firsts[ends - lengths]
        order, found, counts = np.argsort(sizes, kind="stable"), [], np.zeros(len(sizes), np.int64)
        begin = 0
        while begin < len(order):
            widest = sizes[order[begin : begin + CELLS]]
            end = begin + int(min(np.searchsorted(widest * np.arange(1, len(widest) + 1), CELLS, side="right"), np.searchsorted(widest, LONG, side="right")))
            if end == begin:
                part = order[begin]
                found.append(self._long_path("".join(map(chr, text[at[part] : at[part] + sizes[part]].tolist()))))
                counts[part] = len(found[-1])
                begin += 1
                continue
            own = order[begin:end]
            n = sizes[own]
            chars = np.zeros((len(own), int(n[-1])), np.int64)
            chars[np.repeat(np.arange(len(own)), n), ragged(np.zeros(len(n), np.int64), n)] = text[ragged(at[own], n)]
            ids, counts[own] = self._paths(chars, n)
            found.append(ids)
            begin = end
        by_size = counts[order]
        places = np.empty(len(sizes), np.int64)
        places[order] = np.cumsum(by_size) - by_size
        ids = np.concatenate(found)[ragged(places, counts)]
        self.pool.add(ids, counts)
        self.whole = np.concatenate([self.whole[: self.pool.n - len(sizes)], self._come_back(ids, counts, data, lengths)])

    def _come_back(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether each run of ids decodes to the bytes of its part."""
        written = self.sizes[ids]
        out = self.shown[ragged(self.places[ids], written)]
        ends, cuts = np.cumsum(lengths), np.cumsum(counts)
        same = sums_of(written, counts) == lengths
        if same.all():
            told = sums_of((out != data).astype(np.int64), lengths) == 0
        else:
            told, own = np.zeros(len(counts), bool), np.flatnonzero(same)
            before = np.cumsum(written)[cuts - 1] - sums_of(written, counts)
            n = lengths[own]
            told[own] = sums_of((out[ragged(before[own], n)] != data[ragged((ends - lengths)[own], n)]).astype(np.int64), n) == 0
        for i in np.flatnonzero(sums_of(self.special[ids].astype(np.int64), counts)):  # bytes make characters only together
            told[i] = self._decoded(ids[cuts[i] - counts[i] : cuts[i]].tolist(), False).encode("utf-8", "replace") == data[ends[i] - lengths[i] : ends[i]].tobytes()
        return told

    def encode_batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each batch of texts in their order: (parts by text, numbers of parts, their ids' numbers), for a model of merges. ``pool.at`` gives the ids."""
        raw, ends = self._normalised(texts)
        begin = 0
        while begin < len(ends) - 1:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + BATCH_BYTES, side="right")) - 1)
            self.batches += 1
            if self.batches % GIVE_BACK == 0:
                give_back()
            if self.words.n > REMEMBERED or self.words.long_bytes > REMEMBERED_BYTES:
                picked = np.flatnonzero(self.pool.uses[: self.pool.n] > 1)
                picked = picked if 2 * len(picked) <= REMEMBERED and 2 * self.words.long_bytes <= REMEMBERED_BYTES else picked[:0]
                self.words.keep(picked)
                self.pool.keep(picked)
                self.whole = self.whole[picked]
            own = np.zeros(ends[end] - ends[begin] + 32, np.uint8)
            own[:-32] = raw[ends[begin] : ends[end]]
            edges = ends[begin : end + 1] - ends[begin]
            body, cut = own[:-32], np.zeros(len(own) - 31, bool)
            if len(body) > 1 and (self.of_byte or MARK in self.ids):
                marks = body == SPACE
                cut[1:-1] = marks[1:] & ~marks[:-1]
                after = np.flatnonzero(cut[3:-1] & (body[2:-1] == 0x81) & (body[1:-2] == 0x96) & (body[:-3] == 0xE2)) if len(body) > 3 else []
                cut[np.asarray(after, np.int64) + 3] = False  # a mark of the text itself goes on in spaces
                alone = np.flatnonzero(self.apart[body])
                cut[alone], cut[alone + 1] = True, True
            cut[edges] = False
            at = np.flatnonzero(cut)
            full = np.diff(edges) > 0  # an empty text has no part
            parts = np.diff(np.searchsorted(at, edges)) + full
            starts = np.sort(np.concatenate([edges[:-1][full], at]))
            lengths = np.diff(starts, append=edges[-1])
            numbers = self.words.numbers(own, starts, lengths, lambda a, n: self._learn(own, a, n))
            self.pool.uses[: self.pool.n] += np.bincount(numbers, minlength=self.pool.n)
            yield parts, numbers, self.pool.lengths[numbers]
            begin = end

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        if self.unigram:
            return self._best_path(self.normalise(text)).tobytes()
        return b"".join(self.pool.at(numbers, sizes).tobytes() for _, numbers, sizes in self.encode_batch(pa.array([text])))

    def _decoded(self, ids: list[int], lead: bool) -> str:
        """The text of ids, marks as spaces. ``lead``: whether a mark in front goes."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                lead = False
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            piece = self.surface if i == self.unknown else self.texts[i]
            if lead:  # where extra spaces go, each piece in front of the text loses its mark
                rest = piece.removeprefix(MARK)
                lead, piece = not rest and (self.trims or rest == piece), rest
            out.append(piece)
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: bytes) -> str:
        """The text of ids: marks become spaces, runs of bytes are read as UTF-8, a mark in front goes."""
        return self._decoded(np.frombuffer(ids, "<u4").tolist(), bool(self.front or self.trims))


def encode_texts(text, path: str | None = None):
    """A column with the ids of a text column, as binary.

    Null and empty texts have none. Texts of any length are encoded whole;
    rows that repeat have equal ids, and an empty table stays empty.
    """

    @arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        model = Transducer.at(path or default_path("piece_bpe_32k.model"))
        if model.unigram:
            return pa.array([model.encode(t.as_py() or "") for t in texts], pa.binary())
        rows = []
        for parts, numbers, sizes in model.encode_batch(texts):
            raw, ends = model.pool.at(numbers, sizes).tobytes(), 4 * sums_of(sizes, parts).cumsum()
            rows += (raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist()))
        return pa.array(rows, pa.binary())

    return encode.asNondeterministic()(text)


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of runs of so many values each; 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def decode_ids(ids, path: str | None = None):
    """A column with the text of a column of ids; null for null, and an empty text for no ids."""

    @arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        model = Transducer.at(path or default_path("piece_bpe_32k.model"))
        return pa.array([None if (v := x.as_py()) is None else model.decode(v) for x in values], pa.string())

    return decode.asNondeterministic()(ids)


TOLD = pa.struct([("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


def pieces_told(text, path: str | None = None):
    """A column of n_pieces, ids_crc32 and round_trip (whether decoding gives the text back) of a text column, for a model of merges without normaliser rules.

    Every distinct part is decoded from its ids; a text comes back if all its parts do.
    """

    @arrow_udf("struct<n_pieces: bigint, ids_crc32: bigint, round_trip: boolean>")
    def told(texts: pa.Array) -> pa.Array:
        model, columns = Transducer.at(path or default_path("piece_bpe_32k.model")), ([], [], [])
        for parts, numbers, sizes in model.encode_batch(texts):
            raw, counts = memoryview(model.pool.at(numbers, sizes)).cast("B"), sums_of(sizes, parts)
            ends = (4 * counts.cumsum()).tolist()
            columns[0].append(counts)
            columns[1].append(np.array([zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends)], np.int64))
            columns[2].append(sums_of((~model.whole[numbers]).astype(np.int64), parts) == 0)
        arrays = [pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(columns, TOLD)]
        return pa.StructArray.from_arrays(arrays, fields=[*TOLD])

    return told.asNondeterministic()(text)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document's whole text, a checksum of their ids, and whether decoding gives the text back. Ids stay in Python.

    A null or empty text has no pieces and comes back as an empty one; rows
    that repeat are encoded alike; an empty table stays empty.
    """
    return read_table(spark, sf_dir, "documents").select("doc_id", pieces_told("text").alias("p")).select("doc_id", "p.*")
