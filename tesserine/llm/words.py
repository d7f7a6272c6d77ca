"""Texts as pieces of bytes, and numbers of distinct pieces, a whole batch at a time.

A piece of up to WIDTH bytes is a few 64-bit words that hold its bytes and
its length, so pieces are equal exactly if their words are; longer ones
are kept in a dictionary.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the longest piece in the table: three words less the byte of the length.
WIDTH = 23
#: Odd multipliers that spread the words of a key over the table.
_SPREAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: By byte: 1 for a character of white space, 2 for one that may begin such a character.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def give_back() -> None:
    """Return freed memory to the system where the C library can: a worker keeps running, and idle, beside those of later stages."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
    pa.default_memory_pool().release_unused()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 and so on of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts with WIDTH + 9 zeros behind, ends: text i is from ends[i] to ends[i + 1]). A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.zeros(int(ends[-1] - ends[0]) + WIDTH + 9, np.uint8)
    if ends[-1] > ends[0]:
        raw[: ends[-1] - ends[0]] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0]


def white_space(raw: np.ndarray) -> np.ndarray:
    """Whether a byte is the first one of a character of Unicode's white space; also U+001C to U+001F, which not all libraries count as such."""
    kind = _KIND[raw]
    found = kind == 1
    wide = np.flatnonzero(kind == 2)  # these begin the other characters of white space
    wide = wide[wide < len(raw) - 1]
    if len(wide):
        a, b, c = raw[wide], raw[wide + 1], raw[np.minimum(wide + 2, len(raw) - 1)]
        general = ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))
        found[wide] = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE2) & general) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return found


def last_bytes(starts_char: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """From flags at the first bytes of characters, flags at their last bytes."""
    at = np.flatnonzero(starts_char)
    size = np.where(raw[at] < 0xC0, 1, np.where(raw[at] < 0xE0, 2, 3))
    out = np.zeros(len(starts_char), bool)
    out[at + size - 1] = True
    return out


class Words:
    """Numbers of distinct pieces: vectorised open addressing with whole keys."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.keys = np.empty((3, 1 << 12), np.uint64)  # by number
        self.slots = np.full(1 << 13, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    @staticmethod
    def _keys(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
        keys = np.empty((3, len(starts)), np.uint64)
        for i in range(3):
            keys[i] = at[starts + 8 * i] & _MASKS[np.clip(lengths - 8 * i, 0, 8)]
        keys[2] |= lengths.astype(np.uint64) << np.uint64(56)
        return keys

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[0] * _SPREAD[0] + keys[1] * _SPREAD[1] + keys[2] * _SPREAD[2]
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * _SPREAD[0]) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.slots[slot].astype(np.int64)
        k = np.maximum(found, 0)
        own = self.keys
        open_ = np.flatnonzero((found >= 0) & ((own[0, k] != keys[0]) | (own[1, k] != keys[1]) | (own[2, k] != keys[2])))
        slot, most = slot[open_], len(self.slots) - 1
        while len(open_):
            slot = (slot + 1) & most
            now = self.slots[slot].astype(np.int64)
            found[open_] = now
            k = np.maximum(now, 0)
            again = (now >= 0) & (keys[:, open_] != own[:, k]).any(axis=0)
            open_, slot = open_[again], slot[again]
        return found

    def _place(self, numbers: np.ndarray) -> None:
        """Put keys, which aren't there yet, into slots."""
        slot, most = self._slot(self.keys[:, numbers]), len(self.slots) - 1
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & most

    def _insert(self, keys: np.ndarray) -> np.ndarray:
        first, self.n = self.n, self.n + keys.shape[1]
        if self.n > self.keys.shape[1]:
            wider = np.empty((3, max(self.n, 2 * self.keys.shape[1])), np.uint64)
            wider[:, :first] = self.keys[:, :first]
            self.keys = wider
        self.keys[:, first : self.n] = keys
        numbers = np.arange(first, self.n)
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
            table = np.ones(self.n, bool)
            table[list(self.long.values())] = False
            numbers = np.flatnonzero(table)
        self._place(numbers.astype(np.int32))
        return np.arange(first, self.n)

    def numbers(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, learn: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
        """The number of each piece of ``raw``. ``learn`` gets the starts and lengths of distinct new ones, whose numbers come next, in that order."""
        out = np.empty(len(starts), np.int64)
        short = np.flatnonzero(lengths <= WIDTH)
        keys = self._keys(raw, starts[short], lengths[short])
        found = self._find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            missing = keys[:, new]
            order = np.lexsort(missing)
            ordered = missing[:, order]
            first = np.ones(len(order), bool)
            first[1:] = (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)
            own = self._insert(ordered[:, first])
            found[new[order]] = own[np.cumsum(first) - 1]
            at = short[new[order[first]]]
            learn(starts[at], lengths[at])
        out[short] = found
        if len(short) < len(starts):
            self._long(raw, starts, lengths, out, learn)
        return out

    def _long(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, out: np.ndarray, learn) -> None:
        rest = np.flatnonzero(lengths > WIDTH)
        view, fresh = memoryview(raw), []
        for i, a, n in zip(rest.tolist(), starts[rest].tolist(), lengths[rest].tolist()):
            piece = bytes(view[a : a + n])
            number = self.long.get(piece)
            if number is None:
                number = self.long[piece] = self.n + len(fresh)
                self.long_bytes += n
                fresh.append(i)
            out[i] = number
        if fresh:
            first, self.n = self.n, self.n + len(fresh)
            if self.n > self.keys.shape[1]:
                wider = np.empty((3, max(self.n, 2 * self.keys.shape[1])), np.uint64)
                wider[:, :first] = self.keys[:, :first]
                self.keys = wider
            self.keys[:, first : self.n] = 0  # no key: a length of 0 has its own slot only if it was put there
            learn(starts[fresh], lengths[fresh])

    def keep(self, picked: np.ndarray) -> None:
        """Only the picked numbers stay, renumbered in their order."""
        new = np.full(self.n, -1, np.int64)
        new[picked] = np.arange(len(picked))
        self.long = {k: int(new[v]) for k, v in self.long.items() if new[v] >= 0}
        self.long_bytes = sum(map(len, self.long))
        self.keys = self.keys[:, picked].copy() if len(picked) else np.empty((3, 1 << 12), np.uint64)
        self.n = len(picked)
        self.slots = np.full(1 << max(13, (4 * self.n).bit_length()), -1, np.int32)
        table = np.ones(self.n, bool)
        table[list(self.long.values())] = False
        self._place(np.flatnonzero(table).astype(np.int32))


class Table:
    """Values of 64-bit keys: vectorised open addressing. Values aren't negative."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None):
        self.clear()
        if keys is not None:
            self.insert(np.asarray(keys, np.uint64), np.asarray(values, np.int64))

    def clear(self) -> None:
        self.n, self.keys, self.values = 0, np.zeros(1 << 12, np.uint64), np.full(1 << 12, -1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * _SPREAD[0]
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * _SPREAD[1]) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 for those that aren't there."""
        slot = self._slot(keys)
        found = self.values[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        slot, most = slot[open_], len(self.keys) - 1
        while len(open_):
            slot = (slot + 1) & most
            now = self.values[slot]
            found[open_] = now
            again = (now >= 0) & (self.keys[slot] != keys[open_])
            open_, slot = open_[again], slot[again]
        return found

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            full = self.values >= 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            size = 1 << (4 * self.n).bit_length()
            self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        slot, most, rows = self._slot(keys), len(self.keys) - 1, np.arange(len(keys))
        while len(rows):
            free = self.values[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[rows[free]], values[rows[free]]
            left = (self.values[slot] < 0) | (self.keys[slot] != keys[rows])
            rows, slot = rows[left], (slot[left] + 1) & most
