"""Exact searches for the k best of many stored vectors: a cheap bound says which pairs can be among them, and only these get their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from ..functions import bits as B
from ..functions.vectors import EPSILON

#: Queries and stored rows of a tile of pairs of bits, and stored rows that share a bound.
ASKED, TILE, SEGMENT = 256, 4096, 64
#: Queries whose words are counted at once, so that these stay in a core's cache.
COUNTED = 16
#: One of so many stored rows is in the sample that gives a first bound.
SHARE = 64
#: Runs of stored rows that have a bound each, up to which a tile is compared run by run.
RUNS = 64
#: Queries and stored vectors of a tile of products.
ROWS, COLUMNS = 512, 2048
#: Values of candidates that are gathered at once.
GATHERED = 1 << 22
#: Masks of at most so many features have equal rows often enough to keep only those that ties can choose.
FEW = 24
#: Norms within which products in single precision neither overflow nor vanish.
LEAST_NORM, MOST_NORM = 1e-12, 1e15

#: One of so many pairs of a tile that pass the least bound of its columns are looked at one by one; more are compared with the bound of each.
MOST_LOOKED_AT = 512

EPS = 2.0**-52


class Best:
    """The k best (score falling, then label if asked, then id) of each query so far; -inf where there are fewer."""

    def __init__(self, n: int, k: int, by_label: bool):
        self.k, self.by_label = k, by_label
        self.scores = np.full((n, k), -np.inf)
        self.labels, self.ids = (np.full((n, k), np.iinfo(np.int64).max) for _ in range(2))

    def add(self, rows: np.ndarray, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        touched, place = np.unique(rows, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        s, label, i = (np.concatenate([mine[touched].ravel(), more]) for mine, more in ((self.scores, scores), (self.labels, labels), (self.ids, ids)))
        order = np.lexsort((i, label, -s, row) if self.by_label else (i, -s, row))
        at = order[np.searchsorted(row[order], np.arange(len(touched)))[:, None] + np.arange(self.k)]
        self.scores[touched], self.labels[touched], self.ids[touched] = s[at], label[at], i[at]


def candidates(values: np.ndarray, starts: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the values that reach what their row needs in their segment; ``need`` has a column for each segment."""
    row, segment = np.nonzero(np.maximum.reduceat(values, starts, axis=1) >= need)
    length = np.diff(np.append(starts, values.shape[1]))[segment]
    rows, first = np.repeat(row, length), np.cumsum(length) - length
    columns = np.arange(len(rows)) + np.repeat(starts[segment] - first, length)
    keep = values[rows, columns] >= np.repeat(need[row, segment], length)
    return rows[keep], columns[keep]


def reached(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the few flags that are set; 64 that aren't are passed over at once."""
    bits = np.packbits(flags)
    if len(bits) % 8:
        bits = np.append(bits, np.zeros(-len(bits) % 8, np.uint8))
    words = np.flatnonzero(bits.view(np.uint64))
    word, place = np.nonzero(np.unpackbits(bits.reshape(-1, 8)[words], axis=1))
    return np.divmod(64 * words[word] + place, flags.shape[1])


def sampled(n: int, k: int, share: int = 128, most: int = 1024) -> np.ndarray:
    """Places of an even sample of the stored vectors: its k-th best is a first bound, and nothing else."""
    return np.arange(0, n, max(1, n // min(max(n // share, 4 * k), most)))


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf if there are fewer."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if 0 < k <= values.shape[1] else np.full(len(values), -np.inf)


# --- bits ---------------------------------------------------------------------------------------------


def packed(flags: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words, feature i in word i / 64."""
    bits = np.packbits(flags, axis=1, bitorder="little")
    out = np.zeros((len(flags), -(-flags.shape[1] // 64) * 8), np.uint8)
    out[:, : bits.shape[1]] = bits
    return out.view(np.uint64)


def features(length: int, blocks: int) -> tuple[np.ndarray, int]:
    """(words of the features in some blocks, how many these are)."""
    words = np.array([w % 2**64 for w in B.block_mask_words(length, blocks)], np.uint64)
    return words, int(np.bitwise_count(words).sum())


def blended(weight: float) -> Callable:
    """Scores by bits from (shared, a, b, n): Hamming and Jaccard similarity, blended."""

    def score(both: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        either = a + b - both
        hamming = 1.0 - (either - both) / n
        return hamming * (1.0 - weight) + np.where(either > 0, both / np.where(either > 0, either, 1.0), 1.0) * weight

    return score


def equal_share(both: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return (n - (a + b - 2.0 * both)) / n


class Counter:
    """Counts how many bits rows of q and columns of r share, in memory that is used again for the next tile."""

    def __init__(self, kind: type):
        self.sums = np.empty(ASKED * TILE, kind)
        self.words, self.bits = (np.empty(COUNTED * TILE, t) for t in (np.uint64, np.uint8))

    def __call__(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        whole = self.sums[: len(q) * r.shape[1]].reshape(len(q), r.shape[1])
        for begin in range(0, len(q), COUNTED):
            sums, part = whole[begin : begin + COUNTED], q[begin : begin + COUNTED]
            words, bits = (x[: sums.size].reshape(sums.shape) for x in (self.words, self.bits))
            for w in range(len(r)):
                np.bitwise_and(part[:, w, None], r[w][None, :], out=words)
                if w or sums.dtype != np.uint8:
                    np.bitwise_count(words, out=bits)
                    np.add(sums if w else 0, bits, out=sums, casting="unsafe")
                else:
                    np.bitwise_count(words, out=sums)
        return whole

    def candidates(self, sums: np.ndarray, starts: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like ``candidates``, or some more where ``need`` is more than a count can be."""
        if len(starts) > RUNS:
            return candidates(sums, starts, need)
        least = np.clip(need, 0, np.iinfo(sums.dtype).max).astype(sums.dtype)
        rows, columns = [], []
        for i, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), sums.shape[1]])):
            hit = np.flatnonzero(sums[:, a:b].max(axis=1) >= least[:, i])
            if len(hit):
                row, column = reached(sums[hit, a:b] >= least[hit, i, None])
                rows.append(hit[row])
                columns.append(a + column)
        return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.empty(0, np.intp), np.empty(0, np.intp))


def least_shared(score: np.ndarray, a: np.ndarray, b: np.ndarray, weight: float, n: int) -> np.ndarray:
    """The fewest shared bits with which rows of a bits and columns of b bits can reach a score, from (1 - w) (1 - (a + b - 2x) / n) + w x / (a + b - x) = score; rather one less than one more."""
    total = (a[:, None] + b[None, :]).astype(float)
    s = np.where(np.isfinite(score), score, 0.0)[:, None]
    linear, slope = (1.0 - weight) * (1.0 - total / n), 2.0 * (1.0 - weight) / n
    middle = slope * total - linear + s + weight
    root = middle + np.sqrt(np.maximum(middle * middle - 4.0 * slope * (s - linear) * total, 0.0))
    shared = 2.0 * (s - linear) * total / np.where(root > 0.0, root, 1.0)
    return np.where((root > 0.0) & np.isfinite(score)[:, None], np.ceil(shared - 0.01), 0.0)


class Bits:
    """Stored rows of packed bits, over the features in ``words`` (n of them), in the order of how many are set."""

    def __init__(self, r: np.ndarray, ids: np.ndarray, labels: np.ndarray, words: np.ndarray, n: int, k: int, by_label: bool, whole: bool = False):
        self.used = np.flatnonzero(words)
        self.mask, self.n = words[self.used], n
        r = r[:, self.used] & self.mask
        if n <= FEW and not whole:
            r, ids, labels = self._chosen(r, ids, labels, k, by_label)
        b = np.bitwise_count(r).sum(axis=1, dtype=np.int64)
        order = np.argsort(b, kind="stable")
        self.b, self.ids, self.labels = b[order], ids[order].astype(np.int64), labels[order].astype(np.int64)
        self.r = np.ascontiguousarray(r[order].T)
        self.kind = np.uint8 if n < 256 else np.uint16 if n < 1 << 16 else np.uint32

    @staticmethod
    def _chosen(r: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, by_label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal rows have equal scores, so ties never reach those behind the first k of them."""
        order = np.lexsort((ids, labels, *r.T) if by_label else (ids, *r.T))
        r = r[order]
        new = np.append(True, (r[1:] != r[:-1]).any(axis=1))
        at = np.arange(len(r))
        keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
        return r[keep], ids[order][keep], labels[order][keep]

    def search(self, q: np.ndarray, own: np.ndarray | None, wanted: list[tuple[Best, Callable, float]]) -> None:
        """Add what is among the k best of packed queries; ``own`` are their ids if these are left out. All that is wanted, each with what gives its scores from (shared, a, b, n) and the weight in these, is found from the same counts."""
        q = np.ascontiguousarray(q[:, self.used] & self.mask)
        a, count = np.bitwise_count(q).sum(axis=1, dtype=np.int64), Counter(self.kind)
        order = np.argsort(a, kind="stable")
        for begin in range(0, len(q), ASKED):
            at = order[begin : begin + ASKED]
            self._search(q[at], a[at], None if own is None else own[at], wanted, at, count)

    def _search(self, q: np.ndarray, a: np.ndarray, own: np.ndarray | None, wanted: list[tuple[Best, Callable, float]], at: np.ndarray, count: Counter) -> None:
        """Of queries in the order of how many bits are set: tiles with as many come first, and those that no score can be reached in are left out."""
        floors = [self._floor(q, a, own, best.k, score, count) for best, score, _ in wanted]
        lows = np.arange(0, len(self.b), TILE)
        middle = self.b[np.minimum(lows + TILE // 2, len(self.b) - 1)]
        for low in lows[np.argsort(np.abs(middle - a[len(a) // 2]), kind="stable")].tolist():
            b = self.b[low : low + TILE]
            starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            if len(starts) > RUNS:
                starts = np.flatnonzero(_cuts(b))
            set_bits, which = np.unique(b[starts], return_inverse=True)
            bounds = [np.maximum(floor, best.scores[at, -1]) for floor, (best, _, _) in zip(floors, wanted)]
            needs = [least_shared(bound, a, set_bits, weight, self.n) for bound, (_, _, weight) in zip(bounds, wanted)]
            can = np.minimum(a[:, None], set_bits[None, :])
            live = np.flatnonzero(np.any([(need <= can).any(axis=1) for need in needs], axis=0))
            if not len(live):
                continue
            both = count(q[live], self.r[:, low : low + TILE])
            for bound, need, (best, score, _) in zip(bounds, needs, wanted):
                rows, columns = count.candidates(both, starts, need[live][:, which])
                if not len(rows):
                    continue
                shared, rows = both[rows, columns].astype(float), live[rows]
                s = score(shared, a[rows], b[columns], self.n)
                keep = s >= bound[rows]
                if own is not None:
                    keep &= own[rows] != self.ids[low + columns]
                if keep.any():
                    found = low + columns[keep]
                    best.add(at[rows[keep]], s[keep], self.labels[found], self.ids[found])


    def _floor(self, q: np.ndarray, a: np.ndarray, own: np.ndarray | None, k: int, score: Callable, count: Counter) -> np.ndarray:
        """Scores that each query has k times at least, from runs of a sample: in each a row shares the most bits, and scores no less than with the most bits set."""
        some = sampled(len(self.b), k, SHARE, TILE // 2)  # fewer than a tile
        starts = np.arange(0, len(some), max(1, len(some) // max(4 * k, RUNS)))
        both, most = count(q, self.r[:, some]), self.b[some][np.append(starts[1:], len(some)) - 1]
        mine = None if own is None else own[:, None] == self.ids[None, some]
        if mine is not None:
            both = np.where(mine, 0, both)
        first = score(np.maximum.reduceat(both, starts, axis=1).astype(float), a[:, None], most[None, :], self.n)
        if mine is not None:
            first[np.logical_and.reduceat(mine, starts, axis=1)] = -np.inf
        return kth(first, k)


def _cuts(b: np.ndarray) -> np.ndarray:
    """Where segments begin: with each number of set bits, and after SEGMENT rows."""
    return np.append(True, b[1:] != b[:-1]) | (np.arange(len(b)) % SEGMENT == 0)


# --- vectors ------------------------------------------------------------------------------------------


def _norms(x: np.ndarray) -> np.ndarray:
    return ordered_sum(x * x)


class Vectors:
    """Stored vectors for Euclidean or cosine scores, bounded by products in single precision and what these can be wrong by."""

    def __init__(self, r: np.ndarray, ids: np.ndarray, labels: np.ndarray, metric: str, pairs: Callable):
        self.r, self.ids, self.labels, self.metric, self.pairs = r, ids.astype(np.int64), labels.astype(np.int64), metric, pairs
        self.squares = _norms(r)
        self.most = float(np.sqrt(self.squares.max(initial=0.0)))
        self.keys = None
        if np.isfinite(self.most) and (LEAST_NORM < self.most < MOST_NORM):
            keys = self._keys()
            self.keys = np.zeros((len(r), -(-keys.shape[1] // 8) * 8), np.float32)  # zeros make rows of whole registers
            self.keys[:, : keys.shape[1]] = keys

    def _keys(self) -> np.ndarray:
        return np.concatenate([self.r, -0.5 * self.squares[:, None]], axis=1) if self.metric == "euclidean" else _units(self.r, self.squares)

    def fits(self, q: np.ndarray) -> bool:
        """Whether single precision can bound these queries."""
        return self.keys is not None and bool((_norms(q) < MOST_NORM**2).all())

    def _slack(self, size: np.ndarray) -> np.ndarray:
        """What a product can be wrong by."""
        return (self.r.shape[1] + 8) * 2.0**-23 * (size * self.most + 0.5 * self.most**2 if self.metric == "euclidean" else np.ones(len(size)))

    def _need(self, score: np.ndarray, square: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """The least product with which a score can be reached."""
        if self.metric == "cosine":
            return score - slack
        d = np.maximum((1.0 + 8 * EPS) / np.where(np.isfinite(score), score, 1.0) - 1.0 + 8 * EPS, 0.0)
        far = d * d * (1.0 + (self.r.shape[1] + 8) * EPS)
        return np.where(np.isfinite(score), 0.5 * (square - far) - slack - 1e-13 * (square + far), -np.inf)

    def _reached(self, product: np.ndarray, square: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """A score that vectors of such a product reach at least."""
        if self.metric == "cosine":
            return product - slack
        far = np.maximum(square - 2.0 * (product - slack), 0.0) * (1.0 + (self.r.shape[1] + 8) * EPS) + 1e-13 * square
        return np.where(np.isfinite(product), (1.0 - 8 * EPS) / (1.0 + np.sqrt(far)), -np.inf)

    def search(self, q: np.ndarray, own: np.ndarray | None, best: Best) -> None:
        """Add what is among the k best of the queries; ``own`` are their ids if these are left out."""
        step = max(1, GATHERED // max(self.r.shape[1], 1))
        some = sampled(len(self.r), best.k)
        first_keys = np.ascontiguousarray(self.keys[some].T)
        room, flags = np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS, bool)
        for begin in range(0, len(q), ROWS):
            x = q[begin : begin + ROWS]
            square = _norms(x)
            slack = self._slack(np.sqrt(square))
            keys = np.zeros((len(x), self.keys.shape[1]), np.float32)
            if self.metric == "euclidean":
                keys[:, : x.shape[1]], keys[:, x.shape[1]] = x, 1.0
            else:
                keys[:, : x.shape[1]] = _units(x, square)
            mine = None if own is None else own[begin : begin + ROWS]
            first = keys @ first_keys
            if mine is not None:
                first[mine[:, None] == self.ids[None, some]] = -np.inf
            floor = self._reached(kth(first, best.k).astype(float), square, slack)
            for low in range(0, len(self.r), COLUMNS):
                stored = self.keys[low : low + COLUMNS]
                shape = len(x), len(stored)
                products, over = (held[: shape[0] * shape[1]].reshape(shape) for held in (room, flags))
                np.matmul(keys, stored.T, out=products)
                bound = np.maximum(floor, best.scores[begin : begin + len(x), -1])
                need = _less(self._need(bound, square, slack))
                rows, columns = reached(np.greater_equal(products, need[:, None], out=over))
                if mine is not None:
                    keep = mine[rows] != self.ids[low + columns]
                    rows, columns = rows[keep], columns[keep]
                for at in range(0, len(rows), step):
                    i, j = rows[at : at + step], low + columns[at : at + step]
                    s = self.pairs(x[i], self.r[j])
                    keep = s >= bound[i]
                    if keep.any():
                        best.add(begin + i[keep], s[keep], self.labels[j[keep]], self.ids[j[keep]])


class Others(Vectors):
    """Vectors that are stored and asked for at once: a product of two is looked at once, for both."""

    def __init__(self, r: np.ndarray, ids: np.ndarray, labels: np.ndarray, metric: str, pairs: Callable):
        self.order = np.argsort(_norms(r), kind="stable")  # so that a tile's least norm is near all of its norms
        super().__init__(r[self.order], ids[self.order], labels[self.order], metric, pairs)
        self.half = 0.5 * self.squares if metric == "euclidean" else np.zeros(len(r))

    def _keys(self) -> np.ndarray:
        return self.r if self.metric == "euclidean" else _units(self.r, self.squares)

    def floor(self, k: int) -> np.ndarray:
        """Scores that each has k times at least among them all, from a sample of them."""
        some, slack, floors = sampled(len(self.r), k, 16, 4096), self._slack(np.sqrt(self.squares)), []
        keys, half = np.ascontiguousarray(self.keys[some].T), self.half[some].astype(np.float32)
        for begin in range(0, len(self.r), ROWS):
            at = slice(begin, begin + ROWS)
            first = self.keys[at] @ keys - half
            first[self.ids[at, None] == self.ids[None, some]] = -np.inf
            floors.append(self._reached(kth(first, k).astype(float), self.squares[at], slack[at]))
        return np.concatenate(floors)

    def meet(self, other: Others, mine: Best, theirs: Best, floor: np.ndarray, ground: np.ndarray) -> None:
        """Add what is among the k best of these vectors and of the others, which may be these, and reaches their floors; equal ids are left out."""
        alike, step = other is self, max(1, GATHERED // max(self.r.shape[1], 1))
        slack, back = other._slack(np.sqrt(self.squares)), self._slack(np.sqrt(other.squares))
        room, flags, more = (np.empty(ROWS * COLUMNS, t) for t in (np.float32, bool, bool))
        for begin in range(0, len(self.r), ROWS):
            x = slice(begin, min(begin + ROWS, len(self.r)))
            for low in range(begin if alike else 0, len(other.r), COLUMNS):
                y = slice(low, min(low + COLUMNS, len(other.r)))
                shape = x.stop - begin, y.stop - low
                products, over, also = (held[: shape[0] * shape[1]].reshape(shape) for held in (room, flags, more))
                np.matmul(self.keys[x], other.keys[y].T, out=products)
                bound, limit = np.maximum(floor[x], mine.scores[x, -1]), np.maximum(ground[y], theirs.scores[y, -1])
                need = _less(self._need(bound, self.squares[x], slack[x]) + other.half[y].min())
                want = _less(other._need(limit, other.squares[y], back[y]) + self.half[x].min())
                np.greater_equal(products, np.minimum(need, want.min())[:, None], out=over)
                if np.count_nonzero(over) > over.size // MOST_LOOKED_AT:
                    np.greater_equal(products, need[:, None], out=over)
                    np.logical_or(over, np.greater_equal(products, want[None, :], out=also), out=over)
                rows, columns = reached(over)
                p = products[rows, columns]
                keep = ((p >= need[rows]) | (p >= want[columns])) & (self.ids[begin + rows] != other.ids[low + columns])
                if alike:
                    keep &= low + columns > begin + rows
                rows, columns = rows[keep], columns[keep]
                for at in range(0, len(rows), step):
                    i, j = rows[at : at + step], columns[at : at + step]
                    s = self.pairs(self.r[begin + i], other.r[low + j])
                    for best, stored, asked, found, least in ((mine, other, begin + i, low + j, bound[i]), (theirs, self, low + j, begin + i, limit[j])):
                        keep = s >= least
                        if keep.any():
                            best.add(asked[keep], s[keep], stored.labels[found[keep]], stored.ids[found[keep]])


def _less(need: np.ndarray) -> np.ndarray:
    """In single precision, and not more."""
    return np.nextafter(need.astype(np.float32), np.float32(-np.inf))


def _units(x: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Vectors of length 1; those that score 0 with all others are 0."""
    small = squares <= EPSILON
    return np.where(small[:, None], 0.0, x / np.sqrt(np.where(small, 1.0, squares))[:, None])


def ordered_sum(x: np.ndarray) -> np.ndarray:
    """Sums of rows, over the columns in order."""
    return np.add.accumulate(x, axis=1)[:, -1] + 0.0 if x.shape[1] else np.zeros(len(x))


def results(own: np.ndarray, best: Best) -> Iterator[np.ndarray]:
    """query, ref, label and score of all that was found."""
    keep = best.scores > -np.inf
    yield np.broadcast_to(own[:, None], keep.shape)[keep]
    yield from (x[keep] for x in (best.ids, best.labels, best.scores))
