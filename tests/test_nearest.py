"""Bounded searches against the scores of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tesserine.operators import library, nearest
from tesserine.plans import population
from tesserine.queries import base


def rows(rng, kind, n, width):
    if kind == "grid":
        return rng.integers(0, 3, (n, width)).astype(float)
    if kind == "close":
        return rng.standard_normal((n, width)) * 1e-7 + rng.integers(0, 2, (n, 1))
    if kind == "scales":
        return rng.standard_normal((n, width)) * 10.0 ** rng.integers(-9, 9, (n, 1))
    return rng.standard_normal((n, width)) * (1e-10 if kind == "tiny" else 1.0)


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("kind,width,n", [("normal", 64, 5000), ("grid", 3, 400), ("close", 20, 300), ("scales", 8, 700), ("tiny", 16, 300), ("normal", 130, 5), ("grid", 16, 9000)])
def test_bounds_lose_nothing(kind, width, n, exclude):
    """Scores and ties are those of all pairs, whatever the vectors are like; copies and fewer stored vectors than k too."""
    rng = np.random.default_rng(n + width)
    r, q, ids, labels = rows(rng, kind, n, width), rows(rng, kind, 60, width), rng.permutation(n) * 7 - 3, rng.integers(0, 4, n)
    q[0], r[n // 2] = r[0], r[0]
    own = rng.choice(ids, 60)
    bits = [(w, m) for w in (0.0, 0.3, 1.0) for m in (0xFFFF, 0x7E57, 1)]
    found = [(library.dense_finder(m, 0.1), lambda a, b, m=m: library.dense_scores(a, b, m, 0.1), False) for m in library.METRICS]
    found += [(library.bit_finder(0.1, w, m), lambda a, b, w=w, m=m: library.bit_scores(a >= 0.1, b >= 0.1, w, width, m), True) for w, m in bits]
    for finder, scorer, by_label in found:
        mine, all_pairs = (nearest.Best(60, 6, by_label) for _ in range(2))
        finder(r, ids, labels, 6, exclude)(q, own, mine)
        library._scored(r, ids, labels, 6, scorer, by_label, exclude)(q, own, all_pairs)
        assert np.array_equal(mine.scores, all_pairs.scores)
        for x, y in ((mine.ids, all_pairs.ids), (mine.labels, all_pairs.labels)):
            assert np.array_equal(x[mine.scores > -np.inf], y[mine.scores > -np.inf])


def test_few_pairs_get_scores(monkeypatch):
    """F2 to F21: of the pairs of a search, few are scored in full."""
    rng = np.random.default_rng(4)
    r, asked, scored = rng.standard_normal((20_000, 64)), 100, []
    own = library.pair_scores
    monkeypatch.setattr(library, "pair_scores", lambda q, s, metric: scored.append(len(q)) or own(q, s, metric))
    monkeypatch.setattr(library, "dense_scores", None)
    for metric in ("cosine", "euclidean"):
        scored.clear()
        best = nearest.Best(asked, 5, False)
        library.dense_finder(metric, 0.0)(r, np.arange(len(r)), np.zeros(len(r), int), 5, True)(r[:asked], np.arange(asked), best)
        assert 5 * asked <= sum(scored) < 0.02 * asked * len(r)


@pytest.mark.parametrize("shape", [(1, 1), (3, 21), (5, 64), (7, 130)])
def test_flags_that_are_set_are_found(shape):
    """F3 to F20: few of many pairs are found by their flags, whatever the tile's shape."""
    flags = np.random.default_rng(1).random(shape) < 0.1
    for f in (flags, ~flags, np.zeros(shape, bool), np.ones(shape, bool)):
        for x, y in zip(nearest.reached(f), np.nonzero(f)):
            assert np.array_equal(x, y)


@pytest.mark.parametrize("width", [64, 200])
def test_tiles_are_compared_once(width, monkeypatch):
    """F3 to F20: a tile's bounds are compared with its values in one pass, without the greatest of every segment, and lose nothing."""
    monkeypatch.setattr(nearest, "candidates", None)
    rng = np.random.default_rng(6)
    r, ids, labels = rng.standard_normal((5000, width)), rng.permutation(5000), rng.integers(0, 4, 5000)
    for metric in library.METRICS:
        mine, all_pairs = (nearest.Best(600, 4, False) for _ in range(2))
        library.dense_finder(metric, 0.0)(r, ids, labels, 4, True)(r[:600], ids[:600], mine)
        library._scored(r, ids, labels, 4, lambda a, b, m=metric: library.dense_scores(a, b, m, 0.0), False, True)(r[:600], ids[:600], all_pairs)
        assert np.array_equal(mine.scores, all_pairs.scores) and np.array_equal(mine.ids, all_pairs.ids)


def met(one, two, k, metric):
    """What two blocks find among each other and themselves: (rows, best) of both."""
    pairs = lambda q, r: library.pair_scores(q, r, metric)
    stored = [nearest.Others(*b, metric, pairs) for b in (one, two)]
    found = [nearest.Best(len(s.ids), k, False) for s in stored]
    for s, best in zip(stored, found):
        s.meet(s, best, best, s.floor(k), s.floor(k))
    stored[0].meet(stored[1], *found, *(best.scores[:, -1].copy() for best in found))
    return [*zip(stored, found)]


@pytest.mark.parametrize("kind,width,n", [("normal", 64, 5000), ("grid", 3, 700), ("close", 20, 300), ("scales", 8, 700), ("tiny", 16, 300), ("normal", 130, 5), ("grid", 16, 2000)])
def test_blocks_that_meet_lose_nothing(kind, width, n):
    """F9 to F19: a pair that is looked at once, for both of its vectors, gives the scores and ties of all pairs; copies and equal ids too."""
    rng = np.random.default_rng(n + width)
    r, ids, labels = rows(rng, kind, n, width), rng.permutation(n) * 7 - 3, rng.integers(0, 4, n)
    r[n // 2], ids[n - 1] = r[0], ids[0]
    cut = 2 * n // 3
    for metric in ("cosine", "euclidean"):
        for s, best in met((r[:cut], ids[:cut], labels[:cut]), (r[cut:], ids[cut:], labels[cut:]), 4, metric):
            all_pairs = nearest.Best(len(s.ids), 4, False)
            library._scored(r, ids, labels, 4, lambda a, b, m=metric: library.dense_scores(a, b, m, 0.0), False, True)(s.r, s.ids, all_pairs)
            assert np.array_equal(best.scores, all_pairs.scores)
            for x, y in ((best.ids, all_pairs.ids), (best.labels, all_pairs.labels)):
                assert np.array_equal(x[best.scores > -np.inf], y[best.scores > -np.inf])


def test_pairs_are_looked_at_once(monkeypatch):
    """F9 to F19: a search of all among all makes about half of all products, and scores few pairs."""
    n, products, scored = 12_000, [], []
    own, multiply = library.pair_scores, np.matmul
    monkeypatch.setattr(library, "pair_scores", lambda q, s, metric: scored.append(len(q)) or own(q, s, metric))
    monkeypatch.setattr(nearest.np, "matmul", lambda a, b, out: products.append(out.size) or multiply(a, b, out=out))
    r = np.random.default_rng(7).standard_normal((n, 64))
    half = [(r[a : a + n // 2], np.arange(a, a + n // 2), np.zeros(n // 2, int)) for a in (0, n // 2)]
    met(*half, 5, "euclidean")
    assert n * n / 2 < sum(products) < 0.55 * n * n and sum(scored) < 0.02 * n * n


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("odd", [None, 1e200])
def test_vectors_among_themselves(spark, metric, odd, monkeypatch):
    """F9 to F19: blocks in tasks of their own find what a search of all against all finds, also where single precision bounds nothing; the searches of the queries are of this kind."""
    v = np.random.default_rng(8).integers(-9, 9, (900, 5)).astype(float)
    if odd is not None:
        v[17, 2] = odd
    refs = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)], "ref_id bigint, vector array<double>, label bigint")
    told = library.top_k(refs.withColumnRenamed("ref_id", "query_id").drop("label"), refs, 4, metric, exclude_self=True)
    names = ["query_id", "rank", "ref_id", "label", "score"]
    told = sorted(tuple(map(str, r)) for r in told.select(*names).collect())
    monkeypatch.setattr(library, "MANY_PAIRS", 1)
    monkeypatch.setattr(library, "LEAST_BLOCK", 250)
    monkeypatch.setattr(library, "top_k", None)
    mine = library.nearest_others(refs, 4, metric)
    assert sorted(tuple(map(str, r)) for r in mine.select(*names).collect()) == told
    if odd is None:
        assert base.neighbors(spark, "/root/testdata/sf0.001", metric).count() == 500 * 5


def test_few_pairs_of_genomes_get_scores(monkeypatch):
    """F1 and F6: of the pairs of a population, few are scored, and what it compares with is prepared once for all queries of a share."""
    rng = np.random.default_rng(5)
    q, r, scored, prepared = rng.standard_normal((300, 64)), rng.standard_normal((20_000, 64)), [], []
    plain, bits = nearest.blended, nearest.Bits
    monkeypatch.setattr(nearest, "blended", lambda w: lambda both, *x: scored.append(both.size) or plain(w)(both, *x))
    monkeypatch.setattr(nearest, "Bits", lambda *x: prepared.append(1) or bits(*x))
    genomes = [{"genome": i, "k": 3, "threshold": 0.1 * (i % 2), "weight": i / 4, "blocks": 0xFFFF} for i in range(4)]
    assert len([*population.neighbours(genomes, q, np.arange(len(r)), np.zeros(len(r), int), r)]) == 4
    assert sum(scored) < 0.03 * 4 * len(q) * len(r) and len(prepared) == 2


def test_many_pairs_are_dealt_out(spark, monkeypatch):
    """A table in one part is searched by all cores, and what was found is stored for all that reads it."""
    v = spark.range(900).selectExpr("id AS query_id", "array(cast(id % 37 AS double), cast(id % 11 AS double)) AS vector").coalesce(1)
    refs = v.selectExpr("query_id AS ref_id", "vector", "query_id % 3 AS label")
    few = library.top_k(v, refs, 4, exclude_self=True)
    monkeypatch.setattr(library, "MANY_PAIRS", 1)
    for block in (1 << 17, 250):
        monkeypatch.setattr(library, "BLOCK", block)
        seen = []
        spread = type(v).repartition
        monkeypatch.setattr(type(v), "repartition", lambda df, n, *c: seen.append(n) or spread(df, n, *c))
        many = library.top_k(v, refs, 4, exclude_self=True)
        monkeypatch.setattr(type(v), "repartition", spread)
        assert seen == [2 * spark.sparkContext.defaultParallelism]
        assert sorted(map(tuple, many.select(*few.columns).collect())) == sorted(map(tuple, few.collect()))
