"""SQL texts against the DataFrame forms."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserine.functions import vectors as V
from tesserine.operators import images, library
from tesserine.plans.sqlforms import Nearest, nearest_others, nearest_sql, register
from tesserine.queries import sqlforms as queries


def table(spark, rng, n, key):
    return spark.createDataFrame([(i, [float(rng.randint(0, 4)) for _ in range(5)], rng.randint(0, 2)) for i in range(n)], f"{key} bigint, vector array<double>, label bigint")


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "hamming", "jaccard"])
def test_nearest(spark, metric):
    """Ties to the smaller id, whatever part a stored vector is in; more neighbours asked for than there are; nobody asked."""
    rng = random.Random(3)
    asked, stored = table(spark, rng, 40, "query_id").drop("label"), table(spark, rng, 70, "ref_id")
    register(spark, asked=asked, stored=stored, nobody=asked.limit(0))
    for k, parts in ((3, 4), (100, 2), (1, 1)):
        mine = spark.sql(nearest_sql("asked", "stored", k, metric, 1.5, parts)).select("query_id", "rank", "ref_id", "label", "score")
        theirs = library.top_k(asked, stored, k, metric, 1.5).select(*mine.columns)
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect()))
    assert spark.sql(nearest_sql("nobody", "stored", 3)).count() == 0


def test_functions(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    register(spark, rows=rows)
    mine = spark.sql("SELECT vector_euclidean(a, b) AS e, vector_cosine(a, b) AS c, vector_hamming(a, b, 1.5D) AS h FROM rows")
    theirs = rows.select(V.euclidean_similarity(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.dense_hamming(F.col("a"), F.col("b"), 1.5))
    assert [*map(tuple, mine.collect())] == [*map(tuple, theirs.collect())]
    told = spark.sql("SELECT unit_position(x, 0D, 4D) AS p, hard_interval(unit_position(x, 0D, 4D), 4) AS i, unit_position(x, 1D, 1D) AS none FROM VALUES (-1D), (1D), (4D), (double('NaN')), (double('Infinity')) AS t(x)").collect()
    assert [tuple(r) for r in told] == [(0.0, 0, 0.0), (0.25, 1, 0.0), (1.0, 3, 0.0), (0.0, 0, 0.0), (0.0, 0, 0.0)]
    plan = spark.sql("SELECT vector_cosine(a, b) FROM rows")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_patches_of_images(spark):
    rng = np.random.default_rng(4)
    made = [(i, (f"p{i}", h, w, 3, 16, bytearray(rng.integers(0, 255, h * w * 3, dtype=np.uint8)))) for i, (h, w) in enumerate(((9, 12), (4, 4), (20, 7)))]
    rows = spark.createDataFrame(made, "image_id bigint, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>")
    register(spark, pictures=rows)
    mine = spark.sql("SELECT image_id, x, y, w, h, vector FROM image_patches(4, 'rich', 'stretch', 5, 3, TABLE(pictures) PARTITION BY (image_id))").collect()
    theirs = images.vectorize_patches(rows, images.VectorConfig(4, 4, "rich"), 5, 3).collect()
    assert sorted(map(tuple, mine)) == sorted(map(tuple, theirs))
    grid = spark.sql("SELECT image_id, x, y, w, h FROM patches(5, 3, TABLE(SELECT image_id, CAST(image.width AS BIGINT) AS width, CAST(image.height AS BIGINT) AS height FROM pictures) PARTITION BY (image_id))")
    assert sorted(map(tuple, grid.collect())) == sorted(tuple(r)[:5] for r in theirs)


def test_bad_calls(spark):
    register(spark, one=spark.createDataFrame([(1, 8, 8)], "image_id bigint, width bigint, height bigint"))
    with pytest.raises(Exception, match="must be positive"):
        spark.sql("SELECT * FROM patches(0, 3, TABLE(one) PARTITION BY (image_id))").collect()


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_nearest_others(spark, metric):
    """all against all in blocks that meet once, as the DataFrame form has it; ties, one block, and k beyond what there is."""
    rng = random.Random(5)
    stored = table(spark, rng, 90, "ref_id")
    columns = ["query_id", "rank", "ref_id", "label", "score"]
    for k, g in ((3, 4), (100, 3), (2, 1)):
        mine = nearest_others(spark, stored, k, metric, g).select(*columns)
        theirs = library.nearest_others(stored, k, metric).select(*columns)
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect()))


def test_large_searches_meet_in_blocks(spark, sf_dir, monkeypatch):
    """where vectors are many, the queries search them among themselves, with the same rows."""
    for name, query in (("euclidean", queries.QUERIES["sql_nearest_euclidean"]), ("cosine", queries.QUERIES["sql_nearest_cosine"])):
        few = query(spark, sf_dir)
        with monkeypatch.context() as m:
            m.setattr(library, "MANY_PAIRS", 1)
            m.setattr(library, "LEAST_BLOCK", 16)
            many = query(spark, sf_dir)
        assert "nearest_met" in many._jdf.queryExecution().toString() and "nearest_met" not in few._jdf.queryExecution().toString()
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())), name


def test_a_part_scores_few_pairs(monkeypatch):
    """F1, F2: a part of the table function scores few of its pairs in full."""
    rng, scored = np.random.default_rng(6), []
    own = library.pair_scores
    monkeypatch.setattr(library, "pair_scores", lambda q, s, metric: scored.append(len(q)) or own(q, s, metric))
    monkeypatch.setattr(library, "dense_scores", None)
    part = Nearest()
    for side, n in (("ref", 9000), ("query", 50)):
        vectors = pa.array(list(rng.standard_normal((n, 16))), pa.list_(pa.float64()))
        rows = pa.RecordBatch.from_arrays([pa.array([side] * n), pa.array(range(n)), pa.array([1] * n), vectors], names=["side", "id", "label", "vector"])
        list(part.eval(pa.array([3]), pa.array(["cosine"]), pa.array([0.0]), rows))
    assert sum(t.num_rows for t in part.terminate()) == 150 and sum(scored) < 0.05 * 50 * 9000
