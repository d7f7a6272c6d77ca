"""Libraries that grow by batches and streams, against one table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserine.errors import ConfigError, DimensionError
from tesserine.operators import growing, library


def table(spark, rng, ids, key="ref_id"):
    return spark.createDataFrame([(i, rng.randint(0, 2), [float(rng.randint(0, 5)) for _ in range(4)]) for i in ids], f"{key} bigint, label bigint, vector array<double>")


def top(rows):
    return sorted(tuple(r) for r in rows.select("query_id", "rank", "ref_id", "label", "score").collect())


def test_a_stream_of_batches_is_one_table(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    parts = [table(spark, rng, ids) for ids in (range(0, 30), range(30, 60))]
    queries = table(spark, rng, range(12), "query_id").drop("label")
    whole = top(library.top_k(queries, parts[0].union(parts[1]), 4))
    grown = growing.GrowingLibrary(spark, f"{tmp_path}/lib")
    near = growing.Neighbours(grown, f"{tmp_path}/near", queries, 4)
    assert near.update().count() == 0
    searched, true = [], growing.top_k
    monkeypatch.setattr(growing, "top_k", lambda q, r, *a, **k: searched.append(r.count()) or true(q, r, *a, **k))
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(parts[0].schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(grown.appender("s"))
        stream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        rows = near.update()
    assert top(rows) == whole and grown.version == 2 and searched == [30, 30]
    # Replays, of batches and of updates, change nothing.
    assert grown.append(parts[0], "s-0") == 1 and grown.version == 2
    assert top(near.update()) == whole and searched == [30, 30]
    assert top(growing.Neighbours(growing.GrowingLibrary(spark, f"{tmp_path}/lib"), f"{tmp_path}/near", queries, 4).update()) == whole
    assert sorted(map(tuple, grown.read(1).select("ref_id").collect())) == [(i,) for i in range(30, 60)]


def test_what_a_failed_run_has_left_is_not_read(spark, tmp_path):
    rng = random.Random(1)
    grown = growing.GrowingLibrary(spark, f"{tmp_path}/lib")
    table(spark, rng, range(5)).write.parquet(f"{tmp_path}/lib/data/1")
    assert grown.version == 0 and grown.read().count() == 0
    assert grown.append(table(spark, rng, range(7, 9)), "a") == 1
    assert [r.ref_id for r in grown.read().orderBy("ref_id").collect()] == [7, 8]


def test_refused_batches(spark, tmp_path):
    rng = random.Random(1)
    grown = growing.GrowingLibrary(spark, f"{tmp_path}/lib")
    assert grown.append(table(spark, rng, range(3)).limit(0)) == 0
    assert grown.append(table(spark, rng, range(3))) == 1
    wrong = spark.createDataFrame([(9, 0, [1.0, 2.0])], growing.REFS)
    for bad in (wrong, wrong.union(table(spark, rng, range(9, 10))), wrong.withColumn("vector", F.lit(None).cast("array<double>"))):
        with pytest.raises(DimensionError):
            grown.append(bad)
    assert grown.append(table(spark, rng, range(3)).limit(0)) == 1 and grown.version == 1
    with pytest.raises(ConfigError):
        grown.commit(table(spark, rng, range(1)), None, 4, 1, 1)
