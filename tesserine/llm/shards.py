"""Sharding: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import bucket_count, exact_rank
from .store import materialize, plain_names, read_table


def interleave_shards(rows: DataFrame, shards: int, key: str = "doc_id", stratum: str = "source", seed: int = 17) -> DataFrame:
    """Deal rows out so that every shard has the mixture of strata that the whole table has.

    Rows are shuffled within each stratum by a seeded digest of ``key``; a row
    with rank r of the n in its stratum stands at the fraction (2r - 1) / 2n;
    all rows are ordered by that fraction and cut into ``shards`` runs whose
    counts differ by one at most. Adds ``shard`` and ``slot`` (both long, slot
    gapless from 0); the caller's columns of these names are replaced, all
    others stay, whatever their names.

    Null strata form one stratum, null keys sort first. Rows that repeat are
    placed one by one. An empty table stays empty; with fewer rows than
    shards, some shards are empty. Texts are values like others. Keep
    ``rows`` slim: it is shuffled twice.
    """
    true = rows.drop("shard", "slot")
    rows, names = plain_names(true)
    key, stratum = names[key], names[stratum]
    spread = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    own = rows.columns
    total = rows.count()
    buckets = bucket_count(total)
    rows = rows.select(
        "*",
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("__stratum"),
        spread.alias("__spread"),
    ).withColumn("__bucket", F.floor(F.conv(F.substring("__spread", 1, 8), 16, 10).cast("long") * buckets / F.lit(2.0**32)))
    sizes = rows.groupBy("__stratum").agg(F.count(F.lit(1)).alias("__of"))
    ties = ["__spread", *(F.col(c) for c in own if not rows.schema[c].dataType.typeName().startswith("map"))]
    inner = exact_rank(rows, ["__stratum"], "__bucket", ties, "__rank").join(sizes, "__stratum")
    inner = inner.withColumn("__at", (2 * F.col("__rank") + 1).cast("double") / (2 * F.col("__of")).cast("double")).drop("__bucket")
    inner = materialize(inner.withColumn("__bucket", F.floor(F.col("__at") * buckets)), "interleaved")
    dealt = exact_rank(inner, [], "__bucket", ["__at", *ties], "__place")
    shard = F.floor(F.col("__place") * shards / F.lit(max(total, 1))) if total * shards < 2**52 else F.expr(f"__place * {shards} div {total}")
    dealt = dealt.withColumn("shard", shard.cast("long"))
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return dealt.withColumn("slot", F.col("__place") - first).select(*own, "shard", "slot").toDF(*true.columns, "shard", "slot")


def write_shards(rows: DataFrame, path: str, shards: int, **options) -> None:
    """Write the rows themselves, one folder per shard, in the order of their slots."""
    dealt = interleave_shards(rows, shards, **options)
    dealt.repartitionByRange(max(1, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``; a null text has size 1 and the checksum of an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return interleave_shards(slim, 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


#: The checksum is folded over the bytes with the table of its polynomial, which the query builds.
OP1_SQL = """
WITH poly AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END)) AS t
), d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS spread FROM documents
), c AS (
  SELECT doc_id, source, spread, octet_length(encode(text))::BIGINT + 1 AS size,
    xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) AS text_crc32
  FROM d, poly
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY spread, doc_id NULLS FIRST, source, size, text_crc32) AS k,
    count(*) OVER (PARTITION BY source) AS n FROM c
), f AS (SELECT *, (2 * k - 1)::DOUBLE / (2 * n)::DOUBLE AS place_in FROM r
), p AS (
  SELECT *, row_number() OVER (ORDER BY place_in, spread, doc_id NULLS FIRST, source NULLS FIRST, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM f
), s AS (SELECT *, place * 16 // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * total + 15) // 16)::BIGINT AS slot,
  NULL::INT AS grown_shard, source FROM s
"""
