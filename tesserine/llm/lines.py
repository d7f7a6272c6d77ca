"""Line dedup with built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, plain_names, read_table, true_names

BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else kept; ``lower`` does that alone where all characters are ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _document(doc_id: str, text: str) -> list[Column]:
    """What tells a row from others: its id and its text's hash, so that rows that share an id are still treated one by one."""
    return [F.col(doc_id).alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__hash")]


def long_lines(docs: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The lines that could be dropped: document, position, and a 128-bit hash of the normalised line."""
    lines = F.split(lower_ascii(F.col(text)), "\n", -1)
    exploded = docs.select(*_document(doc_id, text), F.posexplode(lines).alias("__pos", "__raw"))
    kept = exploded.withColumn("__line", F.btrim("__raw", F.lit(BLANKS))).where(F.char_length("__line") >= min_chars)
    return kept.select("__id", "__hash", "__pos", F.xxhash64("__line").alias("__h1"), F.xxhash64(F.lit(1), "__line").alias("__h2"))


def dropped_positions(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document that loses lines, the sorted positions of these lines."""
    lines = long_lines(docs, min_chars, doc_id, text)
    often = lines.groupBy("__h1", "__h2").agg(F.count_distinct("__id").alias("__docs"), F.max("__id").alias("__keeper"))
    often = materialize(often.where(F.col("__docs") >= min_docs).drop("__docs"), "lines")
    lost = lines.join(often, ["__h1", "__h2"]).where(~F.col("__id").eqNullSafe(F.col("__keeper")))
    return lost.groupBy("__id", "__hash").agg(F.collect_set("__pos").alias("__lost"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop, from all documents but one, the lines that at least ``min_docs`` documents have.

    Lines are compared with ASCII white space stripped and A-Z lower-cased;
    only those of ``min_chars`` code points or more count. The largest id
    keeps them, as often as it has them. Adds ``__n_lines``, ``__n_dropped``
    and ``__kept_text``; all other columns stay, whatever their names.

    A null or empty text is one empty line. Rows that share an id are one
    document in the count; rows with a null id count for none and lose
    their frequent lines. An empty table stays empty. Texts of any length are
    split whole. A frequent line's rows are counted before the shuffle, and
    the join on its hash can be split, so no line is too common. Each text is
    moved once, to its lost positions, by the same join at every size.
    """
    docs, names = plain_names(docs)
    doc_id, text = names[doc_id], names[text]
    lost = materialize(dropped_positions(docs, min_chars, min_docs, doc_id, text), "lost").hint("merge")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("__lines", F.split(body, "\n", -1))
    keys = docs[doc_id].eqNullSafe(lost["__id"]) & (F.xxhash64(body) == lost["__hash"])
    rows = rows.join(lost, keys, "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col("__lines"), i)), "\n")
    added = {
        "__n_lines": F.size("__lines").cast("long"),
        "__n_dropped": F.coalesce(F.size("__lost"), F.lit(0)).cast("long"),
        "__kept_text": F.when(F.col("__lost").isNull(), body).otherwise(kept),
    }
    return rows.select(*true_names(names, added), *(v.alias(k) for k, v in added.items()))


def drop_lines(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with their frequent lines gone, and the columns they came with; a null text stays null."""
    plain, names = plain_names(docs)
    options = {k: names[v] if k == "doc_id" else v for k, v in ({"doc_id": "doc_id"} | options).items()}
    rows = dedup_lines(plain, text=names[text], **options)
    kept = F.when(F.col(names[text]).isNotNull(), F.col("__kept_text")).alias(names[text])
    return rows.select(*(kept if c == names[text] else F.col(c) for c in plain.columns)).toDF(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and the digest of what stays, for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2("__kept_text", 256).alias("kept_sha256"),
    )


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
), k AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), f AS (SELECT l.*, keeper IS NOT NULL AND keeper <> doc_id AS lost FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
