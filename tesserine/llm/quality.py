"""Quality rules: text rules per document, verdicts per host under an empirical beta prior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .store import materialize, plain_names, read_table
from .words import give_back

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: A host is rejected for a rule if its rate lies, with the one-sided certainty of SURE standard deviations of the
#: posterior, further than HALFWAY from the prior's mean to 1.
HALFWAY, SURE = 0.5, 1.645
#: Rules, as conditions on the measures; the first two also reject a document by themselves.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbolic": "10 * n_symbols > word_chars",
    "duplicated": "n_dup_lines > 0 and 2 * n_dup_lines > n_lines",
}
BASE = ("short", "repetitive")


def repeated_words(words: list[bytes]) -> int:
    """The words in windows of three that are found twice or more. Windows are numbers made of their words' numbers, and are compared by sorting."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n = len(known)
    if len(ids) < 4 or n == len(ids):
        return 0
    pairs = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 21:  # three numbers don't fit a long
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, counts = np.unique(pairs * n + ids[2:], return_inverse=True, return_counts=True)
    often = counts[at] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : len(often) + i] |= often
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, and its number of lines that have a word. bytes.split() splits at exactly the ASCII white space."""
    if not text:
        return (0,) * 6
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = repeated_words(words)
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines)


@arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in (*MEASURES, "n_lines")]))
def _measures(texts: pa.Array) -> pa.Array:
    columns = [*zip(*(measure(t.as_py()) for t in texts))] if len(texts) else [[]] * 6
    give_back()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*MEASURES, "n_lines"])


def measured(docs: DataFrame, text: str = "text", out: str = "__m") -> DataFrame:
    """Add the struct ``out`` of measures; only the text goes to Python."""
    return docs.withColumn(out, _measures.asNondeterministic()(F.col(text)))


def _broken(rule: str, struct: str):
    condition = RULES[rule]
    for name in (*MEASURES, "n_lines"):
        condition = condition.replace(name, f"{struct}.{name}")
    return F.expr(condition)


def base_failed(struct: str = "__m"):
    return _broken(BASE[0], struct) | _broken(BASE[1], struct)


def host_verdicts(measures: DataFrame, host: str = "source", struct: str = "__m") -> DataFrame:
    """One row per host: its count of documents, of failures by rule, the shrunk rates, and ``host_ok``.

    For each rule, a beta prior is fitted to the rates of all hosts by
    moments: its mean m is the share of all documents that fail, its
    strength s comes from the spread of hosts' rates, weighted by their
    documents, beyond what sampling explains. A host's rate is
    (failures + m s) / (documents + s), the mean of its posterior. The host
    is rejected if for some rule the rate less SURE of the posterior's
    standard deviations is above m + HALFWAY (1 - m): if it is nearly certain
    that the host is nearer to breaking the rule always than to what is
    usual. So few documents condemn no host, and a rule that most hosts
    break condemns none.

    Null hosts have no row; without hosts the table is empty. Hosts with
    equal counts are judged alike. Counts are brought together before the
    shuffle, so no host is too large.
    """
    counts = measures.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.count_if(_broken(r, struct)).alias(f"n_{r}") for r in RULES)
    )
    counts = materialize(counts, "hosts")
    n = F.col("n_docs")
    first = counts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares"), *(F.sum(f"n_{r}").alias(r) for r in RULES)
    ).first()
    if not first["hosts"]:
        return counts.withColumns({**{f"rate_{r}": F.lit(0.0) for r in RULES}, "host_ok": F.lit(True)})
    docs, hosts = first["docs"], first["hosts"]
    mean = {r: first[r] / docs for r in RULES}
    spread = counts.agg(*(F.sum(n * F.pow(F.col(f"n_{r}") / n - mean[r], 2)).alias(r) for r in RULES)).first()
    rates, excess = {}, []
    for r in RULES:
        m, strength = mean[r], float(docs)
        noise = (hosts - 1) * m * (1 - m)
        share = docs - first["squares"] / docs
        between = (spread[r] - noise) / share if share > 0 else 0.0
        if between > 0:
            strength = max(1.0, m * (1 - m) / between - 1)
        rate = (F.col(f"n_{r}") + m * strength) / (n + strength)
        rates[f"rate_{r}"] = rate
        excess.append(rate - SURE * F.sqrt(rate * (1 - rate) / (n + strength + 1)) - (m + HALFWAY * (1 - m)))
    return counts.withColumns({**rates, "host_ok": F.greatest(*excess) <= 0})


def apply_host_verdicts(rows: DataFrame, verdicts: DataFrame, host: str = "source", struct: str = "__m") -> DataFrame:
    """Join the hosts' verdicts back: adds ``__base_failed`` and ``__kept``. Rows without a host keep their own verdict."""
    told = materialize(verdicts.select(F.col("host").alias("__host"), F.col("host_ok").alias("__host_ok")), "verdicts")
    joined = rows.join(told, F.col(host) == F.col("__host"), "left")
    failed = base_failed(struct)
    return joined.withColumns({"__base_failed": failed, "__kept": ~failed & F.coalesce("__host_ok", F.lit(True))}).drop("__host", "__host_ok")


def filter_quality(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that the rules keep, with the columns they came with, of any names.

    Null and empty texts have no words and fail. Texts of any length are
    measured whole; rows that repeat are judged alike; rows with a null host
    keep their own verdict. An empty table stays empty. The measures are
    taken twice, once for the hosts and once for the filter, so that no text
    is shuffled or stored.
    """
    plain, names = plain_names(docs)
    seen = measured(plain.select(F.col(names[text]).alias("__t"), F.col(names[host]).alias("__h")), "__t").drop("__t")
    verdicts = host_verdicts(seen, "__h")
    kept = apply_host_verdicts(measured(plain, names[text]), verdicts, names[host]).where("__kept")
    return kept.select(*plain.columns).toDF(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; the host is its source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = materialize(measured(docs).drop("text"), "measures")
    judged = apply_host_verdicts(rows, host_verdicts(rows))
    return judged.select("doc_id", *(F.col(f"__m.{m}").alias(m) for m in MEASURES), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT r, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS found FROM (
    SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE found > 1) GROUP BY r
), m AS (
  SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)
), f AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive, 10 * n_symbols > word_chars AS symbolic,
    n_dup_lines > 0 AND 2 * n_dup_lines > n_lines AS duplicated FROM m
), h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(broken::INT)::DOUBLE AS k FROM (
    SELECT source, unnest(['s', 'r', 'y', 'd']) AS rule, unnest([short, repetitive, symbolic, duplicated]) AS broken FROM f
  ) WHERE source IS NOT NULL GROUP BY 1, 2
), t AS (SELECT rule, sum(k) / sum(n) AS m, count(*) AS hosts, sum(n) AS docs, sum(n * n) AS squares FROM h GROUP BY 1
), v AS (
  SELECT t.*, CASE WHEN docs - squares / docs > 0 THEN (s - (hosts - 1) * m * (1 - m)) / (docs - squares / docs) ELSE 0 END AS between
  FROM t JOIN (SELECT h.rule, sum(n * (k / n - m) ** 2) AS s FROM h JOIN t USING (rule) GROUP BY 1) USING (rule)
), p AS (SELECT rule, m, CASE WHEN between > 0 THEN greatest(1, m * (1 - m) / between - 1) ELSE docs END AS s FROM v
), g AS (SELECT source, rule, m, n, s, (k + m * s) / (n + s) AS rate FROM h JOIN p USING (rule)
), ok AS (SELECT source, max(rate - 1.645 * sqrt(rate * (1 - rate) / (n + s + 1)) - (m + 0.5 * (1 - m))) <= 0 AS host_ok FROM g GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
  NOT (short OR repetitive) AND coalesce(host_ok, true) AS kept
FROM f LEFT JOIN ok USING (source)
"""
