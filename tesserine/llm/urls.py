"""URL filters by hashed expressions, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import lower_ascii
from .store import materialize, plain_names, read_table, true_names

#: (host, path, verdict) of the production rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Hexadecimal digits of the short prefix that expressions and rules are joined on, as a number.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null url or one without ``://``."""
    parts = F.split(url, "://", 2)
    rest = F.when(F.size(parts) == 2, F.get(parts, F.lit(1)))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def short_prefix(full: Column) -> Column:
    return F.conv(F.substring(full, 1, SHORT), 16, 10).cast("long")


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digests and how deep they go. Of equal rules, ``block`` wins; rules with a null are left out."""
    full = rules.dropna(subset=["host", "path", "verdict"])
    once = full.groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("verdict"))
    named = once.withColumn("rule", F.concat("host", "path")).withColumn("digest", digest(F.concat("host", F.lit("\n"), "path")))
    shape = {
        "host_chars": F.char_length("host").cast("long"),
        "labels": F.size(F.split("host", r"\.", -1)),
        "slashes": F.size(F.split("path", "/", -1)) - 1,
        "slashed": F.endswith("path", F.lit("/")),
        "path_chars": F.char_length("path"),
    }
    return named.select(short_prefix(F.col("digest")).alias("short"), "digest", "rule", "verdict", *(v.alias(k) for k, v in shape.items()))


def expressions(host: Column, path: Column, labels: int, slashes: int, lengths: list[int]) -> Column:
    """The (host suffix, path prefix) pairs that a rule can have: suffixes of up to ``labels`` labels, prefixes up to each of the first ``slashes`` slashes and of each length in ``lengths``."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(n - labels + 1, F.lit(1)), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    steps = F.split(path, "/", slashes + 1)  # what is behind the last slash that counts stays whole
    ups = F.size(steps) - 1
    to_slash = F.when(ups > 0, F.transform(F.sequence(F.lit(1), F.greatest(ups, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))))
    prefixes = F.coalesce(to_slash, F.array().cast("array<string>")) if slashes else F.array().cast("array<string>")
    if lengths:
        sizes = F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.char_length(path))
        prefixes = F.array_union(prefixes, F.transform(sizes, lambda k: F.substring(path, F.lit(1), k)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``__host``, ``__path``, ``__rule`` and ``__verdict`` to each row.

    A rule fits its host and all subdomains, if the path starts with the
    rule's; of the rules that fit, the longest (then the one with the longer
    host) decides; where none fits, the rule is null and the verdict
    ``allow``. Each distinct url is expanded once; short prefixes of the
    digests are joined, full digests confirm. Null urls and those without
    ``://`` have an empty host and path, and no rule. Rows that repeat keep
    their rows; other columns stay, whatever their names. An empty table
    stays empty; without rules all is allowed. The planner broadcasts rules,
    or verdicts, only if their size allows it.

    A url is expanded no deeper than the deepest rule, so a long one costs no
    more than its length. Rules whose path ends in no slash add their paths'
    lengths, at most as many as there are lengths, to the prefixes tried.
    """
    plain, names = plain_names(urls)
    url = names[url]
    table = materialize(compile_rules(rules), "rules")
    deepest = table.agg(F.max("labels").alias("labels"), F.max("slashes").alias("slashes"), F.collect_set(F.when(~F.col("slashed"), F.col("path_chars"))).alias("lengths")).first()
    host, path = host_and_path(F.col("__url"))
    once = plain.select(F.col(url).alias("__url")).where(F.col("__url").contains("://")).distinct()
    pairs = expressions(host, path, deepest["labels"] or 1, deepest["slashes"] or 0, sorted(deepest["lengths"]))
    tried = once.select("__url", F.explode(pairs).alias("e")).withColumn("e", digest(F.col("e")))
    met = tried.withColumn("s", short_prefix(F.col("e"))).join(table, F.col("s") == table["short"])
    confirmed = F.when(F.col("e") == F.col("digest"), F.struct(F.char_length("rule"), "host_chars", "rule", "verdict"))  # not in a filter, which would become part of the join
    best = met.groupBy(F.col("__url").alias("__of")).agg(F.max(confirmed).alias("__best"))
    host, path = host_and_path(F.col(url))
    added = {"__host": host, "__path": path, "__rule": F.col("__best.rule"), "__verdict": F.coalesce("__best.verdict", F.lit("allow"))}
    joined = plain.join(best, F.col(url) == F.col("__of"), "left")
    return joined.select(*true_names(names, added), *(v.alias(k) for k, v in added.items()))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = judge_urls(pages, rules)
    return judged.select("page_id", *(F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


OP10_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), f AS (
  SELECT p.r, max_by(struct_pack(rule := rules.host || rules.path, verdict := rules.verdict), length(rules.host || rules.path)) AS best
  FROM p JOIN rules ON (p.host = rules.host OR suffix(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY p.r
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (r)
"""
