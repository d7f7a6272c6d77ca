"""Secret scans over a ledger of blobs, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, new_path, plain_names, read_table

#: Names that a secret is assigned to, in either case of ASCII letters alone: engines differ in what else they take for one.
NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
#: Of each kind, in the order of the digest: pattern, the group whose length counts, and its least length.
#: Runs of a class are maximal, so hex and access put the least length into the pattern; for assign a match that
#: is too short still uses up its characters, so it is found first and dropped then.
RULES = {
    "assign": (r"""(""" + NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
RULE_VERSION = 1
SPAN = "struct<start: bigint, rank: int, end: bigint>"
LEDGER = f"blob string, rule_version int, spans array<{SPAN}>"
#: A text with more copies than one of so many rows is scanned ahead of the others; fewer copies than FEW never are.
SHARE, FEW = 1024, 64
#: Values of a running total that are added up at once, and code points that a text is cut into to be copied in parts.
STEP, CHUNK = 64, 512


def blob_id(text: Column) -> Column:
    """The content address of a version: SHA-256 of its UTF-8 bytes; a null text is an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, fold: Callable[[Column, Column], Column], use: Callable[[Column, Column, Callable[[Column], Column]], Column]) -> Column:
    """``use(values, n, before)`` of an array of longs, before(i) being the fold of 0 and the first i values.

    Folds of STEP values, and of STEP of these, are made once; so the work
    for each value hardly grows with their number.
    """
    zero = F.lit(0).cast("long")
    folded = lambda xs: F.aggregate(xs, zero, fold)
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STEP).cast("int")), lambda b: folded(F.slice(xs, b * STEP + 1, F.lit(STEP))))

    def before(xs: Column, ones: Column, twos: Column) -> Callable[[Column], Column]:
        def at(i: Column) -> Column:
            one, two = F.floor(i / STEP).cast("int"), F.floor(i / STEP**2).cast("int")
            return fold(
                fold(folded(F.slice(twos, F.lit(1), two)), folded(F.slice(ones, two * STEP + 1, one - two * STEP))),
                folded(F.slice(xs, one * STEP + 1, i - one * STEP)),
            )

        return at

    return bound(values, lambda xs: bound(blocks(xs), lambda ones: bound(blocks(ones), lambda twos: use(xs, F.size(xs), before(xs, ones, twos)))))


def _spans(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern's matches in code points, from the lengths of the matches and of the gaps between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    long_enough = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    lengths = lambda xs: F.transform(xs, lambda x: F.char_length(x).cast("long"))
    # Gap and match by turns; what follows the last match isn't needed.
    turns = F.flatten(F.zip_with(lengths(F.split(text, pattern, -1)), lengths(found), lambda gap, hit: F.array(gap, F.coalesce(hit, F.lit(0)))))

    def spans(xs: Column, n: Column, before: Callable[[Column], Column]) -> Column:
        sized = F.transform(long_enough, lambda x, i: F.struct(i.alias("i"), F.char_length(x).alias("chars")))
        right = F.filter(sized, lambda x: x["chars"] >= least)
        def span(x: Column) -> Column:
            start = before(2 * x["i"] + 1)
            return bound(start, lambda a: F.struct(a.alias("start"), F.lit(rank).alias("rank"), (a + F.get(xs, 2 * x["i"] + 1)).alias("end")))
        return F.transform(right, span)

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), running(turns, lambda a, b: a + b, spans)).otherwise(none)


def find_secrets(text: Column) -> Column:
    """All spans of a text, by start and then by kind."""
    return F.array_sort(F.concat(*(_spans(text, i, *rule) for i, rule in enumerate(RULES.values()))))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(body: Column, spans: Column, mark: str) -> Column:
    """A text with every run of overlapping spans replaced by ``mark``. The text is cut into chunks first, as places are slow to find in a long one."""
    chunks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def copied(cs: Column, a: Column, b: Column) -> Column:
        """The code points from a up to b."""
        first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        within = lambda c, x, y: F.substring(F.coalesce(F.get(cs, c), F.lit("")), (x + 1).cast("int"), (y - x).cast("int"))
        several = F.concat(
            within(first, a - first * CHUNK, F.lit(CHUNK).cast("long")),
            F.array_join(F.slice(cs, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            within(last, F.lit(0).cast("long"), b - last * CHUNK),
        )
        return F.when(first == last, within(first, a - first * CHUNK, b - first * CHUNK)).otherwise(several)

    def joined(ends: Column, n: Column, before: Callable[[Column], Column]) -> Column:
        placed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), before(i).alias("before")))
        runs = F.filter(placed, lambda x: x["start"] >= x["before"])
        return bound(
            chunks,
            lambda cs: F.concat(
                F.array_join(F.transform(runs, lambda x: F.concat(copied(cs, x["before"], x["start"]), F.lit(mark))), ""),
                copied(cs, before(n), F.char_length(body).cast("long")),
            ),
        )

    return running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), joined)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """The ledger's new rows: blob, rule_version, spans, one for each distinct blob that this rule version has not seen.

    ``ledger`` holds rows of the same form from earlier runs. Copies are
    scanned once, and brought together before the shuffle; texts are
    scanned whole.
    """
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs = blobs.join(known, "blob", "left_anti")
    once = blobs.groupBy("blob").agg(F.first("body").alias("body"))
    return once.select("blob", F.lit(rule_version).alias("rule_version"), find_secrets(F.col("body")).alias("spans"))


def append_unseen(versions: DataFrame, path: str, text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Scan what the ledger at a path hasn't seen, append that to it, and return the whole ledger. The first call makes it.

    The rows are written in one commit, so a run that fails leaves the ledger as it was.
    """
    spark = versions.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    known = spark.read.schema(LEDGER).parquet(path) if exists else None
    scan_unseen(versions, known, text, rule_version).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _findings(ledger: DataFrame, rule_version: int) -> DataFrame:
    """(__blob, __known) of the blobs that a rule version has seen, once each."""
    own = ledger.where(F.col("rule_version") == rule_version)
    return own.groupBy(F.col("blob").alias("__blob")).agg(F.first("spans").alias("__known"))


def join_findings(versions: DataFrame, ledger: DataFrame, text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """All versions with ``__blob`` and ``__spans``, from a ledger that has seen them.

    Every row of ``versions`` is one historical version at one path; findings
    are joined back to all of them by content address. Rows that repeat, null
    and empty texts all have their row; texts without findings an empty array.
    Only blobs with findings take part in the join; they are stored, so that
    its sides are plain and Spark can split a blob that many versions share.
    """
    hits = materialize(_findings(ledger.where(F.size("spans") > 0), rule_version), "findings")
    rows = versions.drop("__blob", "__spans").withColumn("__blob", blob_id(F.col(text))).join(hits, "__blob", "left")
    return rows.withColumn("__spans", F.coalesce("__known", F.array().cast(f"array<{SPAN}>"))).drop("__known")


def scan_versions(
    versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rule_version: int = RULE_VERSION
) -> tuple[DataFrame, DataFrame]:
    """(all versions with ``__blob`` and ``__spans``, the ledger's new rows, stored)."""
    new = materialize(scan_unseen(versions, ledger, text, rule_version), "ledger")
    return join_findings(versions, new if ledger is None else new.unionByName(ledger.select("blob", "rule_version", "spans")), text, rule_version), new


def common_texts(versions: DataFrame, text: str = "text") -> list[int]:
    """Hashes of the texts that more than one of SHARE rows have: fewer than SHARE, so they may come to the driver."""
    counts = versions.groupBy(F.xxhash64(F.col(text)).alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW)
    least = versions.count() // SHARE
    return [r["h"] for r in counts.where(F.col("n") > least).select("h").collect()]


def scan_in_place(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """The versions with ``__spans``, where their texts are wanted too: each text is moved once, and its copies take the findings from where they meet.

    Texts are dealt out by blob; of the rows of a blob that the ledger
    doesn't know one is scanned. Null and empty texts stay where they are.
    Texts with so many copies that they would fill a task are scanned
    ahead, copies brought together before the shuffle, and their findings
    are joined, so their rows stay where they are, or are split.
    """
    none = F.array().cast(f"array<{SPAN}>")
    body = F.col(text)
    empty, full = versions.where(body.isNull() | (body == "")), versions.where(body != "")
    hot = common_texts(full, text)
    is_hot = F.xxhash64(body).isin(hot) if hot else F.lit(False)
    known = None if ledger is None else _findings(ledger, rule_version)

    def told(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__known", F.lit(None).cast(f"array<{SPAN}>")) if known is None else rows.join(known, "__blob", "left")

    cold = told(full.where(~is_hot).withColumn("__blob", blob_id(body)))
    copies = Window.partitionBy("__blob")
    cold = cold.withColumn("__nth", F.row_number().over(copies.orderBy("__blob")))
    cold = cold.withColumn("__new", F.when((F.col("__nth") == 1) & F.col("__known").isNull(), find_secrets(body)))
    cold = cold.withColumn("__spans", F.coalesce("__known", F.max("__new").over(copies)))
    parts = [cold.drop("__known", "__nth", "__new"), empty.withColumns({"__blob": blob_id(body), "__spans": none})]
    if hot:
        once = full.where(is_hot).select(blob_id(body).alias("__blob"), body.alias("__body")).groupBy("__blob").agg(F.first("__body").alias("__body"))
        found = told(once).select("__blob", F.coalesce("__known", find_secrets(F.col("__body"))).alias("__spans"))
        parts.append(full.where(is_hot).withColumn("__blob", blob_id(body)).join(materialize(found, "findings"), "__blob", "left"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def redact(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every span, or run of overlapping spans, replaced by ``mark``; the columns stay as they were.

    Every document has its row, repeated rows and null or empty texts too;
    the latter stay as they are. Texts are scanned whole. An empty table
    stays empty; columns may have any names.
    """
    plain, names = plain_names(docs)
    body = F.col(names[text])
    rows = scan_in_place(plain, ledger, names[text])
    clean = F.when(F.size("__spans") > 0, masked(body, F.col("__spans"), mark)).otherwise(body)
    return rows.select(*(clean.alias(c) if c == names[text] else F.col(c) for c in plain.columns)).toDF(*docs.columns)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, read back from a ledger that was appended to twice: English documents first, then all of them, of which only blobs are scanned that the first pass hasn't seen.

    The ledger starts empty, and adds no spans to those of the base rules.
    """
    docs, ledger = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), new_path(spark, "ledger")
    append_unseen(docs.where("lang = 'en'"), ledger)
    rows = join_findings(docs.drop("lang"), append_unseen(docs, ledger))
    of_rank = lambda i: F.size(F.filter("__spans", lambda s: s["rank"] == i)).cast("long")
    counts = {f"n_{k}": of_rank(i) for i, k in enumerate(RULES)}
    rows = rows.select("doc_id", *(v.alias(k) for k, v in counts.items()), span_text(F.col("__spans")).alias("spans"))
    return rows.withColumn("base_sha256", F.sha2("spans", 256))


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, start, start + len(hits[i]) AS stop FROM (
    SELECT r, hits, vals, i, (list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0))::BIGINT AS start FROM (
      SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT r, regexp_split_to_array(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}', 0) AS hits, regexp_extract_all(text, '{quoted}', {group}) AS vals
        FROM d WHERE regexp_matches(text, '{quoted}'))))
  WHERE len(vals[i]) >= {least}"""


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(k, i, *rule) for i, (k, rule) in enumerate(RULES.items()))}),
j AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN j USING (r)
"""
