"""Fill-in-middle transformation: texts split by lookaround into units, and cut at two seeded places."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .secrets import bound
from .store import plain_names, read_table, true_names

#: By unit: the (class on the left, class on the right) of neighbouring code points that a unit ends between.
GRAMMARS = {
    "char": [(".", ".")],
    "word": [(r"\s", r"\S")],
    "line": [(r"\n", ".")],
    "sentence": [(r"[.!?]", r"\s")],
}
SENTINELS = ("<P>", "<S>", "<M>")
#: Code points that are split at once: what a task holds as pieces doesn't grow with its texts.
CHUNK = 4096


def boundary(grammar: str | Sequence[tuple[str, str]]) -> str:
    """The regex of no width that matches between units of a grammar, which is a name of GRAMMARS or pairs of classes like those there."""
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return "(?s)" + "|".join(f"(?<={left})(?={right})" for left, right in pairs)


def units(text: Column, grammar: str | Sequence[tuple[str, str]] = "char") -> Column:
    """The units of a text, which joined give the text again; an empty text has none, a null one null."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _chunks(body: Column) -> Column:
    """A text in chunks, each but the first behind the last code point of the one before, so that every pair of neighbours stands in one chunk."""
    own = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    before = lambda cs, i: F.when(i == 0, F.lit("")).otherwise(F.substring(F.get(cs, i - 1), -1, 1))
    return bound(own, lambda cs: F.transform(cs, lambda c, i: F.concat(before(cs, i), c)))


def cut_units(body: Column, grammar: str | Sequence[tuple[str, str]], ends: Sequence[tuple[str, Column]]) -> Column:
    """(n, and the code points before each end) of a text that isn't null, as a struct. An end is a name and what, modulo n + 1, gives a number of units.

    Units are counted chunk by chunk, and only the chunks that hold an end are split again.
    """
    split = boundary(grammar)

    def placed(cs: Column, counts: Column, prior: Column) -> Column:
        n = F.when(body == "", F.lit(0)).otherwise(1 + F.aggregate(counts, F.lit(0), lambda a, b: a + b)).cast("long")

        def within(k: Column, j: Column) -> Column:
            head = F.array_join(F.slice(F.split(F.get(cs, j), split, -1), F.lit(1), (k - F.get(prior, j)).cast("int")), "")
            return j.cast("long") * CHUNK - F.when(j > 0, F.lit(1)).otherwise(F.lit(0)) + F.char_length(head)

        def at(k: Column) -> Column:
            chunk = F.size(F.filter(prior, lambda p: p < k)) - 1
            return F.when(k <= 0, F.lit(0)).when(k >= n, F.char_length(body)).otherwise(bound(chunk, lambda j: within(k, j))).cast("long")

        return F.struct(n.alias("n"), *(at(h % (n + 1)).alias(name) for name, h in ends))

    counted = lambda cs: F.transform(cs, lambda c: F.size(F.split(c, split, -1)) - 1)
    summed = lambda ns: F.transform(ns, lambda _, i: F.aggregate(F.slice(ns, F.lit(1), i), F.lit(0), lambda a, b: a + b))
    return bound(_chunks(body), lambda cs: bound(counted(cs), lambda ns: bound(summed(ns), lambda ps: placed(cs, ns, ps))))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. Texts that hold a sentinel are plain, so the first one of each kind is the one that was put there."""
    p, s, m = sentinels
    second, third = F.when(form == "spm", F.lit(p)).otherwise(F.lit(s)), F.lit(m)
    first_part = F.split_part(output, F.when(form == "spm", F.lit(s)).otherwise(F.lit(p)), F.lit(2))
    one, two, last = F.split_part(first_part, second, F.lit(1)), F.split_part(F.split_part(output, second, F.lit(2)), third, F.lit(1)), F.split_part(output, third, F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, last, two)).otherwise(F.concat(two, last, one))


def fill_in_middle(
    docs: DataFrame,
    grammar: str | Sequence[tuple[str, str]] = "char",
    rate: int = 90,
    spm: int = 20,
    seed: int = 1,
    sentinels: tuple[str, str, str] = SENTINELS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Turn ``rate`` % of the texts into prefix, suffix and middle, and ``spm`` % of these into suffix, prefix and middle.

    Adds ``__n`` (units), ``__form`` (plain, psm or spm), ``__prefix_chars``
    and ``__middle_chars`` (code points; null if plain) and ``__output``;
    all other columns stay, whatever their names. Both cuts, the form and
    its order come from the SHA-256 of seed and id, so a text is treated
    alike wherever its row is, and rows that repeat are too.

    A null text is an empty one, which has no units and is plain, as is one
    that holds a sentinel; a null id counts as an empty string. An empty
    table stays empty. Texts of any length are cut whole; nothing is shuffled.
    """
    p, s, m = sentinels
    if not p or not s or not m or any(a != b and a in b for a in sentinels for b in sentinels) or len({p, s, m}) < 3:
        raise ValueError("sentinels have to differ, and none may hold another")
    if any(x[i:] == y[: len(x) - i] for x in sentinels for y in sentinels for i in range(1, len(x))):
        raise ValueError("no sentinel may begin with what one ends with")  # else one could form across a cut
    plain, names = plain_names(docs)
    body = F.coalesce(F.col(names[text]), F.lit(""))
    spread = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(names[doc_id]).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(spread, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    form = F.when((body == "") | body.rlike("|".join(map(re.escape, sentinels))) | (h[2] % 100 >= rate), F.lit("plain"))
    form = form.when(h[3] % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    rows = plain.withColumn("__cut", cut_units(body, grammar, [("a", h[0]), ("b", h[1])])).withColumn("__form", form)
    first, last = F.least("__cut.a", "__cut.b"), F.greatest("__cut.a", "__cut.b")
    rows = rows.withColumns({"__first": first, "__middle_chars": last - first})
    of = lambda at, n: F.substring(body, (at + 1).cast("int"), n.cast("int"))
    a, b = F.col("__first"), F.col("__first") + F.col("__middle_chars")
    prefix, middle, suffix = of(F.lit(0), a), of(a, b - a), of(b, F.char_length(body) - b)
    made = F.when(F.col("__form") == "plain", body)
    made = made.when(F.col("__form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
    made = made.otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
    moved = F.col("__form") != "plain"
    added = {
        "__n": F.col("__cut.n"),
        "__form": F.col("__form"),
        "__prefix_chars": F.when(moved, a),
        "__middle_chars": F.when(moved, F.col("__middle_chars")),
        "__output": made,
    }
    return rows.select(*true_names(names, added), *(v.alias(k) for k, v in added.items()))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into code points, with the digests of its output and of the text restored from that."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = fill_in_middle(docs)
    return rows.select(
        "doc_id",
        F.col("__n").alias("n"),
        F.col("__form").alias("form"),
        F.col("__prefix_chars").alias("prefix_chars"),
        F.col("__middle_chars").alias("middle_chars"),
        F.sha2("__output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("__output"), F.col("__form")), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS spread FROM documents),
h AS (
  SELECT *, length(text)::BIGINT AS n, ('0x' || spread[1:8])::BIGINT AS h1, ('0x' || spread[9:16])::BIGINT AS h2,
    ('0x' || spread[17:24])::BIGINT AS h3, ('0x' || spread[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
    ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
