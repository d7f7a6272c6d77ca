"""Fill-in-middle against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tesserine.llm import fim

from test_operators import docs_of, odd_docs  # noqa: F401  a fixture


def brute_units(text, grammar):
    """Cut wherever a neighbouring pair of code points is one of the grammar's."""
    pairs, out = fim.GRAMMARS[grammar], []
    for i, c in enumerate(text):
        if not i or any(re.fullmatch(a, text[i - 1], re.S | re.A) and re.fullmatch(b, c, re.S | re.A) for a, b in pairs):
            out.append("")
        out[-1] += c
    return out


def brute(doc_id, text, grammar="char", rate=90, spm=20, seed=1):
    text = text or ""
    spread = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(spread[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = brute_units(text, grammar)
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(parts), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def told(rows):
    return rows.select("doc_id", "text", "__n", "__form", "__prefix_chars", "__middle_chars", "__output", fim.restore(F.col("__output"), F.col("__form")).alias("back")).collect()


TEXTS = [None, "", " ", "a", "😀", "a😀b𝄞 é\r\n\n x.  y! z?\n", "<P>", "a<<S", "S>b", "<<M>", "..", "<P<S<M", "é ‍﻿.  b"]


@pytest.mark.parametrize("grammar", sorted(fim.GRAMMARS))
@pytest.mark.parametrize("chunk", [3, 4096])
def test_against_brute_force(spark, monkeypatch, grammar, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab <\n.é😀") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    df = docs_of(spark, texts)
    rows = told(fim.fill_in_middle(df, grammar))
    assert len(rows) == len(texts) and {r["__form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert tuple(r)[2:7] == brute(r.doc_id, r.text, grammar), r
        assert r.back == (r.text or "")


def test_rates_and_seed(spark):
    df = docs_of(spark, ["some text here"] * 300)
    none = fim.fill_in_middle(df, rate=0).where("__form <> 'plain'")
    assert none.count() == 0
    assert fim.fill_in_middle(df, rate=100, spm=100).where("__form <> 'spm'").count() == 0
    one, two = (told(fim.fill_in_middle(df, seed=s)) for s in (1, 2))
    assert one != two and one == told(fim.fill_in_middle(df, seed=1))


def test_units_joined_are_the_text(spark):
    df = docs_of(spark, TEXTS[1:])
    for grammar in [*fim.GRAMMARS, [("a", "."), (r"\d", r"\D")]]:
        rows = df.select("text", F.array_join(fim.units(F.col("text"), grammar), "").alias("joined"), F.size(fim.units(F.col("text"), grammar)).alias("n")).collect()
        assert all(r.joined == r.text for r in rows) and [r.n for r in rows if r.text == ""] == [0]


def test_odd(spark, odd_docs):  # noqa: F811
    out = fim.fill_in_middle(odd_docs.withColumns({"__n": F.lit(1), "__cut": F.lit(2), "__first": F.lit(3)}))
    assert out.count() == odd_docs.count() and {"__cut", "__first", *odd_docs.columns} <= set(out.columns)
    for r in told(out):
        assert tuple(r)[2:7] == brute(r.doc_id, r.text) and r.back == (r.text or "")
    assert {r["__cut"] for r in out.collect()} == {2}
    assert fim.fill_in_middle(odd_docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "ab😀 " * 500_000
    row = told(fim.fill_in_middle(docs_of(spark, ["x", "y", text])).where("doc_id = 2"))[0]
    assert tuple(row)[2:7] == brute(2, text) and row.back == text


@pytest.mark.parametrize("bad", [("", "<S>", "<M>"), ("<S>", "<S>", "<M>"), ("<S>", "<<S>>", "<M>"), ("ab", "bc", "<M>")])
def test_sentinels_that_could_be_mistaken(spark, bad):
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs_of(spark, ["x"]), sentinels=bad)
