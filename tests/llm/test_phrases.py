"""Phrase collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import docs_of, odd_docs  # noqa: F401  a fixture

from tesserine.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, absorb=100):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, found in counts.items():
        often = {p: f for p, f in found.items() if f >= least}
        lost, n = set(), totals[lang]
        for p, f in often.items():
            for m in range(2, len(p)):
                lost |= {q for i in range(len(p) - m + 1) if (q := p[i : i + m]) in often and 100 * f >= absorb * often[q]}
        scored = []
        for p, a in often.items():
            if len(p) > 1 and p not in lost:
                score, k = min((1000 * a * n // (often[p[:k]] * often[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def told(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts_of(rng, n, words):
    """Zipf-like words with passages, line ends, punctuation, runs of one word, odd blanks."""
    weights = [1 / (i + 1) for i in range(len(words))]
    passage = " ".join(rng.choices(words, weights, k=8))
    out = []
    for _ in range(n):
        parts = [rng.choice(["a a a a a a a", passage, "x y z", "The the THE\tthe"]) if rng.random() < 0.2 else " ".join(rng.choices(words, weights, k=rng.randint(1, 25))) for _ in range(6)]
        out.append("".join(p + rng.choice([". ", "\n", "  ", " \t", "!?", "\x0b", " ", ";;"]) for p in parts))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = ["the", "of", "and", "é", "É", "über", "a", "b" * 40, "😀", "to", "in", "x-y", "it's", "​", "z", "new", "york"]
    texts = [*texts_of(rng, 150, words), None, "", " . ", "the"]
    langs = [rng.choice(["en", "en", "en", "de", None, "und", "it"]) for _ in texts]
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string").repartition(3)


@pytest.mark.parametrize("limits", [{}, {"AT_ONCE": 7, "HELD": 40, "HELD_WORDS": 5, "LANGUAGES": 2}, {"COUNTERS": 4}])
@pytest.mark.parametrize("load", [500_000, 25])
def test_against_brute_force(spark, corpus, monkeypatch, limits, load):
    for k, v in limits.items():
        monkeypatch.setattr(phrases, k, v)
    rows = [(r.lang, r.text) for r in corpus.collect()]
    assert told(corpus, least=6, load=load) == brute(rows, 6)
    assert len(brute(rows, 6)) > 300


@pytest.mark.parametrize("options", [{"top": 7}, {"absorb": 60}, {"absorb": 1000}, {"top": 1, "absorb": 1}])
def test_parameters(spark, corpus, options):
    rows = [(r.lang, r.text) for r in corpus.collect()]
    assert told(corpus, least=4, **options) == brute(rows, 4, **options)


def test_a_hot_passage_and_repeated_rows(spark):
    rng = random.Random(2)
    texts = ["one two three four five six"] * 400 + [" ".join(rng.choices(["one", "two", "q", "w"], k=30)) for _ in range(60)]
    df = docs_of(spark, texts)
    assert told(df, least=20, load=50) == brute([("en", t) for t in texts], 20)


def test_odd(spark, odd_docs):  # noqa: F811
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert told(odd_docs.withColumns({"f": F.lit(1), "words": F.lit(2), "phrase": F.lit("x")}), least=30) == brute(rows, 30)
    assert told(odd_docs.limit(0)) == [] and told(docs_of(spark, [None, "", "..."])) == []


def test_a_long_text_without_punctuation(spark):
    rng = random.Random(4)
    text = " ".join(rng.choices([f"w{i}" for i in range(300)], [1 / (i + 1) for i in range(300)], k=300_000))
    assert told(docs_of(spark, [text, "x" * 300_000])) == brute([("en", text), ("en", "x" * 300_000)], 100)


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 4 * 10**12
    rows = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 3)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (rows, totals))
    assert phrases.collocations(rows).first().score == 1000 * (big - 3) * 9 * 10**15 // (big * (big + 7))


def test_every_gram_has_one_owner():
    """Windows around pivots, fragment by fragment, are exactly the n-grams of frequent words."""
    rng = random.Random(9)
    text = " ".join(rng.choices(["a", "b", "c", "d", "e"], k=400)) + ". a a a b"
    language = phrases._Language("en", np.full(64, 100, np.int64), 100, 10**9, 1)
    import pyarrow as pa

    assert [*language.take(pa.array([text]))] == []
    found = Counter()
    slots = phrases.unpacked(language.fragments.keys[:, : language.fragments.n], phrases.IN_FRAGMENT, 9)
    for row, f in zip(slots.tolist(), language.fragments.sums.tolist()):
        for left in range(5):
            for right in range(5 - left):
                if left + right and row[4 - left] and row[4 + right]:
                    found[" ".join(language.known[i - 1].decode() for i in row[4 - left : 5 + right])] += f
    true = Counter(" ".join(w[i : i + m]) for piece in text.split(".") for w in [piece.split()] for m in range(2, 6) for i in range(len(w) - m + 1))
    assert found == true


@pytest.mark.parametrize("load", [10**9, 50])
@pytest.mark.parametrize("least", [3, 10**6])
def test_mining_by_levels(load, least, monkeypatch):
    """op12: n-grams are looked at only where shorter ones are frequent, not put into a table first; the counts are those of all."""
    import pyarrow as pa

    rng, true, rows = random.Random(10), Counter(), []
    for lang in ("en", "de", "en"):
        text = ". ".join(" ".join(rng.choices(["a", "é", "cc", "d", "e" * 30], k=rng.randint(1, 60))) for _ in range(12))
        language = phrases._Language(lang, np.arange(100, 164), 100, load, 3)
        rows += [*language.take(pa.array([text])), *language.sent()]
        true += Counter((lang, " ".join(w[i : i + m])) for piece in text.split(".") for w in [piece.split()] for m in range(2, 6) for i in range(len(w) - m + 1))
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in phrases.ROUTED.split(", ")]
    monkeypatch.setattr(phrases, "Tally", None)
    found = Counter()
    for group in {r[:2] for r in rows}:
        parts = [pa.table([pa.array([x], t) for x, t in zip(r, kinds)], names=names) for r in rows if r[:2] == group]
        for r in phrases._mine(least)(pa.concat_tables(parts)).to_pylist():
            assert load == 50 or (r["lang"], r["phrase"]) not in found
            found[r["lang"], r["phrase"]] += r["f"]
    assert Counter({p: f for p, f in found.items() if f >= least}) == Counter({p: f for p, f in true.items() if f >= least})
    assert phrases._mine(least)(pa.concat_tables(parts).slice(0, 0)).num_rows == 0
