"""URL filters joined on short prefixes alone, and secrets and hosts with letters that engines fold in different ways, against the queries' SQL."""

from __future__ import annotations

import contextlib
import io
import re

import duckdb
import pytest

from tesserine.llm import secrets, urls
from tools.compare import rows_of

URLS = ["http://a.example.com/en/x", "https://www.EXAMPLE.com/en/", "http://b.net/es/q", "x://net/fr/z?n", "http://com", "http://\u0130.net/es/a", "http://\u212a.com/x", None, "no", "http://example.com/en/", "ftp://org/en/"]


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("digits", [1, 8])
def test_prefixes_that_collide(spark, monkeypatch, digits):
    """With one digit most rules meet expressions that aren't theirs; only full digests decide."""
    rules = spark.createDataFrame([*urls.RULES, *((f"h{i}.com", "/en/", "block") for i in range(40))], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, *(f"http://x.h{i}.com/en/y" for i in range(0, 60, 7))])], "page_id bigint, url string")
    whole = sorted(map(tuple, urls.judge_urls(pages, rules).collect()), key=str)
    monkeypatch.setattr(urls, "SHORT", digits)
    assert sorted(map(tuple, urls.judge_urls(pages, rules).collect()), key=str) == whole
    keys = re.findall(r"Left keys \[\d+\]: (.*)\n.*\n?Right keys \[\d+\]: (.*)", plan_of(urls.judge_urls(pages, rules)))
    assert any(re.fullmatch(r"\[short#\d+L?\]", right) for _, right in keys) and not any("digest" in right for _, right in keys)


def held(spark, tmp_path, name, rows, schema, query, sql):
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    df, con = query(spark, folder), duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    theirs = con.execute(sql)
    columns = [d[0] for d in theirs.description]
    assert sorted(df.columns) == sorted(columns)
    mine = df.collect()
    assert rows_of(df.columns, mine) == rows_of(columns, theirs.fetchall())
    return mine


def test_hosts_with_other_capitals(spark, tmp_path):
    rows = held(spark, tmp_path, "pages", list(enumerate(URLS)), "page_id bigint, url string", urls.op10_urls, urls.OP10_SQL)
    assert {r.host for r in rows} >= {"\u0130.net", "\u212a.com", "www.example.com"}


def test_names_with_letters_that_look_alike(spark, tmp_path):
    texts = ["\u017fecret=abcdefghijklmnop", "to\u212aen: abcdefghijklmnop", "toKEN: abcdefghijklmnop", "API_KEY='abcdefghijkl'", None, "passwd = short", "apiKey:abcdefghijkl"]
    rows = held(spark, tmp_path, "documents", [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts + texts)], "doc_id bigint, text string, lang string", secrets.op9_secrets, secrets.OP9_SQL)
    assert [r.n_assign for r in sorted(rows, key=lambda r: r.doc_id)][:7] == [0, 0, 1, 1, 0, 0, 1]


def test_the_second_pass_scans_only_what_is_new(spark, tmp_path, monkeypatch):
    seen, true = [], secrets.scan_unseen

    def counted(versions, ledger=None, *rest):
        out = true(versions, ledger, *rest)
        seen.append(out.count())
        return out

    monkeypatch.setattr(secrets, "scan_unseen", counted)
    rows = [(0, "a", "en"), (1, "a", "de"), (2, "b", "en"), (3, "c", "fr"), (4, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert secrets.op9_secrets(spark, str(tmp_path)).count() == 5 and seen == [2, 2]
