"""Web archives: round trips, copies, segments, framing, and archives by others."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserine.llm import warc
from tools.compare import rows_of

PAGES = "page_id bigint, url string, html string"


def brute(rows, least=1000):
    out, groups = [], {}
    for i, (page_id, url, html) in enumerate(rows):
        groups.setdefault(html or "", []).append(((page_id is not None, page_id or 0), (url is not None, url or ""), i))
    for body, own in groups.items():
        top = max(own)[2]
        raw = body.encode()
        for _, _, i in own:
            again = len(raw) >= least and i != top
            out.append((rows[i][0], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", rows[top][0] if again else None))
    return Counter(out)


def told(spark, path):
    rows = warc.read_pages(spark, path).collect()
    assert all(r.complete for r in rows)
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)


@pytest.fixture(scope="module")
def odd_pages():
    rng = random.Random(7)
    words = "<p> é 😀 WARC/1.1\r\n WARC/1.1 WARC/1. \r\n\r\n 0\r\n\r\n Content-Length: 3\r\n".split(" ")
    page = lambda n: " ".join(rng.choice(words) for _ in range(n))
    big, edge = page(9000), "é" * 500
    rows = [(i, f"http://h{i}/", page(rng.randint(0, 900))) for i in range(40)]
    rows += [(100, "http://a/", big), (103, "http://b/", big), (101, None, big), (None, "http://c/", big)]
    rows += [(110, "u", edge), (111, "u", edge), (112, "u", edge[:-1] + "e"), (113, "u", edge[:-1] + "e")]  # of 1000 and of 999 bytes
    rows += [(120, "x", "y" * 2000)] * 3 + [(119, "x", "y" * 2000)]
    rows += [(130, "http://a b\r\nX: y\tz\x01/WARC/1.1", "WARC/1.1"), (131, "WARC/1.1", "WARC/1.1\r\n" * 400), (132, "", None), (133, None, ""), (133, None, ""), (None, None, None)]
    return rows


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, odd_pages, compression):
    df = spark.createDataFrame(odd_pages, PAGES).withColumns({"__html": F.lit(1), "value": F.lit("v")}).repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(df, path, compression=compression, segment=700, chunk=90)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # archives that aren't compressed are split
    try:
        assert told(spark, path) == brute(odd_pages)
        records = warc.read_warc(spark, path)
        ids = [r[0] for r in records.select("record_id").collect()]
        assert len(ids) == len(set(ids)) and all(i.startswith("<urn:uuid:") for i in ids)
        kinds = Counter(r[0] for r in records.select("kind").collect())
        assert kinds["continuation"] > 100 and kinds["response"] + kinds["revisit"] == len(odd_pages)
        whole = warc.payloads(warc.reassemble(records)).where("kind = 'response'").select(F.decode("payload", "UTF-8")).collect()
        least = {r[2] or "" for r in odd_pages}
        assert {r[0] for r in whole} == least
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert warc.read_pages(spark, path).count() == 0


def test_query_and_sql_on_odd_pages(spark, tmp_path, odd_pages):
    folder = str(tmp_path / "sf")
    spark.createDataFrame(odd_pages, PAGES).write.parquet(f"{folder}/pages.parquet")
    df = warc.op11_warc(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    theirs = con.execute(warc.OP11_SQL)
    columns = [d[0] for d in theirs.description]
    assert sorted(df.columns) == sorted(columns) and rows_of(df.columns, df.collect()) == rows_of(columns, theirs.fetchall())


def record(kind, block, number=None, origin=None, total=None, own="<a>", length=None):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"content-length: {len(block) if length is None else length}"]
    head += [f"WARC-Segment-Number: {number}"] * (number is not None) + [f"WARC-Segment-Origin-ID: {origin}"] * bool(origin) + [f"WARC-Segment-Total-Length: {total}"] * (total is not None)
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_by_others(spark, tmp_path):
    """Blocks that hold a record's first line, bytes that are no UTF-8, segments out of order in several files, missing, twice or cut off."""
    raw = bytes(range(256)) * 3
    one = [record("response", raw[:300], 1, own="<s>"), record("continuation", raw[300:500], 2, "<s>", own="<s2>"), record("continuation", raw[500:], 3, "<s>", len(raw), own="<s3>")]
    files = {
        "a.warc": one[2] + record("warcinfo", b"software: x\r\nWARC/1.1\r\nWARC/1.1 y\r\nz", own="<i>") + record("response", b"12345", 1, own="<gap>"),
        "b.warc": one[0] + record("continuation", b"6", 3, "<gap>", 6, own="<g3>") + record("response", b"ab", 1, own="<twice>") + record("continuation", b"c", 2, "<twice>", 4, own="<t>"),
        "c.warc": record("continuation", b"c", 2, "<twice>", 4, own="<t>") + record("continuation", b"q", 2, "<lost>", 9, own="<l>") + one[1] + record("resource", b"abc", own="<cut>", length=50),
        "d.warc": record("resource", b"\r\n\r\n", own="<ends>") + record("resource", b"", own="<none>"),
    }
    (tmp_path / "w").mkdir()
    for name, data in files.items():
        (tmp_path / "w" / f"{name}.gz").write_bytes(gzip.compress(data))
    rows = {r.record_id: r for r in warc.reassemble(warc.read_warc(spark, str(tmp_path / "w"))).collect()}
    assert set(rows) == {"<s>", "<i>", "<gap>", "<twice>", "<lost>", "<cut>", "<ends>", "<none>"}
    assert bytes(rows["<s>"].block) == raw and rows["<s>"].complete and rows["<s>"].kind == "response"
    assert bytes(rows["<i>"].block) == b"software: x\r\nWARC/1.1\r\nWARC/1.1 y\r\nz" and rows["<i>"].complete
    assert bytes(rows["<ends>"].block) == b"\r\n\r\n" and rows["<ends>"].complete and rows["<none>"].complete
    assert [rows[f"<{x}>"].complete for x in ("gap", "twice", "lost", "cut")] == [False] * 4
    assert bytes(rows["<gap>"].block) == b"123456" and rows["<lost>"].kind is None


@pytest.mark.parametrize(
    "body, out",
    [
        (b"3\r\nabc\r\n0\r\n\r\n", (b"abc", True)),
        (b"3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\nT: 1\r\n\r\n", (b"abc0123456789", True)),
        (b"0\r\n\r\n", (b"", True)),
        (b"", (b"", False)),
        (b"4\r\nabc\r\n0\r\n\r\n", (b"abc\r", False)),
        (b"3\r\nabc\r\n", (b"abc", False)),
        (b"zz\r\nabc\r\n0\r\n\r\n", (b"", False)),
        (b"5\r\nabc", (b"abc", False)),
    ],
)
def test_chunked_framing(body, out):
    assert warc.decode_chunks(body) == out


def test_http_payloads():
    assert warc.http_payload(b"HTTP/1.1 404 Not Found\r\nContent-Length: 3\r\n\r\nabcd") == (404, b"abc", True)
    assert warc.http_payload(b"HTTP/1.1 200\r\ncontent-length: 9\r\n\r\nabcd") == (200, b"abcd", False)
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n1\r\na\r\n0\r\n\r\n") == (200, b"a", True)
    assert warc.http_payload(b"no header") == (None, b"", True)


def test_a_payload_that_was_changed(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame([(1, "u", "abcdef"), (2, "u", "z" * 2000), (3, "u", "z" * 2000)], PAGES), path, compression="none")
    for f in (tmp_path / "w").glob("part-*"):
        f.write_bytes(f.read_bytes().replace(b"abcdef", b"abcxef").replace(b"z" * 2000, b"z" * 1999 + b"x"))
    for f in (tmp_path / "w").glob(".*.crc"):
        f.unlink()
    rows = {r.page_id: r for r in warc.read_pages(spark, path).collect()}
    assert [rows[i].complete for i in (1, 2, 3)] == [False] * 3 and rows[2].payload_bytes is None and rows[2].refers_to == 3
