"""Web archives: pages written as WARC records, in segments where they are long, and read back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, new_path, plain_names, read_table, remove

CRLF = "\r\n"
#: Fixed names of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Code points of a record's block in one segment, and of a chunk of a payload in transfer; least bytes of a payload that is revisited.
SEGMENT, CHUNK, REVISITED = 8192, 4096, 1000
DATE = "2026-01-01T00:00:00Z"
#: Bytes of blocks that are handed on at once when archives are read.
BATCH = 4 << 20

RECORD = "record_id string, kind string, fields map<string,string>, block binary, whole boolean"


def version_line(version: str = "1.1") -> str:
    return f"WARC/{version}"


# Writing ------------------------------------------------------------------------------------------


def copies_of(rows: DataFrame, page_id: str, url: str, sha: str, least: int) -> DataFrame:
    """Of each payload of ``least`` bytes or more that several rows have: its digest, and page_id, url and number of the rows that are largest in these two."""
    same = rows.where(F.col("__bytes") >= least).groupBy(sha, page_id, url).agg(F.count(F.lit(1)).alias("__c"))
    top = F.max(F.struct(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col("__c").alias("c")))
    found = same.groupBy(F.col(sha).alias("__of")).agg(F.sum("__c").alias("__n"), top.alias("__top")).where("__n > 1")
    return materialize(found.select("__of", "__top"), "copies")


def _roles(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """The rows with ``__kind``: of equal payloads one row is the response, the others revisit it.

    Only digests take part in finding copies. Rows that are the largest and equal in
    everything are brought together, and one of them becomes the response.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("__id"), F.col(url).alias("__url"), body.alias("__html"), F.octet_length(body).cast("long").alias("__bytes"), F.sha2(body, 256).alias("__sha")
    )
    copies = copies_of(rows, "__id", "__url", "__sha", least)
    largest = F.col("__id").eqNullSafe(F.col("__top.id")) & F.col("__url").eqNullSafe(F.col("__top.url"))
    rows = rows.join(copies, F.col("__sha") == F.col("__of"), "left")
    tied = largest & (F.col("__top.c") > 1)
    kind = F.when(F.col("__of").isNull() | largest, F.lit("response")).otherwise(F.lit("revisit"))
    columns = ["__id", "__url", "__html", "__bytes", "__sha"]
    out = rows.where(~F.coalesce(tied, F.lit(False))).select(*columns, kind.alias("__kind"))
    if not copies.where("__top.c > 1").isEmpty():
        same = rows.where(tied).groupBy(*(c for c in columns if c != "__html")).agg(F.first("__html").alias("__html"), F.count(F.lit(1)).alias("__c"))
        same = same.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__c"))))
        out = out.unionByName(same.select(*columns, F.when(F.col("__i") == 1, F.lit("response")).otherwise(F.lit("revisit")).alias("__kind")))
    return out


def chunked(body: Column, mark: str, chunk: int = CHUNK) -> Column:
    """A text in chunked transfer framing. A chunk ends within every ``mark``, so that the framed bytes don't hold one: readers may look for the next record anywhere."""
    broken = F.split(body, f"(?<={re.escape(mark[:-2])})(?={re.escape(mark[-2:])})", -1)
    parts = F.when(body.contains(mark), broken).otherwise(F.array(body))
    pieces = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))))
    framed = F.transform(pieces, lambda p: F.concat(F.lower(F.hex(F.octet_length(p).cast("long"))), F.lit(CRLF), p, F.lit(CRLF)))
    return F.concat(F.array_join(framed, ""), F.lit(f"0{CRLF}{CRLF}"))


def clean_uri(url: Column, mark: str) -> Column:
    """A url as a field's value: blanks and line ends escaped, other control characters gone, and a blank behind it where it ends like a record's first line."""
    for char, escape in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        url = F.replace(url, F.lit(char), F.lit(escape))
    url = F.regexp_replace(url, r"[\x00-\x1F\x7F]", "")
    return F.when(url.endswith(mark), F.concat(url, F.lit(" "))).otherwise(url)


def warc_records(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = REVISITED,
    segment: int = SEGMENT,
    chunk: int = CHUNK,
    date: str = DATE,
    version: str = "1.1",
) -> DataFrame:
    """The text of each record (column ``value``), without the two line ends behind it; a long record is several: its first segment and continuations.

    Of rows with equal payloads of ``least`` bytes or more the one with the
    largest page_id (then url) is written in full, the others revisit it.
    A null html is empty; a null page_id sorts first and is left out of its
    record; a null url becomes one made from the page_id. Rows that repeat
    have a record each. An empty table has none.
    """
    mark = version_line(version)
    plain, names = plain_names(pages)
    rows = _roles(plain, names[page_id], names[url], names[html], least)
    hashed = F.concat_ws("-", *(F.substring("__sha", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    told = F.concat(F.lit("<urn:uuid:"), hashed, F.lit(">"))
    own = F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    response = F.col("__kind") == "response"
    rows = rows.withColumn("__record", F.when(response & (F.col("__bytes") >= least), told).otherwise(own))
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
    full = F.concat(F.lit(f"{http}Transfer-Encoding: chunked{CRLF}{CRLF}"), chunked(F.col("__html"), mark, chunk))
    block = F.when(response, full).otherwise(F.lit(http + CRLF))
    rows = rows.withColumn("__sha1", F.sha1("__html")).withColumn("__block", block).withColumn("__total", F.octet_length("__block"))
    cut = F.regexp_extract_all("__block", F.lit(f"(?s).{{1,{segment}}}"), F.lit(0))
    rows = rows.select("*", F.posexplode(cut).alias("__at", "__segment")).withColumn("__of", F.ceil(F.char_length("__block") / segment))
    first, several, last = F.col("__at") == 0, F.col("__of") > 1, F.col("__at") == F.col("__of") - 1
    uri = clean_uri(F.coalesce(F.col("__url"), F.concat(F.lit("urn:page:"), F.col("__id").cast("string")), F.lit("urn:page")), mark)
    field = lambda name, value, where=None: F.concat(F.lit(f"{name}: "), value if where is None else F.when(where, value))
    head = F.concat_ws(
        CRLF,
        F.lit(mark),
        field("WARC-Type", F.when(first, F.col("__kind")).otherwise(F.lit("continuation"))),
        field("WARC-Record-ID", F.when(first, F.col("__record")).otherwise(own)),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", uri, first),
        field("Page-Id", F.col("__id").cast("string"), first),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__sha1")), first),
        field("WARC-Profile", F.lit(REVISIT), first & ~response),
        field("WARC-Refers-To", told, first & ~response),
        field("WARC-Segment-Number", (F.col("__at") + 1).cast("string"), several),
        field("WARC-Segment-Origin-ID", F.col("__record"), ~first),
        field("WARC-Segment-Total-Length", F.col("__total").cast("string"), several & last),
        field("Content-Type", F.lit("application/http;msgtype=response"), first),
        field("Content-Length", F.octet_length("__segment").cast("string")),
    )
    return rows.select(F.concat(head, F.lit(CRLF + CRLF), F.col("__segment")).alias("value"))


def write_warc(pages: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    """Write the pages to a folder of WARC files, a file for each of Spark's tasks, in one commit. See ``warc_records``."""
    warc_records(pages, **options).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


# Reading ------------------------------------------------------------------------------------------


def _fields(head: bytes) -> dict[str, str]:
    """The named fields of a record or of an HTTP header; names in lower case, folded lines joined."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split(CRLF):
        if name and line[:1] in (" ", "\t"):
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _parse(mark: bytes):
    """Reads records from what lies between marks; where a block holds a mark itself, what follows it is put back until the block is as long as it should be."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        held: list[bytes] = []  # the head's fields first, then parts of the block
        need, fields = 0, {}

        def done() -> None:
            nonlocal held, size
            if held:
                block = mark.join(held)
                out.append((fields.get("warc-record-id"), fields.get("warc-type"), list(fields.items()), block[:need], len(block) >= need))
                size += min(need, len(block))
                held = []

        def batch() -> pa.RecordBatch:
            nonlocal out, size
            columns, kinds = [*zip(*out)] or [()] * 5, (pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["record_id", "kind", "fields", "block", "whole"])
            out, size = [], 0
            return made

        for rows in batches:
            for row in rows.column(0):
                row = row.as_py()
                if not row:  # an archive begins
                    done()
                    continue
                if held and sum(map(len, held)) + len(mark) * (len(held) - 1) < need:
                    held.append(row)
                    continue
                done()
                head, _, rest = row.partition(b"\r\n\r\n")
                fields = _fields(head)
                length = fields.get("content-length", "")
                need = int(length) if length.isdigit() else len(rest)
                held = [rest]
                if size >= BATCH:
                    yield batch()
        done()
        if out:
            yield batch()

    return parse


def read_warc(spark: SparkSession, path: str, version: str = "1.1") -> DataFrame:
    """All records of the WARC files in a folder: record_id, kind, fields (names in lower case), block, and whether the block has its length.

    Archives that Spark can split are split, as records are looked for by
    their first line. Of archives by other writers, a block that holds such
    a line is read whole as long as it lies in one split, so give those
    compressed. What is cut off is kept, with ``whole`` false.
    """
    mark = version_line(version) + CRLF
    text = spark.read.option("lineSep", mark).text(path)
    return text.select(F.col("value").cast("binary")).mapInArrow(_parse(mark.encode()), RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Records with their segments joined: record_id, kind, fields (of the first segment), block and ``complete``.

    Continuations are grouped by their origin and ordered by number; they
    are complete if the numbers are 1 to n, every block has its length, and
    all of them together have the total length that the last one states.
    Segments that are missing or come twice leave the record, joined from
    what is there, with ``complete`` false. Records in one segment are not
    moved.
    """
    number = F.try_to_number(F.col("fields")["warc-segment-number"], F.lit("9" * 18)).cast("long")
    alone = records.where(F.col("fields")["warc-segment-number"].isNull() & ~F.col("kind").eqNullSafe("continuation"))
    rest = records.where(F.col("fields")["warc-segment-number"].isNotNull() | F.col("kind").eqNullSafe("continuation"))
    rest = rest.withColumn("__no", number).withColumn("__total", F.try_to_number(F.col("fields")["warc-segment-total-length"], F.lit("9" * 18)).cast("long"))
    origin = F.coalesce(F.col("fields")["warc-segment-origin-id"], F.col("record_id"))
    first = F.col("__no") == 1
    parts = F.sort_array(F.collect_list(F.struct(F.col("__no").alias("no"), F.col("block").alias("block"))))
    joined = rest.groupBy(origin.alias("record_id")).agg(
        F.first(F.when(first, F.col("kind")), ignorenulls=True).alias("kind"),
        F.first(F.when(first, F.col("fields")), ignorenulls=True).alias("fields"),
        parts.alias("__parts"),
        F.max("__total").alias("__total"),
        F.min("whole").alias("__whole"),
    )
    joined = joined.withColumn("block", F.array_join(F.transform("__parts", lambda p: p["block"].cast("string")), "").cast("binary"))
    gapless = F.transform("__parts", lambda p: p["no"]) == F.sequence(F.lit(1).cast("long"), F.size("__parts").cast("long"))
    complete = F.coalesce(F.col("__whole") & gapless & (F.col("__total") == F.octet_length("block")), F.lit(False))
    columns = ["record_id", "kind", "fields", "block"]
    return alone.select(*columns, F.col("whole").alias("complete")).unionByName(joined.select(*columns, complete.alias("complete")))


def decode_chunks(body: bytes) -> tuple[bytes, bool]:
    """(the payload, whether the framing is right to its end) of a body in chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or re.fullmatch(rb"[0-9A-Fa-f]+", size) is None:
            return b"".join(out), False
        n = int(size, 16)
        if not n:
            return b"".join(out), body.find(b"\r\n", end + 2) >= 0
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
        if len(out[-1]) < n or body[at - 2 : at] != b"\r\n":
            return b"".join(out), False


def http_payload(block: bytes) -> tuple[int | None, bytes, bool]:
    """(status, payload, whether it is whole) of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    line, _, rest = head.partition(b"\r\n")
    words, fields = line.split(None, 2), _fields(rest)
    status = int(words[1]) if len(words) > 1 and words[1].isdigit() and len(words[1]) == 3 else None
    if "chunked" in fields.get("transfer-encoding", "").lower():
        return status, *decode_chunks(body)
    length = fields.get("content-length", "")
    return status, body[: int(length)] if length.isdigit() else body, not length.isdigit() or len(body) >= int(length)


def payloads(records: DataFrame) -> DataFrame:
    """Reassembled records with ``status`` and ``payload``, decoded from the transfer framing; ``complete`` then also says that the framing is right and that the payload has the SHA-1 that the record states in hexadecimal digits, if it does."""

    def told(blocks: pa.Array) -> pa.Array:
        rows = [http_payload(b.as_py() or b"") for b in blocks]
        return pa.array([{"status": s, "payload": p, "good": g} for s, p, g in rows], pa.struct([("status", pa.int32()), ("payload", pa.binary()), ("good", pa.bool_())]))

    decode = F.arrow_udf(told, "status int, payload binary, good boolean")
    rows = records.withColumn("__http", decode("block"))
    stated = F.regexp_extract(F.coalesce(F.col("fields")["warc-payload-digest"], F.lit("")), "^sha1:([0-9a-f]{40})$", 1)
    same = (stated == "") | (F.col("kind") == "revisit") | (stated == F.sha1("__http.payload"))
    return rows.select(
        "record_id", "kind", "fields", F.col("__http.status").alias("status"), F.col("__http.payload").alias("payload"), (F.col("complete") & F.col("__http.good") & same).alias("complete")
    )


def read_pages(spark: SparkSession, path: str, version: str = "1.1") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and complete of the pages that ``write_warc`` has written.

    What revisits tell of their payload comes from the response that they
    refer to, as it was read; they are joined by its record's id, without
    payloads, and Spark can split a response that many rows revisit. A
    record that isn't complete, or whose response isn't, has null there.
    """
    records = payloads(reassemble(read_warc(spark, path, version))).where(F.col("kind").isin("response", "revisit"))
    slim = materialize(
        records.select(
            "record_id",
            "kind",
            F.col("fields")["page-id"].cast("long").alias("page_id"),
            F.col("fields")["warc-refers-to"].alias("refers_to"),
            F.when(F.col("complete"), F.octet_length("payload").cast("long")).alias("payload_bytes"),
            F.when(F.col("complete"), F.sha1("payload")).alias("payload_digest"),
            "complete",
        ),
        "records",
    )
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "complete"]
    whole = slim.where("kind = 'response'")
    of = whole.select(F.col("record_id").alias("__of"), F.col("page_id").alias("__page"), F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest"), F.col("complete").alias("__complete"))
    again = slim.where("kind = 'revisit'").join(of, F.col("refers_to") == F.col("__of"), "left")
    again = again.select(
        "page_id", F.col("__bytes").alias("payload_bytes"), F.col("__digest").alias("payload_digest"), "kind", F.col("__page").alias("refers_to"), (F.col("complete") & F.coalesce("__complete", F.lit(False))).alias("complete")
    )
    return whole.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(again.withColumnRenamed("kind", "record_type"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives have it when they are read back."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_warc(pages, path)
    read = read_pages(spark, path)
    remove(spark, path)  # what is read of it is stored
    return read.drop("complete")


OP11_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
r AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS nth,
    first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS top FROM p
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= {REVISITED} AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISITED} AND nth > 1 THEN top END AS refers_to
FROM r
"""
