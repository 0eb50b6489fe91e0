"""WARC archives and transaction assembly.

``write_archives`` turns captures into gzip archives with Spark's text writer: a
row is a record, the line separator is the blank lines between records. A capture
gives a request, a response (or a revisit of an earlier payload) and a metadata
record, tied by WARC-Concurrent-To. Of captures with equal payloads of at least
``min_revisit`` bytes the one with the largest (page_id, url) is the response and
the others revisit it. Only payload hashes are grouped, with map-side maxima.

``read_archives`` reads such archives as a stream of records: the text reader cuts
at record starts, and a payload that itself contains such a start is joined again
by its Content-Length, so memory is bounded by the longest record. Archives must
be gzip files (one task reads a file in order); per-record gzip members are fine.

``assemble`` joins the records of a transaction through their concurrent-to
identifiers, also over one further record, into one nested row per capture.
Records that answer to no capture in the archives keep a row with a null capture.

Defined cases: a null html is an empty payload; rows equal in page_id, url and
payload are captures of their own, numbered in their record ids, each returned; of equal
payloads all rows of the largest page_id (of several urls, the last) are responses;
a null id sorts below all others; null and empty urls read back as empty; carriage
returns and line feeds in a url are percent-encoded; a very long payload is one record,
held whole by the task that reads it; an empty table gives an empty result; columns
beside page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, ship_package
from .textcols import NULL_ID

CRLF = "\r\n"
BETWEEN = CRLF + CRLF
MIN_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    version: str = "WARC/1.1"
    date: str = "2026-01-01T00:00:00Z"
    #: Records per file; a file is read by one task, which holds one record at a time.
    records_per_file: int = 60_000


def _record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _fields(pairs: list[tuple[str, Column | str]]) -> Column:
    """Header lines; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v, F.lit(CRLF)) for k, v in pairs]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in lines])


#: Rows of a repeated row that one task writes.
_COPIES = 4096


def _numbered(base: DataFrame) -> DataFrame:
    """Rows with ``nth``, which tells rows apart that are equal in page_id, url and payload: 0, 1, ...

    Only the keys that occur more than once are looked up. Their rows are reduced to one with a count, map-side, and
    laid out again in blocks of copies, so that no task holds all copies of a row.
    """
    keys = ["who", "same"]
    repeats = materialize(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "repeated_pages")
    once = base.join(repeats.select(*keys), keys, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    rest = [c for c in base.columns if c not in keys]
    one = (base.join(repeats.select(*keys), keys, "left_semi").groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest])
           .join(repeats, keys))
    blocks = one.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _COPIES))))
    blocks = blocks.repartition(base.sparkSession.sparkContext.defaultParallelism, *keys, "block")
    last = F.least(F.col("n"), (F.col("block") + 1) * _COPIES) - 1
    again = blocks.withColumn("nth", F.explode(F.sequence(F.col("block") * _COPIES, last)))
    return once.unionByName(again.select(*once.columns))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, archive: Archive = Archive()) -> str:
    """Writes one transaction per row below ``path``."""
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    payload = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("same"),
                        F.struct(F.coalesce("page_id", F.lit(NULL_ID)).cast("long").alias("id"),
                                 url.alias("url")).alias("who"))
    base = _numbered(base)
    shared = (base.where(F.col("bytes") >= min_revisit).groupBy("same")
              .agg(F.max("who").alias("first"), F.min("who").alias("last"))
              .where(F.col("first") != F.col("last")).select("same", "first"))
    shared = materialize(shared, "shared_payloads")
    joined = base.join(shared, "same", "left")
    key = (F.col("page_id"), F.col("url"), F.col("same"), F.when(F.col("nth") > 0, F.col("nth")))
    capture = _record_id("capture", *key)
    first_id = F.when(F.col("first.id") != NULL_ID, F.col("first.id"))
    revisits = F.col("first").isNotNull() & (F.col("first") != F.col("who"))
    refers = F.when(revisits, _record_id("capture", first_id, F.col("first.url"), F.col("same"), F.lit(None)))
    digest = F.concat(F.lit("sha1:"), F.sha1("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(BETWEEN))
    asked = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{BETWEEN}"))
    noted = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))

    def record(kind: Column | str, rid: Column, block: Column, content: str, *more: tuple[str, Column | str]) -> Column:
        head = _fields([("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", archive.date),
                        ("WARC-Target-URI", F.col("url")), *more, ("Content-Type", content),
                        ("Content-Length", F.octet_length(block).cast("string"))])
        return F.concat(F.lit(archive.version + CRLF), head, F.lit(CRLF), block)

    answer = record(F.when(revisits, "revisit").otherwise("response"), capture,
                    F.when(revisits, http).otherwise(F.concat(http, F.col("payload"))),
                    "application/http;msgtype=response", ("WARC-Payload-Digest", digest),
                    ("WARC-Profile", F.when(revisits, PROFILE)), ("WARC-Refers-To", refers))
    request = record("request", _record_id("request", *key), asked, "application/http;msgtype=request",
                     ("WARC-Concurrent-To", capture))
    metadata = record("metadata", _record_id("metadata", *key), noted, "application/warc-fields",
                      ("WARC-Concurrent-To", _record_id("request", *key)))
    (joined.select(F.explode(F.array(request, answer, metadata)).alias("value"))
     .write.mode("overwrite").option("lineSep", BETWEEN).option("compression", "gzip")
     .option("maxRecordsPerFile", archive.records_per_file).text(path))
    return path


RECORD = ("record_id string, kind string, concurrent_to string, refers_to string, url string, date string, "
          "payload_bytes long, payload_digest string, payload binary, fields map<string,string>")


def _named(head: bytes) -> dict[str, str]:
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").split(CRLF))
    return {k.strip().lower(): v.strip() for k, _, v in lines if k.strip()}


def _parse(record: bytes, with_payload: bool) -> tuple | None:
    """A record without its version line; None while its block is shorter than its Content-Length."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    if not blank and not record.rstrip():
        return ()
    h = _named(head)
    size = int(h.get("content-length", len(rest)))
    if len(rest) < size or not blank:
        return None
    block, kind = rest[:size], h.get("warc-type", "")
    fields: dict[str, str] = {}
    payload, length, digest = b"", 0, h.get("warc-payload-digest", "").partition(":")[2]
    if kind in ("response", "revisit"):
        status, _, payload = block.partition(b"\r\n\r\n")
        fields = _named(status.partition(b"\r\n")[2])
        length = int(fields.get("content-length", len(payload))) if kind == "revisit" else len(payload)
        if kind == "response":
            digest = hashlib.sha1(payload).hexdigest()
    elif kind == "metadata":
        fields = _named(block)
    return (h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"),
            h.get("warc-target-uri", ""), h.get("warc-date"), length, digest.lower(),
            payload if with_payload else None, list(fields.items()))


def read_archives(spark: SparkSession, path: str, archive: Archive = Archive(), with_payload: bool = True) -> DataFrame:
    """One row per record. The payload and its size and digest are those after the HTTP header; a revisit has the
    size and digest of the payload that it names, and no payload."""
    ship_package(spark)
    start = BETWEEN + archive.version + CRLF
    raw = spark.read.option("lineSep", start).text(path).select(F.col("value").cast("binary").alias("value"),
                                                                F.input_file_name().alias("file"))
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]
    names = [x.split()[0] for x in RECORD.split(", ")]
    version, joint = (archive.version + CRLF).encode(), start.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = b"", None
        for b in batches:
            rows = []
            for value, file in zip(b.column(0), b.column(1).to_pylist()):
                piece = value.as_py()
                if file != of:
                    held, of = b"", file
                    piece = piece.removeprefix(version)
                whole = held + joint + piece if held else piece
                parsed = _parse(whole, with_payload)
                held = whole if parsed is None else b""
                if parsed:
                    rows.append(parsed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return raw.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, capture, request, metadata): one nested row per capture."""
    part = F.struct("record_id", "kind", "refers_to", "url", "date", "payload_bytes", "payload_digest", "payload")
    side = F.struct("record_id", "url", "date", "fields")
    captures = F.col("kind").isin("response", "revisit")
    others = records.where(~captures)
    via = others.select(F.col("record_id").alias("concurrent_to"), F.col("concurrent_to").alias("further"))
    placed = (others.join(via, "concurrent_to", "left")
              .withColumn("capture_id", F.coalesce("further", "concurrent_to", "record_id"))
              .select("capture_id", F.lit(None).cast(records.select(part.alias("x")).schema["x"].dataType).alias("c"),
                      F.col("kind").alias("k"), side.alias("s")))
    main = records.where(captures).select(F.col("record_id").alias("capture_id"), part.alias("c"),
                                          F.lit(None).cast("string").alias("k"), F.lit(None).cast(
                                              records.select(side.alias("x")).schema["x"].dataType).alias("s"))
    return main.union(placed).groupBy("capture_id").agg(
        F.first("c", ignorenulls=True).alias("capture"),
        F.first(F.when(F.col("k") == "request", F.col("s")), ignorenulls=True).alias("request"),
        F.collect_list(F.when(F.col("k") == "metadata", F.col("s"))).alias("metadata"))


def warc_report(pages: DataFrame) -> DataFrame:
    """Archives all pages, reads the archives back and tells what each capture holds."""
    spark = pages.sparkSession
    path = write_archives(pages.select("page_id", "url", "html"), scratch_path(spark, "warc"))
    rows = assemble(read_archives(spark, path, with_payload=False))
    page = F.get("metadata", F.lit(0))["fields"]["page_id"]
    flat = materialize(rows.where(F.col("capture").isNotNull()).select(
        "capture_id", F.when(page != "", page).cast("long").alias("page_id"), "capture.payload_bytes",
        "capture.payload_digest", F.col("capture.kind").alias("record_type"), "capture.refers_to"), "captures")
    named = flat.select(F.col("refers_to"), F.lit(1).alias("one")).where(F.col("refers_to").isNotNull()).distinct() \
        .join(flat.select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("of")), "refers_to")
    return flat.join(named.select("refers_to", "of"), "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("of").alias("refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, {'k': coalesce(page_id, -9223372036854775808),
                  'u': replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A')} AS who FROM pages),
f AS (SELECT html, max(who) AS top FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN top > who THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top > who THEN nullif(top.k, -9223372036854775808) END AS refers_to
FROM p LEFT JOIN f USING (html)
"""
