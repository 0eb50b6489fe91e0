import gzip
import hashlib

from pyspark.sql import functions as F

from cpelink.llm import warc as W
from cpelink.session import scratch_path

BIG = "<html>" + "payload " * 200
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://b/9", BIG), (9, "http://b/9", BIG), (9, "http://b/0", BIG),
    (3, "http://a/3", None), (4, None, ""), (5, "http://a/5", "short"), (6, "http://a/6", "short"),
    (7, "http://a/\r\n7: x", "tricky\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40),
    (8, "http://é/", "é😀" * 400), (None, "http://n", "null id " * 200), (10, "http://n", "null id " * 200),
    (11, "u", "x" * 999), (12, "u", "x" * 999), (13, "u", "y" * 1000), (14, "u", "y" * 1000), (15, "u", "z\r\n\r\n" * 3),
    (16, "u", "l" * 3_000_000),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, kind string, bytes int")


def brute(rows):
    key = lambda r: (-2 ** 63 if r[0] is None else r[0], r[1] or "")
    out = []
    for r in rows:
        b = (r[2] or "").encode()
        same = [x for x in rows if (x[2] or "") == (r[2] or "")]
        top = max(same, key=key)
        again = len(b) >= 1000 and key(top) != key(r)
        out.append((r[0], len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[0] if again else None))
    return sorted(out, key=str)


def test_report(spark):
    got = sorted([tuple(r) for r in W.warc_report(table(spark, PAGES)).collect()], key=str)
    assert got == brute(PAGES)


def test_one_row_for_each_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(W, "_COPIES", 7)
    rows = PAGES[:3] + [(9, "http://b/9", BIG)] * 50 + [(1, "http://a/1", BIG)] * 30 + [(5, None, None), (5, "", "")] * 9
    got = sorted([tuple(r) for r in W.warc_report(table(spark, rows)).collect()], key=str)
    assert got == brute(rows) and len(got) == len(rows)


def test_twin(spark):
    import duckdb
    pages = table(spark, PAGES + [(9, "http://b/9", BIG)] * 3).select("page_id", "url", "html").toPandas()
    con = duckdb.connect()
    con.register("pages", pages)
    want = [tuple(None if x != x else x for x in r) for r in con.sql(
        "SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM (" + W.ORACLE + ")").fetchall()]
    got = [tuple(r) for r in W.warc_report(table(spark, PAGES + [(9, "http://b/9", BIG)] * 3)).collect()]
    assert sorted(got, key=str) == sorted(((None if a is None else int(a), b, c, d, e) for a, b, c, d, e in want), key=str)


def test_nested_rows_and_payloads(spark):
    path = W.write_archives(table(spark, PAGES).coalesce(3), scratch_path(spark, "warc-test"))
    recs = W.read_archives(spark, path).cache()
    assert {r.kind: r["count"] for r in recs.groupBy("kind").count().collect()}["request"] == len(PAGES)
    rows = W.assemble(recs).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert r.capture.record_id == r.capture_id and r.request is not None and r.metadata
        assert r.request.url == r.capture.url and "\n" not in r.request.url
    bodies = {bytes(r.capture.payload) for r in rows if r.capture.kind == "response"}
    assert bodies == {(p[2] or "").encode() for p in PAGES}


def test_standard_member_files_and_orphans(spark, tmp_path):
    def record(kind, rid, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {W.Archive().date}", *more,
                f"Content-Length: {len(block)}"]
        return gzip.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n")
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    members = [record("warcinfo", "i", b"software: x\r\n"), record("response", "r1", http + b"\xff\xfe body"),
               record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r1>"),
               record("metadata", "m1", b"page_id: 7\r\n", "WARC-Concurrent-To: <q1>"),
               record("metadata", "m2", b"page_id: 8\r\n", "WARC-Concurrent-To: <missing>")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    rows = {r.capture_id: r for r in W.assemble(W.read_archives(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<r1>", "<missing>", "<i>"}
    full = rows["<r1>"]
    assert bytes(full.capture.payload) == b"\xff\xfe body" and full.request.record_id == "<q1>"
    assert [m.fields["page_id"] for m in full.metadata] == ["7"]
    assert rows["<missing>"].capture is None and rows["<missing>"].metadata[0].fields["page_id"] == "8"


def test_empty(spark):
    assert W.warc_report(table(spark, [])).collect() == []
