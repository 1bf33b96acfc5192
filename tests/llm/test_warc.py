import base64
import gzip
import hashlib
from pathlib import Path

from trajlake.llm.common import scratch_path
from trajlake.llm.warc import assemble_captures, read_archive, write_archive

ROWS = [
    (5, "http://a.example/x?y=1#z", "<p>é</p>"), (2, "http://b.example", "<p>é</p>"), (9, None, None), (4, "", ""),
    (7, "http://c.example/\r\nX: y", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"), (8, "u", "x" * 3_000_000),
    (11, "u", "\r\n\r\n"), (11, "u", "\r\n\r\n"), (12, "u", "other"), (12, "u", "again"), (13, "v", "<p>é</p>"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'q' AS digest", "1 AS id")
    path = scratch_path(spark, "warc")
    write_archive(pages.repartition(3), path)
    got = assemble_captures(read_archive(spark, path)).collect()
    want = []
    for k, _, html in ROWS:
        data = (html or "").encode()
        one = min(i for i, _, h in ROWS if (h or "") == (html or ""))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((k, len(data), digest, "response" if k == one else "revisit", None if k == one else one, html or ""))
    rows = [
        (r.capture_id, r.response.payload_bytes, r.response.actual_digest, r.record_type, r.refers_to, r.response.payload)
        for r in got
    ]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert all(r.request.payload is not None and "capture-id" in r.metadata.payload for r in got)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path.removeprefix("file://")).glob("*.gz"))
    assert raw.count(b"WARC-Concurrent-To") == 2 * len(ROWS)


def test_min_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    write_archive(pages, path, min_bytes=3)
    kinds = {r.capture_id: r.record_type for r in assemble_captures(read_archive(spark, path, False)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    empty = scratch_path(spark, "warc")
    write_archive(pages.limit(0), empty)
    assert assemble_captures(read_archive(spark, empty)).count() == 0


def test_malformed_records_are_rows_with_a_problem(spark):
    def record(*headers, block=b"x"):
        return b"\r\n".join((b"WARC/1.1", *headers)) + b"\r\n\r\n" + block + b"\r\n\r\n"

    kind, ident, size = b"WARC-Type: resource", b"WARC-Record-ID: <urn:a>", b"Content-Length: 1"
    good = [
        record(kind, ident, size), b"stray line\r\nanother\r\n", record(kind, size), record(ident, size), record(kind, ident),
        record(kind, ident, b"Content-Length: -3"), record(kind, ident, size, "WARC-Target-URI: \u00a0h\u00e9 \u0085".encode("latin-1")),
        record(kind, ident, b"Content-Length: 500", block=b"abc")[:-4],
    ]
    path = scratch_path(spark, "warc")
    folder = Path(path.removeprefix("file://"))
    folder.mkdir()
    whole = gzip.compress(b"".join(good))
    (folder / "a.gz").write_bytes(whole)
    (folder / "b.gz").write_bytes(gzip.compress(record(kind, ident, size) * 9)[:-12])
    (folder / "c.gz").write_bytes(b"no gzip at all")
    (folder / "d.gz").write_bytes(b"")
    rows = read_archive(spark, path).collect()
    problems = [r.problem for r in rows]
    want = {"not_a_record": 1, "no_record-id": 1, "no_type": 1, "no_length": 2, "truncated": 1, "broken_gzip": 2}
    assert {p: problems.count(p) for p in set(problems) if p} == want
    assert [r.target_uri for r in rows if r.target_uri] == ["\u00a0h\u00e9 \u0085"]
    assert [r.payload for r in rows if r.problem == "truncated"] == ["abc"]
    assert assemble_captures(read_archive(spark, path)).count() == 0


def test_blanks_round_a_url_and_large_pages_stay(spark):
    rows = [(1, "  http://a/ \u0085", "x" * 70_000), (2, "b", "y" * 5_000_000), (3, "c", "z" * 5_000_000), (4, "d", "w")]
    path = scratch_path(spark, "warc")
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), path)
    got = {r.capture_id: (r.target_uri, r.response.payload) for r in assemble_captures(read_archive(spark, path)).collect()}
    assert got == {i: (u, h) for i, u, h in rows}
    assert len(list(Path(path.removeprefix("file://")).glob("*.gz"))) == 4
