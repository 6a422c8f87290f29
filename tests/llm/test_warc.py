import base64
import hashlib

from habitnet.llm import warc
from habitnet.llm.common import stored

SCHEMA = "page_id long, url string, html string, refers_to string"


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = [
        (5, "http://a/", "same", "x"), (2, "http://b/", "same", "x"), (9, "http://c/", "same", None),
        (1, "http://d/", None, "x"), (3, "http://e/", "", "x"), (4, None, "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "x"),
        (6, "http://f/\r\nx", "ends in a break\r\n", "x"), (7, "http://g/", "\r\n\r\n\r\n", "x"), (8, "h", "é日\U0001f600" * 20_000, "x"),
        (None, "n", "only null", "x"), (None, "n", "same", "x"), (2, "http://b/", "same", "x"), (10, "k", "WARC/", "x"),
    ]
    out = str(tmp_path / "warc")
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(2), out)
    records = stored(warc.read(spark, out), "test-warc")
    got = warc.resolved(records).collect()
    assert len(got) == len(rows)
    seen = sorted(((-1 if r["page_id"] is None else r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html, _ in rows:
        html = html or ""
        revisit = html in first and i != first[html]
        want.append((-1 if i is None else i, len(html.encode()), sha(html), "revisit" if revisit else "response", first[html] if revisit else None))
    key = lambda r: (r[0], r[1], r[2], r[3], r[4] or -1)
    assert sorted(seen, key=key) == sorted(want, key=key)
    assert {r["payload"] for r in got} == {html or "" for _, _, html, _ in rows}  # revisits get the original's


def test_smaller_payloads_do_not_revisit(spark, tmp_path):
    out = str(tmp_path / "warc")
    warc.write(spark.createDataFrame([(1, "a", "xy", ""), (2, "b", "xy", ""), (3, "c", "xyz", ""), (4, "d", "xyz", "")], SCHEMA), out, min_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in warc.read(spark, out).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_chunks_of_any_size():
    record = lambda i, body: f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    data = record(1, "h\r\n\r\npay") + record(2, "h\r\n\r\n") + record(3, "h\r\n\r\nWARC/1.1\r\n\r\n")
    for size in (1, 2, 3, 7, 50, len(data)):
        got = list(warc.records(data[i : i + size] for i in range(0, len(data), size)))
        assert [p for _, _, p in got] == [b"pay", b"", b"WARC/1.1\r\n\r\n"]


def test_empty(spark, tmp_path):
    out = str(tmp_path / "warc")
    warc.write(spark.createDataFrame([], SCHEMA), out)
    assert warc.read(spark, out).count() == 0
