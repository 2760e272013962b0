"""op5: archives read back hold what was written; plain zstd and the seek table agree on the frames."""

import base64
import hashlib
import io

import pyarrow.fs
import zstandard

from drawgraph.llm import warc

ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "two"), (3, None, "<p>one</p>"), (0, "http://a/ü\r\nX: y", "<p>one</p>"), (4, "u", None), (5, "u", ""), (None, "u", "two"), (None, "u", "alone"), (None, "u", "alone"), (6, "u", "x" * 700_000), (7, "u", "é" * 1000), (7, "u", "é" * 1000)]


def expected(rows):
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    out = []
    for page, _, html in rows:
        data, first = (html or "").encode(), least.get(html or "")
        to = None if first is None or first == page else first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    index = warc.write_archives(frame(spark, ROWS))
    got = warc.read_archives(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS)
    payload = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert payload[6] == b"x" * 700_000 and payload[0] == b"<p>one</p>" and payload[4] == b""


def test_seek_table_and_fetch(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 900) for i in range(300)]
    index = warc.write_archives(frame(spark, rows).coalesce(1))
    places = index.collect()
    for name in {r.bundle for r in places}:
        fs, path = pyarrow.fs.FileSystem.from_uri(name)
        data = fs.open_input_file(path).read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        table = warc.read_seek_table(data)
        assert sum(x[3] for x in table) == len(plain) and len(table) > 1
        for r in (r for r in places if r.bundle == name):
            at, size, start, _ = table[r.frame]
            assert (at, size) == (r.frame_at, r.frame_bytes)
            assert warc.parse(plain[start + r.at : start + r.at + r.length])[0]["WARC-Record-ID"] == f"<urn:x-page:{r.page_id}>"
    some = warc.fetch(index.filter("page_id in (5, 77, 299)")).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in some} == {i: f"page {i} " * 900 for i in (5, 77, 299)}


def test_least_bytes_and_empty(spark):
    index = warc.write_archives(frame(spark, ROWS), least_bytes=5)
    assert {r.page_id for r in index.filter("record_type = 'revisit'").collect()} == {1, 3}
    assert warc.read_archives(warc.write_archives(frame(spark, []))).collect() == []
