import base64
import hashlib

import pyarrow.fs as pafs
import zstandard

from clausewise.llm import warc as W
from clausewise.session import materialise

PAGES = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 3_000_000), (9, "u", "<p>é</p>"), (9, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (None, "v", "solo\r\n\r\nWARC/1.1\r\n")]


def archived(spark, tmp_path, rows, **extra):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name, value in extra.items():
        from pyspark.sql import functions as F

        pages = pages.withColumn(name, F.lit(value))
    index = materialise(W.write_archives(W.dedupe(pages), f"file://{tmp_path}/archive"))
    return index, W.read_archives(index).collect()


def test_round_trip(llm_spark, tmp_path):
    _, rows = archived(llm_spark, tmp_path, PAGES, refers_to=5, _sha="x", payload="p")
    assert len(rows) == len(PAGES)
    html = {}
    for page_id, _, text in PAGES:
        html.setdefault(page_id, set()).add((text or "").encode())
    groups = {}
    for page_id, _, text in PAGES:
        groups.setdefault((text or "").encode(), []).append(page_id)
    by_digest = {base64.b32encode(hashlib.sha1(p).digest()).decode(): p for p in groups}
    for r in rows:
        payload = by_digest[r.payload_digest]
        first = max((i for i in groups[payload] if i is not None), default=None)
        assert r.payload_bytes == len(payload) and payload in html[r.page_id]
        if r.page_id == first:
            assert (r.record_type, r.refers_to, r.payload) == ("response", None, payload)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first, None)
    assert {r.url for r in rows if r.page_id == 1} == {"http://a/%0D%0Ax"}


def test_frames_stand_alone(llm_spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FRAME_BYTES", 500)
    rows = [(i, "u", f"page {i} " * 20) for i in range(40)]
    index, _ = archived(llm_spark, tmp_path, rows)
    places = index.collect()
    bundle = places[0].bundle
    system, path = pafs.FileSystem.from_uri(bundle)
    with system.open_input_file(path) as source:
        table = W.seek_table(source)
        assert len(table) > 1
        for p in (p for p in places if p.bundle == bundle):
            source.seek(p.frame_start)
            frame = zstandard.ZstdDecompressor().decompress(source.read(p.frame_bytes))
            got = W.decode(frame[p.record_start : p.record_start + p.record_bytes])
            assert got["page_id"] == p.page_id and got["payload"] == f"page {p.page_id} ".encode() * 20
    # an ordinary reader unpacks the whole bundle and skips the seek table
    whole = zstandard.ZstdDecompressor().stream_reader(system.open_input_file(path), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == sum(p.bundle == bundle for p in places)


def test_least_bytes(llm_spark):
    pages = llm_spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in W.dedupe(pages, least=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_empty(llm_spark, tmp_path):
    assert archived(llm_spark, tmp_path, [])[1] == []
