import base64
import hashlib
import io
import os
import struct

import pytest
import zstandard

from folioscope.llm import warc
from folioscope.llm.queries import op6_warc


def expected(pages, least=0):
    first = {}
    for page, html in pages:
        data = (html or "").encode()
        if page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, html in pages:
        data = (html or "").encode()
        to = first.get(data)
        revisit = len(data) >= least and to is not None and to != page
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_pages_table(spark, small):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert told(op6_warc(spark, small)) == expected(pages)


def test_odd_pages(spark):
    pages = [(5, "same"), (3, "same"), (9, None), (8, ""), (None, "same"), (None, "own"), (1, "é" * 50_000), (2, "\r\n\r\nWARC/1.1\r\n"), (3, "same")]
    df = spark.createDataFrame([(p, "http://x/\r\nA: b" if p == 2 else None, h, "k") for p, h in pages], "page_id long, url string, html string, sha1 string")
    back = warc.archive(df)
    assert told(back) == expected(pages)
    for r in back.where("record_type = 'response'").collect():
        assert bytes(r.payload) in [(h or "").encode() for p, h in pages if p == r.page_id]
    assert warc.archive(df.limit(0)).count() == 0


def test_smaller_payloads_are_not_revisited(spark, tmp_path):
    pages = [(1, "abc"), (2, "abc"), (3, "abcdef"), (4, "abcdef")]
    df = spark.createDataFrame([(p, "u", h) for p, h in pages], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    assert told(warc.read_archives(warc.write_archives(df, folder, 4), folder)) == expected(pages, 4)
    assert not [f for f in os.listdir(tmp_path / "w") if "draft" in f]


@pytest.mark.parametrize("count", [0, 1, 5, 400])
def test_each_frame_opens_alone(count):
    data = [warc.record(i, f"http://h/{i}", f"<p>page {i} of many</p>".encode() * (i % 9 + 1), 20, b"x" * 20, None) for i in range(count)]
    out = io.BytesIO()
    out.close, held = lambda: None, out
    writer = warc.Writer(held)
    for d in data:
        writer.add(d)
    writer.close()
    raw = held.getvalue()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    assert list(warc.records(io.BytesIO(raw), step=97, piece=31)) == data
    if count == 400:
        assert raw[8:12] == struct.pack("<I", 0xEC30A437)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        assert reader.decompressobj().decompress(raw[8 + size :]) == data[0]
        plain = sum(len(zstandard.ZstdCompressor(level=3).compress(d)) for d in data)
        assert len(raw) - size < plain


