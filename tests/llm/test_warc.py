"""Zstandard archives: round trips, what the checks reject, and odd rows."""

import base64
import glob
import hashlib
import struct

import pytest
import zstandard

from strandweave.llm import warc

PAGES = "page_id long, url string, html string, refers string, first long"


def _want(rows):
    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    out = []
    for k, _, html in rows:
        body, low = (html or "").encode(), first.get(html or "")
        again = low is not None and k != low
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [64 << 20, 2000])
def test_round_trip(spark, size):
    rows = [(k, f"http://a.org/{k} x\r\ny", f"<p>page {k % 40} é</p>" * (1 + k % 7)) for k in range(300)]
    rows += [(900 + k, None, "hot") for k in range(200)] + [(1, "u", rows[1][2]), (5, None, None), (6, "", ""), (None, "n", "only null"), (None, "n", "only null"), (None, "n", "hot"), (700, "l", "long " * 400_000), (701, "w", "\r\n\r\nWARC/1.1\r\n\r\n")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(3)
    got = warc.round_trip(df, warc.Archives(archive_bytes=size)).collect()
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == _want(rows)


def test_archives_are_standard_and_payloads_come_back(spark, tmp_path):
    rows = [(k, f"http://a.org/{k}", f"<html><body>text {k * k} of page {k}</body></html>", "x", 1) for k in range(200)]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(2), str(tmp_path / "out"))
    names = glob.glob(str(tmp_path / "out" / "*"))
    assert len(names) == 2 and all(n.endswith(".warc.zst") and "/part-" in n for n in names)
    data = open(names[0], "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    given = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(data[8 : 8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=given).decompressobj().decompress(data[8 + size :])
    assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC/1.1") == 1  # a frame is a record
    got = {r["page_id"]: (r["url"], bytes(r["html"]).decode()) for r in warc.read_archives(spark, str(tmp_path / "out")).collect()}
    assert got == {k: (u, h) for k, u, h, *_ in rows}


def test_plain_dictionary_none_at_all_and_broken_frames():
    records = [warc.record(k, "u", b"body %d" % k, False, None, 6 + len(str(k)), warc.base32_digest(b"body %d" % k)) for k in range(50)]
    made = warc.dictionary(records, warc.Archives(dictionary_bytes=1024)) or b""
    plain = struct.pack("<II", 0x184D2A5D, len(made)) + made
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(made))
    data = plain + b"".join(pack.compress(r) for r in records)
    assert [r for r, _ in warc.frames(data)] == records
    bare = b"".join(zstandard.ZstdCompressor().compress(r) for r in records)
    assert [r for r, _ in warc.frames(bare)] == records and list(warc.frames(b"")) == []
    cut = list(warc.frames(bare[:-3]))
    assert [r for r, _ in cut[:-1]] == records[:-1] and cut[-1][1] == "frame: cut off"
    assert list(warc.frames(bare + b"noise"))[-1][1].startswith("frame")


def test_every_rule_is_checked():
    good = warc.record(7, "http://a", b"hello", False, None, 5, warc.base32_digest(b"hello"))
    assert warc.parsed(good) == (7, "http://a", "response", 5, warc.base32_digest(b"hello"), None, b"hello", None)
    again = warc.record(8, None, b"hello", True, 7, 5, warc.base32_digest(b"hello"))
    assert warc.parsed(again) == (8, None, "revisit", 5, warc.base32_digest(b"hello"), 7, None, None)
    for old, new, said in [
        (b"WARC/1.1", b"WARC/0.9", "no version line"),
        (b"WARC-Date: ", b"X-Date: ", "header missing: warc-date"),
        (b"hello\r\n", b"hello", "length of the block"),
        (b"hello", b"hallo", "digest of the block"),
    ]:
        assert warc.parsed(good.replace(old, new))[-1] == said
    unlike = warc.record(7, None, b"hello", False, None, 5, warc.base32_digest(b"other"))
    assert warc.parsed(unlike)[-1] == "digest of the payload"
    short = warc.record(7, None, b"hello", False, None, 4, warc.base32_digest(b"hello"))
    assert warc.parsed(short)[-1] == "length of the payload"
    assert warc.parsed(b"")[-1] == "no version line"


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
