import hashlib
import io
import zlib

import pytest

from tidewell.llm import warc

PAGES = "page_id long, url string, html string, payload_digest string, first_id long, path string"


def expected(rows):
    rows = [(i, (h or "").encode()) for i, h in rows]
    out = []
    for i, p in rows:
        first = min((j for j, q in rows if q == p and j is not None), default=None) if len(p) >= 100 else None
        revisit = first is not None and i != first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_and_edges(spark):
    long = "é<p>" * 40_000
    rows = [(5, long), (2, long), (9, long), (1, None), (3, ""), (4, "x" * 99), (6, "x" * 99), (7, "y" * 100), (8, "y" * 100), (8, "y" * 100), (7, "y" * 100), (None, "y" * 100), (None, "z" * 200), (10, "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 9)]
    pages = spark.createDataFrame([(i, "http://x/\r\na%0A" if i == 4 else None, h, "d", 1, "p") for i, h in rows], PAGES).repartition(3)
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.warc_round_trip(pages).collect()), key=repr)
    assert got == expected(rows)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_splits_find_every_record_once(spark):
    from tidewell.llm.common import fresh_path

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = fresh_path(spark, "test-warc")
    files = warc.write_warc(pages.coalesce(1), folder)
    want = {r.page_id: (r.url, r.html) for r in pages.collect()}
    for split in (700, 5000, 1 << 20):
        back = warc.read_warc(spark, files, folder, split_bytes=split).collect()
        assert len(back) == len(want)
        for r in back:
            assert r.url == want[r.page_id][0] and (r.record_type == "revisit" or r.payload.decode() == want[r.page_id][1])


def test_false_magic_is_passed_over():
    good = [warc.record(i, "u", bytes([65 + i]) * 300, hashlib.sha256(bytes([65 + i]) * 300).hexdigest(), None, False) for i in range(3)]
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    stray = other.compress(b"not a record") + other.flush()
    data = good[0] + warc.MAGIC + b"junk" + good[1] + stray + good[2]
    for step in (1, 7, 64, 1000):
        found = [warc.parse(m)[0] for a in range(0, len(data), step) for m in warc.members(io.BytesIO(data), len(data), a, min(len(data), a + step))]
        assert found == [0, 1, 2]


def archive(n):
    return [warc.record(i, "u", bytes([65 + i]) * 300, hashlib.sha256(bytes([65 + i]) * 300).hexdigest(), None, False) for i in range(n)]


def read(data, step=1 << 20):
    return [warc.parse(m)[0] for a in range(0, len(data), step) for m in warc.members(io.BytesIO(data), len(data), a, min(len(data), a + step))]


@pytest.mark.parametrize("step", [9, 1 << 20])
def test_damaged_and_truncated_archives_are_errors(step):
    good = archive(3)
    body = bytearray(good[1])
    body[len(body) // 2] ^= 0x55
    crc = bytearray(good[1])
    crc[-6] ^= 1
    for bad in (bytes(body), bytes(crc)):
        with pytest.raises(ValueError):
            read(good[0] + bad + good[2], step)
    for end in (1, 9, 60):
        with pytest.raises((EOFError, ValueError)):
            read(good[0] + good[1][:-end], step)
    assert read(b"".join(good), step) == [0, 1, 2]


def test_a_hot_payload(spark):
    rows = [(i, "<p>same</p>" * 20 if i % 3 == 0 else "short" if i % 3 == 1 else f"<p>own {i}</p>" * 20) for i in range(90)]
    pages = spark.createDataFrame([(i, None, h, "d", 1, "p") for i, h in rows], PAGES).repartition(5)
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.warc_round_trip(pages).collect()), key=repr)
    assert got == expected(rows)
