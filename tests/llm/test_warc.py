import hashlib
import struct

import pytest

from chartloom.llm import warc
from chartloom.sources.tables import scratch_path


def expected(rows):
    payload = {}
    for page, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            payload[data] = min(page, payload.get(data, page))
    out = []
    for page, html in rows:
        data = (html or "").encode()
        first = payload.get(data)
        revisit = first is not None and first != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (5, "x" * 100), (3, "x" * 100), (9, "x" * 100), (4, "y" * 99), (6, "y" * 99), (7, None), (8, ""), (10, "é" * 50), (11, "é" * 50),
    (3, "x" * 100), (None, "x" * 100), (None, "only" * 50), (-1, "x" * 100), (12, "long \r\n\r\n " * 200_000),
]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(p, None if i % 2 else f"http://a/{i}\r\nX: y", h, "z") for i, (p, h) in enumerate(ROWS)], "page_id bigint, url string, html string, digest string").repartition(2)
    manifest = warc.write(pages, scratch_path(spark, "warc"))
    assert sum(r.records for r in manifest.collect()) == len(ROWS)
    assert sorted((tuple(r) for r in warc.read(manifest).collect()), key=repr) == expected(ROWS)
    assert warc.read(warc.write(pages.limit(0), scratch_path(spark, "warc"))).count() == 0


def test_given_pages_and_dictionary(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    manifest = warc.write(pages, scratch_path(spark, "warc"))
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert sorted((tuple(r) for r in warc.read(manifest).collect()), key=repr) == expected(rows)
    done = manifest.collect()
    with open(done[0].path.removeprefix("file:"), "rb") as f:
        assert struct.unpack("<I", f.read(4))[0] == warc.DICTIONARY_MAGIC
    assert sum(r.bytes for r in done) < sum(len((h or "").encode()) for _, h in rows) / 2


def test_damage_is_noticed():
    raw = warc.build_record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, "1970-01-01T00:00:00Z")
    assert warc.parse_record(raw)[:2] == (1, 7)
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))
