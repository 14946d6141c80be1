"""WARC archives with dictionary-compressed records.

Pages with equal payloads of at least ``REVISIT_BYTES`` are archived once: the smallest page id holds the payload, the
others are revisits that refer to it. Each task writes archives of its own: it buffers its first records, builds a
Zstandard dictionary from them, writes it as a leading skippable frame and compresses every record into a frame of its
own, so records can be read one by one. Archives go to a shared folder under names that no other attempt uses; the
manifest of finished tasks is written down, so a lost executor or a repeated attempt leaves stray files at most.

Defined cases: null html counts as empty and is a response of 0 bytes; a null url is replaced by the record id; null page
ids come back as null and are revisits where the same payload has an id (all are responses where none has); repeated rows
of the smallest id are all responses; other columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import arrays as A
from chartloom.session import cut_lineage

# Fixed values of the formats: magic of the skippable frame that holds a dictionary, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_BYTES = 100
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1 << 21, 1 << 16, 3
ARCHIVE_BYTES = 1 << 28
READ_BYTES = 1 << 14
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def name_of(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split()) if url else name_of(page)}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {name_of(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a response's digest is computed and compared."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *fields = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(f.split(": ", 1) for f in fields)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(f.split(b": ", 1) for f in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest, kind = field["WARC-Payload-Digest"].removeprefix("sha256:"), field["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {field['WARC-Record-ID']} is damaged")
    return page_of(field["WARC-Record-ID"]), size, digest, kind, page_of(field["WARC-Refers-To"]) if "WARC-Refers-To" in field else None


def build_dictionary(samples: list[bytes]) -> zstd.ZstdCompressionDict:
    """Trained on the samples, or, where they are too few to train on, made of their last bytes."""
    try:
        return zstd.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, k=256, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes records to archives ``<folder>/<token>-<n>.warc.zst``; ``made`` lists (path, records, bytes) of finished ones."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.scheme = folder[: len(folder) - len(self.folder)] if folder.endswith(self.folder) else ""
        self.token, self.made = uuid.uuid4().hex, []
        self.out, self.waiting, self.held = None, [], 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= SAMPLE_BYTES:
                self._open()
        else:
            self._put(record)

    def _open(self) -> None:
        dictionary = build_dictionary(self.waiting)
        self.path = f"{self.folder}/{self.token}-{len(self.made)}.warc.zst"
        self.out, self.records, self.size = self.store.open_output_stream(self.path, compression=None), 0, 0
        frame = zstd.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        self.compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        waiting, self.waiting, self.held = self.waiting, [], 0
        for record in waiting:
            self._put(record)

    def _put(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.out.write(frame)
        self.records, self.size = self.records + 1, self.size + len(frame)
        if self.size >= ARCHIVE_BYTES:
            self._close()

    def _close(self) -> None:
        self.out.close()
        self.made.append((self.scheme + self.path, self.records, self.size))
        self.out = None

    def finish(self) -> list[tuple[str, int, int]]:
        if self.out is None and self.waiting:
            self._open()
        if self.out is not None:
            self._close()
        return self.made


def read_archive(path: str) -> Iterator[bytes]:
    """Records of an archive, one frame at a time."""
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError("no leading dictionary frame")
        frame = f.read(size)
        dictionary = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(frame))
        context = zstd.ZstdDecompressor(dict_data=dictionary)
        rest = b""
        while rest or (rest := f.read(READ_BYTES)):
            one, parts = context.decompressobj(), []
            while True:
                parts.append(one.decompress(rest))
                if one.eof:
                    rest = one.unused_data
                    break
                if not (rest := f.read(READ_BYTES)):
                    raise ValueError("archive ends inside a record")
            yield b"".join(parts)


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit). Equal payloads meet as digests, never as texts."""
    html = F.coalesce(F.col("html"), F.lit(""))
    seen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    long = seen.filter(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    # written down: read again, a digest that very many pages share can be split over tasks in the join
    firsts = cut_lineage(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n"))
    later = long.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    # one row per id and digest; null ids get a null-safe key of their own
    marks = later.select(F.coalesce("page_id", F.lit(-1)).alias("key"), F.col("page_id").isNull().alias("none"), "digest", F.col("first").alias("refers_to")).distinct()
    made = seen.withColumn("key", F.coalesce("page_id", F.lit(-1))).withColumn("none", F.col("page_id").isNull())
    return made.join(marks, ["key", "none", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives all pages below ``folder``, a URI that every executor reaches; gives the manifest (path, records, bytes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            writer = writer or ArchiveWriter(folder)
            page, url, digest, refers, revisit = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for s in A.slices(batch.column(2)):
                for i in range(s.rows):
                    k = s.lo + i
                    writer.add(build_record(page[k], url[k], s.buf[s.off[i] : s.off[i + 1]].tobytes(), digest[k], refers[k], revisit[k], date))
        made = writer.finish() if writer else []
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), m)) for m in made], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return cut_lineage(with_revisits(pages).mapInArrow(run, "path string, records bigint, bytes bigint"))


def read(manifest: DataFrame) -> DataFrame:
    """One row per archived record; every task reads the archives of its part of the manifest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for raw in read_archive(path):
                    rows.append(parse_record(raw))
                    if len(rows) == 4096:
                        yield emit(rows)
                        rows = []
                if rows:
                    yield emit(rows)

    return manifest.select("path").mapInArrow(run, RECORD)
