"""SimHash near-duplicates by tiled exact comparison.

A text is lower-cased (A-Z only) and cut into words; its three-word shingles, repeats included, are hashed with XXH64 and
every bit of the fingerprint is the majority of that bit over the hashes. Fingerprints link when at most ``RADIUS`` bits
differ, and documents are in one component when links join them.

Only distinct fingerprints are compared. The population counts of ``parts`` equal parts of a fingerprint name its cell; cells
are cut into tiles of about ``TILE`` fingerprints. The counts of two fingerprints differ by no more than their bits do,
so tiles whose counts lie further apart than the radius are never paired; all other pairs of tiles are compared completely
with exclusive-or and bit counts. A pair of tiles returns a spanning forest of its links, never the links themselves, so
a large group of near copies costs no more rows than it has fingerprints. ``parts`` follows from the number of
fingerprints and changes the work alone, not the result.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; a text of one or
two words has one shingle of all its words; null ids keep their rows, their component is the smallest id that is not null
(null if there is none); repeated rows are rows of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import arrays as A
from chartloom.llm.connect import components
from chartloom.session import cut_lineage

SHINGLE, SEED, RADIUS = 3, 42, 3
TILE = 4096
_CHUNK = 1 << 16
#: Parts of a fingerprint and the number of fingerprints up to which they serve: with more parts more tiles are skipped.
PARTS = ((1, 14 * TILE), (2, 100 * TILE), (4, 2500 * TILE), (8, None))
_CODE = 65  # more than any count plus the radius, so a neighbour outside the counts names no cell


def _shingle_hashes(s: A.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the space-joined ``k``-word shingles of each row, and the index of each row's first (rows + 1)."""
    low = s.buf + ((s.buf >= 65) & (s.buf <= 90)) * np.uint8(32)
    starts, ends, first = A.words(s)
    count = np.diff(first)
    have = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(have)])
    row = np.repeat(np.arange(s.rows), have)
    lead = first[row] + np.arange(at[-1]) - at[row]
    size = np.minimum(count[row], k)
    # words with single spaces between them lie in the text as the shingle has them
    plain = np.ones(len(starts) + 1, bool)
    if len(starts) > 1:
        plain[1:-1] = (starts[1:] - ends[:-1] == 1) & (s.buf[ends[:-1]] == 32)
    broken = np.concatenate([[0], np.cumsum(~plain)])
    as_is = broken[lead + size] == broken[lead + 1]
    data, digest = low.tobytes(), xxhash.xxh64_intdigest
    out = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts[lead].tolist(), ends[lead + size - 1].tolist())), A.U64, len(lead))
    for i in np.flatnonzero(~as_is):
        span = range(lead[i], lead[i] + size[i])
        out[i] = digest(b" ".join([data[starts[j] : ends[j]] for j in span]), SEED)
    return out, at


def fingerprints_of(column: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of every text."""
    made = []
    for s in A.slices(column):
        h, at = _shingle_hashes(s, k)
        ones = np.zeros((s.rows, 64), np.int64)
        row = np.repeat(np.arange(s.rows), np.diff(at))
        for lo in range(0, len(h), _CHUNK):
            part, rows = h[lo : lo + _CHUNK], row[lo : lo + _CHUNK]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            ones[rows[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        most = 2 * ones > np.diff(at)[:, None]
        made.append(np.packbits(most, axis=1, bitorder="little").view("<u8").ravel().astype(A.U64))
    return np.concatenate(made) if made else np.zeros(0, A.U64)


def fingerprint(docs: DataFrame, id_column: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row: its 64-bit fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(1), k).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, fp bigint")


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of ``a[i]`` and ``b[i]`` in place; every label is the smallest member of its class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def tile_forest(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or within one, given twice), as pairs of fingerprints."""
    both = np.concatenate([a, b])
    label = np.arange(len(both))
    step = max(1, (1 << 20) // len(b))
    for lo in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[lo : lo + step, None] ^ b[None]) <= radius)
        union(label, x + lo, y + len(a))
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[label[moved]], both[moved]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            a, b = (np.asarray(c[i].values, np.int64).view(A.U64) for c in (left, right))
            u, v = tile_forest(a, b)
            other = u != v
            yield pa.RecordBatch.from_arrays([pa.array(u[other].view(np.int64)), pa.array(v[other].view(np.int64))], names=["a", "b"])


def near_links(prints: DataFrame, n: int, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """(a, b): links that join all distinct fingerprints ``fp`` within the radius into their components; ``n``: how many."""
    parts = parts or next(p for p, most in PARTS if most is None or n <= most)
    width = 64 // parts
    code = F.lit(0).cast("bigint")
    for i in range(parts):
        mask = ((1 << width) - 1) << (i * width)
        held = F.bit_count(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        code = code + held.cast("bigint") * _CODE**i
    offsets = [sum(m * _CODE**i for i, m in enumerate(move)) for move in _moves(parts, RADIUS)]
    cells = prints.select("fp", code.alias("cell"))
    cuts = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("cuts"))
    dealt = cells.join(cuts, "cell").select("cell", F.pmod(F.xxhash64("fp"), "cuts").alias("cut"), "fp")
    # dealt anew: a cell that holds many fingerprints is spread over its cuts
    tiles = cut_lineage(dealt.repartition("cell", "cut").groupBy("cell", "cut").agg(F.collect_list("fp").alias("fps")))
    # each pair of cells once: towards the larger code
    ahead = F.array(*[F.lit(o).cast("bigint") for o in sorted(offsets) if o >= 0])
    left = tiles.select(F.col("cell").alias("c"), F.col("cut").alias("k"), F.col("fps").alias("x"), F.explode(ahead).alias("o"))
    pairs = left.withColumn("cell", F.expr("c + o")).join(tiles, "cell").filter("o > 0 OR k <= cut")
    return pairs.select("x", "fps").mapInArrow(_compare, "a bigint, b bigint")


def _moves(parts: int, radius: int) -> Iterator[tuple[int, ...]]:
    """Integer vectors whose absolute values sum to at most ``radius``."""
    if not parts:
        yield ()
        return
    for m in range(-radius, radius + 1):
        for rest in _moves(parts - 1, radius - abs(m)):
            yield (m, *rest)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", tile: int = TILE, parts: int | None = None) -> DataFrame:
    """One row per document: id, fingerprint (16 lowercase hex digits), component_id (smallest id it is linked with)."""
    prints = cut_lineage(fingerprint(docs, id_column))
    firsts = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(near_links(firsts.select("fp"), firsts.count(), tile, parts))
    rooted = firsts.join(roots, firsts.fp == roots.sid, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select(F.col("id").alias(id_column), shown, "component_id")
