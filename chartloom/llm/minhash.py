"""MinHash fingerprints of documents.

A text is the set of its five-word shingles. ``PERMS`` multiply-shift hashes of the shingles, taken in vectorised numpy,
give one minimum each; eight bits of every minimum make the fingerprint. The share of equal positions, corrected for the
one in 256 that agree by chance, estimates the Jaccard similarity. Texts are compared with their edited text and the next
one; a join over bands of the fingerprints is not part of this module.

Defined cases: null text counts as empty; texts without words share one fingerprint, and their likeness to one another is
1; texts of one to four words have one shingle of all their words; equal ids are ordered by a hash of the text; null ids come first;
repeated rows are rows of their own; other columns are ignored; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm import arrays as A
from chartloom.sources.tables import scratch_path

PERMS, SHINGLE = 128, 5
_A, _B = A.seeds(PERMS, 11) | A.U64(1), A.seeds(PERMS, 12)


def minima(s: A.Slice) -> np.ndarray:
    """The smallest hash of each row's shingles under each permutation (rows x PERMS); all ones without words."""
    starts, ends, first = A.words(s)
    x, at = A.shingles(A.SpanHash(s.buf)(starts, ends), first, SHINGLE)
    out = np.full((s.rows, PERMS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        heads = at[full]
        for j in range(PERMS):
            out[full, j] = np.minimum.reduceat(((x * _A[j] + _B[j]) >> A.U64(32)).astype(np.uint32), heads)
    return out


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """Eight bits of every minimum (rows x PERMS)."""
    made = [A.mix(minima(s).astype(A.U64)).astype(np.uint8) for s in A.slices(column, 1 << 18)]
    return np.concatenate(made) if made else np.zeros((0, PERMS), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(((a == b).mean(1) - 1 / 256) / (1 - 1 / 256), 0, 1)


def fingerprint(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, fingerprint): lowercase hex, two digits per permutation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = fingerprints_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes().hex() for r in f], pa.string())], names=["id", "fingerprint"])

    ids = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text").alias("__text"))
    return ids.mapInArrow(run, f"id {ids.schema[0].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_column)


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many characters of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_BYTES = 1 << 20


def _compare(ids: list, texts: list[str], prints: np.ndarray) -> tuple[list, dict]:
    """All but the last of ``texts`` with the one that follows."""
    edited = [edit(a, b) for a, b in zip(texts, texts[1:])]
    other = fingerprints_of(pa.array(edited, pa.large_string()))
    own = prints[:-1]
    return ids[:-1], {
        "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [r.tobytes() for r in own], "edited_fingerprint": [r.tobytes() for r in other],
        "near_edited": likeness(own, other), "near_next": likeness(own, prints[1:]),
    }


def with_next(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text's.

    Texts are dealt by ranges of ids and sorted, so neighbours lie in one task. Only the first and last text of each range
    are handed on to meet their neighbour in the next range.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "role", "id", *(c.split()[0] for c in _ROW.split(", ")), "text"]
        part, types = TaskContext.get().partitionId(), None

        def rows(role: int, ids: list, columns: dict, texts: list | None) -> pa.RecordBatch:
            n = len(ids)
            made = {"part": [part] * n, "role": [role] * n, "id": ids, **{c: columns.get(c, [None] * n) for c in names[3:9]}, "text": texts or [None] * n}
            return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in types], schema=types)

        last: tuple | None = None
        for batch in batches:
            if types is None:
                types = pa.schema([("part", pa.int64()), ("role", pa.int32()), ("id", batch.schema.types[0]), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
            for s in A.slices(batch.column(1), _BYTES):
                ids = batch.column(0).slice(s.lo, s.hi - s.lo).to_pylist()
                texts = [s.text(i) for i in range(s.rows)]
                prints = fingerprints_of(batch.column(1).slice(s.lo, s.hi - s.lo))
                if last is None:
                    yield rows(2, ids[:1], {}, texts[:1])
                else:
                    ids, texts, prints = [last[0], *ids], [last[1], *texts], np.concatenate([last[2][None], prints])
                if len(ids) > 1:
                    yield rows(0, *_compare(ids, texts, prints), None)
                last = ids[-1], texts[-1], prints[-1]
        if last:
            yield rows(1, [last[0]], {}, [last[1]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = [batch.column(1)[i].as_py(), batch.column(2)[i].as_py()]
                ids, made = _compare([None, None], pair, fingerprints_of(pa.array(pair)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array(v, t) for v, t in zip(made.values(), (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())))], names=["id", *made])

    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    path = scratch_path(docs.sparkSession, "fingerprints")
    # written once: ranges may be drawn differently if they were computed again
    dealt.mapInArrow(run, f"part bigint, role int, id {kind}, {_ROW}, text string").write.parquet(path)
    made = docs.sparkSession.read.parquet(path)
    heads = made.filter("role = 2").select("part", F.col("text").alias("following"))
    # one number per range, whatever the documents hold
    everything = Window.orderBy("part")
    order = heads.select("part", F.coalesce(F.lead("part").over(everything), F.first("part").over(everything)).alias("after"))
    tails = made.filter("role = 1").select("part", "id", "text").join(order, "part")
    pairs = tails.join(heads.withColumnRenamed("part", "after"), "after").select("id", "text", "following")
    ends = pairs.mapInArrow(finish, f"id {kind}, {_ROW}")
    found = made.filter("role = 0").select(*ends.columns).unionByName(ends)
    shown = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select(F.col("id").alias(id_column), "n_chars", "edited_sha256", shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next")
