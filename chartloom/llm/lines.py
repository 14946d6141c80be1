"""Line dedup over overlapping three-line windows.

Lines with a word are numbered within their text. Every run of three consecutive ones is a window, known by two independent 64-bit hashes. The
first occurrence of a window over the whole table, by document id, hash of the text and position, stays; the lines that any later
occurrence covers go, overlapping windows merging into one stretch. Lines without a word are never counted or removed.

Windows are counted with partial sums before any shuffle; only hashes, ids and positions are shuffled for the search, and
texts once, to meet the positions to remove.

Defined cases: null text counts as empty and stays null; texts of fewer than three lines with a word have no window; null
ids come last; rows that share id and text are one document and treated alike, different texts of one id, or without an id,
are documents of their own; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import arrays as A
from chartloom.session import cut_lineage

RUN = 3


def _solid_lines(s: A.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all lines of a slice, and which of them hold a word."""
    starts, ends, first = A.lines(s)
    solid = np.concatenate([[0], np.cumsum(~A.SPACE[s.buf])])
    return starts, ends, A.row_of(first), solid[ends] > solid[starts]


def windows(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(h, h2, none, id, doc, pos): one row per window, known by two hashes; ``none`` marks null ids, ``doc`` is the hash of the
    whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in A.slices(batch.column(1)):
                starts, ends, row, full = _solid_lines(s)
                starts, ends, row = starts[full], ends[full], row[full]
                if len(row) < RUN:
                    continue
                of = A.SpanHash(s.buf)
                h, h2 = (A.windows(of(starts, ends, k), RUN) for k in range(2))
                at = np.flatnonzero(row[: len(row) - RUN + 1] == row[RUN - 1 :])
                first = np.searchsorted(row, np.arange(s.rows))
                ids, docs_of = (batch.column(c).take(pa.array(row[at] + s.lo)) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in (h, h2)), ids, docs_of, pa.array((at - first[row[at]]).astype(np.int32))], names=["h", "h2", "id", "doc", "pos"])

    ids = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text").alias("__text"), F.xxhash64("text").alias("__doc"))
    made = ids.mapInArrow(run, f"h bigint, h2 bigint, id {ids.schema[0].dataType.simpleString()}, doc bigint, pos int")
    return made.select("h", "h2", F.col("id").isNull().alias("none"), "id", "doc", "pos")


def repeated(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(none, id, doc, starts): per document the window positions that repeat an earlier one."""
    found = windows(docs, id_column)
    place = F.struct("none", "id", "doc", "pos")
    # written down, so that both sides of the join are dealt anew and a window that very many texts share can be split
    first = cut_lineage(found.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = found.join(first, ["h", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("none", "id", "doc").agg(F.collect_set("pos").alias("starts"))


def dedup(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """All documents and columns, texts without repeated lines; adds ``n_lines`` and ``n_removed`` and lets ``n_chars``, where
    there is one, follow."""
    names, kinds = docs.columns, [f.dataType.simpleString() for f in docs.schema]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            starts_of = batch.column(len(names)).to_pylist()
            count, removed = np.ones(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            values = None
            for s in A.slices(text):
                starts, ends, row, full = _solid_lines(s)
                count[s.lo : s.hi] = np.bincount(row, minlength=s.rows)
                touched = [i for i in range(s.rows) if starts_of[s.lo + i]]
                if not touched:
                    continue
                cut = np.searchsorted(row, np.arange(s.rows + 1))
                for i in touched:
                    lines = np.arange(cut[i], cut[i + 1])
                    numbered = lines[full[lines]]
                    gone = np.zeros(len(numbered) + RUN, bool)
                    for p in starts_of[s.lo + i]:
                        gone[p : p + RUN] = True
                    drop = np.zeros(len(lines), bool)
                    drop[numbered - cut[i]] = gone[: len(numbered)]
                    removed[s.lo + i] = drop.sum()
                    if values is None:
                        values = text.to_pylist()
                    values[s.lo + i] = b"\n".join([s.buf[starts[k] : ends[k]].tobytes() for k in lines[~drop]]).decode()
            if values is not None:
                text = pa.array(values, text.type)
            columns = [text if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count), pa.array(removed)], names=[*(f"k{i}" for i in range(len(names))), "n_lines", "n_removed"])

    marks = repeated(docs, id_column)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    own = F.col(f"k{names.index(id_column)}")
    met = rows.join(marks, own.eqNullSafe(F.col("id")) & (F.xxhash64(f"k{at}") == F.col("doc")), "left").drop("none", "id", "doc")
    schema = ", ".join(f"k{i} {k}" for i, k in enumerate(kinds)) + ", n_lines bigint, n_removed bigint"
    made = met.mapInArrow(run, schema)
    if "n_chars" in names:
        k = f"k{names.index('n_chars')}"
        made = made.withColumn(k, F.when(F.col("n_removed") > 0, F.length(f"k{at}")).otherwise(F.col(k)).cast(kinds[names.index("n_chars")]))
    return made.toDF(*names, "n_lines", "n_removed")
