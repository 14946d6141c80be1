"""Hard negatives by slot-decomposed selection.

Every anchor has its positives, the best rows of its own label. The scores of the positives are the upper limits of the
windows in which negatives are wanted; sorted, they cut the scores below into disjoint slots. While rows stream past, a task
keeps the best ``keep`` negatives of every (anchor, slot), nothing else, and the slots of all tasks are merged by the same rule.
Slots follow one another in score, so the best negatives under an upper limit are those of its slot followed by those of
the slots below: one walk from the lowest slot upwards, merging suffixes, answers all windows, however they overlap.

Anchors are compared with all rows, in batches whose vectors take at most ``BATCH_BYTES``; each batch is broadcast and meets the
rows where they lie. A task multiplies blocks of rows with tiles of anchors. Only kept entries are shuffled.

Scores are exact: float64 products while every partial sum stays below 2**53, 64-bit integers and then unbounded ones
beyond; scores outside 64 bits are held at their ends, as are components.

Defined cases: rows with a null label or vector or a null or non-finite component take no part; vectors of different
lengths are multiplied over their common length; rows of equal ids are rows of their own and an anchor leaves out itself once;
null ids are no anchors and come last among ties; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.sources.tables import scratch_path

BATCH_BYTES = 32 << 20
_ROWS, _TILE = 4096, 1024
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_NULL_ID = _HIGH  # stands for a null id: last among ties
_ENTRY = "anchor int, slot int, score bigint, id bigint"


def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and floored components (rows x longest vector) of the rows that take part; columns id, label, vec."""
    ids, labels, column = (batch.column(i) for i in range(3))
    values, size = column.flatten(), np.asarray(column.value_lengths().fill_null(0), np.int64)
    x = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    off = np.concatenate([[0], np.cumsum(size)])
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = np.asarray(column.is_valid()) & np.asarray(labels.is_valid()) & (odd[off[1:]] == odd[off[:-1]])
    rows = np.flatnonzero(good)
    width = int(size[rows].max(initial=0))
    out = np.zeros((len(rows), width), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(256 * x)
        whole = np.where(y >= 2.0**63, _HIGH, np.where(y < -(2.0**63), _LOW, np.clip(y, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))
    if len(rows):
        row = np.repeat(np.arange(len(rows)), size[rows])
        place = np.arange(len(row)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
        out[row, place] = whole[np.repeat(off[rows], size[rows]) + place]
    return np.asarray(ids.fill_null(_NULL_ID))[rows], np.asarray(labels.fill_null(0))[rows], out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``."""
    d = min(a.shape[1], b.shape[1])
    if not (d and len(a) and len(b)):
        return np.zeros((len(a), len(b)), np.int64)
    a, b = a[:, :d], b[:, :d]
    most = d * max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min()))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, _LOW, _HIGH).astype(np.int64)


class Best:
    """The best ``keep`` entries of every key (anchor and slot in one number): higher scores first, then smaller ids."""

    def __init__(self, keys: int, keep: int):
        self.keep = keep
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.worst = np.full(keys, _LOW)  # an entry below it is not among the best

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, key))  # ~x falls as x rises, without overflow
        key, score, ids = key[order], score[order], ids[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        nth = np.arange(len(key)) - np.repeat(head, np.diff(np.concatenate([head, [len(key)]])))
        stay = nth < self.keep
        self.key, self.score, self.id = key[stay], score[stay], ids[stay]
        full = nth == self.keep - 1
        self.worst[key[full]] = score[full]

    def batch(self, slots: int) -> pa.RecordBatch:
        made = [pa.array((self.key // slots).astype(np.int32)), pa.array((self.key % slots).astype(np.int32)), pa.array(self.score), pa.array(self.id)]
        return pa.RecordBatch.from_arrays(made, names=["anchor", "slot", "score", "id"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            ids, labels, x = vectors(batch.slice(lo, _ROWS))
            if len(ids):
                yield ids, labels, x


def _runs(labels: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(labels, kind="stable")
    cut = np.flatnonzero(np.diff(labels[order])) + 1
    return {int(labels[g[0]]): g for g in np.split(order, cut) if len(g)}


def best_same(anchors: tuple, blocks: Iterator[tuple], keep: int) -> Best:
    """For each anchor the best ``keep`` rows of its label, itself included."""
    _, labels, vecs = anchors
    best, own = Best(len(labels), keep), _runs(labels)
    for ids, row_labels, x in blocks:
        for label, rows in _runs(row_labels).items():
            mine = own.get(label, np.zeros(0, np.int64))
            for lo in range(0, len(mine), _TILE):
                tile = mine[lo : lo + _TILE]
                s = scores(vecs[tile], x[rows])
                a, r = np.nonzero(s >= best.worst[tile, None])
                best.add(tile[a], s[a, r], ids[rows[r]])
    return best


def best_in_slots(anchors: tuple, limits: np.ndarray, counts: np.ndarray, blocks: Iterator[tuple], keep: int) -> Best:
    """For each anchor and slot the best ``keep`` rows of other labels. ``limits`` (anchors x slots) fall from left to right; the
    first ``counts`` of them hold, and slot j reaches from its limit down to the next one."""
    _, labels, vecs = anchors
    slots = limits.shape[1]
    best, width = Best(len(labels) * slots, keep), np.arange(slots)
    last = np.take_along_axis(limits, np.maximum(counts - 1, 0)[:, None], 1)[:, 0]
    # no window reaches below four fifths of the lowest limit; windows of negative limits are empty
    floor = np.where(last >= 0, last - last // 5, 0)
    live = np.flatnonzero((counts > 0) & (limits[:, 0] >= 0))
    for ids, row_labels, x in blocks:
        for lo in range(0, len(live), _TILE):
            tile = live[lo : lo + _TILE]
            s = scores(vecs[tile], x)
            wanted = (s >= floor[tile, None]) & (s <= limits[tile, :1]) & (labels[tile, None] != row_labels)
            a, r = np.nonzero(wanted)
            score, anchor = s[a, r], tile[a]
            held = width < counts[anchor][:, None]
            slot = (held & (score[:, None] <= limits[anchor])).sum(1) - 1
            key = anchor * slots + slot
            good = score >= best.worst[key]
            best.add(key[good], score[good], ids[r[good]])
    return best


def suffix_windows(slot: np.ndarray, score: np.ndarray, limits: list[int], keep: int) -> list[list[int]]:
    """For each limit the places of the best ``keep`` entries in its window. Entries are sorted by slot, best first."""
    out: list[list[int]] = [[] for _ in limits]
    below: list[int] = []
    for j in range(len(limits) - 1, -1, -1):
        below = ([*range(*np.searchsorted(slot, [j, j + 1]))] + below)[:keep]
        p = limits[j]
        out[j] = [i for i in below if score[i] >= p - p // 5]
    return out


def _merge(entries: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` of what the tasks kept, for each anchor and slot."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return entries.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= keep).drop("nth")


def mine(rows: DataFrame, is_anchor: Column, label: Column, id_column: str = "vec_id", vector: str = "embedding", positives: int = 5, keep: int = 5, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best
    ``positives`` rows of the same label the best ``keep`` rows of other labels with a score between 80 and 100 percent of the
    positive's."""
    spark = rows.sparkSession
    part = rows.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(f"`{vector}`").alias("vec"), is_anchor.alias("picked"))
    usable = part.filter("label IS NOT NULL AND vec IS NOT NULL")
    picked = usable.filter("picked AND id IS NOT NULL").select("id", "label", "vec")
    n, longest = picked.agg(F.count("*"), F.max(F.size("vec"))).first()
    path = scratch_path(spark, "anchors")
    batches = max(1, -(-n * 8 * max(1, longest or 0) // batch_bytes))
    # dealt evenly, whatever the ids are, and written once so that a batch is the same set of rows in all its jobs
    picked.repartition(batches).withColumn("batch", F.spark_partition_id()).write.parquet(path)
    dealt, rows = spark.read.parquet(path), usable.select("id", "label", "vec")
    parts = [_mine_batch(rows, dealt.filter(F.col("batch") == b).drop("batch"), positives, keep) for b in range(batches)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _mine_batch(rows: DataFrame, anchors: DataFrame, positives: int, keep: int) -> DataFrame:
    spark = rows.sparkSession
    held = [vectors(b) for b in anchors.toArrow().combine_chunks().to_batches()]
    ids, labels, vecs = held[0] if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
    sent = spark.sparkContext.broadcast((ids, labels, vecs))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield best_same(sent.value, _blocks(batches), positives + 1).batch(1)

    near = _merge(rows.mapInArrow(same, _ENTRY), positives + 1).orderBy("anchor", F.desc("score"), "id").toArrow()
    own, score, other = (np.asarray(near.column(c).combine_chunks(), np.int64) for c in ("anchor", "score", "id"))
    # the anchor itself is among its best or not; of equal entries any may stand for it
    selves = np.array([scores(vecs[i : i + 1], vecs[i : i + 1])[0, 0] for i in range(len(ids))], np.int64)
    itself = (other == ids[own]) & (score == selves[own])
    itself &= np.concatenate([[True], ~(itself[:-1] & (own[1:] == own[:-1]))]) if len(own) else itself
    own, score, other = own[~itself], score[~itself], other[~itself]
    head = np.searchsorted(own, np.arange(len(ids)))
    nth = np.arange(len(own)) - head[own]
    own, score, other, nth = (v[nth < positives] for v in (own, score, other, nth))
    limits = np.full((len(ids), positives), _LOW)
    limits[own, nth] = score
    counts = np.bincount(own, minlength=len(ids))
    head = np.searchsorted(own, np.arange(len(ids) + 1))
    bounds = spark.sparkContext.broadcast((limits, counts, other, head))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield best_in_slots(sent.value, *bounds.value[:2], _blocks(batches), keep).batch(positives)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids = sent.value[0]
        limits, counts, positive, head = bounds.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                a, entries = batch.column(0)[i].as_py(), batch.column(1)[i].values
                slot, score, found = (np.asarray(entries.field(k), np.int64) for k in range(3))
                order = np.lexsort((found, ~score, slot))
                slot, score, found = slot[order], score[order], found[order]
                tops = limits[a, : counts[a]].tolist()
                for j, window in enumerate(suffix_windows(slot, score, tops, keep)):
                    for k, e in enumerate(window):
                        row = int(anchor_ids[a]), int(positive[head[a] + j]), k + 1, int(found[e]), tops[j], int(score[e])
                        for c, v in zip(out, row):
                            c.append(v)
            for c in (1, 3):
                out[c] = [None if v == _NULL_ID else v for v in out[c]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    slots = _merge(rows.mapInArrow(apart, _ENTRY), keep)
    # at most positives x keep entries to an anchor
    grouped = slots.groupBy("anchor").agg(F.collect_list(F.struct("slot", "score", "id")).alias("entries"))
    return grouped.mapInArrow(windows, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
