"""Packing of token streams into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, which need no partner, and a rest in parts of up to ``PART`` ids (small parts
balance better: about 0.4 % padding instead of 4 % for uncut rests). Parts are dealt by hash into blocks of bounded size.
In a block every part starts as a partial partition over k windows; again and again the two partial partitions with the
largest imbalance are merged, the fullest windows of one with the emptiest of the other, which leaves k nearly equal
windows. If the fullest exceeds the capacity, k rises and the block is packed again.

Only piece descriptions (id, start, length, checksum) are shuffled, never tokens. Repeated and null ids are packed like
others. A null text counts as empty and gives one piece with the end id alone; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import bpe
from chartloom.session import cut_lineage

WINDOW, END_ID = 2048, 1
PART, BLOCK_PARTS = 512, 2048
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PLACE = f"{PIECE}, sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, path: str, id_column: str = "doc_id", window: int = WINDOW, end_id: int = END_ID, part_size: int = PART) -> DataFrame:
    """Full windows and parts of rests of every document's ids followed by ``end_id``: (id, start, length, ids_crc32, doc_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = bpe.tokenizer(path), end_id.to_bytes(4, "little")
        for batch in batches:
            for lo, texts in bpe.blocks(batch.column(1)):
                row, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(t.encode_block(texts)):
                    ids += end
                    whole = len(ids) - len(ids) % (4 * window)
                    for a in [*range(0, whole, 4 * window), *range(whole, len(ids), 4 * part_size)]:
                        part = ids[a : a + 4 * (window if a < whole else part_size)]
                        row.append(lo + i), start.append(a // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part)), total.append(len(ids) // 4)
                made = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *made], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    ids = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text").alias("__text"))
    return ids.mapInArrow(run, f"id {ids.schema[0].dataType.simpleString()}, {PIECE}")


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` dealt to ``k`` windows of nearly equal sums. Windows may stay empty."""
    sizes = [int(x) for x in sizes]
    left, right = [], []  # inner nodes of the trees of items; leaves are item numbers

    def one(i: int):
        return -sizes[i], i, np.array([sizes[i]], np.int64), np.array([i], np.int64)

    heap = [one(i) for i in range(len(sizes))]
    heapq.heapify(heap)
    n, tie = len(sizes), len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = len(a) + len(b) - k  # windows that get a part of either
        if both <= 0:
            sums, tree = np.concatenate([a, b]), np.concatenate([x, y])
        else:  # sums fall; the last ``both`` of a meet the last of b, smallest with largest
            ta, tb = x[len(a) - both :], y[len(b) - both :][::-1]
            node = np.arange(both) + n + len(left)
            left.extend(ta.tolist()), right.extend(tb.tolist())
            sums = np.concatenate([a[: len(a) - both], b[: len(b) - both], a[len(a) - both :] + b[len(b) - both :][::-1]])
            tree = np.concatenate([x[: len(x) - both], y[: len(y) - both], node])
        order = np.argsort(-sums, kind="stable")
        sums, tree = sums[order], tree[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, tie, sums, tree))
        tie += 1
    out = []
    for top in heap[0][3].tolist() if heap else []:
        stack, items = [top], []
        while stack:
            t = stack.pop()
            if t < n:
                items.append(t)
            else:
                stack += [right[t - n], left[t - n]]
        out.append(items)
    return out


def pack_block(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """The fewest windows, from the sum's share on, at which differencing exceeds no capacity."""
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        made = difference(sizes, k)
        if max((sum(sizes[i] for i in w) for w in made), default=0) <= capacity:
            return made
        over = max(sum(sizes[i] for i in w) for w in made) - capacity
        k += max(1, k * over // (4 * capacity))


def place(cut: DataFrame, window: int = WINDOW, block: int = BLOCK_PARTS) -> DataFrame:
    """Pieces with the sequence and the offset they lie at; sequences hold ``window`` ids at most."""
    cut = cut_lineage(cut).withColumn("m", F.monotonically_increasing_id())  # the written pieces keep their numbers
    full = cut.filter(F.col("length") >= window).select("id", *_names(PIECE), (2 * F.col("m")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = cut.filter(F.col("length") < window)
    blocks = max(1, math.ceil(rest.count() / block))
    id_type = cut.schema["id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m", ignore_index=True)
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        size = pdf["length"].to_numpy()
        for w, items in enumerate(pack_block(size.tolist(), window)):
            sequence[items] = 2 * ((int(pdf["block"][0]) << 20) + w) + 1
            offset[items] = np.cumsum(size[items]) - size[items]
        return pdf.assign(sequence_id=sequence, offset=offset)[["m", *_names(PIECE), "sequence_id", "offset"]]

    # the id travels as m, so that null ids and any id type pass
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("m"), F.lit(blocks)))
    packed = dealt.select("block", "m", *_names(PIECE)).groupBy("block").applyInPandas(pack, f"m bigint, {PLACE}")
    named = packed.join(rest.select("m", "id"), "m").select(F.col("id").cast(id_type).alias("id"), *_names(PLACE))
    return full.unionByName(named)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: the id under its own name, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return place(pieces(docs, path, id_column, window, end_id), window).withColumnRenamed("id", id_column)
