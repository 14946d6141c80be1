"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators.clusters import smallest
from chartloom.session import cut_lineage

HELD = 1 << 18  # links that one task contracts


def _flat(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of one task's links, as links (u, v) from each node to the smallest one."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    ends = np.concatenate([table[c].to_numpy() for c in ("a", "b")])
    node, place = np.unique(ends, return_inverse=True)
    label = smallest(len(node), *np.split(place, 2))
    moved = np.flatnonzero(label != np.arange(len(node)))
    yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(sid, root) for every node of ``links`` (a, b) that is not a root itself: the smallest node it is connected with.

    Tasks of about ``HELD`` links contract their own to stars first. Then large-star and small-star steps take turns until
    nothing changes: every node hands its larger neighbours, then its smaller ones, to the smallest. Where all links met in one
    task there is no step to take. Each round is written once and their number grows with the logarithm of a component; the
    smallest neighbour is an aggregate with partial minima, so a node with very many links needs no task of its own.
    """
    links = cut_lineage(links.select("a", "b"))
    parts = links.count() // HELD + 1
    edges = cut_lineage(links.coalesce(parts).mapInArrow(_contract, "u bigint, v bigint"))
    before = None
    while parts > 1:
        both = _flat(edges)
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = _flat(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        edges = cut_lineage(_flat(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("sid"), F.col("v").alias("root"))
