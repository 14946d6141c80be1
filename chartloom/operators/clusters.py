"""Clusters of points of an image that are connected by steps of at most eps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.session import cut_lineage


_WIDE = 4  # cells


def _linked_cells(points: DataFrame, eps: float, closed: bool, side: int) -> DataFrame:
    """Pairs of cells with points within eps of each other, each pair once.

    For two cells only the facing points matter: for one row the point furthest towards the
    other cell is the closest of its row, and so for columns. Whichever side the neighbour lies
    on, the points with extreme x per row or extreme y per column contain a closest pair.

    Points meet in wide cells of ``_WIDE`` by ``_WIDE`` cells: one shuffle by wide cell serves all sums, and a point travels
    to the up to four wide cells that hold its neighbours ahead, not to every cell among them.
    """
    reach = int(-(-eps // side))
    wide = lambda c: F.floor(c / _WIDE).cast("bigint")
    here = ["image_id", "wx", "wy", "cx", "cy"]
    p = points.withColumn("wx", wide(F.col("cx"))).withColumn("wy", wide(F.col("cy"))).repartition("image_id", "wx", "wy")
    rows = p.groupBy(*here, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    cols = p.groupBy(*here, "x").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    by_row = rows.select(*here, F.explode(F.array("a", "b")).alias("x"), "y")
    by_col = cols.select(*here, "x", F.explode(F.array("a", "b")).alias("y"))
    rim = by_row.unionByName(by_col).distinct()
    spans = [F.explode(F.sequence(wide(F.col(f"a{c}") - back), wide(F.col(f"a{c}") + reach))).alias(f"w{c}") for c, back in (("x", 0), ("y", reach))]
    ahead = rim.select("image_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("x").alias("px"), F.col("y").alias("py"))
    ahead = ahead.select("*", spans[0]).select("*", spans[1])
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    dist = F.sqrt((dx * dx + dy * dy).cast("double"))
    close = dist <= eps if closed else dist < eps
    i, j = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    half = (i >= 0) & (i <= reach) & (j >= -reach) & (j <= reach) & ((i > 0) | (j > 0))
    return ahead.join(rim, ["image_id", "wx", "wy"]).filter(half & close).select("image_id", "ax", "ay", "cx", "cy").distinct()


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest one it is connected with by the edges (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of one partition's edges, as edges from each node to the smallest one."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    image = table.column(0).combine_chunks().dictionary_encode()
    u, v = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in (1, 2))
    code = np.asarray(image.indices, np.int64)
    images, ids = np.concatenate([code, code]), np.concatenate([u, v])
    order = np.lexsort((ids, images))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(images[order]) != 0) | (np.diff(ids[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    node = order[fresh]  # nodes in the order of their ids within an image
    label = smallest(len(node), number[: len(u)], number[len(u) :])
    moved = np.flatnonzero(label != np.arange(len(node)))
    part = TaskContext.get().partitionId()
    columns = [image.dictionary.take(pa.array(images[node[moved]])), pa.array(ids[node[moved]]), pa.array(ids[node[label[moved]]]), pa.array(np.full(len(moved), part))]
    yield pa.RecordBatch.from_arrays(columns, names=["image_id", "u", "v", "part"])


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable node id per node.

    Edges are dealt by ranges of (image, node) and every task contracts its own to stars, so an image whose edges lie in one
    range is done. Only images cut by the border of a range go through rounds of large-star and small-star steps,
    which keep the components and flatten them: their number grows with the logarithm of a component.
    """
    kind = edges.schema["image_id"].dataType.simpleString()
    flat = edges.select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v AND image_id IS NOT NULL")
    stars = cut_lineage(flat.repartitionByRange("image_id", "u").mapInArrow(_contract, f"image_id {kind}, u bigint, v bigint, part bigint"))
    spans = stars.groupBy("image_id").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    cut = spans.filter("a <> b").select("image_id")
    open_edges = cut_lineage(stars.join(cut, "image_id", "left_semi").select("image_id", "u", "v"))
    roots = stars.join(cut, "image_id", "left_anti").select("image_id", "u", F.col("v").alias("root"))
    roots = roots.unionByName(_star_rounds(open_edges))
    return nodes.join(roots, ["image_id", "u"], "left").withColumn("root", F.coalesce("root", "u"))


def _star_rounds(edges: DataFrame) -> DataFrame:
    """(image_id, u, root) by alternating large-star and small-star steps; every round is written once."""
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.groupBy("image_id", "u").agg(F.min("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("image_id", "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, ["image_id", "u"]).select("image_id", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        down = large.select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("image_id", "u").agg(F.min("v").alias("m"))
        small = (
            down.join(low2, ["image_id", "u"]).select("image_id", F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("image_id", "u", F.col("m").alias("v")))
        )
        edges = cut_lineage(small.filter(F.col("u") != F.col("v")).distinct())


def cluster_points(points: DataFrame, eps: float, closed: bool = True) -> DataFrame:
    """Distinct points (image_id, x, y, n) with the id of their cluster.

    ``closed`` joins points at distance exactly eps too.
    """
    merged = cut_lineage(points.groupBy("image_id", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    # whole pixels: the largest distance inside a cell is (side - 1) * sqrt(2), below eps
    side = max(1, int(eps / 2**0.5 - 1e-9))
    cells = merged.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    node = lambda x, y: (F.col(x) * F.lit(1 << 31) + F.col(y)).alias
    links = _linked_cells(cells, eps, closed, side).select("image_id", node("ax", "ay")("u"), node("cx", "cy")("v"))
    # every point looks its cell up by itself: no table of cells in between
    named = cells.withColumn("u", node("cx", "cy")("u")).filter("image_id IS NOT NULL AND u IS NOT NULL")
    return _components(named, links).select("image_id", "x", "y", "n", F.col("root").alias("cluster"))


def count_clusters(points: DataFrame, eps: float) -> DataFrame:
    """Clusters per image, single points included."""
    return cluster_points(points, eps).groupBy("image_id").agg(F.count_distinct("cluster").alias("clusters"))


def clusters_with_members(points: DataFrame, eps: float, minimum: int = 2) -> DataFrame:
    """Clusters of at least ``minimum`` points (strictly closer than eps): size, box and centre.

    Members are the rows of cluster_points with the same cluster id.
    """
    return (
        cluster_points(points, eps, closed=False)
        .groupBy("image_id", "cluster")
        .agg(
            F.sum("n").alias("points"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"),
        )
        .filter(F.col("points") >= minimum)
        .drop("cluster")
    )
