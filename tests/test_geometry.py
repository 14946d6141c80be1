import math
import random

import pytest
from pyspark.sql import functions as F

from chartloom.functions.boxes import centre_form, clip_box
from chartloom.operators import clusters as C
from chartloom.operators import geometry as G
from chartloom.operators import values as V


def _points(seed=1):
    rnd = random.Random(seed)
    rows = [(1, rnd.randint(0, 300), rnd.randint(0, 200)) for _ in range(150)]
    rows += [(1, 40, 40)] * 60  # copies: one hot position
    rows += [(2, 0, 0), (2, 4000, 3000), (3, 5, 5), (4, 7, 7), (4, 7, 7)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, x, y, n) for n, (i, x, y) in enumerate(rows)], "image_id bigint, x int, y int, seq bigint")


def test_nearest_distances(spark):
    rows = _points()
    got = {(r["image_id"], r["x"], r["y"]): r["distance"] for r in G.nearest_distances(_frame(spark, rows)).collect()}
    for n, (i, x, y) in enumerate(rows):
        others = [math.dist((x, y), (p, q)) for m, (j, p, q) in enumerate(rows) if j == i and m != n]
        if others:
            assert got[(i, x, y)] == pytest.approx(min(others))
    assert (3, 5, 5) not in got


@pytest.mark.parametrize("eps", [6.0, 15.0, 32.0])
def test_clusters_and_clustering(spark, eps):
    rows = _points(2)
    df = _frame(spark, rows)
    counts = {r["image_id"]: r["clusters"] for r in C.count_clusters(df, eps).collect()}
    for image in {r[0] for r in rows}:
        pts = sorted({(x, y) for i, x, y in rows if i == image})
        seen, n = set(), 0
        for p in pts:
            if p in seen:
                continue
            n += 1
            stack = [p]
            seen.add(p)
            while stack:
                c = stack.pop()
                for q in pts:
                    if q not in seen and math.dist(c, q) <= eps:
                        seen.add(q)
                        stack.append(q)
        assert counts[image] == n
    share = {r["image_id"]: r["clustering"] for r in G.clustering_share(df, eps).collect()}
    pts = [(x, y) for i, x, y in rows if i == 1]
    want = sum(sum(math.dist(p, q) < eps for q in pts) - 1 >= 2 for p in pts) / len(pts)
    assert share[1] == pytest.approx(want)
    assert 2 not in share


def test_drawn_chart(spark):
    """Two bars, two axes and a circle on a 320 x 240 canvas."""
    cols = "image_id int, seq int, kind string, x int, y int, w int, h int, x2 int, y2 int"
    df = spark.createDataFrame(
        [
            (1, 0, "bar", 40, 80, 35, 120, 0, 0), (1, 1, "bar", 100, 120, 35, 80, 0, 0),
            (1, 2, "axis", 20, 210, 0, 0, 300, 210), (1, 3, "axis", 30, 20, 0, 0, 30, 220),
        ],
        cols,
    )
    axes = G.classify_segments(df.filter("kind = 'axis'"), 320, 240)
    main = G.main_axes(axes).first()
    assert main["horizontal"]["y"] == 210 and main["vertical"]["x"] == 30
    bars = df.filter("kind = 'bar'")
    values = {r["seq"]: r["value"] for r in V.bar_values(bars, axes).collect()}
    assert values == {0: 92.3, 1: 61.5}
    gaps = [r["gap"] for r in G.neighbour_gaps(bars).orderBy("x").collect()]
    assert gaps == [None, 25]
    kept = G.outside_axes(bars, axes).count()
    assert kept == 2


def test_boxes(spark):
    box = [F.lit(v) for v in (-5, 470, 700, 470)]
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(clip_box(box, 640, 480), "abcd")]).first()
    assert tuple(row) == (0, 470, 639, 471)
    text = spark.range(1).select(centre_form(F.lit(2), [F.lit(v) for v in (0, 0, 64, 48)], 640, 480)).first()[0]
    assert text == "2 0.050000 0.050000 0.100000 0.100000"


def test_labels_of_values(spark):
    values = spark.createDataFrame([(1, 0, 10.0), (1, 1, 20.0), (1, 2, 30.0), (1, 3, 40.0)], "image_id int, pos int, value double")
    labels = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a")], "image_id int, pos int, label string")
    got = {r["label"]: r["value"] for r in V.map_labels(values, labels).collect()}
    assert got == {"a": 30.0, "b": 20.0, "Bar_4": 40.0}


def test_clusters_of_one_image_over_many_ranges(spark):
    """Chains whose links lie in several partitions, and other images beside them."""
    chain = spark.range(6000).selectExpr("1 AS image_id", "CAST(3 * id AS INT) AS x", "CAST(0 AS INT) AS y")
    gap = chain.filter("x < 9000 OR x > 9030")
    small = spark.range(400).selectExpr("CAST(2 + id AS INT) AS image_id", "0 AS x", "0 AS y").unionByName(spark.range(400).selectExpr("CAST(2 + id AS INT) AS image_id", "CAST(4 + id % 2 AS INT) AS x", "0 AS y"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for points, want in ((chain, 1), (gap, 2)):
            got = {r.image_id: r.clusters for r in C.count_clusters(points.unionByName(small), 4.0).collect()}
            assert got == {1: want} | {2 + i: 1 + i % 2 for i in range(400)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert C.count_clusters(chain.limit(0), 4.0).count() == 0


def test_values_of_all_chart_types_travel_together(spark):
    """No branch for each chart type that joins and sorts the shapes anew."""
    rows = [
        (1, 1, "bar", 10, 50, 5, 40, 10, 50, 200.0), (1, 2, "bar", 20, 70, 5, 20, 20, 70, 100.0), (1, 3, "axis", 0, 100, 9, 9, 90, 102, 81.0),
        (2, 4, "bar", 10, 30, 5, 10, 10, 30, 50.0), (3, 5, "point", 64, 48, 5, 5, 64, 48, 25.0),
        (4, 6, "pie_slice", 9, 9, 99, 99, 9, 9, 4000.0), (4, 7, "pie_slice", 9, 9, 99, 99, 9, 9, 12000.0), (4, 8, "pie_slice", 9, 9, 9, 9, 9, 9, 81.0),
        (5, 9, "rect", 96, 240, 5, 5, 96, 240, 25.0), (4, 10, "bar", 10, 30, 5, 10, 10, 30, 50.0),
    ]
    elements = spark.createDataFrame(rows, "image_id bigint, seq bigint, kind string, x int, y int, w int, h int, x2 int, y2 int, area double")
    kinds = [(1, "bar_chart"), (2, "histogram"), (3, "scatter_plot"), (4, "pie_chart"), (5, "line_chart"), (6, "unknown")]
    out = V.extract_values(elements, spark.createDataFrame(kinds, "image_id bigint, chart_type string"), 640, 480)
    got = {(r.image_id, r.chart_type, r.seq): round(r.value, 4) for r in out.collect()}
    assert got == {
        (1, "bar_chart", 1): 76.9, (1, "bar_chart", 2): 38.5, (2, "histogram", 4): 100.0, (3, "scatter_plot", 5): 90.5539,
        (4, "pie_chart", 6): 90.0, (4, "pie_chart", 7): 270.0, (5, "line_chart", 96): 50.0,
    }
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3


def test_slices_near_a_tie_are_summed_in_the_order_of_their_files(spark, tmp_path):
    # one by one these areas add up to 20735.999999999996, as most partial sums do not: 56.35000000000001 degrees or 56.349999999999994
    areas = [4023.18, 3198.0, 3759.06, 3189.8999999999996, 3320.1, 3245.7599999999998]
    for i, area in enumerate(areas):
        row = [(1, i, "pie_slice", 0, 0, 1, 1, 1, 1, area)]
        spark.createDataFrame(row, "image_id bigint, seq bigint, kind string, x int, y int, w int, h int, x2 int, y2 int, area double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{i}")
    paths = [f"{tmp_path}/{i}" for i in range(len(areas))]
    total = 0.0
    for area in areas:
        total += area
    want = {i: (math.floor(a / total * 3600 + 0.5) / 10, math.floor(a / total * 1000 + 0.5) / 10) for i, a in enumerate(areas)}
    assert want[5] == (56.4, 15.7)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # each file is a task of its own
    try:
        for order in (paths, paths[::-1]):
            elements = spark.read.parquet(*order)
            assert {r.seq: (r.angle, r.percentage) for r in V.slice_values(elements, 640, 480).collect()} == want
            kinds = spark.createDataFrame([(1, "pie_chart")], "image_id bigint, chart_type string")
            assert {r.seq: r.value for r in V.extract_values(elements, kinds, 640, 480).collect()} == {i: w[0] for i, w in want.items()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_points_travel_to_four_cells(spark):
    points = spark.createDataFrame([(x, y) for x in range(-40, 41, 7) for y in range(-40, 41, 9)], "x int, y int")
    for radius in (8, 90.0):
        cells = G._reaching(points, radius, 2 * radius)
        assert cells.count() == 4 * points.count()
        missed = F.floor((F.col("x") + F.lit(radius)) / (2 * radius)) < F.floor((F.col("x") - F.lit(radius)) / (2 * radius)) + 1
        assert cells.filter(missed).count() == 0


def test_neighbouring_cells_meet_in_wide_cells_after_few_shuffles(spark):
    rnd = random.Random(8)
    rows = [(i % 2, rnd.randrange(-40, 120), rnd.randrange(120), 1) for i in range(500)]
    points = spark.createDataFrame(rows, "image_id int, x int, y int, n int")
    eps, side = 9.0, 6
    cells = points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    links = C._linked_cells(cells, eps, True, side)
    want = set()
    for i, x, y, _ in rows:
        for k, a, b, _ in rows:
            u, v = (x // side, y // side), (a // side, b // side)
            if i == k and u < v and (x - a) ** 2 + (y - b) ** 2 <= eps * eps:
                want.add((i, *u, *v))
    assert sorted(tuple(r) for r in links.collect()) == sorted(want)
    # both sides by wide cell, the points that travel, the pairs; sums need none of their own
    assert links._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 6
