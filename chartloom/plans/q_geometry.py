"""Queries on detected shapes and chart values."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.operators import clusters as C
from chartloom.operators import geometry as G
from chartloom.operators import values as V
from chartloom.plans.registry import query
from chartloom.plans.views import oracle, table, view

WIDTH, HEIGHT = 640, 480


def _el(spark, sf, *kinds):
    df = view(spark, sf, "elements")
    return df.filter(F.col("kind").isin(*kinds)) if kinds else df


def _rounded(df, digits=7):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _nudge(digits: int) -> float:
    """Small offset that keeps exact decimal ties from rounding by the order of summation."""
    return 0.0123 * 10.0**-digits


def _nudged(df, **digits):
    """Round the double columns after the offset; ``digits`` per column, 7 where not given."""
    out = []
    for c, t in df.dtypes:
        d = digits.get(c, 7)
        out.append(F.round(F.col(c) + _nudge(d), d).alias(c) if t == "double" else F.col(c))
    return df.select(*out)


def _nudged_sql(sql: str) -> str:
    """The same offset inside every round(<expression>, <digits>) of a SQL text."""
    head, sep, tail = sql.partition("round(")
    if not sep:
        return sql
    depth, comma = 1, 0
    for end, ch in enumerate(tail):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 1:
            comma = end
        if depth == 0:
            break
    digits = int(tail[comma + 1 : end])
    return f"{head}round(({tail[:comma]}) + {_nudge(digits)!r}, {digits}){_nudged_sql(tail[end + 1:])}"


MEASURES = """WITH m AS (SELECT *, CASE WHEN perimeter > 0 THEN 4 * pi() * area / (perimeter * perimeter) ELSE 0 END AS circularity,
 CASE WHEN w > 0 THEN h / w ELSE 1 END AS aspect, CASE WHEN w * h > 0 THEN area / (w * h) ELSE 0 END AS fill,
 CASE WHEN hull_area > 0 THEN area / hull_area ELSE 0 END AS solidity FROM v_elements)
"""


@query(
    "shape_measures",
    "F9",
    sql=oracle("elements", MEASURES + "SELECT image_id, seq, round(circularity, 9) AS circularity, aspect, fill, solidity FROM m"),
)
def _measures(spark, sf):
    out = G.shape_measures(_el(spark, sf))
    return out.select("image_id", "seq", F.round("circularity", 9).alias("circularity"), "aspect", "fill", "solidity")


@query(
    "shape_classes",
    "P17",
    sql=oracle(
        "elements",
        MEASURES
        + """SELECT image_id, seq, z AND t AS is_text_box, z AND NOT t AND aspect > 0.6 AND fill > 0.35 AS is_bar, area > 15 AND area < 1200 AND circularity > 0.55 AS is_point,
 (circularity > 0.6 AND area > 6144 AND aspect > 0.4 AND aspect < 2.5) OR (area < 1500 AND circularity > 0.5 AND y > 72 AND y + h < 408 AND x > 64 AND x + w < 576) AS is_circle,
 area > 4608 AND area < 230400 AND fill > 0.25 AND fill < 0.95 AND solidity > 0.75 AS is_slice
FROM (SELECT *, area >= 400 AND area <= 153600 AS z, aspect < 0.3 AND fill < 0.4 AS t FROM m) q""",
    ),
)
def _classes(spark, sf):
    return G.shape_classes(_el(spark, sf), WIDTH, HEIGHT).select(
        "image_id", "seq", "is_text_box", "is_bar", "is_point", "is_circle", "is_slice"
    )


SEGMENTS = """WITH g AS (SELECT *, abs(atan2(CAST(y2 - y AS DOUBLE), CAST(x2 - x AS DOUBLE)) * 180 / pi()) AS angle,
 sqrt(CAST((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS DOUBLE)) AS length, (y2 - y) / (x2 - x + CAST(1e-6 AS DOUBLE)) AS slope FROM v_elements),
d AS (SELECT *, CASE WHEN length < 32 THEN 'short' WHEN angle < 10 OR angle > 170 THEN 'horizontal' WHEN angle > 80 AND angle < 100 THEN 'vertical' ELSE 'diagonal' END AS direction,
 CASE WHEN (angle < 5 OR angle > 175) AND length > 160 THEN 'horizontal' WHEN angle > 85 AND angle < 95 AND length > 120 THEN 'vertical' END AS axis_kind FROM g)
"""


@query("segment_directions", "P18", sql=oracle("elements", SEGMENTS + "SELECT image_id, seq, round(angle, 7) AS angle, round(length, 7) AS length, direction, axis_kind FROM d"))
def _directions(spark, sf):
    return _rounded(G.classify_segments(_el(spark, sf), WIDTH, HEIGHT).select("image_id", "seq", "angle", "length", "direction", "axis_kind"))


@query(
    "axis_statistics",
    "A29",
    sql=oracle(
        "elements",
        SEGMENTS
        + """, s AS (SELECT image_id, count(*) FILTER (direction = 'horizontal') AS h, count(*) FILTER (direction = 'vertical') AS v, count(*) FILTER (direction = 'diagonal') AS line_count,
 coalesce(sum(length) FILTER (direction <> 'short'), 0) / 800 AS line_continuity, count(*) FILTER (length > 3 AND length < 32) / (8 + 1e-6) AS tick_density FROM d GROUP BY 1)
SELECT image_id, round(CASE WHEN h + v > 0 THEN h / (h + v) ELSE 0.5 END, 7) AS axis_orientation, round(CASE WHEN h + v > 0 THEN least(1, (h + v) * 50.0 / 800) ELSE 0 END, 7) AS axis_confidence,
 line_count, round(line_continuity, 7) AS line_continuity, round(tick_density, 7) AS tick_density FROM s""",
    ),
)
def _axis_stats(spark, sf):
    return _rounded(G.axis_statistics(_el(spark, sf), WIDTH, HEIGHT))


COUNTS = """WITH c AS (SELECT image_id, count(*) FILTER (kind = 'bar') AS bars, count(*) FILTER (kind = 'line') AS line_segments, count(*) FILTER (kind = 'point') AS scatter_points,
 count(*) FILTER (kind = 'pie_slice') AS pie_slices, count(*) FILTER (kind = 'axis') AS axes, count(*) FILTER (kind = 'rect') AS legend_boxes, count(*) FILTER (kind = 'circle') AS text_regions FROM v_elements GROUP BY 1)
"""


@query("element_counts", "A23", sql=oracle("elements", COUNTS + "SELECT * FROM c"))
def _counts(spark, sf):
    return G.element_counts(_el(spark, sf))


@query(
    "mean_element_counts",
    "A23",
    sql=oracle("elements", COUNTS + "SELECT " + ", ".join(f"round(avg({c}), 9) AS mean_{c}, CAST(sum({c}) AS BIGINT) AS total_{c}" for c in G.ELEMENT_CLASSES) + " FROM c"),
)
def _mean_counts(spark, sf):
    return _rounded(G.mean_counts(G.element_counts(_el(spark, sf))), 9)


@query(
    "count_ratios",
    "A24",
    sql=oracle(
        "elements",
        COUNTS
        + """SELECT image_id, pie_slices / greatest(1, text_regions + pie_slices) AS slice_ratio, (bars + scatter_points + line_segments) / greatest(1, axes + text_regions + pie_slices) AS component_balance,
 scatter_points / greatest(1, line_segments + 1) AS points_per_line FROM c""",
    ),
)
def _ratios(spark, sf):
    return G.count_ratios(G.element_counts(_el(spark, sf)))


@query(
    "bar_geometry",
    "A24",
    sql=oracle(
        "elements",
        _nudged_sql("""SELECT image_id, count(*) AS bar_count, round(avg(w), 7) AS width_mean, round(var_pop(w), 7) AS width_var, round(avg(h), 7) AS height_mean, round(var_pop(h), 7) AS height_var,
 round(avg(h / greatest(1, w)), 7) AS aspect_mean, round(var_pop(h / greatest(1, w)), 7) AS aspect_var, round(avg(area / (w * h)), 7) AS fill_mean,
 round(avg(CASE WHEN h > w THEN 1 ELSE 0 END), 7) AS vertical_ratio, round(1 - least(1, stddev_pop(y + h) / 480), 7) AS alignment FROM v_elements GROUP BY 1"""),
    ),
)
def _bars(spark, sf):
    return _nudged(G.bar_geometry(_el(spark, sf), HEIGHT))


@query(
    "neighbour_gaps",
    "W2",
    sql=oracle(
        "elements",
        """WITH l AS (SELECT image_id, x, seq, x - lag(x) OVER w AS step, x - lag(x + w) OVER w AS gap, row_number() OVER (PARTITION BY image_id, x ORDER BY seq) AS r,
 count(*) OVER (PARTITION BY image_id, x) AS n FROM v_elements WINDOW w AS (PARTITION BY image_id ORDER BY x, seq))
SELECT image_id, x, n, step, gap FROM l WHERE r = 1""",
    ),
)
def _gaps(spark, sf):
    return G.neighbour_gaps(_el(spark, sf))


@query(
    "bin_geometry",
    "A25",
    sql=oracle(
        "elements",
        _nudged_sql("""WITH l AS (SELECT *, CAST(x - lag(x) OVER o AS DOUBLE) AS s, CAST(x - lag(x + w) OVER o AS DOUBLE) AS g, avg(w) OVER (PARTITION BY image_id) AS m FROM v_elements WINDOW o AS (PARTITION BY image_id ORDER BY x, seq)),
a AS (SELECT image_id, count(*) AS n, max(m) AS m, var_pop(s) AS sv, avg(s) AS sm, count(*) FILTER (s < m * 0.15) AS t, stddev_pop(w) AS ws, count(*) FILTER (g >= 0) AS gn, avg(g) FILTER (g >= 0) AS gm, stddev_pop(g) FILTER (g >= 0) AS gs,
 count(*) FILTER (g >= 0 AND g < m * 0.1) AS gt, max(CAST(w > 192 AND h > 72 AS INT)) = 1 AS merged_mass FROM l GROUP BY 1 HAVING count(*) > 1)
SELECT image_id, CASE WHEN merged_mass THEN greatest(n, 10) ELSE n END AS bin_count, round(sv, 5) AS spacing_variance, round(sm / (m + 1e-6), 7) AS gap_ratio, round(t / (n - 1), 7) AS touching_ratio,
 round(1 - least(1, ws / (m + 1e-6)), 7) AS width_uniformity, round(0.55 * (1 - least(1, ws / (m + 1e-6))) + 0.45 * (1 - least(1, sqrt(sv) / (sm + 1e-6))), 5) AS histogram_uniformity,
 round(CASE WHEN merged_mass THEN 0 ELSE coalesce(gm / m, 0) END, 7) AS spacing_ratio, round(CASE WHEN gn > 1 THEN 1 - least(1, gs / (gm + 1e-6)) ELSE 0 END, 7) AS spacing_uniformity,
 round(CASE WHEN gn > 0 THEN gt / gn ELSE 0 END, 7) AS bin_adjacency, merged_mass FROM a"""),
    ),
)
def _bins(spark, sf):
    out = G.bin_geometry(_el(spark, sf), WIDTH, HEIGHT)
    return _nudged(out, spacing_variance=5, histogram_uniformity=5)


@query(
    "spatial_spread",
    "A26",
    sql=oracle(
        "elements",
        _nudged_sql("""SELECT image_id, round((var_pop(x) + var_pop(y)) / 307200, 7) AS spatial_variance, round(count(*) / 307200, 7) AS point_density, round(avg(4 * pi() * area / (perimeter * perimeter)), 7) AS mean_circularity FROM v_elements GROUP BY 1"""),
    ),
)
def _spread(spark, sf):
    return _nudged(G.spatial_spread(_el(spark, sf), WIDTH, HEIGHT))


@query(
    "area_entropy",
    "A27",
    sql=oracle(
        "elements",
        _nudged_sql("""WITH t AS (SELECT image_id, area, sum(area) OVER (PARTITION BY image_id) AS s FROM v_elements)
SELECT image_id, round(-sum(area / s * log2(area / s)), 6) + 0 AS area_entropy, round(var_pop(area), 3) AS area_variance FROM t GROUP BY 1"""),
    ),
)
def _entropy(spark, sf):
    return _nudged(G.area_entropy(_el(spark, sf)), area_entropy=6, area_variance=3)


@query(
    "orientation_entropy",
    "A27",
    "A28",
    sql=oracle(
        "elements",
        SEGMENTS
        + """, b AS (SELECT image_id, least(floor(angle / 10) + 1, 18) AS b, count(*) AS n FROM d WHERE angle BETWEEN 0 AND 180 GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY image_id) AS s FROM b)
SELECT image_id, round(-sum(n / s * log2(n / s)) / log2(18), 6) + 0 AS entropy FROM t GROUP BY 1""",
    ),
)
def _orientation(spark, sf):
    segments = G.segment_measures(_el(spark, sf))
    out = G.orientation_entropy(segments, F.col("angle"), 0.0, 180.0)
    return out.select("image_id", F.round("entropy", 6).alias("entropy"))


@query(
    "circle_statistics",
    "A46",
    sql=oracle(
        "elements",
        """SELECT image_id, count(*) AS circles, least(1, count(*) * 0.5)::DOUBLE AS arc_score, round(greatest(0, max(1 - least(1, sqrt((x - 320.0) * (x - 320.0) + (y - 240.0) * (y - 240.0)) / 144))), 7) AS circular_symmetry
FROM v_elements WHERE kind = 'circle' GROUP BY 1""",
    ),
)
def _circles(spark, sf):
    return _rounded(G.circle_statistics(_el(spark, sf, "circle"), WIDTH, HEIGHT))


@query(
    "chain_features",
    "W3",
    "W4",
    sql=oracle(
        "elements",
        SEGMENTS
        + """, l AS (SELECT *, lag(x2) OVER o AS px, lag(y2) OVER o AS py, lag(slope) OVER o AS ps FROM d WINDOW o AS (PARTITION BY image_id ORDER BY x, seq)),
a AS (SELECT image_id, count(*) AS segments, count(*) FILTER (sqrt((px - x) * (px - x) + (py - y) * (py - y)) < 64) AS chains, count(*) FILTER (abs(slope - ps) > 0.2) AS changes, count(*) FILTER (direction = 'diagonal') AS n, var_pop(slope) FILTER (direction = 'diagonal') AS sv, avg(slope) FILTER (direction = 'diagonal') AS sm FROM l GROUP BY 1)
SELECT image_id, segments, round(CASE WHEN segments > 1 THEN chains / greatest(1, segments - 1) ELSE 0 END, 7) AS continuity, round(CASE WHEN segments > 1 THEN changes / segments ELSE 0 END, 7) AS slope_change_frequency,
 round(CASE WHEN n > 1 THEN sv ELSE 0 END, 7) AS slope_variance, round(CASE WHEN n > 1 THEN 1 - least(1, sv / (abs(sm) + 1)) ELSE 0 END, 7) AS slope_continuity FROM a""",
    ),
)
def _chains(spark, sf):
    return _rounded(G.chain_features(_el(spark, sf), WIDTH))


AXES = (
    SEGMENTS
    + """, h AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY greatest(y, y2) DESC, seq) AS rn FROM d WHERE axis_kind = 'horizontal'),
v AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY least(x, x2), seq) AS rn FROM d WHERE axis_kind = 'vertical')
"""
)


@query(
    "main_axes",
    "T7",
    sql=oracle(
        "elements",
        AXES + "SELECT i.image_id, h.seq AS h_seq, h.y AS h_y, v.seq AS v_seq, v.x AS v_x FROM (SELECT DISTINCT image_id FROM v_elements) i LEFT JOIN h ON h.image_id = i.image_id AND h.rn = 1 LEFT JOIN v ON v.image_id = i.image_id AND v.rn = 1",
    ),
)
def _axes(spark, sf):
    out = G.main_axes(G.classify_segments(_el(spark, sf), WIDTH, HEIGHT))
    return out.select("image_id", F.col("horizontal.seq").alias("h_seq"), F.col("horizontal.y").alias("h_y"), F.col("vertical.seq").alias("v_seq"), F.col("vertical.x").alias("v_x"))


@query(
    "outside_axes",
    "J11",
    sql=oracle(
        "elements",
        AXES
        + """, z AS (SELECT image_id, least(x, x2) - 12 AS l, least(y, y2) - 12 AS t, abs(x2 - x) + 24 AS zw, abs(y2 - y) + 24 AS zh FROM h WHERE rn = 1 UNION ALL
 SELECT image_id, least(x, x2) - 12, least(y, y2) - 12, abs(x2 - x) + 24, abs(y2 - y) + 24 FROM v WHERE rn = 1)
SELECT image_id, seq FROM v_elements e WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.image_id = e.image_id
 AND greatest(0, least(e.x + e.w, l + zw) - greatest(e.x, l)) * greatest(0, least(e.y + e.h, t + zh) - greatest(e.y, t)) / greatest(1, e.w * e.h) > 0.5)""",
    ),
)
def _outside(spark, sf):
    df = _el(spark, sf)
    return G.outside_axes(df, G.classify_segments(df, WIDTH, HEIGHT)).select("image_id", "seq")


PLOT = """WITH b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, seq) AS r FROM (SELECT image_id, seq, x, y, w * 10 AS w, h * 4 AS h FROM v_elements) q WHERE w * h > 30720 AND w * h < 291840),
p AS (SELECT i.image_id, coalesce(x, 64) AS px, coalesce(y, 48) AS py, coalesce(w, 512) AS pw, coalesce(h, 384) AS ph FROM (SELECT DISTINCT image_id FROM v_elements) i LEFT JOIN b ON b.image_id = i.image_id AND r = 1)
"""


def _plots(spark, sf):
    big = _el(spark, sf).withColumns({"w": F.col("w") * 10, "h": F.col("h") * 4})
    return G.plot_area(big, WIDTH, HEIGHT)


@query("plot_area", "T8", sql=oracle("elements", PLOT + "SELECT * FROM p"))
def _plot(spark, sf):
    return _plots(spark, sf)


@query(
    "legend_candidates",
    "P19",
    sql=oracle(
        "elements",
        PLOT
        + """SELECT e.image_id, seq FROM v_elements e JOIN p ON p.image_id = e.image_id WHERE w * h BETWEEN 40 AND 6144 AND w / (h + 1e-6) BETWEEN 0.5 AND 2.5 AND NOT (x BETWEEN px AND px + pw AND y BETWEEN py AND py + ph)""",
    ),
)
def _legend(spark, sf):
    return G.legend_candidates(_el(spark, sf), _plots(spark, sf), WIDTH, HEIGHT).select("image_id", "seq")


@query(
    "pseudo_labels",
    "F7",
    "F8",
    sql=oracle(
        "elements",
        """WITH r AS (SELECT image_id, seq, CASE kind WHEN 'bar' THEN 0 WHEN 'line' THEN 1 WHEN 'point' THEN 2 WHEN 'pie_slice' THEN 3 WHEN 'axis' THEN 4 WHEN 'rect' THEN 5 ELSE 6 END AS class_id,
 CASE kind WHEN 'line' THEN least(x, x2) - 6 WHEN 'axis' THEN least(x, x2) - 8 WHEN 'point' THEN x - 5 ELSE x END AS a, CASE kind WHEN 'line' THEN least(y, y2) - 6 WHEN 'axis' THEN least(y, y2) - 8 WHEN 'point' THEN y - 5 ELSE y END AS b,
 CASE kind WHEN 'line' THEN greatest(x, x2) + 6 WHEN 'axis' THEN greatest(x, x2) + 8 WHEN 'point' THEN x + 5 ELSE x + w END AS c, CASE kind WHEN 'line' THEN greatest(y, y2) + 6 WHEN 'axis' THEN greatest(y, y2) + 8 WHEN 'point' THEN y + 5 ELSE y + h END AS d FROM v_elements),
k AS (SELECT image_id, seq, class_id, greatest(0, least(639, a)) AS x1, greatest(0, least(479, b)) AS y1, greatest(0, least(639, c)) AS x2, greatest(0, least(479, d)) AS y2 FROM r)
SELECT image_id, seq, class_id, x1, y1, CASE WHEN x2 <= x1 THEN least(639, x1 + 1) ELSE x2 END AS x2, CASE WHEN y2 <= y1 THEN least(479, y1 + 1) ELSE y2 END AS y2 FROM k""",
    ),
)
def _pseudo(spark, sf):
    return G.pseudo_labels(_el(spark, sf), WIDTH, HEIGHT).drop("line")


@query(
    "nearest_neighbours",
    "J12",
    sql=oracle(
        "elements",
        """WITH e AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS k FROM v_elements),
n AS (SELECT a.image_id, a.seq, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM e a JOIN e b ON a.image_id = b.image_id AND a.seq <> b.seq WHERE a.k > 2 GROUP BY 1, 2)
SELECT image_id, round(avg(d), 7) AS mean_distance, round(1 - least(1, avg(d) / 80), 7) AS density FROM n GROUP BY 1""",
    ),
)
def _nearest(spark, sf):
    return _rounded(G.neighbour_density(_el(spark, sf), WIDTH, HEIGHT))


@query(
    "clustering_share",
    "J13",
    sql=oracle(
        "elements",
        """WITH n AS (SELECT a.image_id, a.seq, count(b.seq) AS c FROM v_elements a LEFT JOIN v_elements b ON a.image_id = b.image_id AND a.seq <> b.seq AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 90 GROUP BY 1, 2)
SELECT image_id, count(*) FILTER (c >= 2) / count(*) AS clustering FROM n GROUP BY 1 HAVING count(*) > 2""",
    ),
)
def _share(spark, sf):
    return G.clustering_share(_el(spark, sf), 90.0)


CLUSTERS = """WITH RECURSIVE v_p AS (SELECT DISTINCT image_id, x, y FROM v_elements),
q AS (SELECT image_id, x, y, x * 100000 + y AS k FROM v_p),
r AS (SELECT image_id, k, k AS m FROM q UNION SELECT r.image_id, r.k, b.k FROM r JOIN q a ON a.image_id = r.image_id AND a.k = r.m JOIN q b ON b.image_id = a.image_id
 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) {op} 90),
t AS (SELECT image_id, k, min(m) AS root FROM r GROUP BY 1, 2)
"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH RECURSIVE v_p", "WITH v_p").replace("WITH v_elements", "WITH RECURSIVE v_elements", 1).replace(",\nRECURSIVE", ",\n")


@query(
    "eps_clusters",
    "G1",
    sql=_recursive(oracle("elements", CLUSTERS.format(op="<=") + "SELECT image_id, count(DISTINCT root) AS clusters FROM t GROUP BY 1")),
)
def _clusters(spark, sf):
    return C.count_clusters(_el(spark, sf), 90.0)


@query(
    "cluster_members",
    "G2",
    sql=_recursive(
        oracle(
            "elements",
            CLUSTERS.format(op="<")
            + """, c AS (SELECT image_id, x, y, count(*) AS n FROM v_elements GROUP BY 1, 2, 3)
SELECT t.image_id, CAST(sum(n) AS BIGINT) AS points, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM t JOIN c ON c.image_id = t.image_id AND c.x * 100000 + c.y = t.k GROUP BY t.image_id, root HAVING sum(n) >= 2""",
        )
    ),
)
def _members(spark, sf):
    return C.clusters_with_members(_el(spark, sf), 90.0)


BARS = """WITH x AS (SELECT image_id, max(greatest(y, y2)) AS ax FROM v_elements WHERE kind = 'axis' AND abs(y - y2) < 20 GROUP BY 1),
s AS (SELECT image_id, min(y) AS top, max(y + h) AS e FROM v_elements WHERE kind = 'bar' GROUP BY 1),
b AS (SELECT e.image_id, seq, x, round(h / (CASE WHEN coalesce(ax, s.e) - top > 0 THEN coalesce(ax, s.e) - top ELSE 1 END) * 100.0, 1) AS value
 FROM v_elements e JOIN s ON s.image_id = e.image_id LEFT JOIN x ON x.image_id = e.image_id WHERE kind = 'bar')
"""


@query("bar_values", "W14", sql=oracle("elements", BARS + "SELECT image_id, seq, value FROM b"))
def _bar_values(spark, sf):
    return V.bar_values(_el(spark, sf, "bar"), _el(spark, sf, "axis")).select("image_id", "seq", "value")


@query(
    "labelled_values",
    "J14",
    sql=oracle(
        "elements",
        BARS
        + """, p AS (SELECT image_id, value, row_number() OVER (PARTITION BY image_id ORDER BY x, seq) - 1 AS pos FROM b),
j AS (SELECT p.image_id, pos, value, coalesce(CASE pos WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderpriority END, 'Bar_' || (pos + 1)) AS label FROM p LEFT JOIN orders ON o_orderkey = image_id)
SELECT image_id, label, arg_max(value, pos) AS value FROM j GROUP BY 1, 2""",
    ),
)
def _labelled(spark, sf):
    values = V.ordered_bar_values(_el(spark, sf, "bar"), _el(spark, sf, "axis"))
    labels = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.posexplode(F.array("o_orderpriority", "o_orderstatus", "o_orderpriority")).alias("pos", "label")
    )
    return V.map_labels(values, labels)


LINES = """WITH g AS (SELECT CAST(CASE WHEN i = 19 THEN 544 ELSE floor(96 + i * (CAST(448 AS DOUBLE) / 19)) END AS INT) AS gx FROM (SELECT unnest(range(20)) AS i) q),
h AS (SELECT image_id, x, y FROM v_elements JOIN g ON x = gx WHERE y >= 48 AND y < 432),
m AS (SELECT image_id, x, CAST(floor(quantile_cont(CAST(y - 48 AS DOUBLE), 0.5)) AS INT) + 48 AS y_pixel FROM h GROUP BY 1, 2)
"""


@query("line_values", "F17", sql=oracle("elements", LINES + "SELECT image_id, x AS x_pixel, y_pixel, round((1.0 - y_pixel / 480) * 100, 1) AS value FROM m"))
def _line_values(spark, sf):
    return V.line_values(_el(spark, sf), WIDTH, HEIGHT)


@query("point_values", "F16", sql=oracle("elements", "SELECT image_id, seq, round(x / 640 * 100, 1) AS x_normalized, round((1.0 - y / 480) * 100, 1) AS y_normalized FROM v_elements"))
def _point_values(spark, sf):
    return V.point_values(_el(spark, sf), WIDTH, HEIGHT).select("image_id", "seq", "x_normalized", "y_normalized")


SLICES = """WITH k AS (SELECT image_id, seq, area, sum(area) OVER (PARTITION BY image_id) AS t FROM v_elements WHERE area > 3072 AND area < 245760)
"""


@query("slice_values", "W13", sql=oracle("elements", SLICES + "SELECT image_id, seq, round(area / t * 360, 1) AS angle, round(area / t * 100, 1) AS percentage FROM k"))
def _slice_values(spark, sf):
    return V.slice_values(_el(spark, sf), WIDTH, HEIGHT).select("image_id", "seq", "angle", "percentage")


@query(
    "slice_angle_variance",
    "A32",
    sql=oracle("elements", SLICES + "SELECT image_id, round(CASE WHEN count(*) > 1 THEN var_pop(round(area / t * 360, 1)) ELSE 0 END, 5) AS slice_angle_variance FROM k GROUP BY 1"),
)
def _angle_variance(spark, sf):
    return _rounded(G.angle_variance(V.slice_values(_el(spark, sf), WIDTH, HEIGHT), "angle"), 5)


def _types(spark, sf):
    return view(spark, sf, "pred").select(F.col("id").alias("image_id"), F.col("pred").alias("chart_type"))


VALUES = """WITH e AS (SELECT v_elements.*, pred AS chart_type FROM v_elements JOIN v_pred ON id = image_id),
ax AS (SELECT image_id, max(greatest(y, y2)) AS ax FROM e WHERE kind = 'axis' AND abs(y - y2) < 20 GROUP BY 1),
s AS (SELECT image_id, min(y) AS top, max(y + h) AS b FROM e WHERE kind = 'bar' GROUP BY 1),
g AS (SELECT CAST(CASE WHEN i = 19 THEN 544 ELSE floor(96 + i * (CAST(448 AS DOUBLE) / 19)) END AS INT) AS gx FROM (SELECT unnest(range(20)) AS i) q),
l AS (SELECT image_id, x, CAST(floor(quantile_cont(CAST(y - 48 AS DOUBLE), 0.5)) AS INT) + 48 AS yp FROM e JOIN g ON x = gx WHERE chart_type = 'line_chart' AND y >= 48 AND y < 432 GROUP BY 1, 2),
p AS (SELECT image_id, seq, round(x / 640 * 100, 1) AS a, round((1.0 - y / 480) * 100, 1) AS b FROM e WHERE chart_type = 'scatter_plot' AND kind = 'point'),
k AS (SELECT image_id, seq, area, sum(area) OVER (PARTITION BY image_id) AS t FROM e WHERE chart_type = 'pie_chart' AND kind = 'pie_slice' AND area > 3072 AND area < 245760),
u AS (SELECT e.image_id, e.chart_type, seq, round(h / (CASE WHEN coalesce(ax, s.b) - top > 0 THEN coalesce(ax, s.b) - top ELSE 1 END) * 100.0, 1) AS value FROM e JOIN s ON s.image_id = e.image_id LEFT JOIN ax ON ax.image_id = e.image_id
 WHERE kind = 'bar' AND chart_type IN ('bar_chart','histogram')
UNION ALL SELECT image_id, 'line_chart', CAST(x AS BIGINT), round((1.0 - yp / 480) * 100, 1) FROM l
UNION ALL SELECT image_id, 'scatter_plot', seq, sqrt(a * a + b * b) FROM p
UNION ALL SELECT image_id, 'pie_chart', seq, round(area / t * 360, 1) FROM k)
"""


@query("chart_values", "F18", sql=oracle("elements pred", VALUES + "SELECT image_id, chart_type, seq, round(value, 7) AS value FROM u"))
def _chart_values(spark, sf):
    return _rounded(V.extract_values(_el(spark, sf), _types(spark, sf), WIDTH, HEIGHT))


@query(
    "normalized_values",
    "W6",
    sql=oracle(
        "elements pred",
        VALUES
        + """, n AS (SELECT *, min(value) OVER (PARTITION BY image_id) AS lo, max(value) OVER (PARTITION BY image_id) AS hi FROM u)
SELECT image_id, chart_type, seq, round(CASE chart_type WHEN 'line_chart' THEN value / 100 WHEN 'pie_chart' THEN value / 360 WHEN 'scatter_plot' THEN value / (hi + 1e-9)
 ELSE CASE WHEN hi - lo < 1e-9 THEN CASE WHEN hi > 0 THEN 1 ELSE 0 END ELSE (value - lo) / (hi - lo) END END, 7) AS normalized FROM n""",
    ),
)
def _normalized(spark, sf):
    out = V.normalize_values(V.extract_values(_el(spark, sf), _types(spark, sf), WIDTH, HEIGHT))
    return _rounded(out.drop("value"))


@query(
    "coerced_series",
    "F19",
    sql=oracle(
        "series",
        """WITH s AS (SELECT image_id, label, value, row_number() OVER (PARTITION BY image_id ORDER BY pos) AS i FROM v_series)
SELECT image_id, 'map' AS origin, label, CASE WHEN label LIKE '%-01' THEN 0 ELSE value END AS value FROM s
UNION ALL SELECT image_id, 'list', CASE WHEN label LIKE '%-02' THEN 'item_1' ELSE label END, CASE WHEN label LIKE '%-03' THEN 0 ELSE value END FROM s""",
    ),
)
def _coerced(spark, sf):
    s = view(spark, sf, "series")
    text = F.col("value").cast("string")
    as_map = s.select("image_id", F.create_map("label", F.when(F.col("label").endswith("-01"), "n/a").otherwise(text)).alias("m"))
    none = F.lit(None).cast("string")
    entry = F.struct(
        F.when(~F.col("label").endswith("-02"), F.col("label")).alias("label"),
        none.alias("value"),
        F.when(F.col("label").endswith("-03"), "bad").alias("normalized_value"),
        text.alias("estimated_percentage"),
    )
    as_list = s.select("image_id", F.array(entry).alias("l"))
    cols = ["image_id", "origin", "label", "value"]
    return V.coerce_map(as_map, "m", ["image_id"]).withColumn("origin", F.lit("map")).select(*cols).unionByName(
        V.coerce_list(as_list, "l", ["image_id"]).withColumn("origin", F.lit("list")).select(*cols)
    )
