"""Work tables derived from the given parquet tables, as DataFrames and as the same SQL.

The given tables hold no charts, so images, predictions, votes, shapes, tokens and stage
timings are derived from them row by row; every row of the source table is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SQL = {
    # one row per page, seen as an image file
    "images": r"""
SELECT image_id, dataset_name || '_' || slug || '_' || num || '.png' AS image_name,
       '/data/' || dataset_name || '/' || part || '/' || dataset_name || '_' || slug || '_' || num || '.png' AS image_path,
       dataset_name, label_raw, file_size, image_id * 1000 AS mtime, url
FROM (
  SELECT image_id, url, dataset_name, num, file_size, label_raw,
         lower(replace(replace(label_raw, ' ', '_'), '-', '_')) AS slug,
         CASE WHEN url LIKE '%?%' THEN 'train' WHEN url LIKE '%#top' THEN 'Val'
              WHEN url LIKE '%.html' THEN 'TEST' WHEN url LIKE '%/' THEN 'valid' ELSE 'misc' END AS part
  FROM (
    SELECT page_id AS image_id, url, CAST(length(html) AS BIGINT) AS file_size,
           CASE WHEN url LIKE '%//blog.%' THEN 'plotqa' WHEN url LIKE '%//www.%' THEN 'dvqa'
                WHEN url LIKE '%//m.%' THEN 'chartqa' WHEN url LIKE '%spam%' THEN 'local_raw'
                ELSE 'figureqa' END AS dataset_name,
           regexp_extract(url, '/([0-9]+)', 1) AS num,
           CASE WHEN url LIKE '%/fr/%' THEN 'Hist' WHEN url LIKE '%/de/%' THEN 'Dot-Line'
                WHEN url LIKE '%/es/%' THEN 'donut' WHEN url LIKE '%.org/%' THEN 'Scatter Plot'
                WHEN url LIKE '%.net/%' THEN 'Stacked Bars' ELSE 'Vertical-Bar' END AS label_raw
    FROM {pages}
  ) a
) b
""",
    # one row per order, seen as a classified image
    "pred": r"""
SELECT id, source, truth, CASE WHEN cust % 3 = 0 THEN label ELSE guess END AS pred, confidence, price, cust
FROM (
  SELECT o_orderkey AS id, o_orderstatus AS source, o_custkey AS cust, o_totalprice AS price,
         CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'bar_chart' WHEN '2' THEN 'histogram'
              WHEN '3' THEN 'line_chart' WHEN '4' THEN 'scatter_plot' ELSE 'pie_chart' END AS label,
         CASE WHEN o_custkey % 20 = 7 THEN 'unknown'
              WHEN substring(o_orderpriority, 1, 1) = '1' THEN 'bar_chart'
              WHEN substring(o_orderpriority, 1, 1) = '2' THEN 'histogram'
              WHEN substring(o_orderpriority, 1, 1) = '3' THEN 'line_chart'
              WHEN substring(o_orderpriority, 1, 1) = '4' THEN 'scatter_plot' ELSE 'pie_chart' END AS truth,
         CASE WHEN o_totalprice < 100000 THEN 'bar_chart' WHEN o_totalprice < 200000 THEN 'histogram'
              WHEN o_totalprice < 300000 THEN 'line_chart' WHEN o_totalprice < 400000 THEN 'scatter_plot'
              ELSE 'pie_chart' END AS guess,
         (o_totalprice % 100000) / 100000 AS confidence
  FROM {orders}
) a
""",
    # one row per order with four predictors
    "votes": r"""
SELECT id, truth, source, price,
       CASE WHEN price < 125000 THEN 'bar_chart' WHEN price < 250000 THEN 'histogram'
            WHEN price < 375000 THEN 'line_chart' ELSE 'unknown' END AS heuristic_prediction,
       (price % 1000) / 1000 AS heuristic_confidence,
       pred AS ml_prediction, confidence AS ml_confidence,
       CASE WHEN cust % 4 = 0 THEN truth WHEN cust % 4 = 1 THEN 'histogram'
            WHEN cust % 4 = 2 THEN 'bar_chart' ELSE '' END AS cnn_prediction,
       (price % 10000) / 10000 AS cnn_confidence,
       CASE source WHEN 'O' THEN 'scatter_plot' WHEN 'F' THEN 'histogram' ELSE 'bar_chart' END AS yolo_prediction,
       CAST(cust % 100 AS DOUBLE) / 100 AS yolo_confidence,
       (price % 7000) / 7000 AS histogram_score,
       (price % 3000) / 3000 AS bar_chart_score,
       CAST(cust % 11 AS INT) AS yolo_bars, CAST(cust % 9 AS INT) AS yolo_line_segments
FROM {v_pred}
""",
    # one row per line item, seen as a detected shape on a 640 x 480 canvas (order = image)
    "elements": r"""
SELECT image_id, seq, kind, x, y, w, h, x2, y2, w * h * (0.3 + disc * 7) AS area,
       2.0 * (w + h) AS perimeter, w * h * (0.3 + disc * 7) * (1 + tax * 4) AS hull_area,
       CAST(w AS DOUBLE) AS r
FROM (
  SELECT l_orderkey AS image_id,
         ((l_linenumber * CAST(10000000 AS BIGINT) + l_partkey) * 11000000 + CAST(round(l_extendedprice * 100) AS BIGINT)) * 1000
           + l_suppkey % 1000 AS seq,
         CASE l_partkey % 7 WHEN 0 THEN 'bar' WHEN 1 THEN 'point' WHEN 2 THEN 'line' WHEN 3 THEN 'axis'
              WHEN 4 THEN 'pie_slice' WHEN 5 THEN 'circle' ELSE 'rect' END AS kind,
         CAST((l_linenumber - 1) * 85 + l_partkey % 60 AS INT) AS x,
         CAST((l_suppkey * 13 + l_partkey) % 400 AS INT) AS y,
         CAST(floor(l_quantity) AS INT) AS w,
         CAST(floor(l_extendedprice / 1000) AS INT) + 1 AS h,
         CAST((l_linenumber - 1) * 85 + l_partkey % 60 + floor(l_quantity) * 4 AS INT) AS x2,
         CAST((l_suppkey * 13 + l_partkey) % 400 + floor(l_discount * 1000) - 40 AS INT) AS y2,
         l_discount AS disc, l_tax AS tax
  FROM {lineitem}
) a
""",
    # one row per event, seen as a timed stage run
    "runs": r"""
SELECT event_id AS id, event_type AS stage, value / 100 AS seconds, user_id AS host, ts AS ord, props
FROM {events}
""",
    # one row per customer and month, seen as the value list of a chart
    "series": r"""
SELECT image_id, label, value,
       CAST((CAST(substring(label, 1, 4) AS INT) - 1990) * 12 + CAST(substring(label, 6, 2) AS INT) AS BIGINT) AS pos
FROM (
  SELECT o_custkey AS image_id, substring(CAST(o_orderdate AS VARCHAR(30)), 1, 7) AS label,
         CAST(count(*) AS DOUBLE) AS value
  FROM {orders} GROUP BY 1, 2
) a
""",
    # one row per document, labelled or not
    "docs": r"""
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
""",
    # one training epoch per day of events
    "epochs": r"""
SELECT model, epoch, val_metric, seconds FROM (
  SELECT event_type AS model,
         CAST(substring(CAST(ts AS VARCHAR(30)), 9, 2) AS INT) AS epoch,
         round(avg(value) / 500, 6) AS val_metric, round(sum(value) / 1000, 6) AS seconds
  FROM {events} GROUP BY 1, 2
) a
""",
    # one row per order with the measurements that rule sets read
    "rule_inputs": r"""
SELECT id, truth,
CAST((cust * 3 + id) % 15 AS DOUBLE) AS rectangle_count, CAST((cust * 5 + id) % 11 AS DOUBLE) AS s_bars, CAST((cust * 7 + id) % 9 AS DOUBLE) AS g_bar_count, CAST((cust * 9 + id) % 20 AS DOUBLE) AS circle_count, CAST((cust * 11 + id) % 30 AS DOUBLE) AS s_points, CAST((cust * 13 + id) % 4 AS DOUBLE) AS s_point_clusters, CAST((cust * 15 + id) % 5 AS DOUBLE) AS g_scatter_cluster_count, CAST((cust * 17 + id) % 3 AS DOUBLE) AS s_pie_slices, CAST((cust * 19 + id) % 4 AS DOUBLE) AS g_circle_count, CAST((cust * 21 + id) % 2 AS DOUBLE) AS s_circles_hough, CAST((cust * 23 + id) % 3 AS DOUBLE) AS g_hough_circle_count, CAST((cust * 25 + id) % 7 AS DOUBLE) AS g_line_count, CAST((cust * 27 + id) % 9 AS DOUBLE) AS s_lines, CAST((cust * 29 + id) % 13 AS DOUBLE) AS vertex_count,
(price % 101) / 101 AS bar_spacing_ratio, (price % 103) / 103 AS bar_alignment_score, (price % 107) / 107 AS g_bar_gap_ratio, (price % 109) / 109 AS g_histogram_uniformity_score, (price % 113) / 113 AS bin_adjacency, (price % 127) / 127 AS g_bin_adjacency_ratio, (price % 131) / 131 AS bin_continuity, (price % 137) / 137 AS g_axis_numeric_density, (price % 139) / 139 AS point_clustering_coefficient, (price % 149) / 149 AS nearest_neighbor_density, (price % 151) / 151 AS g_cluster_compactness, (price % 157) / 157 AS g_line_connectivity_score, (price % 163) / 163 AS g_slope_continuity_score, (price % 167) / 167 AS avg_circularity, (price % 173) / 173 AS arc_detection_score, (price % 179) / 179 AS circular_symmetry, (price % 181) / 181 AS g_circular_symmetry, (price % 191) / 191 AS polyline_continuity, (price % 193) / 193 AS slope_change_frequency, (price % 197) / 197 AS bar_spacing_uniformity, (price % 199) / 199 AS g_width_uniformity, (price % 211) / 211 AS bar_adjacency_score,
(price % 223) / 223 / 10000 AS scatter_density, (price % 227) / 227 / 20000 AS g_point_density, (price % 229) / 229 / 10 AS radial_edge_density, (price % 233) / 233 / 10 AS line_continuity_score, (price % 239) / 239 / 12 AS g_line_continuity_score, (price % 241) / 241 / 10 AS g_edge_density,
price % 251 AS bar_height_variance
FROM {v_pred}
""",
    # one row per order with the features of the scaled blends
    "blend_inputs": r"""
SELECT id, heuristic_prediction, CAST(yolo_bars AS DOUBLE) AS feature_bar_count, histogram_score AS feature_bin_adjacency_ratio,
 bar_chart_score AS feature_width_uniformity, price % 977 AS feature_bar_spacing_variance, price % 613 AS feature_bar_height_variance,
 ml_confidence AS feature_bar_gap_ratio, cnn_confidence AS feature_histogram_uniformity_score, yolo_confidence AS feature_axis_numeric_density,
 heuristic_confidence AS feature_axis_confidence, (price % 17) / 17 AS numeric_ratio, (price % 19) / 19 AS category_ratio,
 price % 53 AS slice_angle_variance
FROM {v_votes}
""",
}

# words of a conversation turn, seen as text tokens of two engines on one page; the two
# engines differ only in how each dialect splits and numbers words and reads hex digits
_TOKENS = r"""
SELECT image_id, engine, pos, text, confidence, x1, y1, x1 + 7 * CAST(length(text) AS INT) AS x2, y1 + 12 AS y2
FROM (
  SELECT image_id, engine, turn * 100000 + p AS pos, text, hex / 65535 AS confidence,
         CAST((p %% 16) * 40 AS INT) AS x1, CAST(floor(turn / 2) * 60 + floor(p / 16) * 14 AS INT) AS y1
  FROM (
    SELECT conv_id AS image_id, turn, CASE role WHEN 'assistant' THEN 'paddleocr' ELSE 'easyocr' END AS engine,
           p, text, %s AS hex
    FROM (%s) w
  ) a
) b
"""
_SPARK_TOKENS = _TOKENS % (
    "CAST(conv(substring(md5(conv_id || '-' || turn || '-' || p), 1, 4), 16, 10) AS DOUBLE)",
    "SELECT conv_id, turn, role, p, word AS text FROM {conversations}"
    " LATERAL VIEW posexplode(split(trim(BOTH ' \n' FROM text), '[ \n]+')) w AS p, word",
)
_DUCK_TOKENS = _TOKENS % (
    "CAST(CAST('0x' || substring(md5(conv_id || '-' || turn || '-' || p), 1, 4) AS BIGINT) AS DOUBLE)",
    "SELECT conv_id, turn, role, generate_subscripts(ws, 1) - 1 AS p, unnest(ws) AS text FROM ("
    "SELECT conv_id, turn, role, string_split_regex(trim(text, ' ' || chr(10)), '[ \n]+') AS ws"
    " FROM {conversations}) c",
)

_SOURCES = {
    "images": ("pages",),
    "pred": ("orders",),
    "votes": ("v_pred",),
    "elements": ("lineitem",),
    "runs": ("events",),
    "series": ("orders",),
    "docs": ("documents", "labels"),
    "epochs": ("events",),
    "tokens": ("conversations",),
    "rule_inputs": ("v_pred",),
    "blend_inputs": ("v_votes",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived work table."""
    inputs = {
        src: view(spark, sf_dir, src[2:]) if src.startswith("v_") else table(spark, sf_dir, src)
        for src in _SOURCES[name]
    }
    return spark.sql(_SPARK_TOKENS if name == "tokens" else _SQL[name], **inputs)


def _chain(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for src in _SOURCES[name]:
            if src.startswith("v_"):
                out += [n for n in _chain((src[2:],)) if n not in out]
        if name not in out:
            out.append(name)
    return out


def oracle(names: str, body: str) -> str:
    """``body`` in SQL with the named work tables (v_<name>) in front as common tables."""
    parts = []
    for name in _chain(tuple(names.split())):
        text = _DUCK_TOKENS if name == "tokens" else _SQL[name]
        parts.append(f"v_{name} AS ({text.format(**{s: s for s in _SOURCES[name]}).strip()})")
    body = body.strip()
    head = "WITH " + ",\n".join(parts)
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + head[5:] + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return head + ",\n" + body[5:]
    return head + "\n" + body
