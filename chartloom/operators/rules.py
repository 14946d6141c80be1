"""Rule scores, structure rules, min-max scaling and templated answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.labels import STANDARD_LABELS
from chartloom.functions.text import clip, safe_double

# Weights and conditions of the additive rules, in tie order. Columns without
# prefix come from contour metrics, g_ from geometric features, s_ from segment counts.
RULES = {
    "bar_chart": [
        (2.8, "rectangle_count >= 2 AND bar_spacing_ratio > 0.1"),
        (2.2, "g_bar_count BETWEEN 2 AND 12"),
        (1.8, "s_bars BETWEEN 2 AND 12"),
        (1.0, "bar_spacing_ratio > 0.28"),
        (0.8, "bar_alignment_score > 0.8"),
        (1.2, "g_bar_gap_ratio > 0.18"),
        (0.8, "g_histogram_uniformity_score < 0.55"),
    ],
    "histogram": [
        (3.6, "rectangle_count > 5 AND bar_spacing_ratio < 0.15"),
        (2.7, "bin_adjacency > 0.5"),
        (2.1, "g_bin_adjacency_ratio > 0.5"),
        (2.3, "bin_continuity > 0.7 OR g_histogram_uniformity_score > 0.7"),
        (1.2, "g_bar_gap_ratio < 0.12"),
        (1.0, "g_axis_numeric_density > 0.25"),
        (1.2, "g_bar_count > 5 OR s_bars > 5"),
    ],
    "scatter_plot": [
        (3.0, "scatter_density > 0.00005 AND circle_count > 15"),
        (2.0, "g_point_density > 0.00003"),
        (2.4, "s_points > 15"),
        (1.6, "point_clustering_coefficient > 0.3"),
        (1.6, "nearest_neighbor_density > 0.5 OR g_cluster_compactness > 0.45"),
        (1.4, "s_point_clusters > 1 OR g_scatter_cluster_count > 2"),
        (-1.6, "g_line_connectivity_score > 0.45 OR g_slope_continuity_score > 0.45"),
    ],
    "pie_chart": [
        (3.0, "circle_count >= 1 AND avg_circularity > 0.6"),
        (3.0, "s_pie_slices >= 1"),
        (1.5, "g_circle_count >= 1 AND s_bars < 3"),
        (2.0, "arc_detection_score > 0.3"),
        (2.0, "circular_symmetry > 0.5 OR g_circular_symmetry > 0.5"),
        (1.5, "radial_edge_density > 0.05"),
        (1.8, "s_circles_hough >= 1 OR g_hough_circle_count >= 1"),
    ],
    "line_chart": [
        (3.0, "line_continuity_score > 0.05 OR g_line_continuity_score > 0.05"),
        (1.8, "g_line_count > 3"),
        (2.0, "s_lines > 5"),
        (1.7, "g_line_connectivity_score > 0.35"),
        (1.2, "g_slope_continuity_score > 0.35"),
        (1.4, "polyline_continuity > 0.3"),
        (0.8, "slope_change_frequency > 0.2"),
        (0.7, "vertex_count > 5"),
        (0.8, "g_edge_density > 0.05 AND s_bars < 3"),
        (-1.7, "s_points > 20 AND g_cluster_compactness > 0.45"),
    ],
}
# used when no class reaches a score of 1
FALLBACK = [
    ("bar_chart", "rectangle_count >= 2"),
    ("scatter_plot", "circle_count >= 10"),
    ("pie_chart", "circle_count >= 1"),
    ("line_chart", "line_continuity_score > 0.03"),
]
# multipliers of the two graded scores inside the class scores
BAR_SCORE_WEIGHT, HISTOGRAM_SCORE_WEIGHT = 2.0, 2.8
RULE_INPUTS = sorted(
    {w for rules in RULES.values() for _, cond in rules for w in cond.split() if w[0].islower()}
    | {"bar_spacing_uniformity", "g_width_uniformity", "bar_adjacency_score", "bar_height_variance"}
)
COUNT_RULES = [
    ("bar_chart", "bars > 0 AND line_segments = 0"),
    ("line_chart", "line_segments > 0 AND bars = 0"),
    ("pie_chart", "pie_slices > 0"),
    ("scatter_plot", "scatter_points > 0 AND line_segments = 0"),
    ("histogram", "bins > 0"),
]


def argmax(scores: dict[str, Column]) -> Column:
    """Struct (t, label) of the highest score; the first label wins ties."""
    entries = [
        F.struct(score.alias("t"), F.lit(-i).alias("o"), F.lit(label).alias("label"))
        for i, (label, score) in enumerate(scores.items())
    ]
    return F.greatest(*entries)


def first_rule(rules: Sequence[tuple[str, str]], default: str) -> Column:
    out = F
    for label, cond in rules:
        out = out.when(F.expr(cond), F.lit(label))
    return out.otherwise(F.lit(default))


def with_defaults(df: DataFrame, columns: Sequence[str] = RULE_INPUTS) -> DataFrame:
    """Missing rule inputs read 0."""
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in columns})


def _step(*cuts: tuple[Column, float]) -> Column:
    out = F
    for cond, score in cuts:
        out = out.when(cond, F.lit(score))
    return out.otherwise(F.lit(0.0))


def graded_scores(df: DataFrame) -> DataFrame:
    """Add histogram_score and bar_score, means of graded cues in [0, 1]."""
    c = F.col
    spacing = c("bar_spacing_ratio")
    most = F.greatest("rectangle_count", "s_bars")
    hist = (
        F.greatest("bin_adjacency", "g_bin_adjacency_ratio")
        + F.greatest("g_width_uniformity", "bin_continuity")
        + _step((spacing < 0.1, 1.0), (spacing < 0.2, 0.5))
        + _step((most > 8, 1.0), (most > 5, 0.5))
    ) / 4
    moderate = c("rectangle_count").between(2, 12) | c("s_bars").between(2, 12) | c("g_bar_count").between(2, 12)
    bar = (
        _step((spacing > 0.15, 1.0), (spacing > 0.05, 0.5))
        + _step((moderate, 1.0))
        + _step((c("bar_height_variance") > 100, 0.5))
    ) / 3
    return df.withColumns({"histogram_score": hist, "bar_score": bar})


def classify(df: DataFrame) -> DataFrame:
    """Add one score_<class> column per class and chart_type."""
    out = graded_scores(with_defaults(df))
    scores = {}
    for label, rules in RULES.items():
        total = F.lit(0.0)
        for weight, cond in rules:
            total = total + F.when(F.expr(cond), F.lit(weight)).otherwise(F.lit(0.0))
        scores[label] = total
    scores["bar_chart"] = scores["bar_chart"] + F.col("bar_score") * BAR_SCORE_WEIGHT
    scores["histogram"] = scores["histogram"] + F.col("histogram_score") * HISTOGRAM_SCORE_WEIGHT
    out = out.withColumns({f"score_{k}": v for k, v in scores.items()})
    best = argmax({k: F.col(f"score_{k}") for k in RULES})
    return out.withColumn("chart_type", F.when(best["t"] < 1.0, first_rule(FALLBACK, "bar_chart")).otherwise(best["label"]))


def structure_classify(df: DataFrame, bias: Column | None = None) -> DataFrame:
    """Add structure_prediction and structure_confidence from element counts."""
    c = F.col
    cap = lambda top, value: F.least(F.lit(top), value)
    bonus = lambda cond, value: F.when(cond, value).otherwise(0.0)
    scores = {
        "bar_chart": cap(3.0, c("bars") * 0.5) + cap(1.0, c("axes") * 0.2),
        "histogram": cap(4.0, c("bars") * 0.6) + (bias if bias is not None else F.lit(0.5)),
        "line_chart": cap(4.0, c("line_segments") * 0.5) + bonus(c("bars") < 3, 1.0),
        "scatter_plot": cap(4.0, c("scatter_points") * 0.2) + bonus(c("line_segments") < 6, 1.0),
        "pie_chart": cap(5.0, c("pie_slices") * 0.7) + bonus(c("bars") < 2, 0.5),
    }
    from chartloom.operators.voting import top_two_margin

    best = argmax(scores)
    margin = top_two_margin(F.array(*scores.values()))
    return df.withColumns(
        {"structure_prediction": best["label"], "structure_confidence": F.least(F.lit(0.99), F.lit(0.5) + margin / 5.0)}
    )


def count_baseline() -> Column:
    return first_rule(COUNT_RULES, "unknown")


def random_baseline(key: str, seed: int = 42, labels: Sequence[str] = tuple(STANDARD_LABELS)) -> Column:
    """Label drawn from a hash of the key."""
    from chartloom.operators.ordering import order_hash

    return F.array(*[F.lit(x) for x in labels])[(order_hash(key, seed) % len(labels)).cast("int")]


def minmax(df: DataFrame, columns: dict[str, str], eps: float = 1e-12) -> DataFrame:
    """Add min-max scaled copies (new name -> column) over the whole table; constants give 0.

    All extremes come from one aggregate used as a scalar subquery: one extra pass with map-side
    combine, no window and no join.
    """
    numbers = {new: safe_double(F.col(old)) for new, old in columns.items()}
    limits = df.agg(
        F.struct(*[F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias(n) for n, v in numbers.items()]).alias("s")
    ).scalar()
    out = df.withColumn("_lim", limits)
    scaled = {}
    for n, v in numbers.items():
        lo, hi = F.col(f"_lim.{n}.lo"), F.col(f"_lim.{n}.hi")
        scaled[n] = F.when(hi - lo < eps, F.lit(0.0)).otherwise((v - lo) / (hi - lo))
    return out.withColumns(scaled).drop("_lim")


def disambiguate_histograms(df: DataFrame) -> DataFrame:
    """Histogram and bar confidences from scaled features; rewrites close calls of the heuristic."""
    names = [
        "bin_adjacency_ratio", "width_uniformity", "bar_spacing_variance", "bar_count", "bar_gap_ratio",
        "histogram_uniformity_score", "axis_numeric_density",
    ]
    n = {x: F.col(f"_n_{x}") for x in names}
    out = minmax(df, {f"_n_{x}": f"feature_{x}" for x in names})
    continuous = clip(n["bin_adjacency_ratio"] * 0.5 + (1.0 - n["bar_gap_ratio"]) * 0.5)
    uniform = clip(0.6 * n["width_uniformity"] + 0.4 * n["histogram_uniformity_score"])
    hist = clip(
        0.30 * continuous + 0.28 * uniform + 0.20 * F.col("numeric_ratio")
        + 0.12 * n["axis_numeric_density"] + 0.10 * (1.0 - n["bar_spacing_variance"])
    )
    bar = clip(
        0.30 * n["bar_count"] + 0.25 * n["bar_spacing_variance"] + 0.20 * n["bar_gap_ratio"]
        + 0.15 * F.col("category_ratio") + 0.10 * (1.0 - n["axis_numeric_density"])
    )
    out = out.withColumns({"histogram_confidence": hist, "bar_chart_confidence": bar})
    h, b, p = F.col("histogram_confidence"), F.col("bar_chart_confidence"), F.col("heuristic_prediction")
    close = p.isin("histogram", "bar_chart")
    fixed = F.when(close & (h >= b + 0.08), "histogram").when(close & (b > h + 0.08), "bar_chart").otherwise(p)
    return out.withColumn("heuristic_prediction", fixed).drop(*[f"_n_{x}" for x in names])


def blended_scores(df: DataFrame) -> DataFrame:
    """histogram_score and bar_chart_score from six scaled features."""
    names = [
        "bar_count", "bin_adjacency_ratio", "width_uniformity", "bar_spacing_variance", "bar_height_variance", "axis_confidence",
    ]
    n = {x: F.col(f"_n_{x}") for x in names}
    out = minmax(df, {f"_n_{x}": f"feature_{x}" for x in names}, eps=1e-9)
    touching = 1.0 - clip(n["bar_spacing_variance"])
    moderate = clip(1.0 - F.abs(n["bar_count"] - 0.45))
    return out.withColumns(
        {
            "histogram_score": clip(0.35 * n["bin_adjacency_ratio"] + 0.25 * n["width_uniformity"] + 0.20 * touching + 0.20 * n["bar_count"]),
            "bar_chart_score": clip(0.35 * n["bar_spacing_variance"] + 0.25 * n["bar_height_variance"] + 0.20 * moderate + 0.20 * n["axis_confidence"]),
        }
    ).drop(*[f"_n_{x}" for x in names])


# Structural feature -> feature column it is taken from.
STRUCTURAL = {
    "bar_count": "bar_count", "bar_height_variance": "bar_height_variance", "bar_spacing_variance": "bar_spacing_variance",
    "bar_alignment_score": "bar_alignment_score", "polyline_continuity": "polyline_score", "slope_variance": "slope_variance",
    "vertex_count": "polyline_vertex_count", "line_continuity_score": "line_continuity_score", "point_density": "point_density",
    "cluster_count": "scatter_cluster_count", "nearest_neighbor_density": "nn_density", "bar_gap_ratio": "bar_gap_ratio",
    "hist_uniformity": "histogram_uniformity_score", "axis_numeric_density": "axis_numeric_density",
    "edge_orientation_entropy": "edge_orientation_entropy",
}


def structural_features(df: DataFrame) -> DataFrame:
    """struct_* copies of the structural features plus their norm_* min-max scalings."""
    have = set(df.columns)
    out = df.withColumns(
        {f"struct_{n}": safe_double(F.col(f"feature_{f}")) if f"feature_{f}" in have else F.lit(0.0) for n, f in STRUCTURAL.items()}
    )
    names = list(STRUCTURAL)
    if "slice_angle_variance" in have:
        out = out.withColumn("struct_slice_angle_variance", safe_double(F.col("slice_angle_variance")))
        names.append("slice_angle_variance")
    return minmax(out, {f"norm_{n}": f"struct_{n}" for n in names})


def answers(series: DataFrame, key: str = "image_id", chart_type: str = "chart_type") -> DataFrame:
    """Templated trend, highest-value and share answers per chart from rows (key, pos, label, value).

    First, last, smallest and largest entries are aggregates over (value, position), so a long
    series is reduced map-side. A null value marks a chart without numbers.
    """
    v, pos = F.col("value"), F.col("pos")
    entry = F.when(v.isNotNull(), F.struct("label", "value"))
    stats = series.groupBy(key, chart_type).agg(
        F.min_by("value", F.when(v.isNotNull(), pos)).alias("_first"),
        F.max_by("value", F.when(v.isNotNull(), pos)).alias("_last"),
        F.max_by(entry, F.when(v.isNotNull(), F.struct(v, -pos))).alias("_top"),
        F.min_by(entry, F.when(v.isNotNull(), F.struct(v, pos))).alias("_low"),
        F.count("value").alias("_n"),
    )
    some = F.col("_n") > 0
    trend = (
        F.when(F.col("_last") > F.col("_first"), "an increasing trend")
        .when(F.col("_last") < F.col("_first"), "a decreasing trend").otherwise("a mostly stable trend")
    )
    none = "Unable to determine from extracted values."
    out = stats.select(
        key,
        F.when(some, F.format_string("The %s indicates %s.", chart_type, trend))
        .otherwise("Insufficient numeric extraction to infer a reliable trend.").alias("trend"),
        F.when(some, F.format_string("%s has the highest value at %.2f.", F.col("_top.label"), F.col("_top.value"))).otherwise(none).alias("highest"),
        F.when(some, F.format_string("%s has the largest share, while %s is the smallest.", F.col("_top.label"), F.col("_low.label")))
        .otherwise(none).alias("share"),
    )
    return out.withColumn("narrative", F.concat_ws(" ", "trend", "highest", "share"))
