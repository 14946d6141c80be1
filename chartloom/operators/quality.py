"""Column hygiene, backfills and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import labels as L
from chartloom.functions.text import safe_double

# Extra model inputs and feature groups by name.
EXTRA_FEATURES = [
    "yolo_bars", "yolo_line_segments", "yolo_scatter_points", "yolo_pie_slices", "yolo_axes",
    "yolo_legend_boxes", "yolo_text_regions", "yolo_text_blocks", "histogram_score", "bar_chart_score",
]
STRUCTURAL_FEATURES = [
    "bar_count", "line_count", "point_count", "circle_count", "contour_count", "axis_count", "edge_density",
]
BACKFILL_CONFIDENCE = 0.55


def safe_column(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """Numeric column; unreadable values and missing columns give the default."""
    return safe_double(F.col(name), default) if name in df.columns else F.lit(default)


def backfill(df: DataFrame, root: str) -> DataFrame:
    """Fill blank paths, and missing prediction, confidence and truth columns."""
    cols = set(df.columns)
    name = F.col("image_name")
    fallback = F.concat(F.lit(root.rstrip("/") + "/"), name)
    path = F.when(F.coalesce(F.col("image_path"), F.lit("")) == "", fallback).otherwise(F.col("image_path")) if "image_path" in cols else fallback
    out = df.withColumn("image_path", path)
    if "heuristic_prediction" not in cols:
        guess = F.col("predicted_chart_type") if "predicted_chart_type" in cols else F.lit(L.UNKNOWN)
        out = out.withColumn("heuristic_prediction", guess)
    if "heuristic_confidence" not in cols:
        known = F.col("heuristic_prediction") != L.UNKNOWN
        out = out.withColumn("heuristic_confidence", F.when(known, BACKFILL_CONFIDENCE).otherwise(0.0))
    if "true_chart_type" not in cols:
        out = out.withColumn("true_chart_type", L.infer_label(name))
    return out


def feature_columns(df: DataFrame, prefix: str = "feature_", extra: Sequence[str] = EXTRA_FEATURES) -> list[str]:
    return sorted({c for c in df.columns if c.startswith(prefix) or c in extra})


def flatten(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Replace struct columns by prefixed flat columns."""
    flat = []
    for column, prefix in prefixes.items():
        flat += [F.col(f"{column}.{f}").alias(f"{prefix}{f}") for f in df.schema[column].dataType.names]
    return df.select(*[c for c in df.columns if c not in prefixes], *flat)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value; one pass counts them all."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if filled[c] == 0])


def feature_group(name: Column) -> Column:
    return (
        F.when(name.startswith("ocr_"), "OCR")
        .when(name.startswith("hist_"), "Histogram-specific")
        .when(name.isin(STRUCTURAL_FEATURES), "Structural")
        .otherwise("Geometric")
    )


def dataset_checks(
    df: DataFrame,
    *,
    label: str = "label",
    split: str = "split",
    labels: Sequence[str] = tuple(L.STANDARD_LABELS),
    splits: Sequence[str] = ("train", "validation", "test"),
    required: Sequence[str] = ("image_path",),
    per_class: int | None = None,
) -> DataFrame:
    """One row of booleans: non-empty, all splits present, known labels, required columns, class totals."""
    counts = df.groupBy(label, split).agg(F.count(F.lit(1)).alias("n"))
    checks = counts.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("not_empty"),
        F.coalesce(
            F.size(F.array_intersect(F.collect_set(split), F.array(*[F.lit(s) for s in splits]))) == len(splits), F.lit(False)
        ).alias("splits_present"),
        F.coalesce(F.every(F.coalesce(F.col(label).isin(list(labels)), F.lit(False))), F.lit(True)).alias("labels_known"),
        F.lit(set(required) <= set(df.columns)).alias("columns_present"),
        (
            F.coalesce(F.sum("n"), F.lit(0)) == F.lit(per_class or 0) * len(labels) if per_class is not None else F.lit(True)
        ).alias("total_matches"),
    )
    return checks


def require(checks: DataFrame) -> None:
    """Raise if a check of a one-row table is false."""
    failed = [c for c, ok in checks.first().asDict().items() if not ok]
    if failed:
        raise ValueError("failed checks: " + ", ".join(failed))


def verify_run(
    df: DataFrame,
    sources: dict[str, Column],
    *,
    minimum_rows: int = 5000,
    confidence: str = "easyocr_confidence",
    success: str = "paddle_success_rate",
    elements: Sequence[str] = ("yolo_bars", "yolo_line_segments", "yolo_scatter_points", "yolo_pie_slices"),
    runtime_ok: Column | None = None,
) -> DataFrame:
    """End-of-run row: dataset, token, element and runtime checks with the reruns they call for."""
    total = sum((safe_column(df, c) for c in elements[1:]), safe_column(df, elements[0]))
    per_source = [F.count_if(c) > 0 for c in sources.values()]
    enough = F.count(F.lit(1)) >= minimum_rows
    for present in per_source:
        enough = enough & present
    row = df.agg(
        enough.alias("datasets_ok"),
        F.coalesce(
            (F.avg(safe_column(df, confidence)) > 0) & (F.avg(safe_column(df, success)) > 0), F.lit(False)
        ).alias("tokens_ok"),
        F.coalesce(F.avg(total) > 0, F.lit(False)).alias("elements_ok"),
        (runtime_ok if runtime_ok is not None else F.lit(True)).alias("runtime_ok"),
    )
    actions = F.array(
        F.when(~F.col("tokens_ok"), F.lit("rerun_ocr_for_low_confidence_rows")),
        F.when(~F.col("elements_ok"), F.lit("rerun_yolo_inference")),
    )
    return row.withColumn("rerun_actions", F.array_join(F.array_compact(actions), ","))


def rows_to_rerun(df: DataFrame, confidence: str) -> DataFrame:
    return df.filter(safe_column(df, confidence) <= 0)
