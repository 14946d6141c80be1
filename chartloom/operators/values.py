"""Chart values from shapes: bars, lines, points, slices, labels and scaling.

Per-image extremes and totals are aggregates joined back by image, so one image may hold any
share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import safe_double
from chartloom.operators.ordering import rank_in_group
from chartloom.session import cut_lineage

SAMPLES = 20  # x positions at which a line is read


def _bar_value(height: Column, span: Column) -> Column:
    return F.round(height / F.when(span > 0, span).otherwise(1) * 100.0, 1)


def _tenths(value: Column) -> Column:
    """One decimal, half up on the double itself: its decimal text may lie on the other side of a tie."""
    return F.round(value * 10) / 10


def _slice_angle(area: Column) -> Column:
    return _tenths(area / F.col("_total") * 360)


def _slice_totals(slices: DataFrame, *wholes: int) -> DataFrame:
    """(image_id, _total): the summed area of each image's slices, rounded as if added one by one in the order of the files.

    Sums of doubles differ in their last digits by their order, and partial sums meet in any order. That shows only where a
    share of one of the ``wholes`` lies within these digits of a tie, so only such images are added up in order. Slices differ
    in size by 80 times at most, and shares below half a tenth have no tie: such an image has at most 576,000 slices.
    """
    place = F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())
    slices = slices.select("image_id", "area", place.alias("_place"))
    sums = slices.groupBy("image_id").agg(F.sum("area").alias("_total"), F.count(F.lit(1)).alias("_n"))
    tenths = [F.col("area") / F.col("_total") * whole * 10 for whole in wholes]
    ties = [F.abs(t - F.floor(t) - 0.5) <= t * (F.col("_n") + 3) * 2.0**-52 for t in tenths]
    doubtful = slices.join(sums.filter("_n > 2"), "image_id").filter(F.greatest(*ties) if len(ties) > 1 else ties[0]).select("image_id").distinct()
    rows = slices.join(doubtful, "image_id", "left_semi").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("_place", "area"))).alias("_rows"))
    ordered = rows.select("image_id", F.aggregate("_rows", F.lit(0.0), lambda total, row: total + row["area"]).alias("_ordered"))
    return sums.join(ordered, "image_id", "left").select("image_id", F.coalesce("_ordered", "_total").alias("_total"))


def _sized_slice(width: int, height: int) -> Column:
    return (F.col("area") > width * height * 0.01) & (F.col("area") < width * height * 0.8)


def bar_values(bars: DataFrame, axes: DataFrame) -> DataFrame:
    """Add value = h / (baseline - top) * 100, one decimal.

    The baseline is the lowest nearly horizontal axis, else the lowest bar end; a span of zero
    or less counts as 1.
    """
    flat = axes.filter(F.abs(F.col("y") - F.col("y2")) < 20)
    lowest = flat.groupBy("image_id").agg(F.max(F.greatest("y", "y2")).alias("_axis"))
    ends = bars.groupBy("image_id").agg(F.min("y").alias("_top"), F.max(F.col("y") + F.col("h")).alias("_end"))
    spans = ends.join(lowest, "image_id", "left").select("image_id", (F.coalesce("_axis", "_end") - F.col("_top")).alias("_span"))
    return bars.join(spans, "image_id").withColumn("value", _bar_value(F.col("h"), F.col("_span"))).drop("_span")


def ordered_bar_values(bars: DataFrame, axes: DataFrame) -> DataFrame:
    """(image_id, pos, value) of the bars from left to right."""
    ranked = rank_in_group(bar_values(bars, axes), ["image_id"], ["x", "seq"], rank_col="pos")
    return ranked.select("image_id", "pos", "value")


def map_labels(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Values by label at the same position; unlabelled ones become Bar_<n>, repeated labels keep the last."""
    named = values.join(labels, ["image_id", "pos"], "left").withColumn(
        "label", F.coalesce("label", F.concat(F.lit("Bar_"), (F.col("pos") + 1).cast("string")))
    )
    return named.groupBy("image_id", "label").agg(F.max_by("value", "pos").alias("value"))


def line_values(hits: DataFrame, width: int, height: int) -> DataFrame:
    """Median y of the hits at evenly spaced x positions, scaled to 0..100 upwards.

    Hits are counted per pixel first, so the median buffers at most canvas-height entries.
    """
    mx, my = int(width * 0.15), int(height * 0.1)
    xs = [int(mx + i * ((width - mx - mx) / (SAMPLES - 1))) for i in range(SAMPLES - 1)] + [width - mx]
    inside = hits.filter(F.col("x").isin(xs) & (F.col("y") >= my) & (F.col("y") < height - my))
    pixels = inside.groupBy("image_id", "x", "y").agg(F.count(F.lit(1)).alias("_n"))
    y = F.floor(F.percentile(F.col("y") - my, F.lit(0.5), F.col("_n"))).cast("int") + my
    return pixels.groupBy("image_id", "x").agg(y.alias("y_pixel")).select(
        "image_id", F.col("x").alias("x_pixel"), "y_pixel", F.round((1.0 - F.col("y_pixel") / height) * 100, 1).alias("value")
    )


def point_values(points: DataFrame, width: int, height: int) -> DataFrame:
    """Point coordinates on 0..100 scales, y upwards, one decimal."""
    return points.withColumns(
        {
            "x_normalized": F.round(F.col("x") / width * 100, 1),
            "y_normalized": F.round((1.0 - F.col("y") / height) * 100, 1),
        }
    )


def slice_values(slices: DataFrame, width: int, height: int) -> DataFrame:
    """Angle and percentage of every slice with 1% to 80% of the canvas."""
    kept = slices.filter(_sized_slice(width, height))
    share = F.col("area") / F.col("_total")
    return kept.join(_slice_totals(kept, 360, 100), "image_id").withColumns(
        {"angle": _slice_angle(F.col("area")), "percentage": _tenths(share * 100)}
    ).drop("_total")


def extract_values(elements: DataFrame, types: DataFrame, width: int, height: int) -> DataFrame:
    """Values (image_id, chart_type, seq, value) by the extraction of each image's chart type.

    A shape travels as one number, and what bars and slices need of their whole image meets the types
    first. A branch for each chart type would join and sort all columns again, and a task would hold the rows of all branches.
    """
    kind = F.col("kind")
    bar, piece = kind == "bar", (kind == "pie_slice") & _sized_slice(width, height)
    flat = (kind == "axis") & (F.abs(F.col("y") - F.col("y2")) < 20)
    ends = elements.filter(flat | bar).select(
        "image_id", F.when(flat, F.greatest("y", "y2")).alias("_axis"), F.when(bar, F.col("y")).alias("_top"), F.when(bar, F.col("y") + F.col("h")).alias("_end")
    )
    totals = cut_lineage(_slice_totals(elements.filter(piece), 360))
    wholes = ends.unionByName(totals, allowMissingColumns=True).groupBy("image_id").agg(*[f(c).alias(c) for c, f in (("_axis", F.max), ("_top", F.min), ("_end", F.max), ("_total", F.max))])
    across, up = F.col("x_normalized"), F.col("y_normalized")
    sized = F.when(bar, F.col("h").cast("double")).when(kind == "point", F.sqrt(across * across + up * up)).otherwise(F.col("area"))
    use = F.when(bar, 0).when(kind == "point", 1).otherwise(2)
    shapes = point_values(elements.filter(bar | piece | (kind == "point")), width, height).select("image_id", "seq", use.alias("_use"), sized.alias("_v"))
    wanted = F.when(F.col("chart_type").isin("bar_chart", "histogram"), 0).when(F.col("chart_type") == "scatter_plot", 1).when(F.col("chart_type") == "pie_chart", 2)
    images = types.withColumn("_use", wanted).filter("_use is not null").join(wholes, "image_id", "left")
    value = (
        F.when(F.col("_use") == 0, _bar_value(F.col("_v"), F.coalesce("_axis", "_end") - F.col("_top")))
        .when(F.col("_use") == 1, F.col("_v")).otherwise(_slice_angle(F.col("_v")))
    )
    lined = elements.join(types.filter(F.col("chart_type") == "line_chart").select("image_id"), "image_id")
    lines = line_values(lined, width, height).select(
        "image_id", F.lit("line_chart").alias("chart_type"), F.col("x_pixel").cast("bigint").alias("seq"), "value"
    )
    return shapes.join(images, ["image_id", "_use"]).select("image_id", "chart_type", "seq", value.alias("value")).unionByName(lines)


def normalize_values(values: DataFrame) -> DataFrame:
    """Add normalized per image and chart type.

    Line values are divided by 100, angles by 360, scatter norms by their maximum; others are
    min-max scaled, constants giving 1 if positive, else 0. The values are read twice and made once.
    """
    values = cut_lineage(values)
    span = values.groupBy("image_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    v, lo, hi, kind = F.col("value"), F.col("_lo"), F.col("_hi"), F.col("chart_type")
    flat = F.when(hi > 0, 1.0).otherwise(0.0)
    scaled = (
        F.when(kind == "line_chart", v / 100.0).when(kind == "pie_chart", v / 360.0)
        .when(kind == "scatter_plot", v / (hi + 1e-9)).when(hi - lo < 1e-9, flat).otherwise((v - lo) / (hi - lo))
    )
    return values.join(span, "image_id").withColumn("normalized", scaled).drop("_lo", "_hi")


def coerce_map(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(pos, label, value) rows of a map; unreadable values read 0."""
    return df.select(*keys, F.posexplode(F.map_entries(column)).alias("pos", "e")).select(
        *keys, "pos", F.col("e.key").alias("label"), safe_double(F.col("e.value")).alias("value")
    )


def coerce_list(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(pos, label, value) rows of a list of structs label, value, normalized_value, estimated_percentage."""
    return df.select(*keys, F.posexplode(column).alias("pos", "e")).select(
        *keys, "pos",
        F.coalesce("e.label", F.concat(F.lit("item_"), (F.col("pos") + 1).cast("string"))).alias("label"),
        safe_double(F.coalesce("e.value", "e.normalized_value", "e.estimated_percentage")).alias("value"),
    )
