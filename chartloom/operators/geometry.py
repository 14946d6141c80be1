"""Geometric features of detected shapes, per image.

Element tables have image_id, seq, kind, integer pixels x, y, w, h (boxes) or x, y, x2, y2
(segments), and area, perimeter, hull_area. Pixels bound what one image can hold: at most
canvas-width distinct x positions, canvas-width x canvas-height distinct points. Copies are
merged by position first, so an image with any number of rows stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.boxes import centre_form, circularity, clip_box, line_box, ratio
from chartloom.operators.ordering import previous_row
from chartloom.session import cut_lineage

# Thresholds of the shape predicates.
MIN_BAR_AREA, MIN_POINT_AREA, MAX_POINT_AREA = 400, 15, 1200
MIN_PIE_FRACTION, MAX_PIE_FRACTION = 0.015, 0.75
AXIS_MARGIN, AXIS_OVERLAP = 12, 0.5
ELEMENT_CLASSES = ["bars", "line_segments", "scatter_points", "pie_slices", "axes", "legend_boxes", "text_regions"]
KIND_CLASS = {
    "bar": "bars", "line": "line_segments", "point": "scatter_points", "pie_slice": "pie_slices", "axis": "axes",
    "rect": "legend_boxes", "circle": "text_regions",
}


def shape_measures(df: DataFrame) -> DataFrame:
    """Add aspect (h/w), fill, solidity and circularity with guarded denominators."""
    box = F.col("w") * F.col("h")
    return df.withColumns(
        {
            "circularity": circularity(F.col("area"), F.col("perimeter")),
            "aspect": ratio(F.col("h").cast("double"), F.col("w"), 1.0),
            "fill": ratio(F.col("area"), box),
            "solidity": ratio(F.col("area"), F.col("hull_area")),
        }
    )


def shape_classes(df: DataFrame, width: int, height: int) -> DataFrame:
    """Add is_text_box, is_bar, is_point, is_circle, is_slice from the shape measures."""
    canvas = float(width * height)
    area, aspect, fill = F.col("area"), F.col("aspect"), F.col("fill")
    sized = (area >= MIN_BAR_AREA) & (area <= canvas * 0.5)
    text = (aspect < 0.3) & (fill < 0.4)
    inside = (
        (F.col("y") > height * 0.15) & (F.col("y") + F.col("h") < height * 0.85)
        & (F.col("x") > width * 0.10) & (F.col("x") + F.col("w") < width * 0.90)
    )
    return shape_measures(df).withColumns(
        {
            "is_text_box": sized & text,
            "is_bar": sized & ~text & (aspect > 0.6) & (fill > 0.35),
            "is_point": (area > MIN_POINT_AREA) & (area < MAX_POINT_AREA) & (F.col("circularity") > 0.55),
            "is_circle": ((F.col("circularity") > 0.6) & (area > canvas * 0.02) & (aspect > 0.4) & (aspect < 2.5))
            | ((area < 1500) & (F.col("circularity") > 0.5) & inside),
            "is_slice": (area > canvas * MIN_PIE_FRACTION) & (area < canvas * MAX_PIE_FRACTION)
            & (fill > 0.25) & (fill < 0.95) & (F.col("solidity") > 0.75),
        }
    )


def segment_measures(df: DataFrame) -> DataFrame:
    """Add angle (0..180), length and slope of segments."""
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return df.withColumns(
        {
            "angle": F.abs(F.atan2(dy.cast("double"), dx.cast("double")) * 180 / F.pi()),
            "length": F.sqrt((dx * dx + dy * dy).cast("double")),
            "slope": dy / (dx + 1e-6),
        }
    )


def classify_segments(df: DataFrame, width: int, height: int) -> DataFrame:
    """Add direction (horizontal, vertical, diagonal, short), and axis_kind for long straight ones."""
    a, n = F.col("angle"), F.col("length")
    direction = (
        F.when(n < width * 0.05, "short").when((a < 10) | (a > 170), "horizontal")
        .when((a > 80) & (a < 100), "vertical").otherwise("diagonal")
    )
    axis = F.when(((a < 5) | (a > 175)) & (n > width * 0.25), "horizontal").when(
        (a > 85) & (a < 95) & (n > height * 0.25), "vertical"
    )
    return segment_measures(df).withColumn("direction", direction).withColumn("axis_kind", axis)


def axis_statistics(segments: DataFrame, width: int, height: int) -> DataFrame:
    """Per image: horizontal share, confidence, line length over the diagonal, tick density."""
    diag = (width**2 + height**2) ** 0.5
    d = F.col("direction")
    out = classify_segments(segments, width, height).groupBy("image_id").agg(
        F.count_if(d == "horizontal").alias("h"),
        F.count_if(d == "vertical").alias("v"),
        F.count_if(d == "diagonal").alias("line_count"),
        (F.coalesce(F.sum(F.when(d != "short", F.col("length"))), F.lit(0.0)) / max(1.0, diag)).alias("line_continuity"),
        (F.count_if((F.col("length") > 3) & (F.col("length") < max(width, height) * 0.05)) / (diag * 0.01 + 1e-6)).alias("tick_density"),
    )
    total = F.col("h") + F.col("v")
    return out.select(
        "image_id",
        F.when(total > 0, F.col("h") / total).otherwise(0.5).alias("axis_orientation"),
        F.when(total > 0, F.least(F.lit(1.0), total * 50.0 / max(1.0, diag))).otherwise(0.0).alias("axis_confidence"),
        "line_count", "line_continuity", "tick_density",
    )


def element_counts(df: DataFrame) -> DataFrame:
    """Counts of the seven element classes per image."""
    kinds = {c: k for k, c in KIND_CLASS.items()}
    return df.groupBy("image_id").agg(*[F.count_if(F.col("kind") == kinds[c]).alias(c) for c in ELEMENT_CLASSES])


def mean_counts(counts: DataFrame) -> DataFrame:
    return counts.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ELEMENT_CLASSES], *[F.sum(c).alias(f"total_{c}") for c in ELEMENT_CLASSES]
    )


def bar_geometry(bars: DataFrame, height: int) -> DataFrame:
    """Per image: size means and variances, aspect, fill, vertical share and bottom alignment."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    aspect = h / F.greatest(F.lit(1.0), w)
    bottom = (F.col("y") + F.col("h")).cast("double")
    return bars.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("bar_count"),
        F.avg(w).alias("width_mean"), F.var_pop(w).alias("width_var"),
        F.avg(h).alias("height_mean"), F.var_pop(h).alias("height_var"),
        F.avg(aspect).alias("aspect_mean"), F.var_pop(aspect).alias("aspect_var"),
        F.avg(ratio(F.col("area"), F.col("w") * F.col("h"))).alias("fill_mean"),
        F.avg((h > w).cast("double")).alias("vertical_ratio"),
        (1 - F.least(F.lit(1.0), F.stddev_pop(bottom) / height)).alias("alignment"),
    )


def count_ratios(counts: DataFrame) -> DataFrame:
    """Slice share, component balance and points per line from element counts."""
    c = F.col
    at_least = lambda x: F.greatest(F.lit(1.0), x.cast("double"))
    return counts.select(
        "image_id",
        (c("pie_slices") / at_least(c("text_regions") + c("pie_slices"))).alias("slice_ratio"),
        ((c("bars") + c("scatter_points") + c("line_segments")) / at_least(c("axes") + c("text_regions") + c("pie_slices"))).alias("component_balance"),
        (c("scatter_points") / at_least(c("line_segments") + 1)).alias("points_per_line"),
    )


def neighbour_gaps(bars: DataFrame) -> DataFrame:
    """Distinct x positions per image with the step from the previous one and the gap to its end.

    Rows at one x are merged (``n`` keeps their number): between copies the step is 0 and the
    gap is negative, so both are known without listing them.
    """
    merged = bars.groupBy("image_id", "x").agg(F.count(F.lit(1)).alias("n"), F.max_by("w", "seq").alias("last_w"))
    by_x = Window.partitionBy("image_id").orderBy("x")  # at most canvas-width rows
    return merged.select(
        "image_id", "x", "n",
        (F.col("x") - F.lag("x").over(by_x)).alias("step"),
        (F.col("x") - F.lag(F.col("x") + F.col("last_w")).over(by_x)).alias("gap"),
    )


def bin_geometry(bars: DataFrame, width: int, height: int) -> DataFrame:
    """Per image: step and gap ratios, touching share, width, spacing and histogram uniformity.

    Steps run over all neighbours in x order; a step between copies is 0. ``merged_mass`` marks
    images where one box is so large that it must be several merged bins.
    """
    widths = bars.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("w").alias("w_mean"), F.stddev_pop("w").alias("w_std"),
        F.max(((F.col("w") > width * 0.3) & (F.col("h") > height * 0.15)).cast("int")).alias("merged_mass"),
    )
    steps = neighbour_gaps(bars).join(widths.select("image_id", "w_mean"), "image_id")
    s, g, m = F.col("step").cast("double"), F.col("gap").cast("double"), F.col("w_mean")
    open_gap = F.when(g >= 0, g)
    sums = steps.groupBy("image_id").agg(
        F.coalesce(F.sum(s), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(s * s), F.lit(0.0)).alias("s2"),
        F.count_if(s < m * 0.15).alias("s_touch"), F.sum(F.col("n") - 1).alias("zeros"),
        F.avg(open_gap).alias("g_mean"), F.stddev_pop(open_gap).alias("g_std"), F.count(open_gap).alias("g_n"),
        F.count_if((g >= 0) & (g < m * 0.1)).alias("g_touch"),
    )
    j = widths.join(sums, "image_id").filter(F.col("n") > 1)
    k = F.col("n") - 1
    s_mean = F.col("s1") / k
    s_std = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / k - s_mean * s_mean))
    w_cv = F.least(F.lit(1.0), F.col("w_std") / (m + 1e-6))
    s_cv = F.least(F.lit(1.0), s_std / (s_mean + 1e-6))
    zero_touch = F.when(m > 0, F.col("zeros")).otherwise(0)
    base = j.select(
        "image_id",
        F.col("n").alias("bin_count"),
        (s_std * s_std).alias("spacing_variance"),
        (s_mean / (m + 1e-6)).alias("gap_ratio"),
        ((F.col("s_touch") + zero_touch) / k).alias("touching_ratio"),
        (1 - w_cv).alias("width_uniformity"),
        (0.55 * (1 - w_cv) + 0.45 * (1 - s_cv)).alias("histogram_uniformity"),
        F.coalesce(F.when(m > 0, F.col("g_mean") / m), F.lit(0.0)).alias("spacing_ratio"),
        F.when(F.col("g_n") > 1, 1 - F.least(F.lit(1.0), F.col("g_std") / (F.col("g_mean") + 1e-6))).otherwise(0.0).alias("spacing_uniformity"),
        F.when(F.col("g_n") > 0, F.col("g_touch") / F.col("g_n")).otherwise(0.0).alias("bin_adjacency"),
        (F.col("merged_mass") == 1).alias("merged_mass"),
    )
    big = F.col("merged_mass")
    return base.withColumn("bin_count", F.when(big, F.greatest("bin_count", F.lit(10))).otherwise(F.col("bin_count"))).withColumn(
        "spacing_ratio", F.when(big, 0.0).otherwise(F.col("spacing_ratio"))
    )


def spatial_spread(points: DataFrame, width: int, height: int) -> DataFrame:
    """Per image: (var x + var y)/canvas, points per pixel, mean circularity."""
    canvas = float(width * height)
    return points.groupBy("image_id").agg(
        ((F.var_pop("x") + F.var_pop("y")) / canvas).alias("spatial_variance"),
        (F.count(F.lit(1)) / canvas).alias("point_density"),
        F.avg(circularity(F.col("area"), F.col("perimeter"))).alias("mean_circularity"),
    )


def area_entropy(df: DataFrame) -> DataFrame:
    """Per image: base-2 entropy of area shares and variance of areas.

    With shares a/S the entropy is log2(S) - sum(a log2 a)/S, so one aggregation is enough.
    """
    a = F.when(F.col("area") > 0, F.col("area"))
    total = F.sum(a)
    return df.groupBy("image_id").agg(
        F.coalesce(F.log2(total) - F.sum(a * F.log2(a)) / total, F.lit(0.0)).alias("area_entropy"), F.var_pop("area").alias("area_variance")
    )


def orientation_entropy(df: DataFrame, angle: Column, low: float, high: float, bins: int = 18) -> DataFrame:
    """Per image: entropy of a fixed-bin histogram, normalised by log2(bins)."""
    b = F.least(F.width_bucket(angle, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    counts = df.filter((angle >= low) & (angle <= high)).groupBy("image_id", b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return counts.groupBy("image_id").agg(
        ((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total) / F.log2(F.lit(float(bins)))).alias("entropy")
    )


def angle_variance(shares: DataFrame, angle: str) -> DataFrame:
    """Per image: population variance of slice angles, 0 below two slices."""
    return shares.groupBy("image_id").agg(
        F.when(F.count(angle) > 1, F.var_pop(angle)).otherwise(0.0).alias("slice_angle_variance")
    )


def circle_statistics(circles: DataFrame, width: int, height: int) -> DataFrame:
    """Per image: circles, arc score and best symmetry of a circle centre with the canvas centre."""
    dx, dy = F.col("x") - width / 2, F.col("y") - height / 2
    sym = 1 - F.least(F.lit(1.0), F.sqrt(dx * dx + dy * dy) / (min(width, height) * 0.3))
    return circles.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("circles"),
        F.least(F.lit(1.0), F.count(F.lit(1)) * 0.5).alias("arc_score"),
        F.greatest(F.lit(0.0), F.max(sym)).alias("circular_symmetry"),
    )


def chain_features(segments: DataFrame, width: int) -> DataFrame:
    """Per image along x: share of chained neighbours, slope changes, and variance and continuity of the diagonals' slopes."""
    s = classify_segments(segments, width, width).withColumn("sx", F.col("x"))
    p = F.col("prev")
    linked = previous_row(s, "image_id", "sx", "seq", ["x2", "y2", "slope"])
    dx, dy = p["x2"] - F.col("x"), p["y2"] - F.col("y")
    near = F.sqrt((dx * dx + dy * dy).cast("double")) < width * 0.1
    diagonal = F.col("direction") == "diagonal"
    out = linked.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if(near).alias("chains"),
        F.count_if(F.abs(F.col("slope") - p["slope"]) > 0.2).alias("changes"),
        F.count_if(diagonal).alias("_diagonals"),
        F.var_pop(F.when(diagonal, F.col("slope"))).alias("slope_variance"),
        F.avg(F.when(diagonal, F.col("slope"))).alias("_mean"),
    )
    several, sloped = F.col("segments") > 1, F.col("_diagonals") > 1
    return out.select(
        "image_id", "segments",
        F.when(several, F.col("chains") / F.greatest(F.lit(1), F.col("segments") - 1)).otherwise(0.0).alias("continuity"),
        F.when(several, F.col("changes") / F.col("segments")).otherwise(0.0).alias("slope_change_frequency"),
        F.when(sloped, F.col("slope_variance")).otherwise(0.0).alias("slope_variance"),
        F.when(sloped, 1 - F.least(F.lit(1.0), F.col("slope_variance") / (F.abs("_mean") + 1.0))).otherwise(0.0).alias("slope_continuity"),
    )


def main_axes(axes: DataFrame) -> DataFrame:
    """Lowest horizontal and leftmost vertical axis per image, by map-side max and min."""
    low, left = F.greatest("y", "y2"), F.least("x", "x2")
    seg = F.struct("seq", "x", "y", "x2", "y2")
    is_h, is_v = F.col("axis_kind") == "horizontal", F.col("axis_kind") == "vertical"
    return axes.groupBy("image_id").agg(
        F.max_by(seg, F.when(is_h, F.struct(low, -F.col("seq")))).alias("horizontal"),
        F.min_by(seg, F.when(is_v, F.struct(left, F.col("seq")))).alias("vertical"),
    )


def plot_area(df: DataFrame, width: int, height: int) -> DataFrame:
    """Largest box with 10%..95% of the canvas per image, else the canvas inset by a tenth."""
    size = F.col("w") * F.col("h")
    canvas = width * height
    box = F.when((size > canvas * 0.1) & (size < canvas * 0.95), F.struct("x", "y", "w", "h"))
    best = df.groupBy("image_id").agg(F.max_by(box, F.when(box.isNotNull(), F.struct(size, -F.col("seq")))).alias("b"))
    mx, my = int(width * 0.1), int(height * 0.1)
    default = {"x": mx, "y": my, "w": width - 2 * mx, "h": height - 2 * my}
    return best.select("image_id", *[F.coalesce(F.col(f"b.{k}"), F.lit(v)).alias(f"p{k}") for k, v in default.items()])


def legend_candidates(boxes: DataFrame, plots: DataFrame, width: int, height: int) -> DataFrame:
    """Small boxes of moderate aspect whose corner lies outside the plot area."""
    size = F.col("w") * F.col("h")
    inside = F.col("x").between(F.col("px"), F.col("px") + F.col("pw")) & F.col("y").between(F.col("py"), F.col("py") + F.col("ph"))
    shape = (F.col("w") / (F.col("h") + 1e-6)).between(0.5, 2.5)
    sized = (size >= 40) & (size <= width * height * 0.02)
    return boxes.filter(sized & shape).join(plots, "image_id").filter(~inside).drop("px", "py", "pw", "ph")


def outside_axes(boxes: DataFrame, axes: DataFrame) -> DataFrame:
    """Drop boxes covered by more than half by the padded zone of a main axis.

    Each image has at most two main axes, so the zones travel as two structs of one row and
    the anti join needs only the image key.
    """
    def covered(axis: str) -> Column:
        a = F.col(axis)
        left, top = F.least(a["x"], a["x2"]) - AXIS_MARGIN, F.least(a["y"], a["y2"]) - AXIS_MARGIN
        right = left + F.abs(a["x2"] - a["x"]) + 2 * AXIS_MARGIN
        bottom = top + F.abs(a["y2"] - a["y"]) + 2 * AXIS_MARGIN
        ox = F.greatest(F.lit(0), F.least(F.col("x") + F.col("w"), right) - F.greatest(F.col("x"), left))
        oy = F.greatest(F.lit(0), F.least(F.col("y") + F.col("h"), bottom) - F.greatest(F.col("y"), top))
        size = F.greatest(F.lit(1), F.col("w") * F.col("h"))
        return F.when(a.isNotNull(), ox * oy / size > AXIS_OVERLAP).otherwise(F.lit(False))

    joined = boxes.join(main_axes(axes), "image_id", "left")
    return joined.filter(~covered("horizontal") & ~covered("vertical")).drop("horizontal", "vertical")


def _reaching(df: DataFrame, radius: float, side: float) -> DataFrame:
    """One row per cell that comes within ``radius`` of a point in both directions: four if a cell is twice that wide."""
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side)))
    return df.withColumn("cx", cells("x")).withColumn("cy", cells("y"))


def nearest_distances(points: DataFrame, start: int = 8, growth: int = 8) -> DataFrame:
    """Distinct points (image_id, x, y, n copies) with the exact distance of the nearest other point.

    Copies have distance 0. The others look into the four cells, of twice the current reach, that they
    come near; a neighbour within that reach is certainly the nearest. Points without one try again with
    larger cells. Such points lie apart from everything by the previous side, so few of them share a cell and each
    round stays linear in the number of points. The only point of an image has no row.
    """
    merged = cut_lineage(points.groupBy("image_id", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    several = merged.groupBy("image_id").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("image_id")
    done = merged.filter("n > 1").withColumn("d2", F.lit(0).cast("bigint"))
    # images of two points or more: every point finds another one as soon as a cell is as wide as the image
    todo = merged.filter("n = 1").join(several, "image_id", "left_semi")
    side = start
    while not todo.isEmpty():
        cells = merged.select(
            "image_id", F.floor(F.col("x") / (2 * side)).alias("cx"), F.floor(F.col("y") / (2 * side)).alias("cy"), F.col("x").alias("ox"), F.col("y").alias("oy")
        )
        dx, dy = (F.col("x") - F.col("ox")).cast("bigint"), (F.col("y") - F.col("oy")).cast("bigint")
        d2 = dx * dx + dy * dy
        near = _reaching(todo, side, 2 * side).join(cells, ["image_id", "cx", "cy"]).filter(d2 > 0)
        found = near.groupBy("image_id", "x", "y").agg(F.min(d2).alias("d2"))
        sure = cut_lineage(todo.join(found, ["image_id", "x", "y"], "left").select("image_id", "x", "y", "n", "d2"))
        within = F.coalesce(F.col("d2") <= side * side, F.lit(False))
        done = done.unionByName(sure.filter(within))
        todo = sure.filter(~within).drop("d2")
        side *= growth
    return done.select("image_id", "x", "y", "n", F.sqrt(F.col("d2").cast("double")).alias("distance"))


def neighbour_density(points: DataFrame, width: int, height: int) -> DataFrame:
    """Per image with more than two points: mean nearest distance and 1 - min(1, mean/(diag/10))."""
    diag = (width**2 + height**2) ** 0.5
    total = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("_t")).filter("_t > 2").select("image_id")
    mean = nearest_distances(points.join(total, "image_id", "left_semi")).groupBy("image_id").agg(
        (F.sum(F.col("distance") * F.col("n")) / F.sum("n")).alias("mean_distance")
    )
    return mean.withColumn("density", 1 - F.least(F.lit(1.0), F.col("mean_distance") / (diag * 0.1)))


def clustering_share(points: DataFrame, eps: float) -> DataFrame:
    """Per image with more than two points: share of points with at least two others closer than ``eps``.

    In cells of diagonal below eps all points of a cell are neighbours, so cells with three or
    more are settled by counting. Only points of emptier cells are compared, in the four wider cells they come near.
    """
    side = max(1, int(eps / 2**0.5 - 1e-9))
    wide = 2 * eps
    merged = points.groupBy("image_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    merged = merged.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    cell = merged.groupBy("image_id", "cx", "cy").agg(F.sum("n").alias("cn"))
    known = merged.join(cell, ["image_id", "cx", "cy"])
    total = merged.groupBy("image_id").agg(F.sum("n").alias("points"))
    full = known.filter("cn >= 3").groupBy("image_id").agg(F.sum("n").alias("c"))
    sparse = known.filter("cn < 3").select("image_id", "x", "y", "n")
    cells = [F.floor(F.col(c) / wide).alias(f"c{c}") for c in ("x", "y")]
    other = merged.select("image_id", *cells, F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("n").alias("on"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    near = (
        _reaching(sparse, eps, wide).join(other, ["image_id", "cx", "cy"])
        .filter(F.sqrt((dx * dx + dy * dy).cast("double")) < eps)
        .groupBy("image_id", "x", "y", "n").agg((F.sum("on") - 1).alias("near"))
    )
    rest = near.filter("near >= 2").groupBy("image_id").agg(F.sum("n").alias("c"))
    hits = full.unionByName(rest).groupBy("image_id").agg(F.sum("c").alias("c"))
    return total.filter("points > 2").join(hits, "image_id", "left").select(
        "image_id", (F.coalesce("c", F.lit(0)) / F.col("points")).alias("clustering")
    )


def pseudo_labels(df: DataFrame, width: int, height: int) -> DataFrame:
    """Training boxes of the seven element classes: class_id, clipped box and centre-form text."""
    c = F.col
    sides = ("x1", "y1", "x2", "y2")
    area_box = clip_box([c("x"), c("y"), c("x") + c("w"), c("y") + c("h")], width, height)
    point_box = clip_box([c("x") - 5, c("y") - 5, c("x") + 5, c("y") + 5], width, height)
    segment = [c("x"), c("y"), c("x2"), c("y2")]
    by_kind = {"point": point_box, "line": line_box(segment, width, height, 6), "axis": line_box(segment, width, height, 8)}

    def side(i: int) -> Column:
        out = F
        for kind, box in by_kind.items():
            out = out.when(c("kind") == kind, box[i])
        return out.otherwise(area_box[i])

    ids = F.create_map(*[F.lit(v) for k, name in KIND_CLASS.items() for v in (k, ELEMENT_CLASSES.index(name))])
    boxed = df.select("image_id", "seq", F.try_element_at(ids, c("kind")).alias("class_id"), *[side(i).alias(n) for i, n in enumerate(sides)])
    return boxed.withColumn("line", centre_form(c("class_id"), [c(n) for n in sides], width, height))
