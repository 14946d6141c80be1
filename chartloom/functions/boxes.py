"""Box and shape arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]  # x1, y1, x2, y2


def polygon_box(points: Column) -> Column:
    """Enclosing box of an array of [x, y] points, truncated to integers."""
    xs = F.transform(points, lambda p: p[0])
    ys = F.transform(points, lambda p: p[1])
    return F.struct(
        F.array_min(xs).cast("int").alias("x1"),
        F.array_min(ys).cast("int").alias("y1"),
        F.array_max(xs).cast("int").alias("x2"),
        F.array_max(ys).cast("int").alias("y2"),
    )


def intersection(a: Box, b: Box) -> Column:
    wide = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return wide.cast("bigint") * high


def _area(b: Box) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), (b[2] - b[0]).cast("bigint") * (b[3] - b[1]))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; areas are at least 1, disjoint boxes give 0."""
    shared = intersection(a, b)
    return F.when(shared > 0, shared.cast("double") / (_area(a) + _area(b) - shared)).otherwise(F.lit(0.0))


def clip_box(box: Box, width: int, height: int) -> list[Column]:
    """Clip to the canvas; an empty side becomes one pixel."""
    lim = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top - 1), v)).cast("int")
    x1, y1, x2, y2 = lim(box[0], width), lim(box[1], height), lim(box[2], width), lim(box[3], height)
    x2 = F.when(x2 <= x1, F.least(F.lit(width - 1), x1 + 1)).otherwise(x2)
    y2 = F.when(y2 <= y1, F.least(F.lit(height - 1), y1 + 1)).otherwise(y2)
    return [x1, y1, x2, y2]


def line_box(line: Box, width: int, height: int, thickness: int = 6) -> list[Column]:
    """Padded and clipped box around a segment."""
    x1, y1, x2, y2 = line
    return clip_box(
        [F.least(x1, x2) - thickness, F.least(y1, y2) - thickness, F.greatest(x1, x2) + thickness, F.greatest(y1, y2) + thickness],
        width,
        height,
    )


def centre_form(class_id: Column, box: Box, width: int, height: int) -> Column:
    """'class cx cy w h' with sizes relative to the canvas and six decimals."""
    return F.format_string(
        "%d %.6f %.6f %.6f %.6f",
        class_id,
        F.bround((box[0] + box[2]) / 2 / width, 6),
        F.bround((box[1] + box[3]) / 2 / height, 6),
        F.bround((box[2] - box[0]) / F.lit(width), 6),
        F.bround((box[3] - box[1]) / F.lit(height), 6),
    )


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter)).otherwise(F.lit(0.0))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))
