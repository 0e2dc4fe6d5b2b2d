"""Column functions for resize plans and boxes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glyphflow.schemas import BBOX, POLYGON

BOX_POINTS = 4


def plan_resize(width: Column, height: Column, max_pixels: int) -> Column:
    """struct<was_resized, width, height>: dimensions scaled down to at most `max_pixels`."""
    w, h = width.cast("bigint"), height.cast("bigint")
    scale = F.pow(F.lit(float(max_pixels)) / F.nullif(w * h, F.lit(0)), F.lit(0.5))
    too_big = F.coalesce(w * h > max_pixels, F.lit(False))
    return F.struct(
        too_big.alias("was_resized"),
        F.when(too_big, F.floor(w * scale)).otherwise(w).alias("width"),
        F.when(too_big, F.floor(h * scale)).otherwise(h).alias("height"),
    )


def has_box(polygon: Column) -> Column:
    return F.coalesce(F.size(polygon) >= BOX_POINTS, F.lit(False))


def axis_values(polygon: Column, axis: int) -> Column:
    """All x (axis 0) or y (axis 1) values of a polygon of four or more points, else null."""
    return F.when(has_box(polygon), F.transform(polygon, lambda p: F.get(p, F.lit(axis))))


def _extent(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corners = {"x0": x0, "y0": y0, "x1": x1, "y1": y1}
    return F.struct(*[F.coalesce(c, F.lit(0.0)).alias(name) for name, c in corners.items()])


def extent_of_axes(xs: Column, ys: Column) -> Column:
    """struct<x0, y0, x1, y1> of axis values, zeros without them: the shortest form inside a lambda."""
    return _extent(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def extent(polygon: Column) -> Column:
    """struct<x0, y0, x1, y1> around a polygon column of four or more points, else zeros.

    Recognisers return quadrilaterals: four points are compared directly, which
    stays in generated code; only longer polygons are walked as arrays.
    """
    n = F.size(polygon)

    def bound(axis: int, of_four, of_many) -> Column:
        four = [F.get(F.get(polygon, F.lit(i)), F.lit(axis)) for i in range(BOX_POINTS)]
        return F.when(n == BOX_POINTS, of_four(*four)).when(n > BOX_POINTS, of_many(axis_values(polygon, axis)))

    return _extent(
        bound(0, F.least, F.array_min), bound(1, F.least, F.array_min),
        bound(0, F.greatest, F.array_max), bound(1, F.greatest, F.array_max),
    )


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.array(x0, y0).alias("top_left"), F.array(x1, y1).alias("bottom_right")).cast(BBOX)


def bbox_of_extent(e: Column) -> Column:
    return _box(e["x0"], e["y0"], e["x1"], e["y1"])


def normalised_bbox(e: Column, width: Column, height: Column) -> Column:
    """The box in shares of the image size.

    Zeros stay zeros for images of any size; any other value is null for a zero size.
    """
    def share(value: Column, size: Column) -> Column:
        return F.when(value == 0.0, F.lit(0.0)).otherwise(F.try_divide(value, size.cast("double")))

    return _box(share(e["x0"], width), share(e["y0"], height), share(e["x1"], width), share(e["y1"], height))


def polygon_or_empty(polygon: Column, include_polygon: Column) -> Column:
    """The polygon when it is wanted and has a box, else an empty list."""
    return F.when(include_polygon & has_box(polygon), polygon).otherwise(F.array().cast(POLYGON))
