"""Boxes: structs of x0, y0, x1, y1 with x0 <= x1 and y0 <= y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box; null where the corners are out of order."""
    parts = [c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))]
    return F.when((x0 <= x1) & (y0 <= y1), F.struct(*parts))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def intersection(a: Column, b: Column) -> Column:
    """The common box; null if there is none, touching edges included, or if one is null."""
    low = [F.greatest(a[c], b[c]) for c in ("x0", "y0")]
    high = [F.least(a[c], b[c]) for c in ("x1", "y1")]
    common = F.struct(*(c.alias(n) for c, n in zip((*low, *high), ("x0", "y0", "x1", "y1"))))
    return F.when(a.isNotNull() & b.isNotNull() & (low[0] < high[0]) & (low[1] < high[1]), common)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes apart or without area."""
    common = F.coalesce(area(intersection(a, b)), F.lit(0.0))
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).when(union.isNotNull(), 0.0)


def scaled(b: Column, page_width: Column, page_height: Column) -> Column:
    """The box in shares of the page; null for a page without extent."""
    sides = {"x0": page_width, "y0": page_height, "x1": page_width, "y1": page_height}
    return F.when((page_width > 0) & (page_height > 0), F.struct(*((b[c] / s).alias(c) for c, s in sides.items())))
