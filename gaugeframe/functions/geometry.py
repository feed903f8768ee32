"""Boxes and centres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_center(points: Column) -> Column:
    """Mean corner of an ``ARRAY<ARRAY<DOUBLE>>`` polygon as ``STRUCT<x,y>``."""

    def mean(i: int) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(i))) / F.size(points)

    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


def overlap_share(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection of two boxes over the area of the first (at least 1)."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return width * height / F.greatest(F.lit(1.0), (a[2] - a[0]) * (a[3] - a[1]))


def expand_box(box: tuple[Column, ...], width: Column, height: Column, share: float = 0.18) -> tuple[Column, ...]:
    """Grow a box by a whole-pixel share of its size, clipped to the canvas."""
    dx = F.floor((box[2] - box[0]) * share)
    dy = F.floor((box[3] - box[1]) * share)
    zero = F.lit(0)
    return (
        F.greatest(zero, box[0] - dx), F.greatest(zero, box[1] - dy),
        F.least(width, box[2] + dx), F.least(height, box[3] + dy),
    )
