"""Boxes as four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(c: Column) -> Column:
    """A layout coordinate 0..1000 as a single-precision fraction."""
    return (c.cast("double") / 1000).cast("float")


def points(fraction: Column, size: Column) -> Column:
    return F.floor(fraction.cast("double") * size).cast("long")


def thousandths(c: Column, size: Column) -> Column:
    return ((c * 1000 - F.pmod(c * 1000, size.cast("long"))) / size.cast("long")).cast("long")


def overlap(a: list[Column], b: list[Column]) -> Column:
    """The part of box a that box b covers."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = F.greatest(a[2] - a[0], F.lit(1)) * F.greatest(a[3] - a[1], F.lit(1))
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise((w * h).cast("double") / area)


def distance(a: list[Column], b: list[Column]) -> Column:
    """Sum of the gaps of two boxes in both directions."""
    zero = F.lit(0).cast("long")
    dx = F.greatest(b[0] - a[2], a[0] - b[2], zero)
    dy = F.greatest(b[1] - a[3], a[1] - b[3], zero)
    return dx + dy
