"""Conversions of single voxels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binarize(v: Column) -> Column:
    """1.0 where positive, else 0.0 (null counts as 0)."""
    return F.when(v > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def quantize(u: Column) -> Column:
    """Grey level 0..255: truncated ``u * 255``, clipped."""
    return F.least(F.greatest(F.floor(u * 255.0), F.lit(0)), F.lit(255)).cast("smallint")


def is_source(u: Column) -> Column:
    """Voxels that are exactly 1.0 hold their value."""
    return u == 1.0


def illuminate(u: Column, mask: Column) -> Column:
    return F.when(mask, F.lit(1.0)).otherwise(u)


def value_bin(v: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value in the closed range: ``floor((bins - 1) * (v - low) / (high - low))``."""
    if high <= low:
        raise ValueError("the value range is empty")
    return F.floor(F.lit(float(bins - 1)) * ((v.cast("double") - F.lit(float(low))) / F.lit(float(high - low)))).cast("long")


def radius(y: Column, x: Column, center_y: int, center_x: int) -> Column:
    """Whole distance from a centre in the plane."""
    dy, dx = y - center_y, x - center_x
    return F.floor(F.sqrt((dy * dy + dx * dx).cast("double"))).cast("long")


def lower_cell(c: Column, coarse: int, fine: int) -> Column:
    """Cell of a coarser grid that holds a fine coordinate."""
    return F.floor(c.cast("double") * F.lit(coarse / fine)).cast("long")
