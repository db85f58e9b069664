"""The synthetic mask volume: a shell, a cube, nested bars and a lone bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.volume import Shape, coordinates

UNIT = 4  # voxels
# Half-open boxes (z, y, x) around the centre in units; y None is the middle plane.
BOXES = [
    ((-1, 1), (-1, 1), (-1, 1)),
    ((-3, -2), None, (-3, 3)),
    ((-3, 2), None, (-3, -2)),
    ((-3, 2), None, (2, 3)),
    ((-6, 6), None, (-5, -4)),
    ((-6, 6), None, (4, 5)),
    ((5, 6), None, (-5, -2)),
    ((5, 6), None, (2, 5)),
    ((3, 6), None, (-3, -2)),
    ((3, 6), None, (2, 3)),
    ((3, 4), None, (-3, 3)),
    ((-6, -5), None, (-3, 3)),
]


def synthetic_mask(spark: SparkSession, n: int) -> DataFrame:
    """(z, y, x, v): 255 in the figures, else 0, on a cube of ``n`` voxels a side (even, >= 64)."""
    half = n // 2

    def within(axis: str, side: tuple[int, int] | None) -> Column:
        if side is None:
            return F.col(axis) == half
        return (F.col(axis) >= half + UNIT * side[0]) & (F.col(axis) < half + UNIT * side[1])

    hit = F.lit(False)
    for a in ("z", "y", "x"):
        hit |= F.col(a).isin(0, n - 1)
    for z, y, x in BOXES:
        hit |= within("z", z) & within("y", y) & within("x", x)
    cube = spark.range(n**3).select(*coordinates(F.col("id"), Shape(n, n, n)))
    return cube.withColumn("v", F.when(hit, 255).otherwise(0))
