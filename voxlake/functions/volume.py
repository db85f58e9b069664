"""Volumes as DataFrames (z, y, x, v): coordinates, dense grids, slices, ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.shared import materialise, shuffle_partitions

AXES = ("z", "y", "x")


@dataclass(frozen=True)
class Shape:
    z: int
    y: int
    x: int

    @property
    def size(self) -> int:
        return self.z * self.y * self.x

    def of(self, axis: str) -> int:
        return getattr(self, axis)

    def bricks(self, brick: Shape) -> Shape:
        """How many bricks lie along each axis; the last ones may be smaller."""
        return Shape(*(-(-self.of(a) // brick.of(a)) for a in AXES))


def coordinates(flat: Column, shape: Shape) -> list[Column]:
    """z, y, x of a row-major index."""
    return [
        F.floor(flat / F.lit(shape.y * shape.x)).cast("long").alias("z"),
        (F.floor(flat / F.lit(shape.x)).cast("long") % shape.y).alias("y"),
        (flat % shape.x).alias("x"),
    ]


def flat_index(shape: Shape) -> Column:
    """Row-major index of z, y, x."""
    return (F.col("z") * shape.y + F.col("y")) * shape.x + F.col("x")


def in_box(low: Shape, high: Shape) -> Column:
    """Half-open box."""
    out = F.lit(True)
    for a in AXES:
        out &= (F.col(a) >= low.of(a)) & (F.col(a) < high.of(a))
    return out


def densify(volume: DataFrame, shape: Shape, value: str = "v") -> DataFrame:
    """Every voxel of ``shape``; those that ``volume`` lacks are 0.  Voxels outside are left out."""
    grid = volume.sparkSession.range(shape.size).select(*coordinates(F.col("id"), shape))
    filled = grid.join(volume.select(*AXES, value), list(AXES), "left")
    return filled.withColumn(value, F.coalesce(value, F.lit(0).cast(volume.schema[value].dataType)))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in ascending order of ``order``, without gathering the rows.

    Rows are range-partitioned and sorted; only the partitions' row counts meet."""
    spark = df.sparkSession
    placed = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    kept = materialise(placed.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33).alias("_part")
    counts = kept.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    out = kept.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_id") - F.shiftleft(F.col("_part"), 33) + 1).cast("long")).drop("_id", "_part", "_before")
