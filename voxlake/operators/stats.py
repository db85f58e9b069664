"""Summary and comparison statistics of volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.volume import AXES


def mean_stddev(volume: DataFrame, value: str = "v") -> DataFrame:
    """One row (mean, stddev): population standard deviation.  Null on an empty volume."""
    return volume.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))


def difference_stats(a: DataFrame, b: DataFrame, value: str = "v") -> DataFrame:
    """One row (mean, max, min, stddev) of the absolute difference; absent voxels are 0."""
    both = a.select(*AXES, F.col(value).alias("_a")).join(b.select(*AXES, F.col(value).alias("_b")), list(AXES), "full")
    d = F.abs(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)))
    return both.select(d.alias("d")).agg(F.avg("d").alias("mean"), F.max("d").alias("max"), F.min("d").alias("min"), F.stddev_pop("d").alias("stddev"))


def value_check(volume: DataFrame, value: str = "v") -> DataFrame:
    """One row (max, all_zero)."""
    return volume.agg(F.max(value).alias("max"), F.bool_and(F.col(value) == 0).alias("all_zero"))


def names_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(z, y, x, size, side): names with sizes that only one of two components tables holds."""
    cols = [*AXES, "size"]
    left, right = a.select(*cols), b.select(*cols)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
