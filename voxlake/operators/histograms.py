"""Two-dimensional histograms of voxel values."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.pointwise import lower_cell, radius, value_bin
from voxlake.functions.volume import Shape


def _binned(volume: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    inside = volume.where((F.col("v") != 0) & F.col("v").between(low, high))
    return inside.withColumn("bin", value_bin(F.col("v"), low, high, bins))


def axis_histogram(volume: DataFrame, axis: str, low: float, high: float, bins: int, center: tuple[int, int] = (0, 0), most_radius: int | None = None, offset_z: int = 0) -> DataFrame:
    """(axis, pos, bin, n) along ``z``, ``y``, ``x`` or ``r`` (radius around ``center``).

    Zero, null and out-of-range voxels don't count; nor do radii of ``most_radius`` or more."""
    pos = {"z": F.col("z") + offset_z, "y": F.col("y"), "x": F.col("x"), "r": radius(F.col("y"), F.col("x"), *center)}[axis]
    out = _binned(volume, low, high, bins).withColumn("pos", pos)
    if axis == "r" and most_radius is not None:
        out = out.where(F.col("pos") < most_radius)
    return out.groupBy(F.lit(axis).alias("axis"), "pos", "bin").agg(F.count(F.lit(1)).alias("n"))


def axis_histograms(volume: DataFrame, low: float, high: float, bins: int, center: tuple[int, int], most_radius: int | None = None, offset_z: int = 0) -> DataFrame:
    """All four axes in one scan: grouping sets over (position, bin)."""
    b = _binned(volume, low, high, bins).select((F.col("z") + offset_z).alias("z"), "y", "x", radius(F.col("y"), F.col("x"), *center).alias("r"), "bin")
    if most_radius is not None:
        b = b.withColumn("r", F.when(F.col("r") < most_radius, F.col("r")))
    sets = [[F.col(a), F.col("bin")] for a in ("z", "y", "x", "r")]
    g = b.groupingSets(sets, "z", "y", "x", "r", "bin").agg(F.count(F.lit(1)).alias("n"), *(F.grouping(a).alias(f"g{a}") for a in ("z", "y", "x", "r")))
    axis = reduce(lambda acc, a: F.when(F.col(f"g{a}") == 0, F.lit(a)).otherwise(acc), ("z", "y", "x", "r"), F.lit(None).cast("string"))
    pos = reduce(lambda acc, a: F.when(F.col(f"g{a}") == 0, F.col(a)).otherwise(acc), ("z", "y", "x", "r"), F.lit(None).cast("long"))
    return g.select(axis.alias("axis"), pos.alias("pos"), "bin", "n").where("pos is not null")


def add_histograms(*parts: DataFrame, keys: tuple[str, ...] = ("axis", "pos", "bin")) -> DataFrame:
    """Counts add up: histograms of parts make the histogram of the whole."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("n").cast("long").alias("n"))


def field_histogram(volume: DataFrame, shape: Shape, field: DataFrame, field_shape: Shape, bins: int, low: float, high: float, field_low: float, field_high: float) -> DataFrame:
    """(fbin, vbin, n): joint counts of voxel values and of the coarser field at their place.

    ``field`` is (z, y, x, f).  Zeros and values out of range, on either side, don't count."""
    cells = field.where((F.col("f") > 0) & F.col("f").between(field_low, field_high)).select(*(F.col(a).alias(f"f{a}") for a in ("z", "y", "x")), value_bin(F.col("f"), field_low, field_high, bins).alias("fbin"))
    placed = _binned(volume, low, high, bins)
    for a in ("z", "y", "x"):
        placed = placed.withColumn(f"f{a}", lower_cell(F.col(a), field_shape.of(a), shape.of(a)))
    # counts by cell first: the join then carries a row for each cell and bin
    counted = placed.groupBy("fz", "fy", "fx", F.col("bin").alias("vbin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(cells, ["fz", "fy", "fx"]).groupBy("fbin", "vbin").agg(F.sum("n").cast("long").alias("n"))


# ---- packed bricks: counts of a brick meet, not its voxels ----------------------------------


def _bins_of(v: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    return np.floor((bins - 1) * ((v.astype(float) - low) / (high - low))).astype(np.int64)


def _counted(packed: DataFrame, names: list[str], found) -> DataFrame:  # noqa: ANN001
    """Rows (``names``, n) from ``found(row, z, y, x, v)``, the counts of a brick's voxels but zeros;
    equal rows of a batch of bricks meet in the task, those of tasks in a sum."""
    schema = pa.schema([*((n, pa.int64()) for n in names), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = np.frombuffer(row["data"], "<i8").reshape(row["nz"], row["ny"], row["nx"])
                z, y, x = np.nonzero(block)
                keys = found(z + row["z0"], y + row["y0"], x + row["x0"], block[z, y, x])
                distinct, n = np.unique(keys, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in distinct), pa.array(n)], schema=schema)

    counts = packed.mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))
    return counts.groupBy(*names).agg(F.sum("n").alias("n"))


def packed_histograms(packed: DataFrame, low: float, high: float, bins: int, center: tuple[int, int], most_radius: int | None = None, offset_z: int = 0) -> DataFrame:
    """``axis_histograms`` of packed bricks of 64-bit values: (axis, pos, bin, n)."""
    if high <= low:
        raise ValueError("the value range is empty")
    axes = ("z", "y", "x", "r")

    def found(z: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        inside = (v >= low) & (v <= high)
        z, y, x, b = z[inside], y[inside], x[inside], _bins_of(v[inside], low, high, bins)
        dy, dx = y - center[0], x - center[1]
        r = np.floor(np.sqrt((dy * dy + dx * dx).astype(float))).astype(np.int64)
        near = np.ones(len(r), bool) if most_radius is None else r < most_radius
        parts = [np.stack((np.full(len(p), k), p, c)) for k, (p, c) in enumerate(((z + offset_z, b), (y, b), (x, b), (r[near], b[near])))]
        return np.concatenate(parts, axis=1)

    counts = _counted(packed, ["axis", "pos", "bin"], found)
    return counts.withColumn("axis", F.element_at(F.array(*(F.lit(a) for a in axes)), (F.col("axis") + 1).cast("int")))


def packed_field_histogram(packed: DataFrame, shape: Shape, field: DataFrame, field_shape: Shape, bins: int, low: float, high: float, field_low: float, field_high: float) -> DataFrame:
    """``field_histogram`` of packed bricks: counts by coarse cell and bin meet the field's cells."""
    if high <= low:
        raise ValueError("the value range is empty")
    sides = [(field_shape.of(a) / shape.of(a)) for a in ("z", "y", "x")]

    def found(z: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        inside = (v >= low) & (v <= high)
        cells = [np.floor(c[inside] * s).astype(np.int64) for c, s in zip((z, y, x), sides, strict=True)]
        return np.stack((*cells, _bins_of(v[inside], low, high, bins)))

    cells = field.where((F.col("f") > 0) & F.col("f").between(field_low, field_high)).select(*(F.col(a).alias(f"f{a}") for a in ("z", "y", "x")), value_bin(F.col("f"), field_low, field_high, bins).alias("fbin"))
    counted = _counted(packed, ["fz", "fy", "fx", "vbin"], found)
    return counted.join(cells, ["fz", "fy", "fx"]).groupBy("fbin", "vbin").agg(F.sum("n").cast("long").alias("n"))
