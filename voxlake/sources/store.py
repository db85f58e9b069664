"""A volume kept as packed bricks in Parquet, one partition folder a brick.

A box is read from the bricks that it meets, a slab or any set of voxels is written by replacing the
bricks that it touches; all other folders stay as they are.  Works on any file system of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.shared import materialise, shuffle_partitions
from voxlake.functions.volume import AXES, Shape, in_box
from voxlake.operators.bricks import _PACKED, PACKED, PLACE, _out, _rows, pack_values


def write_store(packed: DataFrame, path: str) -> None:
    """Make a store of packed bricks, or replace those bricks of one that is there.

    ``packed`` must not come from the store itself: write it to the shared folder before."""
    dealt = packed.repartition(shuffle_partitions(packed.sparkSession), *PLACE).sortWithinPartitions(*PLACE)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)


def _bricks(spark: SparkSession, path: str) -> DataFrame:
    """All bricks of a store; the partition columns come from the folders' names."""
    return spark.read.schema(PACKED).parquet(path).select(*_PACKED.names)


def _meets(low: Shape, high: Shape, brick: Shape) -> Column:
    """Of a brick's place: whether it meets the box.  Only partition columns, so that folders are
    left out before anything is read."""
    out = F.lit(True)
    for a, p in zip(AXES, PLACE, strict=True):
        out &= (F.col(p) > low.of(a) - brick.of(a)) & (F.col(p) < high.of(a))
    return out


def read_store(spark: SparkSession, path: str, low: Shape, high: Shape, brick: Shape) -> DataFrame:
    """(z, y, x, v) of the voxels other than 0 in a half-open box."""
    schema = pa.schema([(n, pa.int64()) for n in (*AXES, "v")])
    box = [(low.of(a), high.of(a)) for a in AXES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _rows(batch, "<i8"):
                cut = [(max(a - row[p], 0), max(min(b - row[p], n), 0)) for (a, b), p, n in zip(box, PLACE, block.shape, strict=True)]
                part = block[tuple(slice(a, b) for a, b in cut)]
                at = np.nonzero(part)
                yield pa.RecordBatch.from_arrays([*(pa.array(k + a + row[p]) for k, (a, _), p in zip(at, cut, PLACE, strict=True)), pa.array(part[at])], schema=schema)

    return _bricks(spark, path).where(_meets(low, high, brick)).mapInArrow(run, "z long, y long, x long, v long")


def update_store(volume: DataFrame, path: str, shape: Shape, brick: Shape) -> None:
    """Write voxels (z, y, x, v) into a store; all others stay, and so do the folders of bricks that
    hold none of them.

    New bricks are made where voxels lie outside those that exist.  The bricks are whole in the
    shared folder before the store is touched: ``volume`` may come from the store, and running it
    again gives the same store."""
    spark = volume.sparkSession
    rows = materialise(volume.where(in_box(Shape(0, 0, 0), shape)).select(*AXES, F.coalesce(F.col("v").cast("long"), F.lit(0)).alias("v")), "store-update")
    place = [F.expr(f"{a} div {brick.of(a)} * {brick.of(a)}").alias(p) for a, p in zip(AXES, PLACE, strict=True)]
    ends = rows.agg(*(f(a).alias(f"{n}{a}") for a in AXES for f, n in ((F.min, "low"), (F.max, "high")))).first()
    if ends["lowz"] is None:
        return
    low, high = (Shape(*(ends[f"{n}{a}"] + k for a in AXES)) for n, k in (("low", 0), ("high", 1)))
    near = _bricks(spark, path).where(_meets(low, high, brick))

    def patch(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows:
            return pa.Table.from_batches([], schema=_PACKED)
        start = [k.as_py() for k in key]
        size = [min(brick.of(a), shape.of(a) - b) for a, b in zip(AXES, start, strict=True)]
        chunk = (start[0] // brick.z << 40) + (start[1] // brick.y << 20) + start[2] // brick.x
        block = np.zeros(size, "<i8")
        for _, had in _rows(old, "<i8"):
            block[:] = had
        block[tuple(new.column(a).to_numpy() - b for a, b in zip(AXES, start, strict=True))] = new.column("v").to_numpy()
        return pa.Table.from_batches([_out([dict(zip(_PACKED.names, (chunk, *start, *size, block.tobytes()), strict=True))])])

    made = near.groupBy(*PLACE).cogroup(rows.select(*place, *AXES, "v").groupBy(*PLACE)).applyInArrow(patch, PACKED)
    write_store(materialise(made, "store-bricks"), path)


def store_volume(volume: DataFrame, path: str, shape: Shape, brick: Shape) -> None:
    """Make a store of (z, y, x, v)."""
    write_store(pack_values(volume, shape, brick), path)
