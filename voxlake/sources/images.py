"""Planes of volumes as grey-level rows and images."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.volume import Shape


def plane(volume: DataFrame, axis: str, at: int) -> DataFrame:
    return volume.where(F.col(axis) == at)


def middle_planes(volume: DataFrame, shape: Shape, value: str = "v") -> DataFrame:
    """(plane, r, c, v): the planes in the middle of each axis, in one scan."""
    sides = [("z", "y", "x"), ("y", "z", "x"), ("x", "z", "y")]
    cut = F.filter(
        F.array(*(F.when(F.col(a) == shape.of(a) // 2, F.struct(F.lit(a).alias("plane"), F.col(r).alias("r"), F.col(c).alias("c"), F.col(value).alias(value))) for a, r, c in sides)),
        lambda s: s.isNotNull(),
    )
    return volume.select(F.explode(cut).alias("s")).select("s.*")


def pgm_rows(image: DataFrame, level: Column, row: str = "r", column: str = "c") -> DataFrame:
    """(row, line): the grey levels ``trunc(v * 255)`` of each row, by column."""
    grey = F.floor(level * 255.0).cast("long")
    cells = F.sort_array(F.collect_list(F.struct(F.col(column).alias("c"), grey.alias("g"))))
    return image.groupBy(F.col(row).alias("row")).agg(F.concat_ws(" ", F.transform(cells, lambda s: s["g"].cast("string"))).alias("line"))


def write_pgm(rows: DataFrame, folder: str, width: int, height: int) -> None:
    """An ASCII ``P2`` image as ordered text parts in ``folder``; parts in name order make the file."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(-1, f"P2\n{width} {height}\n255")], "row long, line string")
    head.unionByName(rows.select(F.col("row").cast("long"), "line")).repartitionByRange("row").sortWithinPartitions("row").select("line").write.text(folder)


def write_png(image: DataFrame, path: str, width: int, height: int, row: str = "r", column: str = "c", value: str = "v") -> None:
    """Grey levels (row, column, value 0..255) as one PNG file in a folder that executors share.

    Rows are packed by the tasks that hold them and stream, in order, through the task that
    compresses them: it holds a row at a time.  Pixels that the table lacks are 0, ones outside the
    image are left out; the file appears under its name when it is whole."""
    at = path.removeprefix("file://")

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(width, np.uint8)
        line[rows["c"].to_numpy()] = rows["v"].clip(0, 255).to_numpy().astype(np.uint8)
        return pd.DataFrame({"r": [int(key[0])], "line": [line.tobytes()]})

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = f"{at}.{uuid.uuid4().hex}.part", 0
        squeeze = zlib.compressobj()
        with open(part, "wb") as f:

            def chunk(kind: bytes, data: bytes) -> None:
                f.write(struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data)))

            f.write(b"\x89PNG\r\n\x1a\n")
            chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))  # 8-bit grey
            for rows in parts:
                for r, line in zip(rows["r"], rows["line"], strict=True):
                    for data in (*(bytes(width) for _ in range(int(r) - n)), line):
                        if out := squeeze.compress(b"\0" + data):
                            chunk(b"IDAT", out)
                    n = int(r) + 1
            for _ in range(height - n):
                if out := squeeze.compress(bytes(width + 1)):
                    chunk(b"IDAT", out)
            chunk(b"IDAT", squeeze.flush())
            chunk(b"IEND", b"")
        os.replace(part, at)
        yield pd.DataFrame({"n": [height]})

    inside = image.where(F.col(row).between(0, height - 1) & F.col(column).between(0, width - 1)).select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).alias("v"))
    lines = inside.groupBy("r").applyInPandas(packed, "r long, line binary")
    lines.orderBy("r").coalesce(1).mapInPandas(put, "n long").collect()  # one row


def side_by_side(planes: DataFrame, shape: Shape) -> DataFrame:
    """(r, c, v): the middle planes z, y and x of a cube next to each other."""
    at = F.when(F.col("plane") == "z", 0).when(F.col("plane") == "y", shape.x).otherwise(2 * shape.x)
    return planes.select("r", (F.col("c") + at).alias("c"), "v")


def plot_middle_planes(volume: DataFrame, shape: Shape, path: str, value: str = "v") -> list[str]:
    """PNG files of the middle planes: one for a cube, side by side, else ``path`` with ``_z``,
    ``_y`` and ``_x`` before its ending.  Values are grey levels 0..255."""
    planes = middle_planes(volume, shape, value).withColumnRenamed(value, "v")
    if shape.z == shape.y == shape.x:
        write_png(side_by_side(planes, shape), path, 3 * shape.x, shape.y)
        return [path]
    stem, dot, end = path.rpartition(".")
    sizes = {"z": (shape.x, shape.y), "y": (shape.x, shape.z), "x": (shape.y, shape.z)}
    out = []
    for axis, (width, height) in sizes.items():
        out.append(f"{stem}_{axis}{dot}{end}" if dot else f"{path}_{axis}")
        write_png(planes.where(F.col("plane") == axis), out[-1], width, height)
    return out
