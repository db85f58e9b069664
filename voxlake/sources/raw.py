"""Headerless raw volumes: C-order scalars, z slowest.

``raw_volume`` is a Spark data source with the options ``path``, ``shape`` ("z,y,x") and ``dtype``.

Reading gives (z, y, x, v) of the half-open box from ``low`` to ``high`` ("z,y,x" each, the whole
volume without them): only its planes are planned and only its byte ranges are read.  Each input
partition covers ``planes`` planes, in batches of bounded size.  A missing file or one too short is
an error.  Filters of a query are not pushed into the source: Spark 4.1.2 keeps what one query
has pushed for the other queries on the same DataFrame, which then lack rows.

Writing takes (z, y, x, v) in any order.  ``overwrite`` fills a new file beside the old one and
puts it in its place when all tasks are done; a job that fails leaves the old one as it was.
``append`` writes voxels into the file that is there, all others stay; running it again gives the
same file.  Tasks write byte ranges at their places, so one that runs twice does no harm.

Files lie in a folder that all executors mount; ``read_lines`` reads from any file system of Spark.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from voxlake.functions.shared import materialise, shuffle_partitions
from voxlake.functions.volume import AXES, Shape, in_box
from voxlake.operators.bricks import PACKED, PLACE, _out
from voxlake.operators.diffusion import BRICKS, KEY, all_bricks, box_of

# Element types, with the Spark type that holds their values.
DTYPES = {"uint8": ("<u1", "int"), "uint16": ("<u2", "int"), "int64": ("<i8", "long"), "float32": ("<f4", "float")}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32()}
MOST_VOXELS = 1 << 18  # of a batch of rows


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _read_at(file: int, kind: str, count: int, offset: int) -> np.ndarray:
    """``count`` elements from element ``offset`` on; fewer at the end of the file."""
    width = np.dtype(kind).itemsize
    return np.frombuffer(os.pread(file, count * width, offset * width), kind)


def read_box(file: int, kind: str, low: list[int], size: list[int], plane: tuple[int, int]) -> np.ndarray:
    """A box of a file with ``plane`` (lines, elements of a line): whole lines in one range a plane."""
    ny, nx = plane
    block = np.empty(size, kind)
    for k in range(size[0]):
        at = ((low[0] + k) * ny + low[1]) * nx + low[2]
        if size[2] == nx:
            block[k] = _read_at(file, kind, size[1] * nx, at).reshape(size[1], nx)
        else:
            for j in range(size[1]):
                block[k, j] = _read_at(file, kind, size[2], at + j * nx)
    return block


def _write_at(file: int, values: np.ndarray, offset: int) -> None:
    raw, at = memoryview(np.ascontiguousarray(values)).cast("B"), offset * values.itemsize
    while len(raw):
        n = os.pwrite(file, raw, at)
        raw, at = raw[n:], at + n


@dataclass
class _Volume:
    """What the options say."""

    path: str
    shape: Shape
    kind: str
    spark_type: str

    @classmethod
    def of(cls, options: dict) -> _Volume:
        return cls(_local(options["path"]), Shape(*(int(k) for k in options["shape"].split(","))), *DTYPES[options.get("dtype", "uint8")])

    @property
    def bytes(self) -> int:
        return self.shape.size * np.dtype(self.kind).itemsize


class _Planes(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.of = _Volume.of(options)
        ends = [[int(k) for k in options[name].split(",")] if name in options else None for name in ("low", "high")]
        low, high = ends[0] or [0, 0, 0], ends[1] or [self.of.shape.of(a) for a in AXES]
        self.box = {a: (max(lo, 0), min(hi, self.of.shape.of(a))) for a, lo, hi in zip(AXES, low, high, strict=True)}
        self.planes = int(options.get("planes", 16))

    def partitions(self) -> list[InputPartition]:
        (low, high), (y0, y1), (x0, x1) = (self.box[a] for a in AXES)
        return [_Planes(a, min(a + self.planes, high)) for a in range(low, high, self.planes) if y0 < y1 and x0 < x1] or [_Planes(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not os.path.exists(self.of.path):
            raise FileNotFoundError(f"no volume at {self.of.path}")
        (y0, y1), (x0, x1), shape = self.box["y"], self.box["x"], self.of.shape
        lines = max(1, MOST_VOXELS // max(x1 - x0, 1))
        file = os.open(self.of.path, os.O_RDONLY)
        try:
            for z in range(*partition.value):
                for a in range(y0, y1, lines):
                    b = min(a + lines, y1)
                    v = self._lines(file, z, a, b, x0, x1)
                    if len(v) < (b - a) * (x1 - x0):
                        raise ValueError(f"{self.of.path} ends in plane {z} of {shape.z}")
                    y, x = np.divmod(np.arange(len(v)), x1 - x0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), z)), pa.array(y + a), pa.array(x + x0), pa.array(v).cast(_ARROW[self.of.spark_type])], ["z", "y", "x", "v"])
        finally:
            os.close(file)

    def _lines(self, file: int, z: int, a: int, b: int, x0: int, x1: int) -> np.ndarray:
        """Values of lines ``a`` to ``b``: in one range if lines are whole, else a range for each."""
        ny, nx = self.of.shape.y, self.of.shape.x
        if x1 - x0 == nx:
            return _read_at(file, self.of.kind, (b - a) * nx, (z * ny + a) * nx)
        return np.concatenate([_read_at(file, self.of.kind, x1 - x0, (z * ny + y) * nx + x0) for y in range(a, b)])


class _Written(WriterCommitMessage):
    pass


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.of = _Volume.of(options)
        self.overwrite = overwrite
        self.at = f"{self.of.path}.{uuid.uuid4().hex}.part" if overwrite else self.of.path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Voxels at their places, neighbours in one range; ones outside the shape are left out."""
        shape = self.of.shape
        file = os.open(self.at, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                z, y, x = (batch.column(a).to_numpy(zero_copy_only=False) for a in AXES)
                v = batch.column("v").to_numpy(zero_copy_only=False)
                inside = (z >= 0) & (z < shape.z) & (y >= 0) & (y < shape.y) & (x >= 0) & (x < shape.x)
                flat = ((z[inside] * shape.y + y[inside]) * shape.x + x[inside]).astype(np.int64)
                order = np.argsort(flat, kind="stable")  # of voxels given twice the last one stays
                flat, v = flat[order], v[inside][order].astype(self.of.kind)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(flat) != 1) + 1, [len(flat)]))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if a < b:
                        _write_at(file, v[a:b], int(flat[a]))
            os.fsync(file)
        finally:
            os.close(file)
        return _Written()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        file = os.open(self.at, os.O_WRONLY | os.O_CREAT, 0o644)
        os.ftruncate(file, self.of.bytes)  # voxels that nobody wrote are 0
        os.close(file)
        if self.overwrite:
            os.replace(self.at, self.of.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite and os.path.exists(self.at):
            os.remove(self.at)


class RawVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_volume"

    def schema(self) -> str:
        return f"z long, y long, x long, v {DTYPES[self.options.get('dtype', 'uint8')][1]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``raw_volume`` known."""
    spark.dataSource.register(RawVolume)


def _options(path: str, shape: Shape, dtype: str) -> dict:
    return {"path": _local(path), "shape": f"{shape.z},{shape.y},{shape.x}", "dtype": dtype}


def read_raw(spark: SparkSession, path: str, shape: Shape, dtype: str = "uint8", planes: int = 16, low: Shape | None = None, high: Shape | None = None) -> DataFrame:
    """(z, y, x, v) of a raw file, or of its half-open box from ``low`` to ``high``."""
    register(spark)
    reader = spark.read.format("raw_volume").options(**_options(path, shape, dtype), planes=planes)
    for name, end in (("low", low), ("high", high)):
        if end is not None:
            reader = reader.option(name, f"{end.z},{end.y},{end.x}")
    return reader.load()


def _write(volume: DataFrame, mode: str, path: str, shape: Shape, dtype: str) -> None:
    """Sorted first, so that tasks write long ranges: rows are dealt by plane and line."""
    register(volume.sparkSession)
    rows = volume.where(in_box(Shape(0, 0, 0), shape)).select(*AXES, F.col("v").cast(DTYPES[dtype][1]).alias("v"))
    dealt = rows.repartitionByRange(shuffle_partitions(volume.sparkSession), "z", "y").sortWithinPartitions(*AXES)
    dealt.write.format("raw_volume").mode(mode).options(**_options(path, shape, dtype)).save()


def write_raw(volume: DataFrame, path: str, shape: Shape, dtype: str = "uint8") -> None:
    """Write a volume (z, y, x, v) into one raw file in a folder that executors share.

    The file appears under its name when it is whole, so ``volume`` may come from the file that it
    replaces.  Voxels that the table lacks are 0; ones outside the shape are left out."""
    _write(volume, "overwrite", path, shape, dtype)


def update_raw(volume: DataFrame, path: str, shape: Shape, dtype: str = "uint8") -> None:
    """Write voxels (a slab, a box, any set) into an existing raw file; all others stay.

    A missing file is made first, all 0.  ``volume`` is written to the shared folder before the
    file is touched, so it may come from that file; running it again gives the same file.  Voxels
    outside the shape are left out."""
    at = _local(path)
    rows = materialise(volume.select(*AXES, "v"), "raw-update")
    if os.path.exists(at) and os.path.getsize(at) != shape.size * np.dtype(DTYPES[dtype][0]).itemsize:
        raise ValueError(f"{path} does not hold a volume of this shape and type")
    _write(rows, "append", path, shape, dtype)


def _new_file(at: str, size: int) -> str:
    """A file of zeros beside ``at``, to be renamed when it is whole."""
    part = f"{at}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.truncate(size)
    return part


def read_bricks(spark: SparkSession, path: str, shape: Shape, brick: Shape, dtype: str = "uint8", sparse: bool = False) -> DataFrame:
    """The file as bricks of 1.0 where positive, else 0.0: a task maps the file and copies its boxes.

    ``sparse``: bricks without a positive voxel are left out."""
    kind, at = DTYPES[dtype][0], _local(path)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not os.path.exists(at):
            raise FileNotFoundError(f"no volume at {at}")
        if os.path.getsize(at) < shape.size * np.dtype(kind).itemsize:
            raise ValueError(f"{at} ends before the volume does")
        volume = np.memmap(at, kind, "r", shape=(shape.z, shape.y, shape.x))
        for part in parts:
            for row in part.itertuples(index=False):
                box = tuple(slice(a, b) for a, b in box_of(row, brick, shape))
                positive = volume[box] > 0
                if not sparse or positive.any():
                    yield pd.DataFrame([[*row, positive.astype(np.float32).tobytes()]], columns=[*KEY, "data"])

    return all_bricks(spark, brick, shape).mapInPandas(read, BRICKS)


def _write_box(file: int, block: np.ndarray, low: list[int], shape: Shape) -> None:
    """A box at its place, line by line; whole planes and whole lines in one range."""
    if block.shape[1:] == (shape.y, shape.x):
        _write_at(file, block, low[0] * shape.y * shape.x)
        return
    for k, plane in enumerate(block):
        at = ((low[0] + k) * shape.y + low[1]) * shape.x + low[2]
        if block.shape[2] == shape.x:
            _write_at(file, plane, at)
        else:
            for j, line in enumerate(plane):
                _write_at(file, line, at + j * shape.x)


def _fill(blocks: DataFrame, path: str, size: int, put, schema: str) -> None:  # noqa: ANN001
    """Let the tasks' ``put(file, rows)`` fill a new file, which takes its name when it is whole.

    Each task writes ranges of bytes, never pages that it shares with others."""
    at = _local(path)
    part = _new_file(at, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(part, os.O_WRONLY)
        try:
            for batch in batches:
                put(file, batch)
                yield batch.select([c.strip().split(" ")[0] for c in schema.split(",")])
            os.fsync(file)
        finally:
            os.close(file)

    try:
        materialise(blocks.mapInArrow(run, schema), "raw-bricks")
    except BaseException:
        os.remove(part)
        raise
    os.replace(part, at)


def write_grey_bricks(blocks: DataFrame, path: str, shape: Shape, brick: Shape) -> None:
    """Bricks as grey levels (truncated ``u * 255``, clipped) into one uint8 file; each task writes
    its boxes, and the file appears under its name when it is whole.  Missing bricks are 0."""

    def put(file: int, batch: pa.RecordBatch) -> None:
        for row in batch.to_pylist():
            box = box_of(tuple(row[k] for k in KEY), brick, shape)
            grey = np.floor(np.frombuffer(row["data"], np.float32) * np.float64(255)).clip(0, 255).astype(np.uint8)
            _write_box(file, grey.reshape([b - a for a, b in box]), [a for a, _ in box], shape)

    _fill(blocks, path, shape.size, put, "bz long, by long, bx long")


# ---- packed bricks of labels or masks ---------------------------------------------------


def read_packed(spark: SparkSession, files: list[tuple[str, int, int]], plane: tuple[int, int], brick: Shape, dtype: str = "int64", wide: bool | None = None) -> DataFrame:
    """Packed bricks of z-slab files (path, first plane, planes), one chunk each in their order.

    Values become 64-bit integers, or stay bytes for uint8 unless ``wide`` says otherwise.  Each
    task reads the ranges of its boxes."""
    wide = dtype != "uint8" if wide is None else wide
    kind = DTYPES[dtype][0]
    ny, nx = plane
    boxes = []
    for chunk, (path, z0, nz) in enumerate(files):
        cut = [spark.range(0, n, step).select(F.col("id").alias(name)) for n, step, name in ((nz, brick.z, "a"), (ny, brick.y, "y0"), (nx, brick.x, "x0"))]
        boxes.append(cut[0].join(cut[1]).join(cut[2]).select(F.lit(chunk).cast("long").alias("chunk"), (F.col("a") + z0).alias("z0"), "y0", "x0", F.least(F.lit(nz) - F.col("a"), F.lit(brick.z)).cast("long").alias("nz"), F.least(F.lit(ny) - F.col("y0"), F.lit(brick.y)).cast("long").alias("ny"), F.least(F.lit(nx) - F.col("x0"), F.lit(brick.x)).cast("long").alias("nx"), "a", F.lit(_local(path)).alias("path"), F.lit(nz * ny * nx * np.dtype(kind).itemsize).cast("long").alias("size")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not os.path.exists(row["path"]):
                    raise FileNotFoundError(f"no volume at {row['path']}")
                if os.path.getsize(row["path"]) < row["size"]:
                    raise ValueError(f"{row['path']} ends before the volume does")
                file = os.open(row["path"], os.O_RDONLY)
                try:
                    block = read_box(file, kind, [row["a"], row["y0"], row["x0"]], [row["nz"], row["ny"], row["nx"]], plane)
                finally:
                    os.close(file)
                data = block.astype("<i8") if wide else block
                yield _out([{c: row[c] for c in ("chunk", *PLACE, "nz", "ny", "nx")} | {"data": data.tobytes()}])

    made = boxes[0]
    for more in boxes[1:]:
        made = made.unionByName(more)
    return made.repartition(shuffle_partitions(spark), *PLACE).mapInArrow(read, PACKED)


def write_packed(bricks: DataFrame, path: str, shape: Shape, dtype: str = "int64") -> None:
    """Packed bricks of 64-bit labels into one raw file; voxels without a brick are 0."""
    kind = DTYPES[dtype][0]

    def put(file: int, batch: pa.RecordBatch) -> None:
        for row in batch.to_pylist():
            block = np.frombuffer(row["data"], "<i8").reshape(row["nz"], row["ny"], row["nx"])
            _write_box(file, block.astype(kind), [row[c] for c in PLACE], shape)

    _fill(bricks, path, shape.size * np.dtype(kind).itemsize, put, "z0 long, y0 long, x0 long")


# ---- any file system ----------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, shape: Shape, dtype: str = "uint8") -> DataFrame:
    """(z, y, data): the lines along x of a raw file on any file system that Spark reads.

    The JVM splits the file into records of a line and reads the splits where they lie; their
    numbers are their places.  A file that ends within a line is an error."""
    width = shape.x * np.dtype(DTYPES[dtype][0]).itemsize
    records = spark.sparkContext.newAPIHadoopFile(
        path,
        "org.apache.spark.input.FixedLengthBinaryInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(width)},
    )
    lines = spark.createDataFrame(records.map(lambda r: (r[0], bytearray(r[1]))), "line long, data binary")
    return lines.where(F.col("line") < shape.z * shape.y).select(F.expr(f"line div {shape.y}").alias("z"), (F.col("line") % shape.y).alias("y"), "data")


def pack_lines(lines: DataFrame, shape: Shape, brick: Shape, dtype: str = "int64") -> DataFrame:
    """Packed bricks of labels (or bytes, for uint8) from lines (z, y, data): pieces of lines are
    dealt by brick.  A brick that lacks a line is an error."""
    kind = DTYPES[dtype][0]
    width = np.dtype(kind).itemsize
    pieces = F.transform(F.sequence(F.lit(0), F.lit(shape.x - 1), F.lit(brick.x)), lambda x: F.struct(x.cast("long").alias("x0"), F.substring("data", x * width + 1, F.lit(brick.x * width)).alias("piece")))
    cut = lines.select("z", "y", F.explode(pieces).alias("p")).select(*(F.expr(f"{a} div {brick.of(a)} * {brick.of(a)}").alias(f"{a}0") for a in ("z", "y")), "p.x0", "z", "y", "p.piece")

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        low = [int(k.as_py()) for k in key]
        size = [min(brick.of(a), shape.of(a) - b) for a, b in zip(AXES, low, strict=True)]
        if rows.num_rows != size[0] * size[1]:
            raise ValueError(f"lines are missing in the brick at {low}")
        at = (rows.column("z").to_numpy() - low[0]) * size[1] + rows.column("y").to_numpy() - low[1]
        block = np.frombuffer(b"".join(rows.column("piece").to_pylist()), kind).reshape(-1, size[2])[np.argsort(at)]
        data = block if dtype == "uint8" else block.astype("<i8")
        return pa.Table.from_batches([_out([dict(zip(("chunk", *PLACE, "nz", "ny", "nx"), (0, *low, *size), strict=True)) | {"data": data.tobytes()}])])

    return cut.groupBy(*PLACE).applyInArrow(build, PACKED)


def difference_sums(spark: SparkSession, one: str, other: str, shape: Shape, brick: Shape, dtypes: tuple[str, str]) -> DataFrame:
    """(n, total, squares, most, least) of the absolute differences of two files, a row for each
    brick: a task reads the same box of both."""
    kinds = [DTYPES[d][0] for d in dtypes]
    paths = [_local(p) for p in (one, other)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, kind in zip(paths, kinds, strict=True):
            if not os.path.exists(path):
                raise FileNotFoundError(f"no volume at {path}")
            if os.path.getsize(path) < shape.size * np.dtype(kind).itemsize:
                raise ValueError(f"{path} ends before the volume does")
        files = [os.open(path, os.O_RDONLY) for path in paths]
        try:
            for part in parts:
                for row in part.itertuples(index=False):
                    box = box_of(row, brick, shape)
                    a, b = (read_box(f, k, [lo for lo, _ in box], [hi - lo for lo, hi in box], (shape.y, shape.x)).astype(float) for f, k in zip(files, kinds, strict=True))
                    d = np.abs(a - b)
                    yield pd.DataFrame([[d.size, d.sum(), (d * d).sum(), d.max(), d.min()]], columns=["n", "total", "squares", "most", "least"])
        finally:
            for file in files:
                os.close(file)

    return all_bricks(spark, brick, shape).mapInPandas(run, "n long, total double, squares double, most double, least double")
