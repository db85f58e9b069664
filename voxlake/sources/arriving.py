"""Chunk files that arrive one after another, as a stream of voxels.

``raw_chunks`` is a streaming source with the options ``base``, ``plane`` ("y,x"), ``planes`` of a
chunk and ``dtype``.  Chunk k is the file ``{base}{k}.{dtype}``; it holds ``planes`` planes (the last
one may hold fewer) and lies behind the chunks before it.  An offset is the number of chunks that have
come without a gap; a chunk behind a missing one waits.  A file must appear under its name when it
is whole, as ``raw_volume`` writes it, and stay as it is.  Files lie in a folder that driver
and executors mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from voxlake.sources.raw import DTYPES, _local, _Planes, _Reader

PLANES_AT_ONCE = 16  # of an input partition


class _Part(InputPartition):
    def __init__(self, chunk: int, low: int, high: int) -> None:
        super().__init__((chunk, low, high))


class _ChunkReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.base, self.dtype = _local(options["base"]), options.get("dtype", "uint8")
        self.plane, self.planes = options["plane"], int(options["planes"])
        ny, nx = (int(k) for k in self.plane.split(","))
        self.plane_bytes = ny * nx * np.dtype(DTYPES[self.dtype][0]).itemsize
        self.come = 0

    def _path(self, chunk: int) -> str:
        return f"{self.base}{chunk}.{self.dtype}"

    def initialOffset(self) -> dict:
        return {"chunks": 0}

    def latestOffset(self) -> dict:
        while os.path.exists(self._path(self.come)):
            self.come += 1
        return {"chunks": self.come}

    def _heights(self, chunk: int) -> int:
        """Planes that the chunk's file holds."""
        n, rest = divmod(os.path.getsize(self._path(chunk)), self.plane_bytes)
        if rest or n > self.planes or (n < self.planes and os.path.exists(self._path(chunk + 1))):
            raise ValueError(f"{self._path(chunk)} does not hold {self.planes} planes")
        return n

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(k, a, min(a + PLANES_AT_ONCE, n)) for k in range(start["chunks"], end["chunks"]) for n in (self._heights(k),) for a in range(0, n, PLANES_AT_ONCE)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        chunk, low, high = partition.value
        file = _Reader({"path": self._path(chunk), "shape": f"{high},{self.plane}", "dtype": self.dtype})
        for batch in file.read(_Planes(low, high)):
            yield batch.set_column(0, "z", pc.add(batch.column(0), chunk * self.planes))

    def commit(self, end: dict) -> None:
        """Files stay."""


class RawChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_chunks"

    def schema(self) -> str:
        return f"z long, y long, x long, v {DTYPES[self.options.get('dtype', 'uint8')][1]}"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ChunkReader(dict(self.options))


def stream_chunks(spark: SparkSession, base: str, plane: tuple[int, int], planes: int, dtype: str = "uint8") -> DataFrame:
    """(z, y, x, v) of chunk files, those there are and those that come."""
    spark.dataSource.register(RawChunks)
    options = {"base": base, "plane": f"{plane[0]},{plane[1]}", "planes": planes, "dtype": dtype}
    return spark.readStream.format("raw_chunks").options(**options).load()
