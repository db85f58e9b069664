"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the cluster names none (tests in local mode), a temporary folder is made and
    set once for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and
    survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a folder, wherever Spark can write it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    files, at = _hadoop(spark, path)
    files.delete(at, True)


class Generations:
    """A state that a job writes again and again, two generations on disk at most.

    Each ``write`` makes a numbered folder, whole once Spark's ``_SUCCESS`` file lies in it; then
    the one before goes, as only the new one is read from there on.  A job that starts again on the
    same ``folder`` goes on from ``last``, with what another attempt left half written removed."""

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None) -> None:
        self.spark, self.folder = spark, (folder or new_folder(spark, name)).rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.folder}/generation-{number:06d}"

    def numbers(self) -> list[int]:
        """The whole generations on disk, ascending."""
        files, at = _hadoop(self.spark, self.folder)
        if not files.exists(at):
            return []
        names = (s.getPath().getName() for s in files.listStatus(at))
        found = sorted(int(n.rsplit("-", 1)[1]) for n in names if re.fullmatch(r"generation-\d+", n))
        return [n for n in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(n)}/_SUCCESS"))]

    def last(self) -> tuple[int, DataFrame] | None:
        """(number, state) of the last whole generation."""
        whole = self.numbers()
        return (whole[-1], self.spark.read.parquet(self._path(whole[-1]))) if whole else None

    def write(self, number: int, state: DataFrame) -> DataFrame:
        """Write generation ``number``, drop all others, and read it back."""
        before = [n for n in self.numbers() if n != number]
        state.write.mode("overwrite").parquet(self._path(number))
        for n in before:
            discard(self.spark, self._path(n))
        return self.spark.read.schema(state.schema).parquet(self._path(number))

    def clear(self) -> None:
        discard(self.spark, self.folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
