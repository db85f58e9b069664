"""Axis histograms of a stream of voxels: counts that only grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxlake.functions.shared import Generations
from voxlake.operators.histograms import add_histograms, axis_histogram, axis_histograms


def stream_histogram(voxels: DataFrame, name: str, axis: str, low: float, high: float, bins: int, checkpoint: str, center: tuple[int, int] = (0, 0)) -> StreamingQuery:
    """Start a query that keeps the histogram of all voxels seen in the memory table ``name``.

    State is one count for each (position, bin), bounded by the grid."""
    counts = axis_histogram(voxels, axis, low, high, bins, center)
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def stored_histograms(voxels: DataFrame, folder: str, low: float, high: float, bins: int, center: tuple[int, int], most_radius: int | None = None) -> StreamingQuery:
    """Add what has come of the stream ``voxels`` to the histograms along z, y, x and r kept in
    ``folder``, and end; a later call on the same folder goes on from there.

    A batch is counted on its own, then its counts meet those stored, which the grid bounds, in a
    generation with the batch's number.  A batch that comes again after a crash finds its
    generation there and adds nothing, so every voxel of the stream counts once."""
    states = Generations(voxels.sparkSession, "histograms", f"{folder}/counts")

    def add(batch: DataFrame, number: int) -> None:
        last = states.last()
        if last and last[0] > number:
            return
        counts = axis_histograms(batch, low, high, bins, center, most_radius)
        states.write(number + 1, add_histograms(counts, *([last[1]] if last else [])))

    return voxels.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def read_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """(axis, pos, bin, n) kept in ``folder``; no rows before the first batch."""
    last = Generations(spark, "histograms", f"{folder}/counts").last()
    return last[1] if last else spark.createDataFrame([], "axis string, pos long, bin long, n long")
