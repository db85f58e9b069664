"""Jobs from file to file: what a user of raw volumes runs.

Files are headerless C-order scalars in a folder that the driver and all executors share; the
ending of a name tells the type (``mask.uint8``, ``labels0.int64``).

    python -m voxlake.jobs.files merge BASE Z,Y,X PLANES_OF_CHUNK,PLANES_OF_CHUNK,...
    python -m voxlake.jobs.files label MASK.uint8 Z,Y,X OUT.int64
    python -m voxlake.jobs.files same PATH PATH Z,Y,X
    python -m voxlake.jobs.files compare PATH PATH Z,Y,X
    python -m voxlake.jobs.files histograms PATH Z,Y,X LOW HIGH BINS FOLDER
    python -m voxlake.jobs.files synthesize OUT.uint8 SIDE
    python -m voxlake.jobs.files names PATH Z,Y,X FOLDER
    python -m voxlake.jobs.files diffuse PATH.uint8 OUT.uint8 Z,Y,X SIGMA RADIUS [REPETITIONS]
    python -m voxlake.jobs.files plot PATH Z,Y,X OUT.png
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.shared import Generations, materialise
from voxlake.functions.volume import Shape
from voxlake.jobs.fixtures import synthetic_mask
from voxlake.operators.bricks import brick_labels, label_bricks, merge_bricks, packed_names
from voxlake.operators.diffusion import diffuse_blocks
from voxlake.operators.histograms import packed_field_histogram, packed_histograms
from voxlake.operators.stats import names_differ
from voxlake.sources.images import plot_middle_planes
from voxlake.sources.raw import DTYPES, difference_sums, read_bricks, read_packed, read_raw, write_grey_bricks, write_packed, write_raw

BRICK = Shape(128, 128, 128)


def dtype_of(path: str) -> str:
    """The type that the ending of a name tells."""
    ending = path.rsplit(".", 1)[-1]
    if ending not in DTYPES:
        raise ValueError(f"{path} does not end in one of {', '.join(DTYPES)}")
    return ending


def gaussian(sigma: float, radius: int) -> list[float]:
    """Samples of the normal density, not brought to a sum of 1."""
    return [math.exp(-0.5 * (o / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi)) for o in range(-radius, radius + 1)]


def merge_label_files(spark: SparkSession, base: str, plane: tuple[int, int], planes: list[int], brick: Shape = BRICK) -> int:
    """Merge the labels of chunk files ``{base}{i}.int64`` across their seams into
    ``{base}all.int64``; returns the number of components.

    Labels are numbered 1, 2, ... in raster order of first voxels.  Any number of chunks, of any
    heights; each was labelled on its own.  Bricks go from file to file; only labels and boundary
    planes become rows."""
    ends = [sum(planes[:k]) for k in range(len(planes) + 1)]
    files = [(f"{base}{i}.int64", ends[i], n) for i, n in enumerate(planes)]
    labelled = materialise(read_packed(spark, files, plane, brick), "chunk-files")
    return _write_components(merge_bricks(labelled), f"{base}all.int64", Shape(ends[-1], *plane))


def label_mask_file(spark: SparkSession, path: str, shape: Shape, out: str, brick: Shape = BRICK) -> int:
    """Label the components of a uint8 mask file into an int64 file; returns their number."""
    masks = read_packed(spark, [(path, 0, shape.z)], (shape.y, shape.x), brick, dtype_of(path))
    own = masks.withColumn("chunk", F.expr(f"shiftleft(z0 div {brick.z}, 40) + shiftleft(y0 div {brick.y}, 20) + x0 div {brick.x}"))
    return _write_components(merge_bricks(materialise(label_bricks(own), "label-bricks")), out, shape)


def _write_components(merged: DataFrame, path: str, shape: Shape) -> int:
    merged = materialise(merged, "merged-bricks")
    write_packed(merged, path, shape)
    return brick_labels(merged).agg(F.coalesce(F.max("label"), F.lit(0))).first()[0]


def names_of_label_file(spark: SparkSession, path: str, shape: Shape, brick: Shape = BRICK) -> DataFrame:
    """(label, z, y, x, size) of a label file, background (0) included."""
    return packed_names(read_packed(spark, [(path, 0, shape.z)], (shape.y, shape.x), brick))


def same_components(spark: SparkSession, one: str, other: str, shape: Shape) -> DataFrame:
    """Components of two label files that differ, whatever their numbers: (z, y, x, size, side) of
    those whose first voxel and size only one file has.  No rows: the files agree."""
    return names_differ(names_of_label_file(spark, one, shape), names_of_label_file(spark, other, shape))


def compare_files(spark: SparkSession, one: str, other: str, shape: Shape, brick: Shape = BRICK) -> DataFrame:
    """(mean, max, min, stddev) of the absolute differences of two volume files, as doubles.

    Bricks of both files are read side by side; a row of sums for each brick is all that meets."""
    sums = difference_sums(spark, one, other, shape, brick, (dtype_of(one), dtype_of(other)))
    mean, square = F.sum("total") / F.sum("n"), F.sum("squares") / F.sum("n")
    return sums.agg(mean.alias("mean"), F.max("most").alias("max"), F.min("least").alias("min"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("stddev"))


def histograms_of_file(spark: SparkSession, path: str, shape: Shape, low: float, high: float, bins: int, center: tuple[int, int], most_radius: int | None = None, brick: Shape = BRICK) -> DataFrame:
    """(axis, pos, bin, n) along z, y, x and r of a volume file of whole numbers."""
    bricks = read_packed(spark, [(path, 0, shape.z)], (shape.y, shape.x), brick, dtype_of(path), wide=True)
    return packed_histograms(bricks, low, high, bins, center, most_radius)


def field_histogram_of_files(spark: SparkSession, path: str, shape: Shape, field: str, field_shape: Shape, bins: int, value_range: tuple[float, float], field_range: tuple[float, float], brick: Shape = BRICK) -> DataFrame:
    """(fbin, vbin, n) of a volume file of whole numbers and a coarser field's file."""
    bricks = read_packed(spark, [(path, 0, shape.z)], (shape.y, shape.x), brick, dtype_of(path), wide=True)
    cells = read_raw(spark, field, field_shape, dtype_of(field)).withColumnRenamed("v", "f")
    return packed_field_histogram(bricks, shape, cells, field_shape, bins, *value_range, *field_range)


def diffuse_file(spark: SparkSession, path: str, kernel: list[float], out: str, shape: Shape, repetitions: int = 1, brick: Shape = BRICK, state: str | None = None) -> None:
    """Diffuse a uint8 mask file (positive voxels are sources) into a uint8 file of grey levels.

    Bricks are read and written in the tasks; without repetitions the result is mask * 255.  With
    a ``state`` folder a job that was stopped goes on behind its last whole repetition.  Only
    bricks that hold or get values are kept between repetitions."""
    blocks = read_bricks(spark, path, shape, brick, dtype_of(path), sparse=True)
    write_grey_bricks(diffuse_blocks(blocks, shape, kernel, repetitions, brick, state, sparse=True), out, shape, brick)
    if state:
        Generations(spark, "diffusion", state).clear()


def plot_file(spark: SparkSession, path: str, shape: Shape, out: str) -> list[str]:
    """The middle planes of a volume file as PNG; floats 0..1 and labels become grey levels."""
    dtype = dtype_of(path)
    v = F.col("v")
    grey = F.floor(v * 255.0) if dtype == "float32" else F.when(v == 0, 0).otherwise(F.pmod(v * 97, F.lit(200)) + 56) if dtype == "int64" else v
    return plot_middle_planes(read_raw(spark, path, shape, dtype).withColumn("v", grey.cast("long")), shape, out)


def main(args: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    numbers = lambda s: [int(k) for k in s.split(",")]
    match args:
        case ["merge", base, shape, planes]:
            print(merge_label_files(spark, base, tuple(numbers(shape)[1:]), numbers(planes)))
        case ["label", path, shape, out]:
            print(label_mask_file(spark, path, Shape(*numbers(shape)), out))
        case ["same", one, other, shape]:
            differ = same_components(spark, one, other, Shape(*numbers(shape)))
            print("the same components" if differ.isEmpty() else differ._show_string(20))
        case ["compare", one, other, shape]:
            compare_files(spark, one, other, Shape(*numbers(shape))).show()
        case ["histograms", path, shape, low, high, bins, folder]:
            size = Shape(*numbers(shape))
            histograms_of_file(spark, path, size, float(low), float(high), int(bins), (size.y // 2, size.x // 2)).write.parquet(folder)
        case ["synthesize", out, side]:
            write_raw(synthetic_mask(spark, int(side)).where("v > 0"), out, Shape(*[int(side)] * 3))
        case ["names", path, shape, folder]:
            names_of_label_file(spark, path, Shape(*numbers(shape))).write.parquet(folder)
        case ["diffuse", path, out, shape, sigma, radius, *more]:
            diffuse_file(spark, path, gaussian(float(sigma), int(radius)), out, Shape(*numbers(shape)), int(more[0]) if more else 1)
        case ["plot", path, shape, out]:
            print(*plot_file(spark, path, Shape(*numbers(shape)), out), sep="\n")
        case _:
            raise SystemExit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
