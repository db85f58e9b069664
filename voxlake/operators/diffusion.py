"""Iterated separable correlation with fixed sources."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.functions.pointwise import binarize, illuminate, is_source, quantize
from voxlake.functions.shared import Generations, materialise
from voxlake.functions.volume import AXES, Shape, coordinates, in_box


def correlate_axis(dense: DataFrame, axis: str, kernel: list[float], value: str = "u") -> DataFrame:
    """Correlate a dense grid with an odd kernel along one axis; 0 outside the grid."""
    half = len(kernel) // 2
    line = Window.partitionBy(*(a for a in AXES if a != axis)).orderBy(axis)
    taps = [F.coalesce(F.lead(value, o).over(line) if o > 0 else F.lag(value, -o).over(line) if o else F.col(value), F.lit(0.0)) * F.lit(float(w)) for o, w in zip(range(-half, half + 1), kernel, strict=True)]
    total = taps[0]
    for t in taps[1:]:
        total = total + t
    return dense.select(*AXES, *(c for c in dense.columns if c not in (*AXES, value)), total.alias(value))


def scatter_axis(sparse: DataFrame, shape: Shape, axis: str, kernel: list[float], value: str = "u") -> DataFrame:
    """The same for a grid that holds only non-zero voxels: each adds to its neighbours."""
    half = len(kernel) // 2
    taps = F.explode(F.array(*(F.struct(F.lit(half - k).alias("o"), F.lit(float(w)).alias("w")) for k, w in enumerate(kernel)))).alias("t")
    moved = sparse.select(*AXES, value, taps).withColumn(axis, (F.col(axis) + F.col("t.o")).cast("long")).where(F.col(axis).between(0, shape.of(axis) - 1))
    return moved.groupBy(*AXES).agg(F.sum(F.col(value) * F.col("t.w")).alias(value))


def diffuse(dense: DataFrame, kernel: list[float], repetitions: int, cut_every: int = 4) -> DataFrame:
    """(z, y, x, u): ``repetitions`` of three axis passes, each followed by the sources' 1.0.

    ``dense`` is (z, y, x, v) with every voxel of the grid; sources are voxels with v > 0 and,
    later, any voxel that is exactly 1.0 when a repetition begins."""
    now = dense.select(*AXES, binarize(F.col("v")).alias("u"))
    for k in range(repetitions):
        now = now.withColumn("mask", is_source(F.col("u")))
        for axis in AXES:
            now = correlate_axis(now, axis, kernel)
        now = now.select(*AXES, illuminate(F.col("u"), F.col("mask")).alias("u"))
        if k % cut_every == cut_every - 1:
            now = materialise(now, "diffusion")
    return now


def to_grey(diffused: DataFrame) -> DataFrame:
    return diffused.select(*AXES, quantize(F.col("u")).alias("g"))


# ---- bricks: for volumes of billions of voxels --------------------------------------
# A box of voxels is one row (bz, by, bx, data): its place among the bricks along each axis, and
# float32 values in row-major order.  Bricks at the end of an axis may be smaller.

BRICKS = "bz long, by long, bx long, data binary"
KEY = ["bz", "by", "bx"]


def as_brick(brick: Shape | int, shape: Shape) -> Shape:
    """A number stands for a slab of so many whole planes."""
    return Shape(brick, shape.y, shape.x) if isinstance(brick, int) else brick


def box_of(place: tuple, brick: Shape, shape: Shape) -> list[tuple[int, int]]:
    """(low, high) of a brick along each axis."""
    return [(int(k) * brick.of(a), min((int(k) + 1) * brick.of(a), shape.of(a))) for k, a in zip(place, AXES, strict=True)]


def all_bricks(spark: SparkSession, brick: Shape, shape: Shape) -> DataFrame:
    """(bz, by, bx) of every brick."""
    n = shape.bricks(brick)
    return spark.range(n.size).select(*(c.alias(k) for c, k in zip(coordinates(F.col("id"), n), KEY, strict=True)))


def to_blocks(volume: DataFrame, shape: Shape, brick: Shape | int, sparse: bool = False) -> DataFrame:
    """Bricks from (z, y, x, v): 1.0 where v > 0.  Voxels outside the shape are left out.

    ``sparse``: only bricks with such voxels exist."""
    brick = as_brick(brick, shape)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        box = box_of(key, brick, shape)
        block = np.zeros([b - a for a, b in box], np.float32)
        hit = (rows["v"] > 0).to_numpy()
        block[tuple(rows[c].to_numpy()[hit] - a for c, (a, _) in zip(AXES, box, strict=True))] = 1
        return pd.DataFrame({**{k: [int(v)] for k, v in zip(KEY, key, strict=True)}, "data": [block.tobytes()]})

    def filled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in np.flatnonzero(part["data"].isna()):
                size = np.prod([b - a for a, b in box_of(tuple(part.loc[i, KEY]), brick, shape)])
                part.at[i, "data"] = bytes(4 * int(size))
            yield part

    placed = volume.where(in_box(Shape(0, 0, 0), shape)).select(*AXES, "v", *(F.floor(F.col(a) / F.lit(brick.of(a))).cast("long").alias(k) for a, k in zip(AXES, KEY, strict=True)))
    if sparse:
        return placed.where("v > 0").groupBy(*KEY).applyInPandas(build, BRICKS)
    found = placed.groupBy(*KEY).applyInPandas(build, BRICKS)
    return all_bricks(volume.sparkSession, brick, shape).join(found, KEY, "left").mapInPandas(filled, BRICKS)


HALO = "bz long, by long, bx long, z0 long, y0 long, x0 long, nz long, ny long, nx long, data binary"


def exchange_halo(blocks: DataFrame, shape: Shape, radius: int, brick: Shape | int, sparse: bool = False) -> DataFrame:
    """(bz, by, bx, z0, y0, x0, nz, ny, nx, data) by target brick: each brick with the boxes of
    others that lie within ``radius`` of it; only those boxes travel.

    ``sparse``: boxes of nothing but 0 stay at home, so a target appears if a value reaches it."""
    brick = as_brick(brick, shape)
    many = shape.bricks(brick)

    def parts_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                box = box_of(row[:3], brick, shape)
                block = np.frombuffer(row.data, np.float32).reshape([b - a for a, b in box])
                near = []  # along each axis: (target, low, high)
                for (a, b), name in zip(box, AXES, strict=True):
                    side = brick.of(name)
                    first, last = max(0, (a - radius) // side), min(many.of(name) - 1, (b - 1 + radius) // side)
                    near.append([(t, max(a, t * side - radius), min(b, min((t + 1) * side, shape.of(name)) + radius)) for t in range(first, last + 1)])
                for to in product(*near):
                    cut = block[tuple(slice(lo - a, hi - a) for (_, lo, hi), (a, _) in zip(to, box, strict=True))]
                    if cut.any() if sparse else cut.size:
                        yield pd.DataFrame([[*(t for t, _, _ in to), *(lo for _, lo, _ in to), *cut.shape, cut.tobytes()]], columns=[*KEY, "z0", "y0", "x0", "nz", "ny", "nx", "data"])

    return blocks.mapInPandas(parts_of, HALO)


def correlate(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along one axis, 0 outside, in float32."""
    half, n = len(kernel) // 2, a.shape[axis]
    out = np.zeros_like(a)
    for k, w in enumerate(kernel):
        o = k - half
        if abs(o) < n and w:
            to = [slice(None)] * 3
            at = [slice(None)] * 3
            to[axis], at[axis] = slice(max(0, -o), n - max(0, o)), slice(max(0, o), n - max(0, -o))
            out[tuple(to)] += np.float32(w) * a[tuple(at)]
    return out


def diffuse_blocks(blocks: DataFrame, shape: Shape, kernel: list[float], repetitions: int, brick: Shape | int, state: str | None = None, sparse: bool = False) -> DataFrame:
    """Diffusion of bricks: one shuffle of bricks and halos a repetition, all axes in one task.

    A task holds a brick with the kernel's radius around it, whatever the volume's size.  Each
    repetition is a generation, of which two are on disk at most; those of a ``state`` folder
    outlive the job, and one that starts again there does only the repetitions that are left.

    ``sparse``: a brick that isn't there is all 0.  Values that reach it wake it, and one that
    becomes all 0 goes, so rows, shuffle and disk follow the active bricks and not the volume;
    the values are the same."""
    weights = np.asarray(kernel, np.float32)
    half, brick = len(kernel) // 2, as_brick(brick, shape)

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = box_of(key, brick, shape)
        wide = [(max(0, a - half), min(shape.of(n), b + half)) for (a, b), n in zip(own, AXES, strict=True)]
        state = np.zeros([b - a for a, b in wide], np.float32)
        for r in rows.itertuples(index=False):
            size, low = (r.nz, r.ny, r.nx), (r.z0, r.y0, r.x0)
            state[tuple(slice(lo - a, lo - a + n) for lo, n, (a, _) in zip(low, size, wide, strict=True))] = np.frombuffer(r.data, np.float32).reshape(size)
        inner = tuple(slice(a - lo, b - lo) for (a, b), (lo, _) in zip(own, wide, strict=True))
        mask = state[inner] == 1
        for axis in range(3):  # along each axis only its inner part is right, and only that goes on
            keep = [slice(None)] * 3
            keep[axis] = inner[axis]
            state = np.ascontiguousarray(correlate(state, weights, axis)[tuple(keep)])
        state[mask] = 1
        if sparse and not state.any():
            return pd.DataFrame(columns=[*KEY, "data"])
        return pd.DataFrame({**{k: [int(v)] for k, v in zip(KEY, key, strict=True)}, "data": [state.tobytes()]})

    states = Generations(blocks.sparkSession, "diffusion", state)
    done, now = (states.last() if state else None) or (0, blocks)
    if done > repetitions:
        raise ValueError(f"the state is {done} repetitions old, more than {repetitions}")
    for k in range(done, repetitions):
        now = states.write(k + 1, exchange_halo(now, shape, half, brick, sparse).groupBy(*KEY).applyInPandas(step, BRICKS))
    return now


def from_blocks(blocks: DataFrame, shape: Shape, brick: Shape | int) -> DataFrame:
    """(z, y, x, u) of the bricks there are."""
    brick = as_brick(brick, shape)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                box = box_of(row[:3], brick, shape)
                state = np.frombuffer(row.data, np.float32).reshape([b - a for a, b in box])
                (z0, _), (y0, y1), (x0, x1) = box
                y, x = (c.ravel() for c in np.mgrid[y0:y1, x0:x1])
                for k, plane in enumerate(state):
                    yield pd.DataFrame({"z": np.full(len(y), z0 + k), "y": y, "x": x, "u": plane.ravel().astype(float)})

    return blocks.mapInPandas(rows, "z long, y long, x long, u double")
