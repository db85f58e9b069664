"""Connected components of packed bricks: a box of labels is one binary row.

Only what the merge needs becomes rows of its own: boundary planes of bricks (still packed), each
brick's distinct labels with their first voxels, and the pairs of labels that touch.  The rename
table reaches each brick by a cogroup and is applied inside it.  A brick that isn't there, or a
label 0, is background.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.shared import materialise
from voxlake.functions.volume import AXES, Shape, in_box
from voxlake.operators.components import chunk_of, rename_from

#: Labels are little-endian 64-bit integers in row-major order; masks are bytes.  Within a chunk,
#: one label is one component; a chunk is a brick, or several that were labelled together.
PACKED = "chunk long, z0 long, y0 long, x0 long, nz long, ny long, nx long, data binary"
PLACE = ["z0", "y0", "x0"]
_PACKED = pa.schema([*((n, pa.int64()) for n in ("chunk", *PLACE, "nz", "ny", "nx")), ("data", pa.binary())])


def _rows(batch: pa.RecordBatch | pa.Table, kind: str) -> Iterator[tuple[dict, np.ndarray]]:
    """Each brick with its box as an array."""
    for row in batch.to_pylist():
        yield row, np.frombuffer(row["data"], kind).reshape(row["nz"], row["ny"], row["nx"])


def _out(rows: list[dict], schema: pa.Schema = _PACKED) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def pack_masks(volume: DataFrame, shape: Shape, brick: Shape) -> DataFrame:
    """Bricks of bytes from (z, y, x, v): 1 where v is neither 0 nor null.  Bricks without such
    voxels don't exist; voxels outside the shape are left out."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        low = [(k >> 40) * brick.z, (k >> 20 & 0xFFFFF) * brick.y, (k & 0xFFFFF) * brick.x]
        size = [min(brick.of(a), shape.of(a) - b) for a, b in zip(AXES, low, strict=True)]
        block = np.zeros(size, np.uint8)
        block[tuple(rows[a].to_numpy() - b for a, b in zip(AXES, low, strict=True))] = 1
        return pd.DataFrame([[k, *low, *size, block.tobytes()]], columns=_PACKED.names)

    placed = volume.where((F.col("v") != 0) & in_box(Shape(0, 0, 0), shape)).select(chunk_of(brick).alias("chunk"), *AXES)
    return placed.groupBy("chunk").applyInPandas(build, PACKED)


def pack_values(volume: DataFrame, shape: Shape, brick: Shape) -> DataFrame:
    """Bricks of 64-bit values from (z, y, x, v), null as 0; of voxels given twice one stays.  Bricks
    without voxels don't exist; voxels outside the shape are left out."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        k = key[0].as_py()
        low = [(k >> 40) * brick.z, (k >> 20 & 0xFFFFF) * brick.y, (k & 0xFFFFF) * brick.x]
        size = [min(brick.of(a), shape.of(a) - b) for a, b in zip(AXES, low, strict=True)]
        block = np.zeros(size, "<i8")
        block[tuple(rows.column(a).to_numpy() - b for a, b in zip(AXES, low, strict=True))] = rows.column("v").to_numpy()
        return pa.Table.from_batches([_out([dict(zip(_PACKED.names, (k, *low, *size, block.tobytes()), strict=True))])])

    inside = volume.where(in_box(Shape(0, 0, 0), shape))
    placed = inside.select(chunk_of(brick).alias("chunk"), *(F.col(a).cast("long").alias(a) for a in AXES), F.coalesce(F.col("v").cast("long"), F.lit(0)).alias("v"))
    return placed.groupBy("chunk").applyInArrow(build, PACKED)


def run_labels(mask: np.ndarray) -> np.ndarray:
    """Components of a box, 1, 2, ... in raster order of first voxels; 0 is background.

    Runs along x are the nodes; runs that meet along y or z are hooked until nothing moves."""
    mask = mask != 0
    begins = mask.copy()
    begins[:, :, 1:] &= ~mask[:, :, :-1]
    run = np.cumsum(begins.ravel()).reshape(mask.shape) * mask
    root = np.arange(int(run.max(initial=0)) + 1)
    pairs = []
    for a, b in ((run[1:], run[:-1]), (run[:, 1:], run[:, :-1])):
        both = (a > 0) & (b > 0)
        pairs.append(np.unique(a[both] * len(root) + b[both]))
    a, b = np.divmod(np.concatenate(pairs), len(root))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return np.unique(root, return_inverse=True)[1][run]  # run 0 is the smallest root


def label_bricks(masks: DataFrame) -> DataFrame:
    """Bricks of labels from bricks of bytes; each brick is labelled on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _rows(batch, "u1"):
                yield _out([row | {"data": run_labels(block).astype("<i8").tobytes()}])

    return masks.mapInArrow(run, PACKED)


def brick_labels(labelled: DataFrame) -> DataFrame:
    """(chunk, z0, y0, x0, label, z, y, x, size) of every label of every brick, background
    included: its first voxel in raster order and its voxels there."""
    names = ["chunk", *PLACE, "label", *AXES, "size"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _rows(batch, "<i8"):
                label, first, size = np.unique(block, return_index=True, return_counts=True)
                at = np.unravel_index(first, block.shape)
                fixed = [np.full(len(label), row[n]) for n in ("chunk", *PLACE)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*fixed, label, *(k + row[p] for k, p in zip(at, PLACE, strict=True)), size)], schema=schema)

    return labelled.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def packed_names(labelled: DataFrame) -> DataFrame:
    """(label, z, y, x, size) of packed bricks: the bricks' own counts meet, not voxels."""
    found = brick_labels(labelled).groupBy("label").agg(F.min(F.struct(*AXES)).alias("f"), F.sum("size").alias("size"))
    return found.select("label", *(F.col(f"f.{a}").alias(a) for a in AXES), "size")


def brick_faces(labelled: DataFrame) -> DataFrame:
    """(axis, at, u, v, side, chunk, data): the first and the last plane of each brick along each
    axis, packed.  ``at`` is the coordinate of the boundary, (u, v) the place along the other axes;
    ``side`` 0 lies before the boundary.  Planes without labels are left out."""
    schema = pa.schema([*((n, pa.int64()) for n in ("axis", "at", "u", "v", "side", "chunk")), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, block in _rows(batch, "<i8"):
                for axis in range(3):
                    u, v = (row[p] for k, p in enumerate(PLACE) if k != axis)
                    for side, plane, at in ((0, block.shape[axis] - 1, row[PLACE[axis]] + block.shape[axis]), (1, 0, row[PLACE[axis]])):
                        cut = block.take(plane, axis)
                        if cut.any():
                            rows.append({"axis": axis, "at": at, "u": u, "v": v, "side": side, "chunk": row["chunk"], "data": cut.tobytes()})
            yield _out(rows, schema)

    return labelled.mapInArrow(run, "axis long, at long, u long, v long, side long, chunk long, data binary")


def face_edges(faces: DataFrame) -> DataFrame:
    """(chunk, la, other, lb): distinct labels of two chunks that touch across a boundary.

    The bricks of both sides are cut alike along the other axes."""
    names = ["chunk", "la", "other", "lb"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = np.frombuffer(row["data"], "<i8"), np.frombuffer(row["facing"], "<i8")
                if len(a) != len(b):
                    raise ValueError("bricks on both sides of a boundary are cut differently")
                both = (a != 0) & (b != 0)
                pairs = np.unique(np.stack((a[both], b[both])), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(pairs.shape[1], row["chunk"])), pa.array(pairs[0]), pa.array(np.full(pairs.shape[1], row["other"])), pa.array(pairs[1])], schema=schema)

    key = ["axis", "at", "u", "v"]
    before = faces.where("side = 0").select(*key, "chunk", "data")
    behind = faces.where("side = 1").select(*key, F.col("chunk").alias("other"), F.col("data").alias("facing"))
    return before.join(behind, key).where("chunk <> other").select("chunk", "data", "other", "facing").mapInArrow(run, "chunk long, la long, other long, lb long").distinct()


def merge_bricks(labelled: DataFrame) -> DataFrame:
    """Bricks with global labels 1, 2, ... in raster order of first voxels.

    ``labelled`` should be a written table: it is read for labels, for faces, and for the result."""
    present = materialise(brick_labels(labelled).where("label <> 0"), "brick-labels")
    firsts = present.groupBy("chunk", "label").agg(F.min(F.struct(*AXES)).alias("first"))
    lut = rename_from(firsts, face_edges(brick_faces(labelled)))
    return rename_bricks(labelled, present.join(lut, ["chunk", "label"]).select(*PLACE, "label", "new"))


def rename_bricks(labelled: DataFrame, lut: DataFrame) -> DataFrame:
    """Replace labels inside each brick by ``lut`` (z0, y0, x0, label, new); others stay."""

    def rename(bricks: pa.Table, names: pa.Table) -> pa.Table:
        old, new = (names.column(c).to_numpy() for c in ("label", "new"))
        order = np.argsort(old)
        old, new = old[order], new[order]
        out = []
        for row, block in _rows(bricks, "<i8"):
            if len(old):
                at = np.minimum(np.searchsorted(old, block), len(old) - 1)
                block = np.where(old[at] == block, new[at], block)
            out.append(row | {"data": block.astype("<i8").tobytes()})
        return pa.Table.from_batches([_out(out)])

    return labelled.groupBy(*PLACE).cogroup(lut.groupBy(*PLACE)).applyInArrow(rename, PACKED)


def unpack(labelled: DataFrame) -> DataFrame:
    """(z, y, x, label) of all voxels but background."""
    schema = pa.schema([(n, pa.int64()) for n in (*AXES, "label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _rows(batch, "<i8"):
                for k, plane in enumerate(block):
                    y, x = np.nonzero(plane)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(len(y), row["z0"] + k), y + row["y0"], x + row["x0"], plane[y, x])], schema=schema)

    return labelled.mapInArrow(run, "z long, y long, x long, label long")
