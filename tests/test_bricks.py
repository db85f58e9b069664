"""Packed bricks against flood fill."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_voxels import as_table, flood

from voxlake.functions.shared import materialise
from voxlake.functions.volume import Shape
from voxlake.operators import bricks as B


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.floats(0.0, 1.0), st.tuples(*[st.integers(1, 6)] * 3))
def test_run_labels_match_flood_fill(seed, density, size):
    a = np.random.default_rng(seed).random(size) < density
    assert (B.run_labels(a) == flood(a)).all()


@pytest.mark.parametrize("brick", [Shape(5, 4, 3), Shape(1, 1, 1), Shape(32, 32, 32), Shape(16, 2, 8)])
def test_merged_bricks_match_flood_fill(spark, brick):
    a = (np.random.default_rng(7).random((17, 9, 8)) < 0.4).astype(int)
    want = flood(a)
    labelled = materialise(B.label_bricks(B.pack_masks(as_table(spark, a), Shape(*a.shape), brick)), "test")
    merged = materialise(B.merge_bricks(labelled), "test")
    got = np.zeros(a.shape, int)
    for r in B.unpack(merged).collect():
        got[r.z, r.y, r.x] = r.label
    assert (got == want).all()
    names = {r.label: (r.z, r.y, r.x, r["size"]) for r in B.packed_names(merged).collect() if r.label}
    assert names == {int(k): (*(int(c) for c in np.argwhere(want == k)[0]), int((want == k).sum())) for k in np.unique(want) if k}


def test_rows_follow_faces_not_voxels(spark):
    """A full cube: one label a brick, one packed plane a face."""
    n, side = 24, 12
    cube = spark.range(n**3).selectExpr("id div 576 as z", "id div 24 % 24 as y", "id % 24 as x", "1 as v")
    labelled = materialise(B.label_bricks(B.pack_masks(cube, Shape(n, n, n), Shape(side, side, side))), "test")
    assert labelled.count() == B.brick_labels(labelled).count() == 8
    assert B.brick_faces(labelled).count() == 48
    assert B.face_edges(B.brick_faces(labelled)).count() == 12
    assert {r.label for r in B.brick_labels(B.merge_bricks(labelled)).collect()} == {1}


def test_no_bricks(spark):
    none = B.pack_masks(spark.createDataFrame([(0, 0, 0, 0), (9, 0, 0, 1), (0, 0, 0, None)], "z long, y long, x long, v long"), Shape(4, 4, 4), Shape(2, 2, 2))
    assert none.count() == 0
    assert B.unpack(B.merge_bricks(materialise(B.label_bricks(none), "test"))).count() == 0


def test_bricks_cut_differently_are_refused(spark):
    rows = [(0, 0, 0, 0, 1, 2, 2, np.ones(4, "<i8").tobytes()), (1, 1, 0, 0, 1, 3, 2, np.ones(6, "<i8").tobytes())]
    with pytest.raises(Exception, match="cut differently"):
        B.face_edges(B.brick_faces(spark.createDataFrame(rows, B.PACKED))).collect()
