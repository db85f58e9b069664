"""Voxel operators against plain NumPy versions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.functions import pointwise as P
from voxlake.functions.volume import Shape, densify, ranked
from voxlake.jobs import files
from voxlake.jobs.fixtures import synthetic_mask
from voxlake.operators import components as C
from voxlake.operators import diffusion as D
from voxlake.operators import graph
from voxlake.operators import histograms as H
from voxlake.operators.graph import connected_components
from voxlake.sources import images
from voxlake.sources.raw import read_raw, update_raw, write_raw

GAUSS = [float(np.exp(-0.5 * (o / 5) ** 2) / (5 * np.sqrt(2 * np.pi))) for o in range(-20, 21)]


def as_table(spark, a: np.ndarray, value: str = "v"):
    z, y, x = np.nonzero(a)
    rows = [(int(i), int(j), int(k), a[i, j, k].item()) for i, j, k in zip(z, y, x, strict=True)]
    kind = "double" if a.dtype.kind == "f" else "long"
    return spark.createDataFrame(rows, f"z long, y long, x long, {value} {kind}")


def flood(a: np.ndarray) -> np.ndarray:
    """Labels in raster order of first voxels."""
    out = np.zeros(a.shape, int)
    n = 0
    for start in zip(*np.nonzero(a), strict=True):
        if out[start]:
            continue
        n += 1
        todo = [start]
        out[start] = n
        while todo:
            p = todo.pop()
            for axis in range(3):
                for d in (-1, 1):
                    q = list(p)
                    q[axis] += d
                    q = tuple(q)
                    if all(0 <= c < s for c, s in zip(q, a.shape, strict=True)) and a[q] and not out[q]:
                        out[q] = n
                        todo.append(q)
    return out


@pytest.mark.parametrize("planes", [1, 5, 32, Shape(4, 3, 5), Shape(1, 1, 1)])
def test_components_of_any_chunking(spark, planes):
    rng = np.random.default_rng(3)
    a = (rng.random((17, 9, 8)) < 0.35).astype(int)
    want = flood(a)
    got = {(r.z, r.y, r.x): r.label for r in C.components(as_table(spark, a), planes).collect()}
    assert got == {tuple(int(c) for c in p): int(want[p]) for p in zip(*np.nonzero(a), strict=True)}


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([], "z long, y long, x long, v long")
    assert C.components(empty, 4).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**31), st.floats(0.1, 0.9))
def test_chunk_labels_match_flood_fill(seed, density):
    a = np.random.default_rng(seed).random((4, 6, 5)) < density
    if a.any():
        z, y, x = np.nonzero(a)
        got = np.unique(C._label(z, y, x), return_inverse=True)[1] + 1
        assert (got == flood(a)[z, y, x]).all()


@pytest.mark.parametrize("planes", [4, 16])
def test_synthetic_mask_has_five_components(spark, planes):
    found = C.names_and_sizes(C.components(synthetic_mask(spark, 64).where("v > 0"), planes)).collect()
    assert {(r.z, r.y, r.x): r["size"] for r in found} == {(0, 0, 0): 23816, (8, 32, 12): 576, (8, 32, 20): 96, (20, 32, 20): 224, (28, 28, 28): 512}


def test_graph_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (7, 7), (None, 4), (3, 50), (50, 49)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 50: 1, 49: 1, 10: 10, 11: 10, 12: 10, 7: 7}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).count() == 0


@pytest.mark.parametrize("most", [5, 40, 1_000_000])
def test_graph_components_by_slices_and_by_stars(spark, most, monkeypatch):
    """Few edges a slice leave work to the star rounds; a chain, a hub, rings and repeated edges."""
    rng = np.random.default_rng(most)
    chain = [(k, k + 1) for k in range(100)]
    hub = [(900, k) for k in range(200, 290)] + [(900, 900)]
    rings = [(300 + 10 * r + k, 300 + 10 * r + (k + 1) % 10) for r in range(5) for k in range(10)]
    strays = [tuple(int(x) for x in rng.integers(1000, 1150, 2)) for _ in range(70)]
    edges = chain + hub + rings + strays + strays[:20] + [(2**62, -(2**62)), (5, None)]
    edges = [edges[k] for k in rng.permutation(len(edges))]
    up: dict[int, int] = {}
    for _ in range(200):  # by brute force: least labels spread until nothing changes
        was = dict(up)
        for a, b in edges:
            if b is not None:
                up[a] = up[b] = min(up.get(a, a), up.get(b, b))
        if up == was:
            break
    rounds = []
    monkeypatch.setattr(graph, "_star_rounds", lambda now, n, run=graph._star_rounds: rounds.append(now.count()) or run(now, n))
    found = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7), most=most).collect()
    assert len(found) == len(up) and {r.id: r.root for r in found} == up
    assert bool(rounds) == (most < 1000)


def diffuse_numpy(mask: np.ndarray, kernel: list[float], repetitions: int) -> np.ndarray:
    u = (mask > 0).astype(float)
    half = len(kernel) // 2
    for _ in range(repetitions):
        fixed = u == 1.0
        for axis in range(3):
            pad = np.pad(u, [(half, half) if a == axis else (0, 0) for a in range(3)])
            u = sum(w * np.take(pad, range(k, k + u.shape[axis]), axis) for k, w in enumerate(kernel))
        u[fixed] = 1.0
    return u


@pytest.mark.parametrize("kernel", [[1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16], [0.5, 0.25, 0.25], GAUSS])
@pytest.mark.parametrize("repetitions", [0, 1, 2])
def test_diffusion_forms_agree(spark, kernel, repetitions):
    rng = np.random.default_rng(5)
    shape = Shape(7, 6, 5)
    a = (rng.random((7, 6, 5)) < 0.1).astype(int)
    want = diffuse_numpy(a, kernel, repetitions)
    if len(kernel) < 10:
        dense = densify(as_table(spark, a), shape)
        for r in D.diffuse(dense, kernel, repetitions).collect():
            assert r.u == pytest.approx(want[r.z, r.y, r.x], abs=1e-12)
    outside = spark.createDataFrame([(0, 0, 5, 1), (7, 0, 0, 1), (0, -1, 2, 1)], "z long, y long, x long, v long")
    for brick in (3, Shape(4, 2, 3)):  # slabs, and bricks smaller than the kernel
        blocks = D.diffuse_blocks(D.to_blocks(as_table(spark, a).unionByName(outside), shape, brick), shape, kernel, repetitions, brick)
        got = np.zeros(a.shape)
        for r in D.from_blocks(blocks, shape, brick).collect():
            got[r.z, r.y, r.x] = r.u
        assert np.abs(got - want).max() < 1e-6
        assert np.abs(np.floor(got * 255) - np.floor(want * 255)).max() <= 1


@pytest.mark.parametrize("repetitions", [0, 1, 3])
def test_sparse_bricks_hold_the_same_values(spark, repetitions):
    """Two sources far apart: bricks wake as values reach them, and no others are kept."""
    shape, brick = Shape(24, 24, 24), Shape(4, 4, 4)
    volume = spark.createDataFrame([(1, 1, 1, 1), (22, 20, 3, 5), (10, 10, 10, 0), (11, 11, 11, None), (24, 0, 0, 1)], "z long, y long, x long, v long")
    kernel = GAUSS[len(GAUSS) // 2 - 1 : len(GAUSS) // 2 + 2]
    every = D.diffuse_blocks(D.to_blocks(volume, shape, brick), shape, kernel, repetitions, brick)
    sparse = D.diffuse_blocks(D.to_blocks(volume, shape, brick, sparse=True), shape, kernel, repetitions, brick, sparse=True)
    held = {(r.bz, r.by, r.bx): bytes(r.data) for r in every.collect()}
    active = {k: d for k, d in held.items() if np.frombuffer(d, np.float32).any()}
    assert {(r.bz, r.by, r.bx): bytes(r.data) for r in sparse.collect()} == active
    assert len(held) == 216 and 2 <= len(active) <= 2 * (1 + 2 * -(-repetitions // 4)) ** 3
    none = D.to_blocks(volume.where("v = 0"), shape, brick, sparse=True)
    assert D.diffuse_blocks(none, shape, kernel, 1, brick, sparse=True).count() == 0


def test_scatter_matches_correlation(spark):
    shape = Shape(5, 4, 6)
    a = np.random.default_rng(1).random((5, 4, 6)) * (np.random.default_rng(2).random((5, 4, 6)) < 0.3)
    sparse = as_table(spark, a, "u")
    kernel = [0.5, 0.25, 0.125]
    for k, axis in enumerate(("z", "y", "x")):
        pad = np.pad(a, [(1, 1) if j == k else (0, 0) for j in range(3)])
        want = sum(w * np.take(pad, range(i, i + a.shape[k]), k) for i, w in enumerate(kernel))
        got = {(r.z, r.y, r.x): r.u for r in D.scatter_axis(sparse, shape, axis, kernel).collect()}
        for p in np.ndindex(*a.shape):
            assert got.get(p, 0.0) == pytest.approx(want[p], abs=1e-12)


def test_histogram_edges(spark):
    v = spark.createDataFrame([(0, 0, 0, 10), (0, 0, 1, 20), (0, 1, 0, 0), (1, 0, 0, 21), (1, 1, 1, None)], "z long, y long, x long, v int")
    got = {(r.pos, r.bin): r.n for r in H.axis_histogram(v, "z", 10, 20, 4).collect()}
    assert got == {(0, 0): 1, (0, 3): 1}  # the largest value has the top bin to itself
    together = {(r.axis, r.pos, r.bin): r.n for r in H.axis_histograms(v, 10, 20, 4, (0, 0)).collect()}
    apart = {(r.axis, r.pos, r.bin): r.n for a in "zyxr" for r in H.axis_histogram(v, a, 10, 20, 4).collect()}
    assert together == apart
    with pytest.raises(ValueError, match="empty"):
        P.value_bin(F.col("v"), 3, 3, 4)


def test_ranked_counts_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    rows = sorted(ranked(df, ["k"], "n").collect(), key=lambda r: r.k)
    assert [r.n for r in rows] == list(range(1, 1001))


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int64", "float32"])
def test_raw_round_trip(spark, tmp_path, dtype):
    shape = Shape(5, 3, 4)
    a = np.random.default_rng(0).integers(0, 200, (5, 3, 4))
    path = f"{tmp_path}/volume.{dtype}"
    write_raw(as_table(spark, a), path, shape, dtype)
    back = np.zeros(a.shape)
    for r in read_raw(spark, path, shape, dtype, planes=2).collect():
        back[r.z, r.y, r.x] = r.v
    assert (back == a).all()
    assert {r.z for r in read_raw(spark, path, shape, dtype, low=Shape(1, 0, 0), high=Shape(3, 3, 4)).collect()} == {1, 2}
    with pytest.raises(Exception, match="no volume"):
        read_raw(spark, f"{path}.none", shape, dtype).collect()


def test_raw_box_and_safe_rewriting(spark, tmp_path):
    """Voxels outside are left out; a file can be replaced by what is read from it."""
    shape = Shape(4, 3, 4)
    path = f"{tmp_path}/v.uint8"
    rows = spark.createDataFrame([(0, 0, 5, 9), (4, 0, 0, 9), (0, 3, 0, 9), (-1, 0, 0, 9), (1, 2, 3, 7)], "z long, y long, x long, v long")
    write_raw(rows, path, shape)
    want = np.zeros((4, 3, 4), np.uint8)
    want[1, 2, 3] = 7
    assert (np.fromfile(path, np.uint8).reshape(want.shape) == want).all()
    write_raw(read_raw(spark, path, shape).withColumn("v", F.col("v") + 1), path, shape)
    assert (np.fromfile(path, np.uint8).reshape(want.shape) == want + 1).all()
    update_raw(read_raw(spark, path, shape, low=Shape(1, 0, 0), high=Shape(2, 3, 4)).withColumn("v", F.col("v") * 2), path, shape)
    want = want + 1
    want[1] *= 2
    assert (np.fromfile(path, np.uint8).reshape(want.shape) == want).all()
    update_raw(rows, f"{tmp_path}/new.uint8", shape)
    assert np.fromfile(f"{tmp_path}/new.uint8", np.uint8).sum() == 7
    with pytest.raises(ValueError, match="shape"):
        update_raw(rows, path, Shape(5, 3, 4))
    assert not list(tmp_path.glob("*.part"))


@pytest.mark.parametrize("heights", [[4] * 16, [4] * 17, [3, 1, 7, 2, 5]])
def test_label_files_merge(spark, tmp_path, heights):
    """Chunk files labelled apart, with gaps in their labels, make the whole's components."""
    rng = np.random.default_rng(len(heights))
    a = rng.random((sum(heights), 6, 5)) < 0.4
    z0 = 0
    for i, n in enumerate(heights):
        (flood(a[z0 : z0 + n]) * 3).astype("<i8").tofile(f"{tmp_path}/c{i}.int64")
        z0 += n
    want = flood(a)
    assert files.merge_label_files(spark, f"{tmp_path}/c", (6, 5), heights) == want.max()
    assert (np.fromfile(f"{tmp_path}/call.int64", "<i8").reshape(a.shape) == want).all()
    names = {r.label: (r.z, r.y, r.x, r["size"]) for r in files.names_of_label_file(spark, f"{tmp_path}/call.int64", Shape(*a.shape)).collect()}
    assert names == {int(k): (*(int(c) for c in np.argwhere(want == k)[0]), int((want == k).sum())) for k in np.unique(want)}


@pytest.mark.parametrize("repetitions", [0, 1, 2])
def test_diffusion_of_files(spark, tmp_path, repetitions):
    a = (np.random.default_rng(5).random((17, 20, 9)) < 0.1).astype(np.uint8) * 255
    a.tofile(f"{tmp_path}/mask.uint8")
    files.diffuse_file(spark, f"{tmp_path}/mask.uint8", files.gaussian(5, 20), f"{tmp_path}/grey.uint8", Shape(17, 20, 9), repetitions, Shape(8, 6, 5))
    got = np.fromfile(f"{tmp_path}/grey.uint8", np.uint8).reshape(a.shape).astype(int)
    assert np.abs(got - np.floor(diffuse_numpy(a, GAUSS, repetitions) * 255)).max() <= 1
    with pytest.raises(Exception, match="no volume"):
        files.diffuse_file(spark, f"{tmp_path}/none.uint8", GAUSS, f"{tmp_path}/x.uint8", Shape(17, 20, 9))


def png_pixels(path):
    data = open(path, "rb").read()
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + part) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            width, height = (int.from_bytes(part[k : k + 4], "big") for k in (0, 4))
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:]


def test_middle_planes_as_png(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (6, 6, 6)).astype(np.uint8)
    a[3, 2] = 0  # a row without voxels
    a.tofile(f"{tmp_path}/v.uint8")
    assert files.plot_file(spark, f"{tmp_path}/v.uint8", Shape(6, 6, 6), f"{tmp_path}/v.png") == [f"{tmp_path}/v.png"]
    assert (png_pixels(f"{tmp_path}/v.png") == np.hstack((a[3], a[:, 3], a[:, :, 3]))).all()
    b = a[:4, :5]
    paths = images.plot_middle_planes(as_table(spark, b.astype(int)), Shape(4, 5, 6), f"{tmp_path}/b.png")
    for path, want in zip(paths, (b[2], b[:, 2], b[:, :, 3]), strict=True):
        assert (png_pixels(path) == want).all()
    with pytest.raises(ValueError, match="does not end"):
        files.dtype_of("x.bin")


def test_pgm(spark, tmp_path):
    image = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (1, 0, 0.5), (1, 1, 0.25)], "r long, c long, v double")
    images.write_pgm(images.pgm_rows(image, F.col("v")), f"{tmp_path}/image", 2, 2)
    lines = [line for part in sorted((tmp_path / "image").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines == ["P2", "2 2", "255", "0 255", "127 63"]


def test_relabelling_reports_what_it_saw(spark):
    from voxlake.operators import components as C

    rows = [(0, 0, 0, 0, 5), (0, 0, 0, 1, 9), (1, 1, 0, 0, 5), (1, 1, 0, 1, None), (1, 1, 0, 2, 0), (1, 1, 0, 3, -1)]
    labelled = spark.createDataFrame(rows, "chunk long, z long, y long, x long, label long")
    lut = spark.createDataFrame([(0, 5, 7), (1, 5, 50)], "chunk long, label long, new long")
    out, seen = C.relabel_observed(labelled, lut, 9)
    assert sorted(str(r.label) for r in out.collect()) == sorted(str(k) for k in (7, 9, 50, None, 0, -1))
    assert seen == {"voxels": 6, "rejects": 3, "largest": 50}
    assert C.relabel_observed(labelled.limit(0), lut, 9)[1] == {"voxels": 0, "rejects": 0, "largest": None}


def test_stream_histogram(spark, tmp_path):
    from voxlake.streaming.histogram import stream_histogram

    v = spark.range(200).select((F.col("id") % 4).alias("z"), (F.col("id") % 3).alias("y"), F.lit(0).cast("long").alias("x"), (F.col("id") % 50 + 1).cast("int").alias("v"))
    for k in range(2):
        v.where(F.col("z") % 2 == k).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_histogram(stream, "seen", "z", 1, 50, 5, f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    got = {(r.pos, r.bin): r.n for r in spark.table("seen").collect()}
    assert got == {(r.pos, r.bin): r.n for r in H.axis_histogram(v, "z", 1, 50, 5).collect()}
