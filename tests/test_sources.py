"""Raw files, the store of bricks, and jobs on them."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_voxels import GAUSS, as_table, diffuse_numpy, flood

from voxlake.functions.shared import Generations, materialise
from voxlake.functions.volume import Shape
from voxlake.jobs import files
from voxlake.operators import bricks as B
from voxlake.operators import components as C
from voxlake.operators import diffusion as D
from voxlake.operators import histograms as H
from voxlake.sources import raw, store


def dense(df, shape, value="v"):
    out = np.zeros((shape.z, shape.y, shape.x))
    for r in df.collect():
        out[r.z, r.y, r.x] = r[value]
    return out


# ---- the raw source ----------------------------------------------------------------------


def test_a_box_narrows_what_is_read(spark, tmp_path, monkeypatch):
    shape = Shape(40, 30, 20)
    a = np.random.default_rng(0).integers(1, 200, (40, 30, 20)).astype(np.uint8)
    a.tofile(f"{tmp_path}/v.uint8")
    df = raw.read_raw(spark, f"{tmp_path}/v.uint8", shape, planes=4)
    box = raw.read_raw(spark, f"{tmp_path}/v.uint8", shape, low=Shape(10, 5, 7), high=Shape(13, 10, 8))
    want = {(z, y, 7): int(a[z, y, 7]) for z in range(10, 13) for y in range(5, 10)}
    assert {(r.z, r.y, r.x): r.v for r in box.collect()} == want
    assert box.rdd.getNumPartitions() == 1 and df.rdd.getNumPartitions() == 10
    # filters of one query don't reach into another on the same DataFrame
    assert df.where("z = 3 and y = 2").union(df.where("z = 5 or z = 7")).count() == 20 + 2 * 600
    assert df.where("z = 3").count() == 600 and df.count() == a.size
    # what a task reads
    read = []
    monkeypatch.setattr(raw.os, "pread", lambda f, n, at, pread=os.pread: read.append(n) or pread(f, n, at))
    for options, n in (({}, a.size), ({"low": "10,0,7", "high": "13,10,8"}, 30), ({"low": "39,-5,0", "high": "99,99,99"}, 600), ({"low": "5,0,0", "high": "5,30,20"}, 0)):
        reader = raw._Reader({"path": f"{tmp_path}/v.uint8", "shape": "40,30,20"} | options)
        read.clear()
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == sum(read) == n


def test_batches_are_bounded(tmp_path, monkeypatch):
    np.arange(60, dtype=np.uint8).tofile(f"{tmp_path}/v.uint8")
    monkeypatch.setattr(raw, "MOST_VOXELS", 10)
    reader = raw._Reader({"path": f"{tmp_path}/v.uint8", "shape": "2,6,5"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in batches) == 10
    assert np.concatenate([b.column("v").to_numpy() for b in batches]).tolist() == list(range(60))


def test_writer_commits_or_leaves_the_old_file(spark, tmp_path):
    shape, path = Shape(6, 5, 4), f"{tmp_path}/v.uint16"
    a = np.random.default_rng(1).integers(0, 60000, (6, 5, 4))
    raw.write_raw(as_table(spark, a), path, shape, "uint16")
    assert (np.fromfile(path, "<u2").reshape(a.shape) == a).all()
    fails = as_table(spark, a).repartition(4).withColumn("v", F.when(F.col("z") == 3, F.raise_error(F.lit("on purpose")).cast("long")).otherwise(1))
    raw.register(spark)
    with pytest.raises(Exception, match="on purpose"):
        fails.write.format("raw_volume").mode("overwrite").options(path=path, shape="6,5,4", dtype="uint16").save()
    assert (np.fromfile(path, "<u2").reshape(a.shape) == a).all()
    assert [p.name for p in tmp_path.iterdir()] == ["v.uint16"]
    # unsorted rows, rows outside, and a range of an existing file
    rows = spark.createDataFrame([(5, 4, 3, 7), (0, 0, 1, 8), (9, 0, 0, 9), (0, -1, 0, 9)], "z long, y long, x long, v int")
    rows.write.format("raw_volume").mode("append").options(path=path, shape="6,5,4", dtype="uint16").save()
    a[5, 4, 3], a[0, 0, 1] = 7, 8
    assert (np.fromfile(path, "<u2").reshape(a.shape) == a).all()
    rows.limit(0).write.format("raw_volume").mode("overwrite").options(path=path, shape="6,5,4", dtype="uint16").save()
    assert np.fromfile(path, "<u2").sum() == 0 and os.path.getsize(path) == 240


def test_lines_from_a_path_that_only_spark_reads(spark, tmp_path):
    shape = Shape(7, 6, 5)
    a = np.random.default_rng(2).integers(-9, 9, (7, 6, 5))
    a.astype("<i8").tofile(f"{tmp_path}/v.int64")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.voxels.link./in", f"file://{tmp_path}")
    lines = raw.read_lines(spark, "viewfs://voxels/in/v.int64", shape, "int64")
    assert lines.count() == 42
    packed = raw.pack_lines(lines, shape, Shape(4, 4, 3))
    assert (dense(B.unpack(packed), shape, "label") == a).all()
    with pytest.raises(Exception, match="lines are missing"):
        raw.pack_lines(lines.where("y <> 3"), shape, Shape(4, 4, 3)).collect()
    b = raw.pack_lines(raw.read_lines(spark, "viewfs://voxels/in/v.int64", Shape(7, 6, 40), "uint8"), Shape(7, 6, 40), Shape(7, 6, 40), "uint8").first()
    assert b["data"] == a.astype("<i8").tobytes()


def test_packed_files_round_trip(spark, tmp_path):
    shape = Shape(9, 7, 6)
    a = np.random.default_rng(3).integers(0, 3, (9, 7, 6)).astype("<i8")
    a.tofile(f"{tmp_path}/v.int64")
    for brick in (Shape(4, 3, 2), Shape(2, 7, 6), Shape(3, 2, 6), Shape(9, 7, 6)):
        raw.write_packed(raw.read_packed(spark, [(f"{tmp_path}/v.int64", 0, 9)], (7, 6), brick), f"{tmp_path}/w.int64", shape)
        assert (np.fromfile(f"{tmp_path}/w.int64", "<i8").reshape(a.shape) == a).all()
    with pytest.raises(Exception, match="ends before"):
        raw.read_packed(spark, [(f"{tmp_path}/v.int64", 0, 10)], (7, 6), brick).collect()
    bad = raw.read_packed(spark, [(f"{tmp_path}/none.int64", 0, 9)], (7, 6), brick)
    with pytest.raises(Exception, match="no volume"):
        raw.write_packed(bad, f"{tmp_path}/w.int64", shape)
    assert (np.fromfile(f"{tmp_path}/w.int64", "<i8").reshape(a.shape) == a).all() and not list(tmp_path.glob("*.part"))


# ---- jobs ----------------------------------------------------------------------------------


def test_mask_file_to_label_file(spark, tmp_path):
    a = np.random.default_rng(4).random((13, 11, 9)) < 0.4
    shape = Shape(*a.shape)
    (a * 255).astype(np.uint8).tofile(f"{tmp_path}/m.uint8")
    want = flood(a)
    assert files.label_mask_file(spark, f"{tmp_path}/m.uint8", shape, f"{tmp_path}/l.int64", Shape(5, 4, 3)) == want.max()
    assert (np.fromfile(f"{tmp_path}/l.int64", "<i8").reshape(a.shape) == want).all()
    other = np.where(want > 0, want.max() + 1 - want, 0)
    other.astype("<i8").tofile(f"{tmp_path}/o.int64")
    assert files.same_components(spark, f"{tmp_path}/l.int64", f"{tmp_path}/o.int64", shape).count() == 0
    other[np.unravel_index(want.argmax(), a.shape)] = 0
    other.astype("<i8").tofile(f"{tmp_path}/o.int64")
    assert files.same_components(spark, f"{tmp_path}/l.int64", f"{tmp_path}/o.int64", shape).count() >= 2


def test_large_chunk_files_merge_raw_to_raw(spark, tmp_path):
    """128 planes a side in two chunk files, against a labelling of the whole by another algorithm."""
    n = 128
    a = np.random.default_rng(5).random((n, n, n)) < 0.3
    z, y, x = np.nonzero(a)
    want = np.zeros(a.shape, np.int64)
    want[z, y, x] = np.unique(C._label(z, y, x), return_inverse=True)[1] + 1
    for i in range(2):
        B.run_labels(a[i * 64 : (i + 1) * 64]).astype("<i8").tofile(f"{tmp_path}/c{i}.int64")
    began = time.perf_counter()
    assert files.merge_label_files(spark, f"{tmp_path}/c", (n, n), [64, 64], Shape(64, 64, 64)) == want.max()
    assert time.perf_counter() - began < 120
    assert (np.fromfile(f"{tmp_path}/call.int64", "<i8").reshape(a.shape) == want).all()


def test_compare_and_histograms_of_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    shape, brick = Shape(10, 8, 12), Shape(4, 5, 7)
    a, b = (rng.integers(0, 256, (10, 8, 12)) for _ in range(2))
    a.astype(np.uint8).tofile(f"{tmp_path}/a.uint8")
    b.astype("<u2").tofile(f"{tmp_path}/b.uint16")
    d = np.abs(a - b).astype(float)
    got = files.compare_files(spark, f"{tmp_path}/a.uint8", f"{tmp_path}/b.uint16", shape, brick).first()
    assert (got["mean"], got["max"], got["min"], got["stddev"]) == pytest.approx((d.mean(), d.max(), d.min(), d.std()))
    with pytest.raises(Exception, match="no volume"):
        files.compare_files(spark, f"{tmp_path}/a.uint8", f"{tmp_path}/none.uint8", shape).collect()
    want = {(r.axis, r.pos, r.bin): r.n for r in H.axis_histograms(as_table(spark, b), 20, 200, 7, (4, 6), 5).collect()}
    assert {(r.axis, r.pos, r.bin): r.n for r in files.histograms_of_file(spark, f"{tmp_path}/b.uint16", shape, 20, 200, 7, (4, 6), 5, brick).collect()} == want
    field = rng.random((5, 4, 3)).astype("<f4")
    field.tofile(f"{tmp_path}/f.float32")
    want = {(r.fbin, r.vbin): r.n for r in H.field_histogram(as_table(spark, a), shape, as_table(spark, field, "f"), Shape(5, 4, 3), 6, 10, 250, 0.1, 0.9).collect()}
    got = files.field_histogram_of_files(spark, f"{tmp_path}/a.uint8", shape, f"{tmp_path}/f.float32", Shape(5, 4, 3), 6, (10, 250), (0.1, 0.9), brick)
    assert {(r.fbin, r.vbin): r.n for r in got.collect()} == want


# ---- generations -----------------------------------------------------------------------------


def test_ten_repetitions_hold_two_volumes_and_resume(spark, tmp_path, monkeypatch):
    a = (np.random.default_rng(8).random((8, 7, 6)) < 0.1).astype(int)
    shape, brick, kernel = Shape(*a.shape), Shape(4, 4, 6), [0.25, 0.5, 0.25]
    blocks = materialise(D.to_blocks(as_table(spark, a), shape, brick), "test")
    held = []
    monkeypatch.setattr("voxlake.functions.shared.discard", lambda s, p, discard=__import__("voxlake.functions.shared", fromlist=["discard"]).discard: held.append(len(os.listdir(tmp_path / "state"))) or discard(s, p))
    D.diffuse_blocks(blocks, shape, kernel, 3, brick, f"{tmp_path}/state")
    assert os.listdir(tmp_path / "state") == ["generation-000003"]
    os.makedirs(tmp_path / "state" / "generation-000004")  # half written when the job was stopped
    lost = blocks.withColumn("data", F.raise_error(F.lit("the first repetitions ran again")).cast("binary"))
    out = D.diffuse_blocks(lost, shape, kernel, 10, brick, f"{tmp_path}/state")
    assert np.abs(dense(D.from_blocks(out, shape, brick), shape, "u") - diffuse_numpy(a, kernel, 10)).max() < 1e-6
    assert max(held) <= 2 and os.listdir(tmp_path / "state") == ["generation-000010"]
    with pytest.raises(ValueError, match="repetitions old"):
        D.diffuse_blocks(blocks, shape, kernel, 9, brick, f"{tmp_path}/state")
    states = Generations(spark, "diffusion", f"{tmp_path}/state")
    assert states.last()[0] == 10
    states.clear()
    assert states.last() is None


def test_diffusion_job_clears_its_state(spark, tmp_path):
    a = (np.random.default_rng(5).random((9, 8, 7)) < 0.1).astype(np.uint8)
    a.tofile(f"{tmp_path}/m.uint8")
    files.diffuse_file(spark, f"{tmp_path}/m.uint8", GAUSS, f"{tmp_path}/g.uint8", Shape(9, 8, 7), 2, Shape(4, 8, 7), f"{tmp_path}/state")
    got = np.fromfile(f"{tmp_path}/g.uint8", np.uint8).reshape(a.shape).astype(int)
    assert np.abs(got - np.floor(diffuse_numpy(a, GAUSS, 2) * 255)).max() <= 1
    assert not (tmp_path / "state").exists()


# ---- the store -------------------------------------------------------------------------------


def test_store_touches_only_its_bricks(spark, tmp_path):
    shape, brick, path = Shape(12, 10, 9), Shape(4, 5, 9), f"{tmp_path}/store"
    a = np.random.default_rng(9).integers(0, 50, (12, 10, 9))
    store.store_volume(as_table(spark, a), path, shape, brick)
    listed = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    before = listed()
    assert len(before) == 6
    everything = (Shape(0, 0, 0), shape)
    assert (dense(store.read_store(spark, path, *everything, brick), shape) == a).all()
    slab = store.read_store(spark, path, Shape(4, 0, 0), Shape(8, 5, 9), brick).withColumn("v", F.col("v") + 100)
    store.update_store(slab, path, shape, brick)
    a[4:8, :5][a[4:8, :5] > 0] += 100
    assert (dense(store.read_store(spark, path, *everything, brick), shape) == a).all()
    after = listed()
    changed = {p for p in before.keys() ^ after.keys() | {p for p in before.keys() & after.keys() if before[p] != after[p]}}
    assert {p.split("/store/")[1].rsplit("/", 1)[0] for p in changed} == {"z0=4/y0=0/x0=0"}
    # voxels in two far bricks, with values of 0, outside the shape, and in a brick that isn't there
    rows = spark.createDataFrame([(0, 0, 0, 7), (11, 9, 8, None), (12, 0, 0, 1), (5, 6, 2, 0)], "z long, y long, x long, v int")
    store.update_store(rows, path, shape, brick)
    a[0, 0, 0], a[11, 9, 8], a[5, 6, 2] = 7, 0, 0
    assert (dense(store.read_store(spark, path, *everything, brick), shape) == a).all()
    store.update_store(rows.limit(0), path, shape, brick)
    store.store_volume(rows.where("z = 0"), f"{path}2", shape, brick)
    store.update_store(rows.where("z = 5").withColumn("v", F.lit(3)), f"{path}2", shape, brick)
    assert {(r.z, r.v) for r in store.read_store(spark, f"{path}2", *everything, brick).collect()} == {(0, 7), (5, 3)}


def test_store_scans_prune_folders(spark, tmp_path):
    shape, brick, path = Shape(8, 8, 8), Shape(2, 8, 8), f"{tmp_path}/store"
    a = np.arange(1, 513).reshape(8, 8, 8)
    store.store_volume(as_table(spark, a), path, shape, brick)
    box = store.read_store(spark, path, Shape(3, 1, 0), Shape(4, 6, 3), brick)
    assert (dense(box, shape)[3, 1:6, :3] == a[3, 1:6, :3]).all() and box.count() == 15
    plan = box._jdf.queryExecution().executedPlan()
    scan = next(line for line in plan.toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters: [" in scan and "z0" in scan.split("PartitionFilters: [")[1].split("]")[0]
    (tmp_path / "store" / "z0=6" / "y0=0" / "x0=0").chmod(0o755)
    for p in (tmp_path / "store" / "z0=6").rglob("*.parquet"):
        p.write_bytes(b"not parquet")  # never opened
    assert store.read_store(spark, path, Shape(3, 1, 0), Shape(4, 6, 3), brick).count() == 15


# ---- numbering of pairs ------------------------------------------------------------------------


def test_pair_renaming_order(spark):
    labels = spark.createDataFrame([("a", k) for k in (1, 2, 3, 4, 0)] + [("b", k) for k in (1, 2, 3, 5)], "side string, label long")
    edges = spark.createDataFrame([(4, 2), (2, 2), (3, 5)], "la long, lb long")
    got = {(r.side, r.label): r.new for r in C.pair_renaming(labels, edges).collect()}
    assert got == {("a", 2): 1, ("a", 4): 1, ("b", 2): 1, ("a", 3): 2, ("b", 5): 2, ("a", 1): 3, ("b", 1): 4, ("b", 3): 5}
    none = {(r.side, r.label): r.new for r in C.pair_renaming(labels, edges.limit(0)).collect()}
    assert none[("a", 1)] == 1 and none[("b", 5)] == 8


@pytest.mark.parametrize("seed", range(2))
def test_replaced_chunks_equal_a_merge_of_all(spark, seed, monkeypatch):
    """Chunks of random graphs come, go and change; groups are those of the whole graph, components
    that nothing touches keep their numbers and are not looked at again."""
    rng = np.random.default_rng(seed)
    n = 12
    edges = {(c, int(a), c + 1, int(b)) for c in range(5) for a, b in rng.integers(1, n + 1, (5, 2))}
    table = lambda e: spark.createDataFrame(sorted(e), "chunk long, la long, other long, lb long")
    firsts = spark.createDataFrame([(c, k, (c, k, 0)) for c in range(6) for k in range(1, n + 1)], "chunk long, label long, first struct<z: long, y: long, x: long>")
    state = C.merged_chunks(firsts, table(edges))
    sizes = {c: n for c in range(6)}
    seen = []
    monkeypatch.setattr(C, "connected_components", lambda e, find=C.connected_components: seen.append(e.count()) or find(e))

    def groups(state):
        out = {}
        for r in state.labels.collect():
            out.setdefault(r.new, set()).add((r.chunk, r.label))
        return out

    for chunk, size in ((2, 9), (5, 0), (6, 7)):
        before = groups(state)
        gone = {e for e in edges if chunk in (e[0], e[2])}
        new = {(c, int(rng.integers(1, (sizes.get(c, 0) if c != chunk else size) + 1)), c + 1, int(rng.integers(1, (sizes.get(c + 1, 0) if c + 1 != chunk else size) + 1))) for c in (chunk - 1, chunk) for _ in range(4) if size and (sizes.get(c) or c == chunk) and (sizes.get(c + 1) or c + 1 == chunk)}
        edges = edges - gone | new
        sizes[chunk] = size
        state = C.replace_chunk(state, chunk, spark.createDataFrame([(k,) for k in range(1, size + 1)], "label long"), table(new) if new else table(edges).limit(0))
        after = groups(state)
        up = {(c, k): (c, k) for c, m in sizes.items() for k in range(1, m + 1)}

        def root(p, up=up):
            while up[p] != p:
                p = up[p]
            return p

        for c, a, d, b in edges:
            x, y = root((c, a)), root((d, b))
            up[max(x, y)] = min(x, y)
        want = {}
        for p in up:
            want.setdefault(root(p), set()).add(p)
        assert sorted(map(sorted, after.values())) == sorted(map(sorted, want.values()))
        met = {(c, k) for e in gone | new for c, k in (e[:2], e[2:])} | {(chunk, k) for k in range(1, 20)}
        for number, members in before.items():
            if not members & met:
                assert after[number] == members
        assert seen[-1] < len(edges)


def test_chunk_files_that_arrive(spark, tmp_path):
    """Chunks come in any order; a batch that is run again after a crash counts nothing twice."""
    import shutil

    from voxlake.operators import histograms as H
    from voxlake.sources.arriving import stream_chunks
    from voxlake.streaming.histogram import read_histograms, stored_histograms

    a = np.random.default_rng(3).integers(0, 60, (25, 6, 5)).astype(np.uint8)
    parts = [a[:10], a[10:20], a[20:]]
    folder = f"{tmp_path}/state"

    def run():
        stored_histograms(stream_chunks(spark, f"{tmp_path}/part", (6, 5), 10), folder, 1, 50, 5, (3, 2)).awaitTermination()
        return {(r.axis, r.pos, r.bin): r.n for r in read_histograms(spark, folder).collect()}

    def want(n):
        rows = [(int(z), int(y), int(x), int(a[z, y, x])) for z, y, x in np.ndindex(*a[:n].shape)]
        return {(r.axis, r.pos, r.bin): r.n for r in H.axis_histograms(spark.createDataFrame(rows, "z long, y long, x long, v int"), 1, 50, 5, (3, 2)).collect()}

    assert run() == {}
    parts[0].tofile(f"{tmp_path}/part0.uint8")
    parts[2].tofile(f"{tmp_path}/part2.uint8")
    assert run() == want(10)  # the third waits for the second
    parts[1].tofile(f"{tmp_path}/part1.uint8")
    assert run() == want(25)
    commits = sorted((tmp_path / "state/progress/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)  # as if the job had died before it noted its last batch
    assert run() == want(25)
    assert run() == want(25)
    shutil.copy(f"{tmp_path}/part2.uint8", f"{tmp_path}/part3.uint8")
    with pytest.raises(Exception, match="does not hold 10 planes"):
        stored_histograms(stream_chunks(spark, f"{tmp_path}/part", (6, 5), 10), f"{tmp_path}/other", 1, 50, 5, (3, 2)).awaitTermination()
