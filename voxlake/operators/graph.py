"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.shared import materialise

#: Edges that a task holds at once while it contracts them: some 50 MB.
SLICE = 1_000_000


def stars_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) of each id that isn't the least itself.

    Each turn hooks every tree to the least tree that an edge leads to, then flattens all
    trees, and drops the edges inside one."""
    ids, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    up = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(up, high, low)
        while not np.array_equal(up, flat := up[up]):
            up = flat
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    leaf = np.flatnonzero(up != np.arange(len(ids)))
    return ids[leaf], ids[up[leaf]]


def _contraction(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def stars() -> tuple[np.ndarray, np.ndarray]:
            return stars_of(np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held]))

        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            rows += batch.num_rows
            if rows >= most:
                u, v = stars()
                held, rows = [(u, v)], len(u)
                if 2 * rows > most:  # little left to gain here
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars()], ["u", "v"])

    return run


def _contracted(edges: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Edges (u, v) replaced by stars over the same components, and their number.

    Tasks contract ``most`` edges at a time and no edge moves; what they leave is read by
    fewer tasks again, until one did all or edges got no fewer than half."""
    now, before, tasks = edges, None, None
    while True:
        now = materialise(now.mapInArrow(_contraction(most), "u long, v long"), "components")
        n = now.count()
        if n == 0 or tasks == 1 or (before is not None and 2 * n > before and n > most):
            return now, n
        before, tasks = n, -(-n // most)
        now = now.coalesce(tasks)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame) -> DataFrame:
    """(u, v, m): each directed edge with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def _star_rounds(now: DataFrame, most_rounds: int) -> DataFrame:
    """Alternates large-star and small-star operations (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014) until the edges are stars around their roots.  Minima are
    combined before the shuffle, so a hub costs no more than other ids."""
    before = _state(now)
    for _ in range(most_rounds):
        either = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(either).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        met = _star(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialise(small, "components")
        after = _state(now)
        if after == before:
            return now
        before = after
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, most: int = SLICE) -> DataFrame:
    """(id, root) of every id in ``edges``; root is the smallest id of its component.

    Edges are contracted where they lie, ``most`` at a time: a spanning forest of each part
    keeps all components (Lattanzi et al., "Filtering", 2011).  If more than ``most`` are left,
    star operations go on from there.  Each step is written to the shared folder.  Loops and
    null ends are ignored; an id that has only a loop gets itself as root."""
    both = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    ids = both.where("u = v").select(F.col("u").alias("id")).distinct()
    now, n = _contracted(both.where("u <> v"), most)
    if n > most:
        now = _star_rounds(now, most_rounds)
    found = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    roots = found.select(F.col("root").alias("id")).distinct().withColumn("root", F.col("id"))
    all_found = found.unionByName(roots)
    return all_found.unionByName(ids.join(all_found, "id", "left_anti").withColumn("root", F.col("id")))
