"""Approximate nearest neighbours by inner product: inverted lists with adaptive dimension scan.

Vectors get one more component that gives all the same length, so the largest inner product
is the smallest distance, and are turned by a random rotation, so any block of columns is a
fair sample of a distance.  About sqrt(n) centroids part n vectors into lists, in two levels: some
n ** 0.25 coarse centroids, fitted on the driver, and finer ones within each coarse cell, fitted in
the tasks; a vector goes to the nearest fine centroid of its nearest coarse one.  Within each
probed list a scan adds up squared distances column block by column block; after each block a
hypothesis test drops the candidates whose distance is too large to be among the best with high
probability.  What survives is scored exactly: double precision, original vectors.

The index is fitted on samples drawn by a hash of the id: about ``SAMPLE`` rows for the coarse
level, the bounds and the number of probes, and ``PER_LIST`` rows a list for the fine level; every
row is indexed, and all sizes take the same path.  What reaches the driver and is broadcast is the
sample and one centroid for each list, so it grows as the square root of the number of vectors
(10 ** 10 vectors of 64 components: 100,000 lists, 52 MB).  Large lists are cut by a salt, so no task
gets more than about ``MOST_ROWS`` rows of a list.  A query's k-th best score against the sample is
a lower bound of its final k-th best score: list tasks return only what reaches it.  (Taken over
the probed lists, with twice k.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.wordhash import mix

SAMPLE = 8192
PER_LIST = 16  # sampled rows for each fine centroid
MOST_ROWS = 4096
BLOCK = 16  # columns in a scan step
EPSILON = 2.1  # of the test; a larger one drops fewer candidates
ENOUGH = 2  # a query's lists hold so many times k candidates at least, if there are as many
COVER = 0.98  # share of the sample's true neighbours that the probes must reach


@dataclass(frozen=True)
class Index:
    longest: float
    rotation: np.ndarray
    coarse: np.ndarray
    centroids: np.ndarray  # of the lists, those of a coarse cell in a row
    cells: np.ndarray  # bounds of the coarse cells in the lists
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray  # original vectors
    sample_lists: np.ndarray

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Candidates in the rotated space."""
        extra = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.column_stack((x, extra)) @ self.rotation

    def turned_queries(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack((q, np.zeros(len(q)))) @ self.rotation

    def order(self, turned: np.ndarray) -> np.ndarray:
        """Lists by distance of their centroids."""
        return np.argsort(_distances(turned, self.centroids), axis=1, kind="stable")

    def lists_of(self, turned: np.ndarray) -> np.ndarray:
        """The list of each candidate: of its coarse cell's centroids the nearest."""
        cell = np.argmin(_distances(turned, self.coarse), axis=1)
        out = np.zeros(len(turned), np.int64)
        for c in np.unique(cell):
            own = np.flatnonzero(cell == c)
            out[own] = self.cells[c] + np.argmin(_distances(turned[own], self.centroids[self.cells[c] : self.cells[c + 1]]), axis=1)
        return out


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances but for what depends on the row alone."""
    return (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centroids; an empty one moves to a row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds if k > 1 else 1):
        near = np.argmin(_distances(x, centroids), axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
    return centroids


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components added in their order."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def usable(vector: Column, dimension: int) -> Column:
    """Vectors of the dimension without null or non-finite components, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(vector) == dimension) & fine & F.exists(vector, lambda v: v != 0)


def one_in(n: int, wanted: int) -> Column:
    """About ``wanted`` of ``n`` ids, by their hash."""
    return F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // wanted))).cast("long")) == 0


def fit_index(vectors: DataFrame, n: int, longest: float, k: int) -> Index:
    """Fit on samples of ``vectors`` (id, vec); rows that share an id count as one in them."""
    rows = vectors.where(one_in(n, SAMPLE)).groupBy("id").agg(F.min("vec").alias("vec")).collect()  # about SAMPLE rows
    if not rows:  # few rows, and none that the hash takes
        rows = vectors.groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").limit(1).collect()
    rows.sort(key=lambda r: r["id"])
    ids, x = np.array([r["id"] for r in rows], np.int64), np.array([r["vec"] for r in rows], np.float64)
    rng = np.random.default_rng(7)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1] + 1, x.shape[1] + 1)))[0]
    bare = Index(longest, rotation, np.empty(0), np.empty(0), np.empty(0), 1, ids, x, ids)
    t = bare.turned(x)
    lists = max(1, round(math.sqrt(n)))
    coarse = k_means(t, max(1, round(math.sqrt(lists))), 8)
    wanted = PER_LIST * lists

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = np.argmin(_distances(bare.turned(matrix(b.column(1))), coarse), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(1)], ["cell", "vec"])

    def fine(table: pa.Table) -> pa.Table:
        c = table.column("cell")[0].as_py()
        own = matrix(table.column("vec").combine_chunks())
        own = own[np.lexsort(own.T)]  # rows come in any order
        found = k_means(bare.turned(own), max(1, round(len(own) * lists / min(n, wanted))), 9 + c)
        return pa.table({"cell": pa.array([c] * len(found), pa.int32()), "centroid": pa.array(found.tolist(), pa.list_(pa.float64()))})

    chosen = vectors.where(one_in(n, wanted)).groupBy("id").agg(F.min("vec").alias("vec")).select("id", "vec")
    made: list[list] = [[] for _ in coarse]
    for r in chosen.mapInArrow(cells, "cell int, vec array<double>").groupBy("cell").applyInArrow(fine, "cell int, centroid array<double>").collect():  # one row for each list
        made[r["cell"]].append(r["centroid"])
    groups = [np.array(sorted(m)) if m else coarse[c : c + 1] for c, m in enumerate(made)]
    found = Index(longest, rotation, coarse, np.concatenate(groups), np.cumsum([0, *map(len, groups)]), 1, ids, x, ids)
    near = found.lists_of(t)
    trial = np.arange(min(256, len(x)))
    place = np.argsort(found.order(found.turned_queries(x[trial])), axis=1)  # of each list in a query's order
    s = x[trial] @ x.T
    s[trial, trial] = -np.inf
    best = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    reach = np.sort(place[trial[:, None], near[best]].ravel())
    probes = int(reach[min(len(reach) - 1, int(COVER * len(reach)))]) + 1 if len(reach) else len(found.centroids)
    return replace(found, probes=probes, sample_lists=near)


def scan_list(index: Index, k: int, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, c_ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score): each query's ``k`` best candidates of one list that
    reach its bound."""
    tq, tc = index.turned_queries(q), index.turned(c)
    total = tq.shape[1]
    length2 = (q**2).sum(1) + index.longest**2  # distance^2 = length2 - 2 * score
    least = bound.copy()
    out_q, out_c, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for a in range(0, len(c), 1024):
        part, own = tc[a : a + 1024], slice(a, a + 1024)
        most2 = np.where(np.isneginf(least), np.inf, length2 - 2 * least)
        first = min(BLOCK, total)
        near = (tq[:, :first] ** 2).sum(1)[:, None] + (part[:, :first] ** 2).sum(1)[None, :] - 2 * tq[:, :first] @ part[:, :first].T
        ratio = lambda d: 1.0 + 1e-9 if d >= total else d / total * (1 + EPSILON / math.sqrt(d)) ** 2
        keep = near <= (most2 * ratio(first) + 1e-9)[:, None]
        qi, ci = np.nonzero(keep & (q_ids[:, None] != c_ids[own][None, :]))
        d2 = near[qi, ci]
        for d in range(first, total, BLOCK):
            d2 = d2 + ((tq[qi, d : d + BLOCK] - part[ci, d : d + BLOCK]) ** 2).sum(1)
            ok = d2 <= most2[qi] * ratio(min(d + BLOCK, total)) + 1e-9
            qi, ci, d2 = qi[ok], ci[ok], d2[ok]
        score = exact_scores(q[qi], c[own][ci])
        ok = score >= bound[qi]
        qi, ci, score = qi[ok], ci[ok] + a, score[ok]
        qi, ci, score = (np.concatenate(x) for x in ((out_q[-1], qi), (out_c[-1], ci), (out_s[-1], score)))
        order = np.lexsort((c_ids[ci], -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        best = rank < k
        kth = rank == k - 1
        least[qi[kth]] = np.maximum(least[qi[kth]], score[kth])
        out_q, out_c, out_s = [qi[best]], [ci[best]], [score[best]]
    return q_ids[out_q[0]], c_ids[out_c[0]], out_s[0]


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` candidates of largest inner product found for each query row.

    Returns (query_id, rank from 1, vec_id, score), nearest first, ties to the smaller id.
    ``is_query`` is a Boolean column of ``vectors``; candidates are all rows with another id.
    Rows with a null id, and vectors that are null, zero, of another than the commonest
    dimension (the larger of two) or hold a null or non-finite component, take no part.  Rows
    that repeat an id are candidates each; queries that repeat one share a ranking.  Extra
    columns are not carried; an empty table gives an empty result."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("id is not null and vec is not null")
    result = "query_id long, vec_id long, score double"
    common = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dimension = common["d"] if common else 1
    rows = rows.where(usable(F.col("vec"), dimension))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))).alias("longest")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit_index(rows.select("id", "vec"), facts["n"], facts["longest"], k)
    # About SAMPLE vectors and a centroid for each of sqrt(n) lists, see the module.
    shared = spark.sparkContext.broadcast(index)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ix = shared.value
                lists = ix.lists_of(ix.turned(matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column(0), b.column(1)], ["list", "id", "vec"])

    listed = rows.select("id", "vec").mapInArrow(assigned, "list int, id long, vec array<double>")
    sizes = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each list
    held = np.array([sizes.get(a, 0) for a in range(len(index.centroids))], np.int64)
    salts = spark.sparkContext.broadcast(-(-held // MOST_ROWS))  # a number for each list

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in assigned(batches):
            ids, many = b.column(1).to_numpy(), salts.value[b.column(0).to_numpy()]
            h = mix(ids.view(np.uint64) ^ mix(np.ascontiguousarray(matrix(b.column(2))[:, 0]).view(np.uint64)))
            salt = (h % many.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(salt), b.column(1), b.column(2)], ["list", "salt", "id", "vec"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ix = shared.value
            step = max(1, min(256, (1 << 22) // len(ix.centroids)))
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                ids, q = part.column(0).to_numpy(), matrix(part.column(1))
                s = q @ ix.sample.T
                s[ids[:, None] == ix.sample_ids[None, :]] = -np.inf
                order = ix.order(ix.turned_queries(q))
                upto = np.cumsum(held[order], axis=1)  # rows in the lists so far; those of the query's id are no candidates
                lists = np.maximum(ix.probes, 1 + (upto < ENOUGH * k + part.column(2).to_numpy()[:, None]).sum(1))
                lists = np.minimum(lists, len(ix.centroids))
                probed = np.zeros((len(ids), len(ix.centroids)), bool)
                np.put_along_axis(probed, order, np.arange(order.shape[1]) < lists[:, None], axis=1)
                s[~probed[:, ix.sample_lists]] = -np.inf
                spare = 2 * k  # so many of the sample reach the bound: the test may drop some
                bound = np.partition(s, s.shape[1] - spare, axis=1)[:, s.shape[1] - spare] if s.shape[1] >= spare else np.full(len(ids), -np.inf)
                bound = bound - 1e-9 * ix.longest * np.sqrt((q**2).sum(1))  # sums in another order differ in the last digits
                who = np.repeat(np.arange(len(ids)), lists)
                to = order[who, np.arange(len(who)) - np.repeat(np.cumsum(lists) - lists, lists)]
                many = salts.value[to]
                who, to = np.repeat(who, many), np.repeat(to, many)
                salt = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(salt, pa.int32()), pa.array(ids[who]), part.column(1).take(pa.array(who)), pa.array(bound[who])], ["list", "salt", "id", "vec", "bound"])

    asked = rows.where("is_query").dropDuplicates(["id"]).select("id", "vec")
    same = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_same"))
    probes = asked.join(same, "id").select("id", "vec", "n_same").mapInArrow(probing, "list int, salt int, id long, vec array<double>, bound double")
    def scan(q: pa.Table, c: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if q.num_rows and c.num_rows:
            c = c.combine_chunks().sort_by("id")
            q = q.combine_chunks()
            one = lambda t, n: t.column(n).combine_chunks() if isinstance(t.column(n), pa.ChunkedArray) else t.column(n)
            cm, c_ids = matrix(one(c, "vec")), c.column("id").to_numpy()
            parts = []
            for a in range(0, q.num_rows, 512):
                p = q.slice(a, 512)
                parts.append(scan_list(shared.value, k, p.column("id").to_numpy(), matrix(one(p, "vec")), p.column("bound").to_numpy(), c_ids, cm))
            found = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    hits = probes.groupBy("list", "salt").cogroup(rows.select("id", "vec").mapInArrow(salted, "list int, salt int, id long, vec array<double>").groupBy("list", "salt")).applyInArrow(scan, result)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
