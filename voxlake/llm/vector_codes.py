"""Product codes of integer vectors: k-means of each part, with Drake-Hamerly adaptive bounds.

A vector is cut into parts; each part position has a codebook.  Between rounds every part keeps
its entry with an upper bound on the distance, the ``b`` entries that come next with ascending
lower bounds, and one outer bound for all others.  When the codebooks move, bounds move by the
entries' drift: a part whose upper bound lies strictly below its first lower bound keeps its entry
without a look at the vector.  All other parts are decided by exact integer distances to the
entries whose lower bounds are not strictly above, so that ties go to the lower index.  ``b``
follows from how many entries the parts of the last round had to look at.

A round is one pass: it writes the state of each vector, with the tasks' sums and counts beside
it, as a generation in the shared folder; two of them exist at a time.  No shuffle but the sums'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.functions.shared import Generations
from voxlake.llm.common import join_counted, materialise

SCALE = 4096
MOST = 1 << 27  # larger integers count as this, so that squared distances fit in 64 bits
FIRST_B = 4
SPARE = 0.02  # share of parts that may need more entries than the next ``b``
FAR = np.iinfo(np.int64).max


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(-1)


@dataclass
class Bounds:
    """Of the parts at one position: entry, upper bound, next entries, and their lower bounds with
    the outer bound as the last column."""

    entry: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray

    def resized(self, b: int) -> Bounds:
        """Lists of ``b`` entries: cut, with the outer bound at the first cut one's, or filled up
        with places that know no more than the outer bound."""
        have = self.near.shape[1]
        if b < have:
            return Bounds(self.entry, self.upper, self.near[:, :b], self.low[:, : b + 1])
        near = np.concatenate((self.near, np.repeat(self.entry[:, None], b - have, 1)), 1)
        low = np.concatenate((self.low, np.repeat(self.low[:, -1:], b - have, 1)), 1)
        return Bounds(self.entry, self.upper, near, low)


def _ordered(low: np.ndarray) -> np.ndarray:
    return np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]


def assign_all(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    """Entries and bounds from the distances to all entries."""
    d = squared(x[:, None, :], book[None])
    order = np.argsort(d, axis=1, kind="stable")  # ties to the lower index
    dist = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
    low = np.full((len(x), b + 1), np.inf)
    low[:, : min(b + 1, len(book) - 1)] = _down(dist[:, 1 : b + 2])
    near = np.repeat(order[:, :1], b, 1)
    near[:, : len(book) - 1] = order[:, 1 : b + 1]
    return Bounds(order[:, 0], _up(dist[:, 0]), near, low)


def reassign(x: np.ndarray, was: Bounds, book: np.ndarray, drift: np.ndarray) -> tuple[Bounds, np.ndarray, int]:
    """(entries and bounds after the book's move by ``drift``, how many listed entries each part
    had to look at, distances computed).  One more than the list means all entries."""
    b = was.near.shape[1]
    entry, near = was.entry.copy(), was.near.copy()
    upper = _up(was.upper + drift[entry])
    low = was.low.copy()
    low[:, :b] = _down(low[:, :b] - drift[near])
    low[:, b] = _down(low[:, b] - drift.max())
    low = _ordered(low)
    need = np.zeros(len(x), np.int64)
    rows = np.flatnonzero(upper >= low[:, 0])
    own = squared(x[rows], book[entry[rows]])
    computed = len(rows)
    upper[rows] = _up(np.sqrt(own.astype(float)))
    still = upper[rows] >= low[rows, 0]
    rows, own = rows[still], own[still]
    need[rows] = (low[rows] <= upper[rows, None]).sum(1)
    some = need[rows] <= b
    r, own = rows[some], own[some]
    if len(r):
        listed = np.arange(b) < need[r, None]
        i, j = np.nonzero(listed)
        dist = np.full((len(r), b + 1), FAR)
        dist[:, 0] = own
        dist[i, j + 1] = squared(x[r[i]], book[near[r[i], j]])
        computed += len(i)
        who = np.concatenate((entry[r, None], near[r]), 1)
        tie = np.where(dist < FAR, who, len(book) + np.arange(b + 1))  # what wasn't looked at stays in place
        order = np.lexsort((tie, dist), axis=1)
        dist, who = np.take_along_axis(dist, order, 1), np.take_along_axis(who, order, 1)
        root = np.sqrt(dist.astype(float))
        entry[r], near[r], upper[r] = who[:, 0], who[:, 1:], _up(root[:, 0])
        low[r, :b] = np.where(dist[:, 1:] < FAR, _down(root[:, 1:]), low[r, :b])
        low[r] = _ordered(low[r])
    r = rows[~some]
    if len(r):
        made = assign_all(x[r], book, b)
        computed += len(r) * len(book)
        entry[r], upper[r], near[r], low[r] = made.entry, made.upper, made.near, made.low
    return Bounds(entry, upper, near, low), need, computed


def next_b(needed: np.ndarray, b: int, most: int) -> int:
    """The fewest listed entries that all but ``SPARE`` of the parts would have done with; one
    more than now if the lists were too short.  ``needed`` counts parts by entries looked at."""
    more = needed.sum() - np.cumsum(needed)
    enough = int(np.flatnonzero(more <= SPARE * max(needed.sum(), 1))[0])
    return max(min(enough if enough <= b else b + 1, most), min(1, most))


def part_bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where each part lies: equal lengths where ``parts`` divides ``dim``."""
    return [(k * dim // parts, (k + 1) * dim // parts) for k in range(parts)]


def _pack(values: list[Bounds]) -> tuple[list[bytes], list[bytes]]:
    """A row's entries (one byte each: own, then listed ones) and bounds (32-bit floats, rounded
    away from the middle) of all parts."""
    names = np.stack([np.concatenate((v.entry[:, None], v.near), 1) for v in values], 1).astype(np.uint8)
    upper, low = np.stack([v.upper for v in values], 1)[:, :, None], np.stack([v.low for v in values], 1)
    with np.errstate(over="ignore"):
        u, w = upper.astype(np.float32), low.astype(np.float32)
    u, w = np.where(u < upper, np.nextafter(u, np.float32(np.inf)), u), np.where(w > low, np.nextafter(w, np.float32(-np.inf)), w)
    both = np.concatenate((u, w), 2).astype("<f4")
    return [r.tobytes() for r in names], [r.tobytes() for r in both]


def _unpack(names: pa.Array, bounds: pa.Array, parts: int) -> list[Bounds]:
    n = len(names)
    e = np.frombuffer(b"".join(names.to_pylist()), np.uint8).reshape(n, parts, -1).astype(np.int64)
    d = np.frombuffer(b"".join(bounds.to_pylist()), "<f4").reshape(n, parts, -1).astype(float)
    return [Bounds(e[:, p, 0], d[:, p, 0], e[:, p, 1:], d[:, p, 1:]) for p in range(parts)]


@dataclass
class Codebooks:
    """One integer matrix (entries, length) for each part, and what the rounds looked at."""

    books: list[np.ndarray]
    listed: list[int]  # ``b`` of each pass
    distances: list[int]  # computed in each pass

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def integers(vector: pa.Array, dim: int) -> np.ndarray:
    flat = vector.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vector), dim)
    return np.clip(np.floor(SCALE * flat), -MOST, MOST).astype(np.int64)


def _small(x: np.ndarray) -> list[bytes]:
    """Vectors in 16 bits, or in 32 where a component of the batch asks for them."""
    return [r.tobytes() for r in x.astype("<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4")]


def _wide(rows: list[bytes], dim: int) -> np.ndarray:
    """Vectors of either width: batches of other rows than they were written in may come."""
    short = np.array([len(r) == 2 * dim for r in rows])
    out = np.empty((len(rows), dim), np.int64)
    for kind, which in (("<i2", short), ("<i4", ~short)):
        if which.any():
            out[which] = np.frombuffer(b"".join(rows[k] for k in np.flatnonzero(which)), kind).reshape(which.sum(), dim)
    return out


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """((id, label, code, error, label_error), codebooks) of all vectors that can be coded.

    ``code`` holds two hex digits for each part, ``error`` is the squared distance to the entries,
    summed over parts, ``label_error`` the sum of ``error`` over rows of the same label (nulls are
    one label).  Codebooks start as the parts of the ``entries`` smallest ids (ties by the
    vector, null ids last; fewer rows make fewer entries, 256 at most).

    Rows whose vector is null or holds null or non-finite components are left out, and so are ones
    of another length than the vector of the smallest id.  Repeated ids are rows of their own;
    extra columns don't come back.  A length that the parts don't divide gives parts that differ by
    one.  Integers beyond 2**27 count as 2**27.  An empty table gives no rows and no entries."""
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("entries are numbered by one byte")
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = vectors.where(v.isNotNull() & finite).select(F.col(id_col), F.col(label_col), v.alias("_v"))
    firsts = usable.orderBy(F.col(id_col).asc_nulls_last(), "_v").limit(entries).collect()  # `entries` rows
    dim = len(firsts[0]["_v"]) if firsts else 0
    if any(len(r["_v"]) != dim for r in firsts):
        firsts = usable.where(F.size("_v") == dim).orderBy(F.col(id_col).asc_nulls_last(), "_v").limit(entries).collect()
    usable = usable.where(F.size("_v") == dim)
    whole = integers(pa.array([r["_v"] for r in firsts], pa.list_(pa.float64())), dim) if firsts else np.empty((0, 0), np.int64)
    cuts = part_bounds(dim, parts)
    now = Codebooks([whole[:, a:b] for a, b in cuts], [], [])
    id_type, label_type = vectors.schema[id_col], vectors.schema[label_col]
    coded = T.StructType([id_type, label_type, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not firsts:
        return spark.createDataFrame([], coded).withColumn("label_error", F.lit(0).cast("long")), now
    kept = T.StructType([id_type, label_type]).add("ints", "binary").add("names", "binary").add("bounds", "binary").add("totals", T.ArrayType(T.LongType()))
    states = Generations(spark, "vector-codes")
    k, most = len(firsts), max(len(firsts) - 1, 0)
    b, drift, state = min(FIRST_B, most), None, None
    for r in range(rounds):
        state = states.write(r, (state if r else usable).mapInArrow(_pass(now.books, drift, b, dim, cuts, kept, id_col, label_col), kept))
        found = state.where("totals is not null").select(F.posexplode("totals").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
        totals = np.zeros(k * (dim + parts) + b + 3, np.int64)
        for row in found.collect():  # of fixed size: the codebooks' own
            totals[row["at"]] = row["n"]
        now.listed.append(b)
        now.distances.append(int(totals[-1]))
        moved = []
        at = 0
        for (lo, hi), book in zip(cuts, now.books, strict=True):
            sums, n = totals[at : at + k * (hi - lo)].reshape(k, hi - lo), totals[at + k * (hi - lo) : at + k * (hi - lo + 1)]
            at += k * (hi - lo + 1)
            moved.append(np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], book))
        drift = [_up(np.sqrt(squared(new, old).astype(float))) for new, old in zip(moved, now.books, strict=True)]
        b = next_b(totals[-b - 3 : -1], b, most) if r else b
        now.books = moved
        state = state.where("totals is null")
    last = usable if state is None else state
    final = materialise(last.mapInArrow(_pass(now.books, drift, b, dim, cuts, coded, id_col, label_col), coded), "vector-codes")
    states.clear()
    key = F.when(F.col(label_col).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(label_col).cast("string")))
    keyed = final.withColumn("_key", key)
    by_label = materialise(keyed.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    return join_counted(keyed, by_label, "_key", "_n", by_label).select(*coded.fieldNames(), "label_error"), now


def _pass(books: list[np.ndarray], drift: list[np.ndarray] | None, b: int, dim: int, cuts: list[tuple[int, int]], schema: T.StructType, id_col: str, label_col: str):  # noqa: ANN202
    """One pass over vectors (without bounds) or states: new states and the task's totals, or codes
    and errors if the schema asks for them."""
    arrow = to_arrow_schema(schema)
    k, parts = len(books[0]), len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((k, hi - lo), np.int64) for lo, hi in cuts]
        n = np.zeros((parts, k), np.int64)
        needed, computed = np.zeros(b + 2, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            if "ints" in names:
                x = _wide(batch.column("ints").to_pylist(), dim)
                was = _unpack(batch.column("names"), batch.column("bounds"), parts)
            else:
                x, was = integers(batch.column("_v"), dim), None
            made = []
            for p, ((lo, hi), book) in enumerate(zip(cuts, books, strict=True)):
                own = x[:, lo:hi]
                if was is None:
                    got, need, looked = assign_all(own, book, b), np.full(len(own), b + 1), len(own) * k
                else:
                    got, need, looked = reassign(own, was[p].resized(b), book, drift[p])
                made.append(got)
                needed += np.bincount(need, minlength=b + 2)
                computed += looked
                n[p] += np.bincount(got.entry, minlength=k)
                for c in range(hi - lo):
                    # sums of integers are exact in doubles below 2**53: 2**26 rows of a batch at the most
                    sums[p][:, c] += np.bincount(got.entry, weights=own[:, c], minlength=k).astype(np.int64)
            ids, labels = batch.column(id_col), batch.column(label_col)
            if "code" in schema.fieldNames():
                codes = np.stack([m.entry for m in made], 1).astype(np.uint8)
                error = sum((squared(x[:, lo:hi], book[m.entry]) for (lo, hi), book, m in zip(cuts, books, made, strict=True)), np.zeros(len(x), np.int64))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], schema=arrow)
                continue
            entry, bounds = _pack(made)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(_small(x), pa.binary()), pa.array(entry, pa.binary()), pa.array(bounds, pa.binary()), pa.nulls(len(x), arrow.field("totals").type)], schema=arrow)
        if "totals" in schema.fieldNames():
            flat = np.concatenate([*(np.concatenate((s.ravel(), c)) for s, c in zip(sums, n, strict=True)), needed, [computed]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(arrow)[:-1]), pa.array([flat.tolist()], arrow.field("totals").type)], schema=arrow)

    return run


def codes_sql(dim: int = 64, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The query in SQL, for vectors of ``dim`` components: rounds unrolled, all distances computed."""
    long = dim // parts
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"comp AS MATERIALIZED (SELECT vec_id, i // {long} AS p, i % {long} AS j, v[i + 1] AS x FROM kept, (SELECT unnest(range(0, {dim})) AS i))",
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT p, e, j, x AS c FROM comp JOIN firsts USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM comp JOIN b{r} USING (p, j) GROUP BY ALL)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min((d, e)) AS w FROM d{r} GROUP BY ALL)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT p, w[2] AS e, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM a{r} JOIN comp USING (vec_id, p) GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, j, coalesce(s{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN s{r} USING (p, e, j))")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', w[2]), '' ORDER BY p) AS code, CAST(sum(w[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,"
        f" (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"
    )
