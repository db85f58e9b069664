"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Weighted shingles: runs of five words, weighted by how often a document holds them.  The
signature follows ProbMinHash: the points of a Poisson process arrive at each shingle at a
rate equal to its weight, each at a random register; a register keeps its first arrival, and
a shingle stops as soon as its next arrival is later than all registers' (early
termination).  The share of equal registers estimates the probability Jaccard similarity

    J_P(x, y) = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i)   over shared shingles i.

1. Documents of equal word sequences collapse to the smallest id.
2. Bands of registers are bucket keys.  Buckets of the same members count once.  In a bucket,
   pairs whose 8-bit registers agree often enough become candidate links; only a spanning
   forest of them leaves the task.
3. Components of candidate links are groups; each group's documents come together, and pairs
   that aren't connected yet are verified by their exact J_P.
4. Components of verified links are the classes.

Large buckets and groups, in steps 2 and 3 alike, are cut into blocks; each block is compared
within itself and with the smallest member, which goes along with every block: linear in the
group.  Only what that leaves unconnected meets again, in pairs of blocks of different
components, so no link is lost; what the first round has joined is not compared again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import materialise, shuffle_partitions
from voxlake.llm.wordhash import Rolling, Texts, U, mix, text_slices
from voxlake.operators.graph import connected_components

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS, ROWS = 120, 5  # 24 bands: at 0.8 a pair is missed once in 13,000
#: Registers that must agree for a candidate link: 4.8 standard deviations under 0.8.
CANDIDATE = 75
BLOCK = 512  # documents of a bucket or group that are compared with each other at once
TASK = ["key", "i", "j"]
SIGNATURES = "doc_id long, k1 long, k2 long, bands array<long>, sig binary"


def shingles(x: Texts, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, weight), distinct within a document and sorted by both.

    A text of fewer than ``size`` words has one shingle, all its words."""
    rolling = Rolling(hashes)
    n = x.n_words
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + x.word_offsets[:-1][doc]
    h = rolling.at(at, np.minimum(n, size)[doc])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def prob_min_hash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The ProbMinHash signature of each document: the shingle that holds each register."""
    earliest = np.full(n_docs * registers, np.inf)
    holder = np.zeros(n_docs * registers, U)
    latest = np.full(n_docs, np.inf)
    who = np.arange(len(doc))
    time = np.zeros(len(doc))
    turn = 0
    while len(who):
        turn += 1
        r = mix(shingle[who] + U((turn * 0x9E3779B97F4A7C15) % 2**64))
        time = time - np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[who]
        live = time < latest[doc[who]]
        who, time, r = who[live], time[live], r[live]
        if not len(who):
            break
        at = doc[who] * registers + (mix(r ^ U(0xD6E8FEB86659FD93)) % U(registers)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        holder[at[won]] = shingle[who[won]]
        touched = np.unique(doc[who])
        latest[touched] = earliest.reshape(n_docs, registers)[touched].max(1)
        live = time < latest[doc[who]]
        who, time = who[live], time[live]
    return holder.reshape(n_docs, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two (sorted shingles, weights)."""
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][ia].astype(float), b[1][ib].astype(float)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    last = np.searchsorted(ratio, ratio, side="right")
    y_upto = np.append(0.0, np.cumsum(y))[last]  # shingles whose ratio is no larger: y decides
    x_from = x.sum() - np.append(0.0, np.cumsum(x))[last]
    return float(np.sum(1.0 / ((x_from + only_x) / x + (y_upto + only_y) / y)))


def word_digests(x: Texts) -> np.ndarray:
    """128 bits of the BLAKE2 digest of each text's words, in two columns."""
    digests = [hashlib.blake2b(b" ".join(x.text(k).split()), digest_size=16).digest() for k in range(len(x.ids))]
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _signatures(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    for x in text_slices(batches, id_col, text_col):
        hashes = x.hashes()
        n = x.n_words
        doc, h, weight = shingles(x, hashes)
        z = prob_min_hash(doc, h, weight, len(n))
        bands = np.full((len(n), REGISTERS // ROWS), U(0x51ED270B0A1F39C1)) + np.arange(REGISTERS // ROWS, dtype=U)
        for k in range(ROWS):
            bands = mix(bands ^ z[:, k::ROWS][:, : REGISTERS // ROWS])
        k1, k2 = word_digests(x).T
        has = np.flatnonzero(n > 0)
        bands, low = bands[has], mix(z[has]).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.ids[has]), pa.array(k1[has].view(np.int64)), pa.array(k2[has].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1]), pa.int32()), pa.array(bands.ravel().view(np.int64))), pa.array([s.tobytes() for s in low], pa.binary())],
            ["doc_id", "k1", "k2", "bands", "sig"],
        )


class Forest:
    """Union-find over ids; remembers the edges that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []
        self.known = False

    def root(self, a: int) -> int:
        up = self.up
        top = a
        while (t := up.get(top, top)) != top:
            top = t
        while a != top:
            up[a], a = top, up.get(a, a)
        return top

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def know(self, a: int, b: int) -> None:
        """``a`` and ``b`` are connected already: no edge."""
        self.known = True
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def batch(self) -> pa.RecordBatch:
        edges = self.edges
        if not self.known:  # as stars: components of links close in fewer rounds
            edges = [(i, top) for i in self.up if (top := self.root(i)) != i]
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Bounds of runs of equal keys."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        col = table.column(k).to_numpy()
        new |= col[1:] != col[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [table.num_rows]))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most_rows:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(_groups(table, keys)[-2])
            if cut:
                yield table.slice(0, cut)
            held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidate_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_groups(batches, TASK):
        forest = Forest()
        ids, seed = table.column("doc_id").to_numpy(), table.column("seed").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        bounds = _groups(table, TASK)
        size = np.diff(bounds)
        small = np.flatnonzero((size > 1) & (size <= 24))
        for n in np.unique(size[small]):
            lo = bounds[:-1][small[size[small] == n]]
            p, q = np.triu_indices(int(n), 1)
            step = max(1, 200_000 // len(p))
            for k in range(0, len(lo), step):
                a, b = (lo[k : k + step, None] + p).ravel(), (lo[k : k + step, None] + q).ravel()
                apart = seed[a] != seed[b]
                a, b = a[apart], b[apart]
                near = (sig[a] == sig[b]).sum(1) >= CANDIDATE
                for u, v in zip(ids[a[near]].tolist(), ids[b[near]].tolist(), strict=True):
                    forest.join(u, v)
        for g in np.flatnonzero(size > 24):
            own = slice(bounds[g], bounds[g + 1])
            _join_near(ids[own].tolist(), seed[own], sig[own], forest)
        yield forest.batch()


def _join_near(ids: list[int], seed: np.ndarray, sig: np.ndarray, forest: Forest) -> None:
    """Breadth first: each document is compared with those not yet reached.  Documents of one
    seed are connected already; whoever reaches one has reached all."""
    mates: dict[int, list[int]] = {}
    for k, m in enumerate(seed.tolist()):
        mates.setdefault(m, []).append(k)
    waiting = np.ones(len(ids), bool)
    for first in range(len(ids)):
        if not waiting[first]:
            continue
        front = list(mates[int(seed[first])])
        waiting[front] = False
        while front:
            k = front.pop()
            rest = np.flatnonzero(waiting)
            if not len(rest):
                return
            for t in rest[(sig[rest] == sig[k]).sum(1) >= CANDIDATE].tolist():
                if waiting[t]:
                    forest.join(ids[k], ids[t])
                    new = mates[int(seed[t])]
                    waiting[new] = False
                    front += new


def _verified_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, TASK, 2000):
            forest = Forest()
            bounds = _groups(table, TASK)
            sets: list[tuple[np.ndarray, np.ndarray]] = []
            for x in text_slices(table.select(["doc_id", "text"]).to_batches(), "doc_id", "text"):
                doc, h, w = shingles(x, x.hashes())
                cut = np.searchsorted(doc, np.arange(len(x.ids) + 1))
                sets += [(h[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            ids = table.column("doc_id").to_pylist()
            for i, m in zip(ids, table.column("seed").to_pylist(), strict=True):
                if i != m:
                    forest.know(i, m)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                _verify(ids[a:b], sets[a:b], threshold, forest)
            yield forest.batch()

    return run


def _verify(ids: list[int], sets: list[tuple[np.ndarray, np.ndarray]], threshold: float, forest: Forest) -> None:
    """Join documents whose exact similarity reaches the threshold, unless they already are."""
    if len(ids) <= 4:
        for p in range(len(ids)):
            for q in range(p):
                if forest.root(ids[p]) != forest.root(ids[q]) and probability_jaccard(sets[p], sets[q]) >= threshold:
                    forest.join(ids[p], ids[q])
        return
    owner = np.repeat(np.arange(len(ids)), [len(h) for h, _ in sets])
    every = np.concatenate([h for h, _ in sets])
    share = np.concatenate([w / max(w.sum(), 1) for _, w in sets])
    order = np.argsort(every, kind="stable")
    every, owner, share = every[order], owner[order], share[order]
    for p in range(1, len(ids)):
        h, w = sets[p]
        lo, hi = np.searchsorted(every, h, "left"), np.searchsorted(every, h, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        # no pair's J_P is above the overlap of its relative weights
        most = np.bincount(owner[at], np.minimum(share[at], np.repeat(w / max(w.sum(), 1), n)), len(ids))[:p]
        for q in sorted(np.flatnonzero(most >= threshold - 1e-9).tolist(), key=lambda k: -most[k]):
            if forest.root(ids[p]) != forest.root(ids[q]) and probability_jaccard(sets[p], sets[q]) >= threshold:
                forest.join(ids[p], ids[q])


def _blocks(rows: DataFrame) -> DataFrame:
    """First round.  ``rows`` has key, n (its rows), least (its smallest id) and doc_id; adds i, j
    and seed.  A large key is cut into blocks, and its smallest member goes to each."""
    nb = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), nb.cast("long")).cast("int")
    to = F.when(F.col("doc_id") == F.col("least"), F.sequence(F.lit(0), nb - 1)).otherwise(F.array(own))
    return rows.withColumn("i", F.explode(to)).withColumn("j", F.lit(0)).withColumn("seed", F.col("doc_id"))


def _block_pairs(rows: DataFrame, found: DataFrame) -> DataFrame | None:
    """Second round, for large keys whose members the first one left in several components (id,
    root): pairs of blocks but those of one component; ``None`` if there is no such key.

    A component of ``BLOCK`` members or more has blocks of its own; the others share some."""
    large = rows.where(F.col("n") > BLOCK).select("key", "doc_id")
    if large.isEmpty():
        return None
    large = large.join(found.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left")
    large = large.withColumn("seed", F.coalesce("root", "doc_id")).drop("root")
    parts = large.groupBy("key", "seed").agg(F.count(F.lit(1)).alias("m"))
    several = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key")
    parts = materialise(parts.join(several, "key", "left_semi"), "near-parts")
    if parts.isEmpty():
        return None
    big = F.col("m") >= BLOCK
    parts = parts.withColumn("part", F.when(big, F.col("seed")))  # null: shares blocks
    shared = parts.groupBy("key", "part").agg(F.ceil(F.sum("m") / F.lit(BLOCK)).cast("int").alias("blocks"))
    # Rows of a key are its large components and one more: ``n / BLOCK`` at most.
    upto = Window.partitionBy("key").orderBy(F.asc_nulls_first("part"))
    placed = shared.withColumn("first", F.sum("blocks").over(upto) - F.col("blocks")).withColumn("all", F.sum("blocks").over(Window.partitionBy("key")))
    where = parts.alias("p").join(placed.alias("q"), (F.col("p.key") == F.col("q.key")) & F.col("p.part").eqNullSafe(F.col("q.part")))
    where = where.select(F.col("p.key").alias("key"), F.col("p.seed").alias("seed"), F.col("p.part").isNotNull().alias("alone"), "blocks", "first", "all")
    members = large.join(where.hint("merge"), ["key", "seed"])
    own = (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long"))).cast("int")
    every = F.sequence(F.lit(0), (F.col("all") - 1).cast("int"))
    other = F.filter(every, lambda b: ~F.col("alone") | (b < F.col("first")) | (b >= F.col("first") + F.col("blocks")))
    members = members.select("key", "doc_id", "seed", own.alias("own"), F.explode(other).alias("other"))
    members = members.select("key", "doc_id", "seed", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return rows.join(members.hint("merge"), ["key", "doc_id"])


def _connected(rows: DataFrame, payload: str, links_of, name: str) -> DataFrame:
    """Components (id, root) of the links among rows of the same key; ``links_of`` finds the links
    in batches of tasks (key, i, j)."""
    parts = shuffle_partitions(rows.sparkSession)

    def round_of(work: DataFrame, which: str) -> DataFrame:
        dealt = work.select(*TASK, "doc_id", "seed", payload).repartition(parts, *TASK).sortWithinPartitions(*TASK, "doc_id")
        return materialise(dealt.mapInArrow(links_of, "a long, b long"), f"{name}-{which}")

    links = round_of(_blocks(rows), "blocks")
    found = materialise(connected_components(links), f"{name}-found")
    again = _block_pairs(rows, found)
    if again is None:
        return found
    more = round_of(again, "pairs")
    stars = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    return found if more.isEmpty() else materialise(connected_components(stars.unionByName(more)), f"{name}-found")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate documents: (doc_id, class_id, kept), one row for each row.

    ``class_id`` is the smallest id of the class, ``kept`` is true for that document.  Two
    documents are linked if the probability Jaccard similarity of their five-word shingles,
    weighted by count, is at least ``threshold``; classes are the components of links.

    Texts without words (null, empty, blank) are in no class but their own.  A text of one to
    four words is one shingle.  Rows with equal ids count as one document each and share the
    flag; rows without an id come back with a null class and ``kept`` true.  Extra columns are
    not carried."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id is not null")
    sigs = materialise(known.mapInArrow(lambda it: _signatures(it, "doc_id", "text"), SIGNATURES), "near-signatures")
    reps = sigs.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    # Signatures of the first of equal texts; of rows that share id and text, one.
    firsts = sigs.join(reps, (sigs["k1"] == reps["k1"]) & (sigs["k2"] == reps["k2"]) & (sigs["doc_id"] == reps["rep"]), "left_semi").select("doc_id", "bands", "sig")
    banded = firsts.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.bit_xor(F.xxhash64("doc_id")).alias("members")).where("n > 1")
    buckets = buckets.groupBy("n", "least", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "least")
    met = banded.join(buckets, "bucket").join(firsts.select("doc_id", "sig"), "doc_id").dropDuplicates(["bucket", "doc_id"])
    met = materialise(met.withColumnRenamed("bucket", "key"), "near-buckets")
    groups = _connected(met, "sig", _candidate_links, "near-candidates")
    sized = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").select(F.col("id").alias("doc_id"), F.col("root").alias("key"), "n", F.col("root").alias("least"))
    # The table of groups grows with the data: never broadcast, at any size the same plan.
    texts = materialise(known.join(sized.hint("merge"), "doc_id"), "near-texts")
    classes = _connected(texts, "text", _verified_links(threshold), "near-links")
    named = reps.join(classes, reps["rep"] == classes["id"], "left").select("k1", "k2", F.coalesce("root", "rep").alias("class_id"))
    worded = sigs.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "class_id")
    blank = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.col("doc_id").alias("class_id"))
    return worded.unionByName(blank).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
