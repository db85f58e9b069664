"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's features are hashed: each word, its first six bytes, its last three bytes and
whether it repeats the word before are dimensions, valued ``SCALE`` * count / words, so that a
score does not grow with the length.  One more for each grade but the best is its evidence, which
does not thin out with the length either: the largest value of a word in the document, by how
surely the word is commoner in documents of that grade than of higher ones.  All grades share one
weight vector w; ordered thresholds t_1 < t_2 < ... part them:

    P(grade >= k | x) = sigmoid(w . x - t_k)

The loss is the negative log likelihood of the grades with an L2 penalty, minimised by
AdaGrad over the whole sample, on the dimensions that occur in it.  The expected grade is the sum of the tail probabilities;
documents are selected by a tail probability, whose cut weighs both errors on out-of-fold rows.

The weights are fitted on a bounded sample (``most_labelled``) of the labelled rows; scoring
is one pass without a shuffle over all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.llm.wordhash import Texts, U, hash_words, mix, text_slices

BITS = 18
MOST_LABELLED = 4000
HEAD, TAIL = 6, 3
SCALE = 3.0
SURE = 3.0  # standard errors that are taken off a word's log odds ratio
FOLDS = 3  # every labelled row is scored by a model fitted without it, to set the cut
GOOD_COST = 20.0  # losing a share of the best grade costs this many times as much as keeping that share of the others


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # float32, 2 ** BITS and one for each evidence
    thresholds: np.ndarray  # ascending
    cut: float = 0.5  # documents whose last tail probability is under it are rejected
    evidence: np.ndarray | None = None  # float32, a row of word values for each grade but the best

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by column; no column is above the one before."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def grade(quality: Column, toxic: Column) -> Column:
    """0: low quality; 1: good but toxic; 2: good.  Null ratings give a null grade."""
    return F.when(quality.isNull() | toxic.isNull(), F.lit(None)).when(quality == 0, 0).when(toxic == 1, 1).otherwise(2).cast("int")


def features_of_words(x: Texts) -> np.ndarray:
    """Four hashed dimensions of every word of a slice."""
    mask = U((1 << BITS) - 1)
    whole = x.hashes(11) & mask
    head = hash_words(x.data, x.start, np.minimum(x.end, x.start + HEAD), 12) & mask
    tail = hash_words(x.data, np.maximum(x.start, x.end - TAIL), x.end, 13) & mask
    again = np.zeros(len(whole), U)
    again[1:] = whole[1:] == whole[:-1]
    again[x.word_offsets[:-1][x.n_words > 0]] = 0
    again = mix(again + U(14)) & mask
    return np.stack((whole, head, tail, again), 1).astype(np.int32)


def cores_of_words(x: Texts) -> np.ndarray:
    """Hashes of the words in lower case (A-Z) without ASCII punctuation at their ends."""
    data = x.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    at = np.flatnonzero((data >= 97) & (data <= 122) | (data >= 48) & (data <= 57) | (data >= 128))
    first, last = np.searchsorted(at, x.start), np.searchsorted(at, x.end)
    at = np.append(at, 0)
    some = last > first
    start, end = np.where(some, at[first], x.start), np.where(some, at[last - 1] + 1, x.end)
    return (hash_words(data, start, end, 15) & U((1 << BITS) - 1)).astype(np.int64)


def word_values(words: list[np.ndarray], grades: np.ndarray, n_grades: int) -> np.ndarray:
    """For each grade but the best, by word: the log odds ratio of being in its documents
    against those of higher grades, less ``SURE`` standard errors, 0 at least."""
    held = [np.zeros(1 << BITS) for _ in range(n_grades)]
    for w, g in zip(words, grades, strict=True):
        held[g][w] += 1  # the words of a document are distinct
    size = np.bincount(grades, minlength=n_grades)
    out = np.zeros((n_grades - 1, 1 << BITS), np.float32)
    for g in range(n_grades - 1):
        a, b = held[g] + 0.5, np.sum(held[g + 1 :], 0) + 0.5
        odds = np.log(a / (size[g] + 1 - a)) - np.log(b / (size[g + 1 :].sum() + 1 - b))
        out[g] = np.maximum(odds - SURE * np.sqrt(1 / a + 1 / b), 0)
    return out


Shard = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # index, value, document, grades


def _by_document(index: np.ndarray, value: np.ndarray, doc: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index, value, documents with entries, where theirs begin, how many, grades): entries in
    the order of documents, so that sums and repeats take no lookups."""
    order = np.argsort(doc, kind="stable")
    has, begins, count = np.unique(doc[order], return_index=True, return_counts=True)
    return index[order].astype(np.intp), value[order].astype(float), has, begins, count, own


def fit_ordinal(shards: list[Shard], n_grades: int, l2: float = 1e-4, rounds: int = 250, rate: float = 0.4) -> OrdinalModel:
    """Fit on sparse rows in shards; documents count from 0 in each.  Every round sums the
    gradient over all shards, so only one shard's working arrays exist at a time."""
    grades = np.concatenate([g for *_, g in shards]) if shards else np.empty(0, int)
    n = max(len(grades), 1)
    # only the dimensions that occur: the others keep their weight of 0
    used = np.unique(np.concatenate([np.unique(s[0]) for s in shards])) if shards else np.empty(0, int)
    shards = [_by_document(np.searchsorted(used, index), value, doc, own) for index, value, doc, own in shards]
    w = np.zeros(len(used))
    at_least = np.array([(grades >= k).mean() if len(grades) else 0.5 for k in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(at_least / (1 - at_least))
    first, steps = start[0], np.log(np.maximum(np.diff(start), 1e-3))  # thresholds by log steps: always ordered
    seen_w, seen_t = np.full(len(w), 1e-6), np.full(n_grades - 1, 1e-6)
    for _ in range(rounds if len(grades) else 0):
        t = first + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
        g_w, g_t = l2 * w / n, np.zeros(n_grades - 1)
        for index, value, has, begins, count, own in shards:
            score = np.zeros(len(own))
            if len(index):
                score[has] = np.add.reduceat(w[index] * value, begins)
            tail = 1 / (1 + np.exp(-np.clip(score[:, None] - t, -60, 60)))
            rows = np.arange(len(own))
            upper = np.column_stack((np.ones(len(own)), tail))[rows, own]
            lower = np.column_stack((tail, np.zeros(len(own))))[rows, own]
            slope = np.column_stack((np.zeros(len(own)), tail * (1 - tail), np.zeros(len(own))))
            up, low = slope[rows, own], slope[rows, own + 1]
            p = np.maximum(upper - lower, 1e-9) * n
            np.add.at(g_t, np.maximum(own - 1, 0), np.where(own > 0, up / p, 0))
            np.add.at(g_t, np.minimum(own, n_grades - 2), np.where(own < n_grades - 1, -low / p, 0))
            g_w += np.bincount(index, np.repeat(-(up - low)[has] / p[has], count) * value, len(w))
        g_par = np.concatenate(([g_t.sum()], [g_t[k + 1 :].sum() * np.exp(steps[k]) for k in range(len(steps))]))
        seen_w += g_w**2
        seen_t += g_par**2
        w -= rate * g_w / np.sqrt(seen_w)
        move = rate * g_par / np.sqrt(seen_t)
        first, steps = first - move[0], steps - move[1:]
    weights = np.zeros((1 << BITS) + n_grades - 1, np.float32)
    weights[used] = w
    return OrdinalModel(weights, first + np.concatenate(([0.0], np.cumsum(np.exp(steps)))))


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in text_slices(batches, "doc_id", "text"):
        f = features_of_words(x)
        doc = np.repeat(x.doc_of_word(), f.shape[1])
        key, n = np.unique(doc.astype(np.int64) << BITS | f.ravel(), return_counts=True)
        bounds = np.searchsorted(key, np.arange(len(x.ids) + 1, dtype=np.int64) << BITS)
        index = (key & ((1 << BITS) - 1)).astype(np.int32)
        value = (SCALE * n / np.maximum(x.n_words, 1)[key >> BITS]).astype(np.float32)
        core = np.unique(x.doc_of_word() << BITS | cores_of_words(x))
        ends = np.searchsorted(core, np.arange(len(x.ids) + 1, dtype=np.int64) << BITS)
        core = (core & ((1 << BITS) - 1)).astype(np.int32)
        parts = [pa.array([v[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()) for v, at in ((index, bounds), (value, bounds), (core, ends))]
        yield pa.RecordBatch.from_arrays([x.columns.column("grade"), *parts], ["grade", "index", "value", "words"])


def _shards(rows: list, evidence: np.ndarray, docs: int = 400) -> list[Shard]:
    out = []
    for a in range(0, len(rows), docs):
        part = rows[a : a + docs]
        size = [len(r["index"]) // 4 for r in part]
        index = [np.frombuffer(b"".join(r["index"] for r in part), np.int32)]
        value = [np.frombuffer(b"".join(r["value"] for r in part), np.float32)]
        doc = [np.repeat(np.arange(len(part), dtype=np.int32), size)]
        for k, values in enumerate(evidence):
            index.append(np.full(len(part), (1 << BITS) + k, np.int32))
            value.append(np.array([values[np.frombuffer(r["words"], np.int32)].max(initial=0) for r in part], np.float32))
            doc.append(np.arange(len(part), dtype=np.int32))
        out.append((np.concatenate(index), np.concatenate(value), np.concatenate(doc), np.array([r["grade"] for r in part], int)))
    return out


def _fit_rows(rows: list, n_grades: int) -> OrdinalModel:
    evidence = word_values([np.frombuffer(r["words"], np.int32) for r in rows], np.array([r["grade"] for r in rows], int), n_grades)
    model = fit_ordinal(_shards(rows, evidence), n_grades)
    return OrdinalModel(model.weights, model.thresholds, evidence=evidence)


def _score_rows(rows: list, model: OrdinalModel) -> np.ndarray:
    return np.concatenate([np.empty(0), *(np.bincount(doc, model.weights[index] * value, len(own)) for index, value, doc, own in _shards(rows, model.evidence))])


def _fit_folds(spark: SparkSession, rows: list, fold: np.ndarray, n_grades: int) -> tuple[OrdinalModel, np.ndarray]:
    """(the model of all rows, out-of-fold tails): a task for each fold, and one for all rows.

    The rows are the bounded sample; tasks get them by broadcast and give back a model and scores."""
    shared = spark.sparkContext.broadcast((rows, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, fold = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                model = _fit_rows([r for r, f in zip(rows, fold, strict=True) if f != k], n_grades)
                if k < FOLDS:
                    parts = [b"", b"", b"", model.tails(_score_rows([r for r, f in zip(rows, fold, strict=True) if f == k], model))[:, -1].tobytes()]
                else:
                    parts = [model.weights.tobytes(), model.thresholds.tobytes(), model.evidence.tobytes(), b""]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], ["id", "weights", "thresholds", "evidence", "tails"])

    tail, model = np.zeros(len(rows)), None
    for r in spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "id long, weights binary, thresholds binary, evidence binary, tails binary").collect():
        if r["id"] < FOLDS:
            tail[fold == r["id"]] = np.frombuffer(r["tails"])
        else:
            evidence = np.frombuffer(r["evidence"], np.float32).reshape(n_grades - 1, -1)
            model = OrdinalModel(np.frombuffer(r["weights"], np.float32), np.frombuffer(r["thresholds"]), evidence=evidence)
    return model, tail


def choose_cut(tail: np.ndarray, best: np.ndarray) -> float:
    """The cut of least ``GOOD_COST`` * (share of the best grade under it) + (share of the others
    that reach it).  It is 0 if there are only documents of the best grade, or none of it."""
    if best.all() or not best.any():
        return 0.0
    good, other, cuts = np.sort(tail[best]), np.sort(tail[~best]), np.unique(tail)
    cost = GOOD_COST * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(other, cuts) / len(other)
    return float(cuts[np.argmin(cost)])


def fit_quality(docs: DataFrame, labels: DataFrame, n_grades: int = 3, most_labelled: int = MOST_LABELLED) -> OrdinalModel:
    """Fit on at most ``most_labelled`` labelled ids, drawn by their hash.

    ``labels`` has ``doc_id`` and ``grade``; null grades and ids that ``docs`` lacks take no
    part.  An id that is labelled twice has the lowest of its grades, and one that several
    rows of ``docs`` share counts once, with the first of its texts in order.  ``cut`` is set in the same way at every size, on out-of-fold scores of all rows of
    the sample; copies of a text share a fold.  Without labels the model gives every document the same score."""
    graded = labels.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    one_in = max(1, -(-graded.count() // most_labelled))
    chosen = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in).cast("long")) == 0)  # about most_labelled rows at most
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
    found = rows.select("doc_id", "text", "grade").mapInArrow(_sparse_rows, "grade int, index binary, value binary, words binary").collect()
    found.sort(key=lambda r: (zlib.crc32(r["index"]), r["grade"]))  # the rows come in any order
    fold = np.array([zlib.crc32(r["index"]) % FOLDS for r in found], int)
    best = np.array([r["grade"] == n_grades - 1 for r in found], bool)
    model, tail = _fit_folds(docs.sparkSession, found, fold, n_grades)
    return replace(model, cut=choose_cut(tail, best))


def score_quality(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``score``, ``expected_grade`` and ``tail_1``, ``tail_2``, ... (double) to ``docs``.

    Empty, blank and null texts have no features: their score is 0.  Columns of ``docs``
    named like an added one are replaced; all rows come back."""
    tails = [f"tail_{k + 1}" for k in range(len(model.thresholds))]
    names = ["score", "expected_grade", *tails]
    keep = [c for c in docs.columns if c not in names]
    docs = docs.select(*keep)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in text_slices(batches, id_col, text_col):
            by_word = m.weights[features_of_words(x)].sum(1, dtype=np.float64)
            score = SCALE * np.bincount(x.doc_of_word(), by_word, len(x.ids)) / np.maximum(x.n_words, 1)
            if m.evidence is not None:
                doc, core = x.doc_of_word(), cores_of_words(x)
                for k, values in enumerate(m.evidence):
                    most, tells = np.zeros(len(x.ids), np.float32), np.flatnonzero(values[core])
                    np.maximum.at(most, doc[tells], values[core[tells]])
                    score += m.weights[(1 << BITS) + k] * most
            p = m.tails(score)
            yield pa.RecordBatch.from_arrays([*(x.columns.column(c) for c in keep), pa.array(score), pa.array(p.sum(1)), *(pa.array(p[:, k]) for k in range(p.shape[1]))], schema=arrow)

    return docs.mapInArrow(run, schema)
