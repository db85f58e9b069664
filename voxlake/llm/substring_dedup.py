"""Substring dedup by fixed-block anchors.

A window is ``window`` consecutive words of one document.  A word goes if a window that
covers it also starts in a document with a smaller id.  Windows are judged on the input.

1. *Index and probe*: the rolling ``block``-word windows of every document are hashed and
   dealt into buckets; those that start at a multiple of ``block`` are the non-overlapping
   reference blocks, the others only probe them.  As ``2 * block <= window``, every window
   of a document covers a whole reference block of that document, so no repeat is missed.
2. *Extend*: around the hits, and only there, whole windows are hashed; the smallest
   document id of each window decides it.  Windows that overlap merge to maximal repeats.

Both steps are settled within a slice of documents first: a window sends one entry for each
document, and only those that the slice can't decide, so a passage that a third of all
documents hold sends a few entries from each slice.  Hashes travel packed (about ten bytes a
word) and are dealt by hash.  What comes back is a row of positions for each document and
bucket, sort-merged onto the documents, which then stream by; a task holds one slice of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.llm.common import PACK_ARROW, PACK_SCHEMA, materialise, pack, shuffle_partitions, unpack
from voxlake.llm.wordhash import MULT2, Rolling, Texts, U, mix, text_slices, window_starts

WINDOW = 50
SLICE_BYTES = 6 << 20
OUT = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("removed_spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
HITS = "_id long, _tag int, pos array<int>"
NO_ID = np.iinfo(np.int64).max


def _tags(x: Texts) -> np.ndarray:
    """Tells apart documents of one id but different texts."""
    return np.asarray(x.columns.column("_tag"), np.int32)


def _one_per_document(h: np.ndarray, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of document, then position.  (hash, document, least key) of each distinct
    (hash, document), by hash."""
    order = np.argsort(h, kind="stable")
    h, doc, key = h[order], doc[order], key[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    return h[first], doc[first], np.minimum.reduceat(key, first)


def _by_hash(h: np.ndarray, of: Callable, values: np.ndarray) -> np.ndarray:
    """``of.reduceat`` over runs of equal hashes, for each entry."""
    new = np.append(True, h[1:] != h[:-1])
    return of.reduceat(values, np.flatnonzero(new))[np.cumsum(new) - 1]


def _packs(x: Texts, doc: np.ndarray, pos: np.ndarray, bucket: np.ndarray | None, payload: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """Packed entries; decided ones (without a payload) are dealt by document."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    dealt = (mix(x.ids[doc].view(U)) % U(buckets)).astype(np.int32) if bucket is None else bucket[order]
    return pack(dealt, doc, pos, x.ids, _tags(x), None if payload is None else payload[order])


def _probes(id_col: str, text_col: str, block: int, window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in text_slices(batches, id_col, text_col, SLICE_BYTES):
            start, doc = window_starts(x.word_offsets, block)
            keep = (x.n_words >= window)[doc]
            start, doc = start[keep], doc[keep]
            if not len(start):
                continue
            pos = start - x.word_offsets[doc]
            h, doc, key = _one_per_document(Rolling(x.hashes()).at(start, block), doc, pos + ((pos % block != 0).astype(np.int64) << 40))
            anchor, pos, ids = key < 1 << 40, key & ((1 << 40) - 1), x.ids[doc]
            least = _by_hash(h, np.minimum, np.where(anchor, ids, NO_ID))
            hit = (ids > least) | (anchor & (ids < _by_hash(h, np.maximum, ids)))
            if hit.any():
                yield _packs(x, doc[hit], pos[hit], None, None, buckets)
            ask = ids <= least
            yield _packs(x, doc[ask], pos[ask], ((h[ask] >> U(32)) % U(buckets)).astype(np.int32), h[ask].astype(np.uint32), buckets)

    return run


def _hit_rows(done: tuple, found: tuple) -> pa.Table:
    """A row for each document of a slice that decided it, and one for each position found here:
    as many whatever the number of buckets."""
    ids, tags, pos = done
    order = np.lexsort((tags, ids))
    ids, tags, pos = ids[order], tags[order], pos[order]
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))) if len(ids) else np.empty(0, int)
    start = np.concatenate((first, len(ids) + np.arange(len(found[0]) + 1)))
    ids, tags, pos = np.concatenate((ids[first], found[0])), np.concatenate((tags[first], found[1])), np.concatenate((pos, found[2]))
    lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(pos.astype(np.int32)))
    return pa.table({"_id": pa.array(ids), "_tag": pa.array(tags, pa.int32()), "pos": lists})


def _decided_and_rest(packs: pa.Table, payload_type) -> tuple[tuple, tuple]:
    done = packs.column("decided")
    return unpack(packs.filter(done))[:3], unpack(packs.filter(pc.invert(done)), payload_type)


def _hits(block: int):
    def run(packs: pa.Table) -> pa.Table:
        done, (ids, tags, pos, h) = _decided_and_rest(packs, np.uint32)
        if len(ids):
            order = np.argsort(h, kind="stable")
            ids, tags, pos, h = ids[order], tags[order], pos[order], h[order]
            anchor = pos % block == 0
            keep = (ids > _by_hash(h, np.minimum, np.where(anchor, ids, NO_ID))) | (anchor & (ids < _by_hash(h, np.maximum, ids)))
            ids, tags, pos = ids[keep], tags[keep], pos[keep]
        return _hit_rows(done, (ids, tags, pos))

    return run


def _decide(packs: pa.Table) -> pa.Table:
    done, (ids, tags, pos, h) = _decided_and_rest(packs, U)
    if len(ids):
        order = np.argsort(h, kind="stable")
        ids, tags, pos, h = ids[order], tags[order], pos[order], h[order]
        keep = ids > _by_hash(h, np.minimum, ids)
        ids, tags, pos = ids[keep], tags[keep], pos[keep]
    return _hit_rows(done, (ids, tags, pos))


def _with_equal(x: Texts, hashes: Rolling, size: int, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, position) of every window of ``size`` words that equals one given by
    (document, position) in its document: entries stand for all of a document's equal windows."""
    if not len(doc):
        return doc, at
    start, of = window_starts(x.word_offsets, size)
    keep = np.isin(of, doc)
    start, of = start[keep], of[keep]
    own = lambda d, s: mix(hashes.at(s, size) ^ mix(d.astype(U) + U(1)))
    same = np.isin(own(of, start), own(doc, x.word_offsets[doc] + at))
    return of[same], start[same] - x.word_offsets[of[same]]


def _marks(x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(document, position) of the slice's joined positions."""
    column = x.columns.column("_pos")
    n = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return np.repeat(np.arange(len(n)), n), np.asarray(column.flatten(), np.int64)


def _windows(id_col: str, text_col: str, block: int, window: int, buckets: int):
    """Hash the whole windows that cover a hit block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = (b.filter(b.column("_pos").is_valid()) for b in batches)
        for x in text_slices(hit, id_col, text_col, SLICE_BYTES):
            hashes = x.hashes()
            doc, at = _with_equal(x, Rolling(hashes), block, *_marks(x))
            n_starts = np.maximum(x.n_words - window + 1, 0)
            base = x.word_offsets[:-1]
            total = x.word_offsets[-1] + 1
            edge = np.zeros(total + 1, np.int64)
            lo = np.maximum(at - (window - block), 0)
            hi = np.minimum(at + 1, n_starts[doc])
            ok = lo < hi
            np.add.at(edge, base[doc[ok]] + lo[ok], 1)
            np.add.at(edge, base[doc[ok]] + hi[ok], -1)
            start = np.flatnonzero(np.cumsum(edge)[:total] > 0)
            if not len(start):
                continue
            which = np.searchsorted(x.word_offsets, start, side="right") - 1
            h, doc, pos = _one_per_document(Rolling(hashes).at(start, window), which, start - base[which])
            ids = x.ids[doc]
            later = ids > _by_hash(h, np.minimum, ids)
            if later.any():
                yield _packs(x, doc[later], pos[later], None, None, buckets)
            ask = ~later
            other = Rolling(x.hashes(1), MULT2).at(base[doc[ask]] + pos[ask], window)
            yield _packs(x, doc[ask], pos[ask], ((other >> U(16)) % U(buckets)).astype(np.int32), h[ask], buckets)

    return run


def _remove(id_col: str, text_col: str, window: int, schema: pa.Schema, keep_cols: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in text_slices(batches, id_col, text_col):
            doc, at = _marks(x)
            if len(doc):
                doc, at = _with_equal(x, Rolling(x.hashes()), window, doc, at)
            edge = np.zeros(x.word_offsets[-1] + window + 2, np.int64)
            np.add.at(edge, x.word_offsets[doc] + at, 1)
            np.add.at(edge, x.word_offsets[doc] + at + window, -1)
            gone = np.cumsum(edge) > 0
            touched = np.zeros(len(x.ids), bool)
            touched[doc] = True
            n_removed, kept, spans = [], [], []
            for k in range(len(x.ids)):
                words = x.text(k).split()
                if touched[k]:
                    g = gone[x.word_offsets[k] : x.word_offsets[k + 1]]
                    turn = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8)))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
                    n_removed.append(int(g.sum()))
                    words = [w for w, b in zip(words, g.tolist(), strict=True) if not b]
                else:
                    spans.append([])
                    n_removed.append(0)
                kept.append(b" ".join(words))
            new = [pa.array(x.n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, schema.field("removed_spans").type)]
            yield pa.RecordBatch.from_arrays([x.columns.column(c) for c in keep_cols] + new, schema=schema)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the words of ``window``-word passages that a document with a smaller id holds.

    Returns the columns of ``docs`` with ``n_words``, ``n_removed`` (long), ``kept_text``
    (kept words joined by one space) and ``removed_spans`` (half-open word ranges).

    Null and empty texts, and texts shorter than a window: nothing is removed.  Rows without
    an id have no order: they neither remove nor lose words.  Rows that share an id do not
    remove each other's words.  Columns of ``docs`` named like an added one are replaced."""
    if window < 2:
        raise ValueError("window must be at least 2")
    spark = docs.sparkSession
    block, buckets = window // 2, 2 * shuffle_partitions(spark)
    keep_cols = [c for c in docs.columns if c not in (*OUT.fieldNames(), "_id", "_tag", "_pos")]
    schema = T.StructType([*docs.select(*keep_cols).schema.fields, *OUT.fields])
    docs = docs.select(*keep_cols, F.col(id_col).cast("long").alias("_id"), F.hash(text_col).alias("_tag"))
    probes = docs.where("_id is not null").mapInArrow(_probes("_id", text_col, block, window, buckets), PACK_SCHEMA)
    hits = materialise(probes.groupBy("bucket").applyInArrow(_hits(block), HITS), "substring-hits")

    def marked(found: DataFrame) -> DataFrame:
        """The documents, with their positions in ``_pos``; a sort-merge join at every size."""
        own = found.groupBy("_id", "_tag").agg(F.flatten(F.collect_list("pos")).alias("_pos"))
        return docs.join(own.hint("merge"), ["_id", "_tag"], "left")

    windows = marked(hits).mapInArrow(_windows("_id", text_col, block, window, buckets), PACK_SCHEMA)
    repeats = windows.groupBy("bucket").applyInArrow(_decide, HITS)
    return marked(repeats).mapInArrow(_remove("_id", text_col, window, to_arrow_schema(schema), keep_cols), schema)
