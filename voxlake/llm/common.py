"""Helpers that the training-data operators share: tables and packed rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.shared import materialise, new_folder, shared_folder, shuffle_partitions  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOT = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, counted: DataFrame) -> DataFrame:
    """Inner join on a key that is unique in ``right``, without its column ``n``: how many rows of
    ``left`` have the key.  The sum of ``n`` over ``counted`` is the number of rows of ``left``.

    Keys of a thousandth of the rows or more, ``HOT`` at most, are broadcast; the others shuffle."""
    total = F.lit(counted.agg(F.sum(n)).first()[0] or 0)
    hot = F.broadcast(right.where(F.col(n) * HOT >= total).drop(n))
    rest = right.where(F.col(n) * HOT < total).drop(n)
    cold = left.join(F.broadcast(right.where(F.col(n) * HOT >= total).select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(cold.join(rest.hint("merge"), key))


# ---- packed rows -------------------------------------------------------------
# Entries (document, position, payload) of one bucket travel as a few binary columns:
# far smaller than a row for each entry, and still dealt by an ordinary shuffle.  Entries that
# are decided already only pass through; they carry no payload.

PACK_SCHEMA = "bucket int, decided boolean, ids binary, tags binary, counts binary, pos binary, payload binary"
PACK_ARROW = pa.schema([("bucket", pa.int32()), ("decided", pa.bool_()), *((n, pa.binary()) for n in ("ids", "tags", "counts", "pos", "payload"))])


def _small(x: np.ndarray) -> bytes:
    """One byte that names the width, then the values; the smallest width that holds all."""
    most = int(x.max()) if len(x) else 0
    kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[x[0]], offset=1).astype(np.int64)


def pack(bucket: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, tags: np.ndarray, payload: np.ndarray | None) -> pa.RecordBatch:
    """One row for each bucket.  ``doc`` indexes ``ids`` and ``tags``; entries come by
    document, then position."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket, kind="stable")
    bucket, doc, pos = bucket[order], doc[order], pos[order]
    payload = payload[order] if payload is not None else None
    n = len(bucket)
    new_bucket = np.ones(n, bool)
    new_bucket[1:] = bucket[1:] != bucket[:-1]
    new_doc = new_bucket.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    delta = pos.copy()
    delta[1:] -= pos[:-1]
    delta[new_doc] = pos[new_doc]
    heads = np.flatnonzero(new_doc)
    counts = np.diff(np.append(heads, n))
    head_doc = doc[heads]
    cut = np.append(np.flatnonzero(new_bucket), n)
    head_cut = np.searchsorted(heads, cut)
    rows: list[list] = [[], [], [], [], [], [], []]
    for k in range(len(cut) - 1):
        a, b, u, v = cut[k], cut[k + 1], head_cut[k], head_cut[k + 1]
        rows[0].append(int(bucket[a]))
        rows[1].append(payload is None)
        rows[2].append(ids[head_doc[u:v]].tobytes())
        rows[3].append(tags[head_doc[u:v]].tobytes())
        rows[4].append(_small(counts[u:v]))
        rows[5].append(_small(delta[a:b]))
        rows[6].append(payload[a:b].tobytes() if payload is not None else b"")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, PACK_ARROW.types, strict=True)], schema=PACK_ARROW)


def unpack(packs: pa.Table, payload_type=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(id, tag, position, payload) of every entry of some packed rows."""
    ids, tags, pos, payload = [], [], [], []
    for row in packs.select(["ids", "tags", "counts", "pos", "payload"]).to_pylist():
        counts, delta = _wide(row["counts"]), _wide(row["pos"])
        ids.append(np.repeat(np.frombuffer(row["ids"], np.int64), counts))
        tags.append(np.repeat(np.frombuffer(row["tags"], np.int32), counts))
        upto = np.cumsum(delta)
        first = np.cumsum(counts) - counts
        pos.append(upto - np.repeat(np.where(first > 0, upto[first - 1], 0), counts))
        if payload_type is not None:
            payload.append(np.frombuffer(row["payload"], payload_type))
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return cat(ids, np.int64), cat(tags, np.int32), cat(pos, np.int64), cat(payload, payload_type) if payload_type is not None else None
