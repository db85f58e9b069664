"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit.  In a superstep documents and open gaps are range-sorted together by
size, largest first.  A sweep over each range gives every document its successor, the smallest
gap that can hold it and that no longer document takes; what is left of a gap stays open in the
range if its size lies there.  What a range leaves over is its longest documents and its smallest
gaps, by rank; the counts of all ranges (a row for each range and length) tell which ranks of one
range meet which of another, and an ordinary join brings them together.  Then gaps shrink and
the next superstep begins.  Sequences are opened in the sweep of the first range, whose documents
nobody else has a gap for; then for documents of more than half the capacity, then, for the
longest documents left, as many as all packings need at least, and where no gap can hold one.

There are as many ranges as shuffle partitions at first, more where they would hold over
``RANGE_ROWS`` rows, then fewer in proportion to what is left, so that a range stays as large and
its sweep goes through as many lengths; a gap too small for all documents left is not dealt again.
Equal sizes are parted by a hash, so a length that a third of all documents have is dealt over
many ranges.  Only counts reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.functions.shared import shuffle_partitions
from voxlake.llm.common import materialise
from voxlake.llm.tokens import Memo, encode_apart, ids_of, offsets_of, tokenizer
from voxlake.llm.wordhash import Texts, U, hash_words, text_slices

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMOS: dict[str, Memo] = {}


def _odd_space(x: Texts) -> np.ndarray:
    """Texts that hold white space other than ASCII space and 09-0D, or control 1C-1F.

    Next to such a character a text can't be cut at ASCII white space."""
    a, b, c = x.data[:-8], x.data[1:-7], x.data[2:-6]
    hit = (a >= 0x1C) & (a <= 0x1F)
    hit |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    hit |= (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    odd = np.zeros(len(x.ids), bool)
    odd[np.searchsorted(x.offsets, np.flatnonzero(hit), side="right") - 1] = True
    return odd


def encode_bytes_slice(path: str, x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, offsets of texts in them) of a byte-level tokenizer.

    Its pattern never joins a word with the white space after it, so a text is cut after
    each word; a piece is white space and a word.  Texts for which that doesn't hold are
    encoded as they are."""
    tok = tokenizer(path)
    memo = _MEMOS.setdefault(path, Memo(1_200_000))
    end = x.end.copy()
    last = x.word_offsets[1:][x.n_words > 0] - 1
    start = np.zeros(len(end), np.int64)
    start[1:] = end[:-1]
    has = x.n_words > 0
    start[x.word_offsets[:-1][has]] = x.offsets[:-1][has]
    # white space after the last word, or a text of nothing else
    tail_from = x.offsets[:-1].copy()
    tail_from[has] = end[last]
    tail_to = x.offsets[1:]
    owner = np.concatenate((x.doc_of_word(), np.arange(len(x.ids))))
    start, end = np.concatenate((start, tail_from)), np.concatenate((end, tail_to))
    order = np.argsort(owner, kind="stable")  # a text's tail after its words
    start, end = start[order], end[order]
    owner = owner[order]
    keep = end > start
    start, end, owner = start[keep], end[keep], owner[keep]
    if len(start):
        h = hash_words(x.data, start, end)
        make = lambda new: encode_apart(tok, [x.data[start[k] : end[k]].tobytes() for k in new.tolist()])
        count, ids = memo.runs(h, make)
    else:
        count, ids = np.empty(0, np.int64), np.empty(0, np.uint32)
    offsets = offsets_of(np.bincount(owner, weights=count, minlength=len(x.ids)).astype(np.int64))
    odd = np.flatnonzero(_odd_space(x))
    if len(odd):
        runs = np.split(ids, offsets[1:-1])
        for k in odd:
            runs[k] = ids_of(tok, x.text(k).decode("utf-8", "replace"))
        ids, offsets = np.concatenate(runs), offsets_of(np.array([len(r) for r in runs]))
    return ids, offsets


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, append ``end_id``, and cut what is longer than ``capacity`` into pieces of
    that length, of which the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in text_slices(batches, id_col, text_col):
            ids, offsets = encode_bytes_slice(vocabulary, x)
            null = x.columns.column(id_col).is_null().to_numpy(zero_copy_only=False)
            raw = memoryview(ids.astype("<u4").tobytes())
            last = int(end_id).to_bytes(4, "little")
            rows: list[tuple] = []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                total = b - a + 1
                size = total % capacity or capacity
                at = piece = 0
                doc = None if null[k] else int(x.ids[k])
                while at < total:
                    to = at + size
                    if to < total:
                        crc = zlib.crc32(raw[4 * (a + at) : 4 * (a + to)])
                    else:
                        crc = zlib.crc32(last, zlib.crc32(raw[4 * (a + at) : 4 * b]))
                    rows.append((doc, piece, at, size, crc))
                    at, piece, size = to, piece + 1, capacity
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, PIECES)


GAP, DOC, PLACED, SHRUNK = 0, 1, 2, 3  # roles of rows
RANGE_ROWS = 20_000  # of documents and gaps, about, at most
INTERVALS = "part int, low long, high long, pair int, first long, step int"
OPENED = "size long, first_rank long, take long, first_seq long, per long"


def sweep(size: list[int], is_doc: list[bool], seq: list[int], at: list[int], capacity: int = 0, first_new: int = 0) -> tuple[list, list, list, list]:
    """One range, largest first, gaps before documents of their size.

    With ``capacity``, for the first range of all, a document without a gap opens a sequence, from
    ``first_new`` on: no other range has a gap for it.

    (documents that found a gap as (place, sequence, offset), places of the others, gaps left as
    (size, sequence, offset) from the largest on, gaps left that are smaller than the range)."""
    low = size[-1] if size else 0
    stack: list[tuple] = []  # open gaps, the smallest last
    later: list[tuple] = []  # rests of gaps that come when the sweep reaches their size
    found, without, smaller = [], [], []
    for k, n in enumerate(size):
        while later and -later[0][0] >= n:
            stack.append(heappop(later))
        if not is_doc[k]:
            stack.append((-n, seq[k], at[k]))
        elif stack:
            room, s, a = stack.pop()
            found.append((k, s, a))
            if -room - n >= max(low, 1):
                heappush(later, (room + n, s, a + n))
            elif -room > n:
                smaller.append((-room - n, s, a + n))
        elif capacity:
            found.append((k, first_new, 0))
            if capacity - n >= max(low, 1):
                heappush(later, (n - capacity, first_new, n))
            elif capacity > n:
                smaller.append((capacity - n, first_new, n))
            first_new += 1
        else:
            without.append(k)
    stack += sorted(later)
    return found, without, [(-n, s, a) for n, s, a in stack], smaller


def _sweeps(schema: pa.Schema, capacity: int, first_new: int):
    """Match within a range; the rest keeps its rank among the range's documents or gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        part = TaskContext.get().partitionId()
        role, size, seq, at = (t.column(c).to_numpy() for c in ("role", "size", "seq", "at"))
        found, without, gaps, smaller = sweep(size.tolist(), (role == DOC).tolist(), seq.tolist(), at.tolist(), 0 if part else capacity, first_new)
        row = t.column("row").combine_chunks()
        row = row.combine_chunks() if isinstance(row, pa.ChunkedArray) else row

        def rows(role: int, size, seq, at, row) -> pa.RecordBatch:
            n = len(size)
            cols = [np.full(n, role), np.full(n, part), np.arange(n), size, seq, at]
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)), row], schema=schema)

        where = np.array([k for k, _, _ in found], int)
        yield rows(PLACED, size[where], [s for _, s, _ in found], [a for _, _, a in found], row.take(pa.array(where)))
        yield rows(DOC, size[without], seq[without], at[without], row.take(pa.array(without, pa.int64())))
        for kind, some in ((GAP, gaps), (SHRUNK, smaller)):
            yield rows(kind, *(list(zip(*some, strict=True)) or ([], [], [])), pa.nulls(len(some), row.type))

    return run


def meet(docs: list[tuple[int, int]], gaps: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(range of documents, first rank, how many, range of gaps) of what meets across ranges,
    from the numbers of documents and gaps that each range leaves, ranges in order.

    The documents of a range come before its gaps, and take the last ones of the ranges before."""
    stack: list[list[int]] = []
    found = []
    n_docs, n_gaps = dict(docs), dict(gaps)
    for part in sorted({*n_docs, *n_gaps}):
        rank, left = 0, n_docs.get(part, 0)
        while left and stack:
            top = stack[-1]
            n = min(left, top[1])
            found.append((part, rank, n, top[0]))
            rank, left, top[1] = rank + n, left - n, top[1] - n
            if not top[1]:
                stack.pop()
        if n_gaps.get(part):
            stack.append([part, n_gaps[part]])
    return found


def open_sequences(counts: dict[int, int], free: int, largest: int, capacity: int, first: int) -> list[tuple[int, int, int, int, int]]:
    """(length, rank of its first document, documents taken, first new sequence, documents in
    each) for the documents left, ``counts`` by length, with ``free`` tokens in gaps."""
    per = lambda k: capacity // k
    need = sum(n for k, n in counts.items() if 2 * k > capacity)
    if not need:
        need = -(-(sum(k * n for k, n in counts.items()) - free) // capacity)
    if need <= 0 and max(counts, default=0) > largest:  # room enough in all, but no gap that holds the longest
        need = sum(-(-n // per(k)) for k, n in counts.items() if k > largest)
    out, rank = [], 0
    for k in sorted(counts, reverse=True):
        if need <= 0:
            break
        opened = min(need, -(-counts[k] // per(k)))
        out.append((k, rank, min(counts[k], opened * per(k)), first, per(k)))
        rank, first, need = rank + counts[k], first + opened, need - opened
    return out


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (``doc_id``, ``piece``, ``length`` from 1 to ``capacity``) its
    ``sequence_id`` and ``offset``; sequences are gapless from 0.

    Repeated rows are pieces each.  An empty table gives an empty result."""
    spark = pieces.sparkSession
    rows = pieces.count()
    parts = max(shuffle_partitions(spark), rows // RANGE_ROWS)
    a_range = max(1, -(-rows // parts))
    cols = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    zero = F.lit(0).cast("long")
    row = F.struct(*cols)
    state = pieces.select(F.lit(DOC).alias("role"), F.col("length").cast("long").alias("size"), zero.alias("seq"), zero.alias("at"), row.alias("row"))
    step_schema = T.StructType().add("role", "integer").add("part", "integer").add("rank", "long").add("size", "long").add("seq", "long").add("at", "long").add("row", state.schema["row"].dataType)
    names = ["role", "size", "seq", "at", "row"]
    placed: list[DataFrame] = []
    n_open = 0
    while True:
        # a hash parts equal sizes; gaps come before documents of their size
        tie = F.xxhash64("seq", "at", "row")
        dealt = state.withColumn("_size", -F.col("size")).withColumn("_tie", tie).repartitionByRange(parts, "_size", "role", "_tie")
        swept = dealt.sortWithinPartitions("_size", "role", "_tie").select(*names).mapInArrow(_sweeps(to_arrow_schema(step_schema), capacity, n_open), step_schema)
        step = materialise(swept, "pack-step")
        placed.append(step.where(F.col("role") == PLACED))
        # At most a row for each range and role, and one more for each length: counts only.
        kinds = F.when(F.col("role") == DOC, F.col("size")).otherwise(0)
        counted = step.groupBy("part", "role", kinds.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("size").alias("most"), F.max("seq").alias("seq")).collect()
        n_open = max([n_open, *(r["seq"] + 1 for r in counted if r["role"] != DOC)])
        counted = [r for r in counted if r["role"] != PLACED]
        lengths: dict[int, dict[int, int]] = {}
        for r in counted:
            if r["role"] == DOC:
                lengths.setdefault(r["part"], {})[r["kind"]] = r["n"]
        n_gaps = {r["part"]: r["n"] for r in counted if r["role"] == GAP}
        met = meet([(p, sum(c.values())) for p, c in lengths.items()], list(n_gaps.items()))
        free = sum(r["total"] for r in counted if r["role"] != DOC)
        taken = {p: 0 for p in lengths}
        for p, _, n, _ in met:
            taken[p] += n
        counts: dict[int, int] = {}
        offsets, before = [], 0
        for p in sorted(lengths):
            skip = taken[p]
            offsets.append((p, taken[p], before))
            for k in sorted(lengths[p], reverse=True):
                n = max(0, lengths[p][k] - skip)
                free -= k * (lengths[p][k] - n)
                skip -= lengths[p][k] - n
                before += n
                if n:
                    counts[k] = counts.get(k, 0) + n
        if not lengths:
            break
        opened = open_sequences(counts, free, max((r["most"] for r in counted if r["role"] != DOC), default=0), capacity, n_open)
        n_open = max([n_open, *(first + -(-take // per) for _, _, take, first, per in opened)])
        # What meets across ranges: the i-th document of a pair with the i-th gap from the end.
        ends, doc_side, gap_side = dict(n_gaps), [], []
        for pair, (p, rank, n, q) in enumerate(met):
            doc_side.append((p, rank, rank + n, pair, rank, 1))
            gap_side.append((q, ends[q] - n, ends[q], pair, ends[q] - 1, -1))
            ends[q] -= n
        number = (F.col("rank") - F.col("first")) * F.col("step")
        inside = lambda side: (F.col("_part") == F.col("part")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))  # noqa: E731, ARG005
        # broadcast: at most two rows for each range
        paired = [step.where(F.col("role") == role).withColumnRenamed("part", "_part").join(F.broadcast(spark.createDataFrame(side, INTERVALS)), inside(side)).withColumn("number", number) for role, side in ((DOC, doc_side), (GAP, gap_side))]
        d = paired[0].select("pair", "number", F.col("size").alias("length"), F.col("row").alias("_row"))
        g = paired[1].select("pair", "number", "size", "seq", "at")
        both = d.join(g.hint("merge"), ["pair", "number"])
        none = F.lit(None).cast(step_schema["row"].dataType)
        across = both.select(F.explode(F.array(_row(PLACED, "length", "seq", "at", F.col("_row")), _row(SHRUNK, F.col("size") - F.col("length"), "seq", F.col("at") + F.col("length"), none))).alias("r")).select("r.*")
        # The rest: documents that open sequences or wait, and gaps that nobody took.
        ranks = F.broadcast(spark.createDataFrame(offsets, "part int, taken long, before long"))  # a row for each range
        waiting = step.where(F.col("role") == DOC).join(ranks, "part").where("rank >= taken").withColumn("number", F.col("before") + F.col("rank") - F.col("taken"))
        waiting = waiting.withColumnRenamed("seq", "_seq").join(F.broadcast(spark.createDataFrame(opened, OPENED)), "size", "left")  # at most `capacity` rows
        own = F.col("number") - F.col("first_rank")
        seq, place = F.col("first_seq") + F.floor(own / F.col("per")).cast("long"), own % F.col("per")
        last = (place == F.col("per") - 1) | (own == F.col("take") - 1)
        goes = own < F.col("take")
        done = _row(PLACED, "size", seq, place * F.col("size"), F.col("row"))
        gap = F.when(last, _row(SHRUNK, F.lit(capacity) - (place + 1) * F.col("size"), seq, (place + 1) * F.col("size"), none))
        stays = _row(DOC, "size", "_seq", "at", F.col("row"))
        new = waiting.select(F.explode(F.when(goes, F.array(done, gap)).otherwise(F.array(stays))).alias("r")).where("r is not null").select("r.*")
        kept = F.broadcast(spark.createDataFrame(list(ends.items()), "part int, n long"))  # a row for each range
        idle = step.where(F.col("role") == GAP).join(kept, "part").where("rank < n").select(*names)
        resolved = materialise(across.unionByName(new).where("size > 0"), "pack-resolved")
        placed.append(resolved.where(F.col("role") == PLACED))
        gaps = idle.unionByName(step.where(F.col("role") == SHRUNK).select(*names)).unionByName(resolved.where(F.col("role") == SHRUNK).select(*names))
        for k, _, take, _, _ in opened:
            counts[k] -= take
        least = min((k for k, n in counts.items() if n), default=None)
        if least is None:
            break
        state = gaps.where(F.col("size") >= least).withColumn("role", F.lit(GAP)).unionByName(resolved.where(F.col("role") == DOC).select(*names))
        parts = max(1, -(-state.count() // a_range))
    out = placed[0].select("seq", "at", "row")
    for p in placed[1:]:
        out = out.unionByName(p.select("seq", "at", "row"))
    return out.select("row.*", F.col("seq").alias("sequence_id"), F.col("at").alias("offset"))


def _row(role: int, size, seq, at, row: Column) -> Column:  # noqa: ANN001
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(F.lit(role).alias("role"), col(size).cast("long").alias("size"), col(seq).cast("long").alias("seq"), col(at).cast("long").alias("at"), row.alias("row"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack the pieces into sequences of ``capacity``.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset).  A null text is
    empty: one piece that holds only the end token.  Rows with a null or repeated id are
    packed like others.  Extra columns are not carried."""
    return best_fit_pack(materialise(token_pieces(docs, vocabulary, capacity, end_id), "pack-pieces"), capacity)
