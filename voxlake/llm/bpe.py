"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut into pieces, each a word with the white space after it, and into chunks of
pieces where a rolling hash of the last pieces says so; texts that share a passage share its
chunks.  The bytes of a chunk are encoded as one text, once, and reused by their digest, within
a worker and across documents and tasks.  A join of two chunks stands if the pieces around it
come out together as they do on each side.  Where they don't, the join is re-encoded over
ever more pieces until two widths agree on what to replace on each side; if that doesn't fit
the chunks' ids, the whole text is encoded in one go.

No shuffle: texts are read once, and only their ids leave the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.llm.tokens import Memo, encode_apart, gather, ids_of, offsets_of, tokenizer
from voxlake.llm.wordhash import Rolling, Texts, U, hash_words, mix, text_slices

ROLL = 8  # pieces that decide about a cut
CUT_MASK = 255  # a chunk has about this many pieces
AROUND = 2  # pieces on each side that a join is first judged by
RIM = 3  # ids next to a join that a chunk has to share with what the join was judged by
NONE = 2**32 - 1
_MEMOS: dict[str, tuple[Memo, Memo]] = {}


def _memos(path: str) -> tuple[Memo, Memo]:
    """Of chunks and of joins, by hash; bounded."""
    if path not in _MEMOS:
        _MEMOS[path] = (Memo(60_000), Memo(300_000))
    return _MEMOS[path]


def pieces_of(x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(starts in the data with the end of all after the last, offsets of texts in them).

    A piece is a word and what follows it up to the next word; a text's first piece begins
    with the text.  A text of nothing but white space is one piece."""
    start = x.start.copy()
    has = x.n_words > 0
    start[x.word_offsets[:-1][has]] = x.offsets[:-1][has]
    blank = x.offsets[:-1][~has & (np.diff(x.offsets) > 0)]
    start = np.sort(np.concatenate((start, blank)))
    return np.append(start, x.offsets[-1]), np.searchsorted(start, x.offsets)


def chunk_starts(rolling: Rolling, offsets: np.ndarray) -> np.ndarray:
    """First pieces of the content-defined chunks; every text with pieces begins one."""
    n = int(offsets[-1])
    start = np.zeros(n + 1, bool)
    if n > ROLL:
        h = rolling.at(np.arange(n - ROLL), ROLL)
        start[ROLL:n] = (h & U(CUT_MASK)) == 0
    start[offsets] = True
    start[n] = False
    return np.flatnonzero(start)


def chunk_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2 digest of each chunk's bytes: rolling hashes of built texts can
    meet (those of a Thue-Morse word and its complement do), digests don't."""
    raw = memoryview(data)
    digests = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), "<u8")


def splice(left: np.ndarray, right: np.ndarray, both: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(ids lost at the end of ``left``, ids lost at the start of ``right``, ids between): what
    makes ``both`` of the ids of two sides."""
    n = min(len(left), len(both))
    differ = np.flatnonzero(left[:n] != both[:n])
    head = int(differ[0]) if len(differ) else n
    n = min(len(right), len(both) - head)
    differ = np.flatnonzero(right[len(right) - n :][::-1] != both[len(both) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return len(left) - head, len(right) - tail, both[head : len(both) - tail]


def encode_slice(path: str, x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, offsets of texts in them)."""
    tok, (chunk_memo, join_memo) = tokenizer(path), _memos(path)
    n_doc = len(x.ids)
    at, texts = pieces_of(x)
    if len(at) == 1:
        return np.empty(0, np.uint32), np.zeros(n_doc + 1, np.int64)
    rolling = Rolling(hash_words(x.data, at[:-1], at[1:]))
    first = chunk_starts(rolling, texts)
    bounds = np.append(first, texts[-1])
    size = np.diff(bounds)
    count, ids = chunk_memo.runs(chunk_keys(x.data, at[bounds[:-1]], at[bounds[1:]]), lambda new: encode_apart(tok, [x.data[at[bounds[k]] : at[bounds[k + 1]]].tobytes() for k in new.tolist()]))
    doc = np.searchsorted(texts, first, side="right") - 1
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1  # chunks that have one before them in their text
    bad: list[int] = []
    if len(inner):
        a, b = first[inner] - np.minimum(size[inner - 1], AROUND), first[inner] + np.minimum(size[inner], AROUND)

        def joins(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For each join: 1 if the ids of its sides stand side by side, then the last ids of
            the left side, from the join on, and the first ones of the right side."""
            texts_of = [x.data[at[u] : at[v]].tobytes() for k in new.tolist() for u, v in ((a[k], first[inner[k]]), (first[inner[k]], b[k]), (a[k], b[k]))]
            n, found = encode_apart(tok, texts_of)
            runs = np.split(found, np.cumsum(n)[:-1])
            out = np.full((len(new), 1 + 2 * RIM), NONE, np.uint32)
            for k, row in enumerate(out):
                left, right, both = runs[3 * k : 3 * k + 3]
                row[0] = np.array_equal(np.concatenate((left, right)), both)
                near, far = left[::-1][:RIM], right[:RIM]
                row[1 : 1 + len(near)], row[1 + RIM : 1 + RIM + len(far)] = near, far
            return np.full(len(new), out.shape[1], np.int64), out.ravel()

        key = chunk_keys(x.data, at[a], at[b]) ^ mix((at[b] - at[first[inner]]).astype(U))
        judged = join_memo.runs(key, joins)[1].reshape(len(inner), -1)
        stands, end = judged[:, 0] == 1, offsets_of(count)[:-1][inner]
        for k in range(RIM):
            for seen, place, within in ((judged[:, 1 + k], end - 1 - k, count[inner - 1] > k), (judged[:, 1 + RIM + k], end + k, count[inner] > k)):
                stands &= (seen == NONE) | within & (ids[np.clip(place, 0, len(ids) - 1)] == seen)
        bad = np.unique(doc[inner[~stands]]).tolist()
    offsets = offsets_of(np.bincount(doc, weights=count, minlength=n_doc).astype(np.int64))
    if not bad:
        return ids, offsets
    runs = np.split(ids, offsets[1:-1])
    parts = np.split(ids, offsets_of(count)[1:-1])
    for d in bad:
        lo, hi = np.searchsorted(doc, (d, d + 1))
        runs[d] = _repair(tok, x.data, at, parts[lo:hi], bounds[lo : hi + 1])
    return np.concatenate(runs), offsets_of(np.array([len(r) for r in runs]))


def _repair(tok, data: np.ndarray, at: np.ndarray, parts: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """The ids of one text from those of its chunks, whose first pieces are ``bounds``."""
    ids = lambda a, b: ids_of(tok, data[at[a] : at[b]].tobytes().decode("utf-8", "replace"))
    done = parts[0]
    for k in range(1, len(parts)):
        low, here, high = bounds[k - 1 : k + 2].tolist()
        width, before = AROUND, None
        while True:
            a, b = max(low, here - width), min(high, here + width)
            left, right, both = ids(a, here), ids(here, b), ids(a, b)
            lost_left, lost_right, between = splice(left, right, both)
            now = (lost_left, lost_right, between.tobytes())
            # what goes, and the ids next to it, must be the chunks' own
            n_left, n_right = min(len(left), lost_left + RIM), min(len(right), lost_right + RIM)
            fits = n_left <= len(done) and np.array_equal(done[len(done) - n_left :], left[len(left) - n_left :]) and np.array_equal(parts[k][:n_right], right[:n_right])
            reached = (a > low and lost_left == len(left)) or (b < high and lost_right == len(right))  # no id at the rim agrees
            if fits and not reached and (now == before or (a, b) == (low, high)):
                break
            if (a, b) == (low, high):
                return ids(bounds[0], bounds[-1])
            before, width = now, 2 * width
        done = np.concatenate((done[: len(done) - lost_left], between, parts[k][lost_right:]))
    return done


class _Decoder:
    """Decoded text of runs of ids: the tokenizer's tokens joined by one space.

    That is what a tokenizer without a decoder section does; with one, its own is used."""

    def __init__(self, path: str) -> None:
        self.tok = tokenizer(path)
        self.plain = self.tok.decoder is None
        if self.plain:
            size = self.tok.get_vocab_size(with_added_tokens=True)
            tokens = [(self.tok.id_to_token(k) or "").encode() + b" " for k in range(size)]
            self.flat = np.frombuffer(b"".join(tokens), np.uint8)
            self.count = np.array([len(t) for t in tokens], np.int64)
            self.start = offsets_of(self.count)[:-1]

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        if not self.plain:
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                yield self.tok.decode(ids[a:b].tolist(), skip_special_tokens=False).encode()
            return
        step = 200_000
        k = 0
        while k < len(offsets) - 1:
            last = max(k + 1, int(np.searchsorted(offsets, offsets[k] + step, side="right")) - 1)
            part = ids[offsets[k] : offsets[last]]
            flat = gather(self.flat, self.start[part], self.count[part]).tobytes()
            upto = offsets_of(self.count[part])
            for a, b in zip(offsets[k:last] - offsets[k], offsets[k + 1 : last + 1] - offsets[k], strict=True):
                yield flat[upto[a] : upto[b] - 1] if b > a else b""
            k = last


_DECODERS: dict[str, _Decoder] = {}


def bpe_encode(docs: DataFrame, vocabulary: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode whole texts with the tokenizer file ``vocabulary``.

    Joins of chunks are checked against the tokenizer, see the module; it has to settle a
    place in a text by the words around it, as BPE over pre-tokens does.

    Returns the columns of ``docs`` but the text, with ``n_tokens`` (long) and either
    ``ids`` (array of long) and ``decoded`` (string), or with ``digests`` the lower-case hex
    SHA-256 of the ids as little-endian unsigned 32-bit integers (``ids_sha256``) and of the
    decoded UTF-8 text (``decoded_sha256``).

    A null text counts as empty; empty texts have no tokens.  Null ids, repeated rows and
    extra columns pass through; columns named like an added one are replaced."""
    added = T.StructType().add("n_tokens", "long")
    if digests:
        added = added.add("ids_sha256", "string").add("decoded_sha256", "string")
    else:
        added = added.add("ids", T.ArrayType(T.LongType())).add("decoded", "string")
    keep = [c for c in docs.columns if c not in added.fieldNames()]
    out_cols = [c for c in keep if c != text_col]
    docs = docs.select(*keep)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text_col), *added.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _DECODERS.setdefault(vocabulary, _Decoder(vocabulary)) if vocabulary not in _DECODERS else _DECODERS[vocabulary]
        for x in text_slices(batches, id_col, text_col):
            ids, offsets = encode_slice(vocabulary, x)
            n = pa.array(np.diff(offsets), pa.int64())
            if digests:
                raw = memoryview(ids.astype("<u4").tobytes())
                new = [n, pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]), pa.array([hashlib.sha256(t).hexdigest() for t in decoder.texts(ids, offsets)])]
            else:
                new = [n, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64())), pa.array(decoder.texts(ids, offsets), pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(x.columns.column(c) for c in out_cols), *new], schema=arrow)

    return docs.mapInArrow(run, schema)
