"""Vectorised words, word hashes and rolling window hashes over Arrow string columns.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` of the UTF-8 bytes, so no Python
string is made for a word.  Null texts count as empty.  Every helper works on a slice of
a batch whose size is bounded by bytes, except that one text is never divided here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
_LONG = 256  # longer words are hashed one by one
MULT = 0xD1342543DE82EF95
MULT2 = 0xAF251AF3B0F025B5


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Texts:
    """A slice of documents: ids, UTF-8 bytes (8 bytes of padding), text and word offsets."""

    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  # of texts in data, one more than texts
    start: np.ndarray  # of words in data
    end: np.ndarray
    word_offsets: np.ndarray  # of texts in start, one more than texts
    columns: pa.RecordBatch | pa.Table

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.n_words)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_words(self.data, self.start, self.end, seed)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte range; ``data`` has 8 bytes of padding at its end."""
    size = end - start
    blocks = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    out = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U((seed * 0x632BE59BD9B4E019 + 0x2545F4914F6CDD1D) % 2**64))
    left, at, who = size, start, None
    while True:
        if who is None:
            out = mix(out ^ (blocks[at] & _MASK[np.minimum(left, 8)])) if len(at) else out
        else:
            out[who] = mix(out[who] ^ (blocks[at] & _MASK[np.minimum(left, 8)]))
        more = (left > 8) & (size <= _LONG) if who is None else left > 8
        if not more.any():
            break
        who = np.flatnonzero(more) if who is None else who[more]
        left, at = left[more] - 8, at[more] + 8
    for k in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, key=str(seed).encode()).digest()
        out[k] = np.frombuffer(digest, "<u8")[0]
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up), np.cumprod(down))
        if size > 1 << 22:  # a single giant text: not kept
            del _POWERS[base]
    return have


class Rolling:
    """Hashes of any run of consecutive words, from prefix sums of word hashes."""

    def __init__(self, word_hash: np.ndarray, base: int = MULT) -> None:
        self.n = len(word_hash)
        self.up, self.down = _powers(base, self.n + 1)
        self.prefix = np.zeros(self.n + 1, U)
        np.cumsum(word_hash * self.up[: self.n], out=self.prefix[1:])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.down[start])


def window_starts(word_offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every window of ``size`` words that lies in one text."""
    count = np.maximum(np.diff(word_offsets) - size + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return np.arange(len(doc)) - before[doc] + word_offsets[:-1][doc], doc


def split_texts(ids: np.ndarray, column: pa.Array, columns: pa.RecordBatch) -> Texts:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    base, total = int(raw[0]), int(raw[-1] - raw[0])
    data = np.zeros(total + 8, np.uint8)
    if total:
        data[:total] = np.frombuffer(column.buffers()[2], np.uint8)[base : base + total]
    offsets = raw - base
    word = _IS_WORD[data[:total]]
    edge = np.zeros(total + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(total, bool), np.zeros(total, bool)
    before[1:] = word[:-1]
    after[:-1] = word[1:]
    before &= ~edge[:-1]
    after &= ~edge[1:]
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return Texts(ids, data, offsets, start, end, np.searchsorted(start, offsets), columns)


def text_slices(batches: Iterable[pa.RecordBatch], id_col: str, text_col: str, most_bytes: int = 4 << 20) -> Iterator[Texts]:
    """Cut batches into slices of about ``most_bytes`` of text; a longer text is a slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col).cast(pa.large_binary())), 0), np.int64)
        upto = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            limit = (upto[first - 1] if first else 0) + most_bytes
            last = max(first + 1, int(np.searchsorted(upto, limit, side="right")))
            part = batch.slice(first, last - first)
            ids = np.asarray(pc.fill_null(part.column(id_col).cast(pa.int64()), -(1 << 63)), np.int64)
            yield split_texts(ids, part.column(text_col), part)
            first = last
