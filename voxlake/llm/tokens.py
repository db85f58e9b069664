"""Token ids of many short byte strings at once, through a memo keyed by hash.

A memo lives as long as its Python worker and is bounded; what it holds never changes a
result, only how often the tokenizer runs."""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

U = np.uint64


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[start[k] : start[k] + count[k]]`` over all k."""
    count = count.astype(np.int64)
    upto = np.cumsum(count)
    total = int(upto[-1]) if len(upto) else 0
    return flat[np.repeat(start - (upto - count), count) + np.arange(total)]


def offsets_of(count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    return out


class Memo:
    """Sorted hash -> run of ids.  When it would pass ``most`` entries or ``most_ids`` ids,
    only the entries that were found again since the last time stay."""

    def __init__(self, most: int, most_ids: int = 8_000_000) -> None:
        self.most, self.most_ids = most, most_ids
        self.clear()

    def clear(self) -> None:
        self.hash, self.start, self.count = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)
        self.again = np.empty(0, bool)

    def shrink(self) -> None:
        keep = self.again
        if keep.sum() > self.most // 2:
            self.clear()
            return
        flat = gather(self.flat, self.start[keep], self.count[keep])
        self.hash, self.count, self.flat = self.hash[keep], self.count[keep], flat
        self.start = offsets_of(self.count)[:-1]
        self.again = np.zeros(len(self.hash), bool)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each hash."""
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        return at, (self.hash[at] == h) if len(self.hash) else np.zeros(len(h), bool)

    def add(self, h: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """Add distinct hashes that are not yet held, in ascending order."""
        at = np.searchsorted(self.hash, h)
        self.start = np.insert(self.start, at, len(self.flat) + offsets_of(count)[:-1])
        self.hash, self.count = np.insert(self.hash, at, h), np.insert(self.count, at, count)
        self.again = np.insert(self.again, at, False)
        self.flat = np.concatenate((self.flat, flat.astype(np.uint32)))

    def runs(self, h: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(count, ids) of each hash in order.  ``make`` gets the places in ``h`` of one
        instance of each hash that is not held, and gives counts and ids for those."""
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        at, found = self.find(distinct)
        self.again[at[found]] = True
        if not found.all():
            if len(self.hash) + len(distinct) > self.most or len(self.flat) > self.most_ids:
                self.shrink()
                _, found = self.find(distinct)
            new = ~found
            self.add(distinct[new], *make(first[new]))
        at, _ = self.find(distinct)
        at = at[back]
        return self.count[at], gather(self.flat, self.start[at], self.count[at])


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; one for each worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _TOKENIZERS[path] = made
    return _TOKENIZERS[path]


def ids_of(tok, text: str) -> np.ndarray:
    return np.asarray(tok.encode(text, add_special_tokens=False).ids, np.uint32)


def encode_apart(tok, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ids) of the pieces, each encoded as a text of its own."""
    counts, found = np.zeros(len(pieces), np.int64), []
    for a in range(0, len(pieces), 10_000):
        made = tok.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces[a : a + 10_000]], add_special_tokens=False)
        ids = [e.ids for e in made]
        counts[a : a + len(ids)] = [len(x) for x in ids]
        found.append(np.fromiter(chain.from_iterable(ids), np.uint32))
    return counts, np.concatenate(found) if found else np.empty(0, np.uint32)
