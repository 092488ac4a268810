"""Token counts by rank-synchronous array merging.

All new pre-tokens of a batch are held as one ragged numpy array of symbol ids. In
each round every sequence finds its own lowest-rank pair and merges all its
occurrences, left to right; sequences with no pair left retire. The symbols that
survive are the tokens.

Nulls count as empty. The work is map-only: nothing is shuffled, and rows that repeat
are answered alike. Columns of the input that are named as those added, in any case,
stay, and the added ones get an underscore more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, plus, ship, text_slices, tidy
from .pretokens import SCAN_BYTES, Cache, Encoded, Units, Vocabulary, vocabulary, word_bpe

TOKEN_LIMIT = 2048
_NONE = np.int64(2**62)
_BITS, _SPREAD = 20, np.uint64(0x9E3779B97F4A7C15)


class RankMerger:
    """Merges of a vocabulary as sorted arrays, applied to ragged batches."""

    def __init__(self, v: Vocabulary) -> None:
        self.ids, self.end = v.ids, v.end
        self.n = max(v.ids.values()) + 1
        pairs = sorted((a * self.n + b, rank, made) for (a, b), (rank, made) in v.merges.items())
        self.key, self.rank, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        slot = self._slot(self.key)
        taken = np.bincount(slot, minlength=1 << _BITS)
        self.table = np.full(1 << _BITS, -1, np.int32)  # -2: several keys share the slot
        self.table[slot] = np.arange(len(self.key))
        self.table[taken > 1] = -2

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, pair: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges, or -1."""
        at = self.table[self._slot(pair)].astype(np.int64)
        shared = np.flatnonzero(at == -2)
        if len(shared):
            k = np.searchsorted(self.key, pair[shared])
            k[k == len(self.key)] = 0
            at[shared] = k
        at[self.key[at] != pair] = -1
        return at

    def symbols(self, piece: str, closed: bool = True) -> list[int]:
        """Ids of a pre-token's symbols; the last carries the word end if closed."""
        out = [self.ids[c] for c in piece]
        if closed:
            out[-1] = self.ids[piece[-1] + self.end]
        return out

    def merge(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their sequence numbers, in order. starts: first symbol of each sequence (none is empty)."""
        seq = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(flat)]))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(flat):
            pair = flat[:-1] * self.n + flat[1:]
            at = self.find(pair)
            known = (at >= 0) & (seq[:-1] == seq[1:])
            rank = np.full(len(flat), _NONE)
            rank[:-1][known] = self.rank[at[known]]
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(flat)])
            alive = np.repeat(low < _NONE, size)
            if not alive.all():
                done.append((flat[~alive], seq[~alive]))
                if not alive.any():
                    break
            left = np.flatnonzero(alive & (rank == np.repeat(low, size)))
            # of touching pairs (of one symbol repeated) each run merges its first, third, ...
            run = np.cumsum(np.r_[True, np.diff(left) != 1]) - 1
            begin = np.flatnonzero(np.r_[True, np.diff(run) != 0])
            left = left[(np.arange(len(left)) - begin[run]) % 2 == 0]
            flat = flat.copy()
            flat[left] = self.made[at[left]]
            alive[left + 1] = False
            flat, seq = flat[alive], seq[alive]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, seq = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(seq, kind="stable")
        return flat[order], seq[order]


class Counter:
    """Ids of the pre-tokens of slices of texts."""

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        self.merger = RankMerger(self.v)
        self.known = Cache(self.odd_ids)

    def merge(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = self.v.inner[data]
        last = np.r_[starts[1:], len(data)] - 1
        flat[last] = self.v.last[data[last]]
        return self.merger.merge(flat, starts)

    def odd_ids(self, fragments: list[bytes]) -> list[list[int]]:
        """Ids of fragments that need the library's normaliser."""
        split = [self.v.pieces(f.decode("utf-8")) for f in fragments]
        todo = list({p for x in split for p in x if not isinstance(p, int)})
        flat: list[int] = []
        starts = []
        for p in todo:
            starts.append(len(flat))
            flat += self.merger.symbols(p)
        ids, seq = self.merger.merge(np.array(flat, np.int64), np.array(starts, np.int64))
        edge, ids = np.searchsorted(seq, np.arange(len(todo) + 1)).tolist(), ids.tolist()
        known = {p: ids[x:y] for p, x, y in zip(todo, edge, edge[1:], strict=False)}
        return [[i for p in x for i in ((p,) if isinstance(p, int) else known[p])] for x in split]

    def odd(self, fragments: list[bytes]) -> list[list[int]]:
        known = self.known.learn(fragments)
        return [known[f] for f in fragments]

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """How many tokens each text has."""
        return Encoded(Units(raw, off), self.v, self.merge, self.odd).per_text


_counters: dict[str, Counter] = {}


def count_tokens(documents: DataFrame, text: str = "text", path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """documents with n_bytes (UTF-8), n_tokens and over_limit added."""
    schema = plus(documents, n_tokens="long")
    n_tokens, n_bytes, over_limit = (free_name(documents, c) for c in ("n_tokens", "n_bytes", "over_limit"))
    ship(documents.sparkSession)
    path = path or word_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path)
        counter = _counters[path]
        for b in batches:
            out = [counter(raw, off) for _, _, raw, off in text_slices(b[text], SCAN_BYTES)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else [], pa.int64())], names=schema.names)

    counted = documents.mapInArrow(tidy(run), schema)
    return counted.select(*documents.columns, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(n_bytes), n_tokens, (F.col(n_tokens) > limit).alias(over_limit))


def digest(documents: DataFrame) -> DataFrame:
    """The contract of op10."""
    return count_tokens(documents.select("doc_id", "text")).drop("text")
