"""Pieces shared by the operators: shipping the package, reading tables, and a
vectorised word scanner over Arrow string batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.lineage import ship  # noqa: F401  the operators take it from here


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over Arrow batches whose worker gives freed memory back to the system when its task ends: workers
    live through many stages, and what their allocators keep would add up."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    _pow[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bits of a broadcast bitmap of hashes: its size is fixed, and one that fills up filters less and loses nothing.
BITMAP_BITS = 27
#: Bytes of text that one call of the vectorised kernels works on; a longer text is taken alone.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus(df: DataFrame, **columns: str) -> StructType:
    """The frame's schema with columns added, each under its name or, if a column has that, with underscores more."""
    out = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out = out.add(free_name(df, name), _parse_datatype_string(kind))
    return out


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the first with underscores added that no column has; case does not tell names apart, as in Spark."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) pieces of a string column of at most `limit` bytes each,
    or of one longer text; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if n and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j - i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_rng = np.random.default_rng(20240607)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: digits, lower-case letters and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, r in enumerate((_R, _RINV)):
            p = np.full(max(n, 1 << 16), r, np.uint64)
            p[0] = 1
            _pow[k] = np.cumprod(p)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, from one prefix sum of a rolling polynomial."""
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a slice of texts: byte ranges, 64-bit hashes, and first word of each text."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, kinds: np.ndarray = WORD) -> None:
        self.low = LOWER[raw]
        w = kinds[self.low]
        filled = off[:-1] < off[1:]
        before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        before[off[:-1][filled]] = False
        after[off[1:][filled] - 1] = False
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.start, off)  # of text i: words first[i] to first[i + 1]
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.low, self.start, self.end)
        return self._hash

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def last(self) -> np.ndarray:
        """For each word, the end of its text, as a word index."""
        return np.repeat(self.first[1:], self.count)

    def joined(self, at: int, n: int) -> bytes:
        low, s, e = self.low, self.start, self.end
        return b" ".join(low[s[k] : e[k]].tobytes() for k in range(at, at + n))


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """For each pair the words from a to b, joined by single spaces."""
    size = ends - starts + 1
    place = np.r_[0, np.cumsum(size)]
    length = np.maximum(0, place[b] - place[a] - 1)
    # first the words of all pairs, then their bytes
    n = b - a
    word = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
    out = np.full(int((place[b] - place[a]).sum()), 32, np.uint8)
    to = np.cumsum(size[word]) - size[word]
    inner = size[word] - 1
    step = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
    out[np.repeat(to, inner) + step] = raw[np.repeat(starts[word], inner) + step]
    # the space after the last word of each pair goes
    keep = np.ones(len(out), bool)
    keep[np.cumsum(place[b] - place[a])[n > 0] - 1] = False
    off = np.r_[0, np.cumsum(length)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(off), pa.py_buffer(out[keep])])


def bit_set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes are set."""
    low = h & np.uint64((1 << BITMAP_BITS) - 1)
    return ((bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)


def bitmap_of(hashes: DataFrame):
    """A broadcast bitmap of BITMAP_BITS bits from a column h of longs."""
    mask = (1 << BITMAP_BITS) - 1
    words = hashes.select(F.expr(f"cast(shiftright(h & {mask}L, 6) as int)").alias("w"), F.expr("shiftleft(1L, cast(h & 63L as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def marked(documents: DataFrame, key: str, hashes: DataFrame, flag: str) -> DataFrame:
    """documents with whether the bit of their key is set by some of the hashes (h): a join with at most 4,096 bitmaps of 4 KB."""
    mask = F.lit((1 << BITMAP_BITS) - 1)
    bit = lambda c: F.col(c).bitwiseAND(F.lit(32767))
    bucket = lambda c: F.shiftright(F.col(c).bitwiseAND(mask), 15)
    names = [f"{flag}_bucket", f"{flag}_bits"]
    bits = hashes.groupBy(bucket("h").alias(names[0])).agg(F.bitmap_construct_agg(bit("h")).alias(names[1]))
    byte = F.conv(F.hex(F.substring(F.col(names[1]), (F.shiftright(bit(key), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, bit(key).bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return documents.join(F.broadcast(bits), bucket(key) == F.col(names[0]), "left").withColumn(flag, F.coalesce(is_set, F.lit(False))).drop(*names)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of an array, sorted; by a plain sort, which takes a twentieth of the time that numpy's own way does."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def gram_hashes(h: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n words from each position (or from those given); positions too near the end are left out."""
    if at is None:
        if len(h) < n:
            return np.zeros(0, np.uint64)
        parts = (h[j : len(h) - n + 1 + j] for j in range(n))
    else:
        parts = (h[at + j] for j in range(n))
    out: np.ndarray | None = None
    for x in parts:
        out = x.copy() if out is None else out * _R + x
    return mix(out) if out is not None else np.zeros(0, np.uint64)
