"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A fingerprint bit is set if it is set in over half of the 64-bit hashes of a text's
word shingles. Fingerprints that differ in at most 3 bits are linked, and a text's
component is named by the smallest doc_id in it.

Finding the links. A fingerprint has four 16-bit segments, and 3 errors fall on them
in one of two ways. Either two segments have none: all fingerprints that share a pair
of segments meet under one of 6 exact keys. Or one segment has none and the other
three one each: the exact segment is combined with the next segment, read as a word
of the binary Golay code [23,12,7] padded with zeros. That code is perfect, so a word
lies within distance 3 of exactly one codeword. One side takes the codeword of its
segment; the other takes those of the segment and of all its one-bit neighbours, at
most 6 in all, so two segments at distance 1 share a codeword. The keys have 32 and
28 bits, so chance meetings stay rare in large corpora.

Exact copies are one fingerprint before any key is made. The fingerprints under one
key are compared in numpy and only a spanning forest of the links is kept, so a dense
group of m fingerprints gives at most m - 1 edges, not all pairs. A key with more
than BLOCK fingerprints is cut finer: the bits that it leaves open are dealt into four
parts, and as there are at most 3 errors, one part has none; so the fingerprints meet
again under four keys, each with one part more. That goes on while groups are large and
over SMALL bits are open; with fewer a group has at most 2^SMALL fingerprints. Nothing is
capped and a task holds BLOCK fingerprints of a key, or 2^SMALL at the last. The edges
then go through star contraction (operators/graph.py).

Nulls and texts without words have fingerprint zero and are linked like any other; a
null doc_id names no component, but its row is kept and answered. Rows that repeat are
answered alike. Columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from ..operators.graph import components, join_in_parts, share_of_a_task
from .common import LOWER, Words, free_name, plus, ship, text_slices, tidy

BITS, SHINGLE, BLOCK, SMALL = 3, 3, 4096, 14
_SPACE = np.ones(256, bool)
_SPACE[[32, *range(9, 14)]] = False


# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of byte ranges: those under 32 bytes, which are nearly all shingles, step by step for all at once, longer ones by the library."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded.data, strides=(1,))
    h = np.uint64(seed) + _P5 + size.astype(np.uint64)
    at = start.copy()
    for k in range(3):
        some = np.flatnonzero((size >= 8 * (k + 1)) & (size < 32))
        h[some] = _turn(h[some] ^ _turn(lanes[at[some]] * _P2, 31) * _P1, 27) * _P1 + _P4
        at[some] += 8
    left = size & 7
    some = np.flatnonzero((left >= 4) & (size < 32))
    h[some] = _turn(h[some] ^ (lanes[at[some]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    at[some] += 4
    for k in range(3):
        some = np.flatnonzero(((left & 3) > k) & (size < 32))
        h[some] = _turn(h[some] ^ padded[at[some]].astype(np.uint64) * _P5, 11) * _P1
        at[some] += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    if len(long):
        raw = data.tobytes()
        h[long] = [xxhash.xxh64_intdigest(raw[a : a + n], seed) for a, n in zip(start[long].tolist(), size[long].tolist(), strict=True)]
    return h


def fingerprints(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Fingerprints of a slice of texts, as uint64."""
    w = Words(raw, off, _SPACE)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(w):
        return out
    # all words of the slice, joined by single spaces, so that a shingle is one byte range
    length = w.end - w.start
    begin = np.cumsum(np.r_[0, length[:-1] + 1])
    flat = np.full(begin[-1] + length[-1], 32, np.uint8)
    inside = np.repeat(begin - w.start, length)
    source = np.arange(len(inside)) - np.repeat(np.cumsum(np.r_[0, length[:-1]]), length) + np.repeat(w.start, length)
    flat[source + inside] = w.low[source]
    end = begin + length
    count = w.count
    filled = np.flatnonzero(count)
    n = np.maximum(1, count - size + 1) * (count > 0)
    first = np.cumsum(np.r_[0, n])
    at = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(w.first[:-1], n)
    stop = np.minimum(at + size, np.repeat(w.first[1:], n)) - 1
    hashes = xxh64(flat, begin[at], end[stop] - begin[at], seed)
    half = n[filled] / 2
    starts = first[:-1][filled]
    for byte in range(8):
        part = ((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
        bits = np.unpackbits(part[:, None], axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[filled] |= (np.packbits(ones > half[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64)) << np.uint64(8 * byte)
    return out


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit word padded to 23 bits: its codeword's index, and those of the word and its one-bit neighbours (-1 fills up)."""
    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for k in range(22, 10, -1):
            x = np.where((x >> k) & 1, x ^ (0xC75 << (k - 11)), x)
        return x

    errors = np.array([sum(1 << b for b in c) for r in range(4) for c in combinations(range(23), r)])
    leader = np.zeros(2048, np.int64)
    leader[syndrome(errors)] = errors

    def index(x: np.ndarray) -> np.ndarray:
        return (x ^ leader[syndrome(x)]) >> 11

    words = np.arange(1 << 16) << 3
    own = index(words)
    near = np.sort(np.stack([own, *(index(words ^ (8 << b)) for b in range(16))], axis=1), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near = -np.sort(-near, axis=1)
    return own, near[:, : (near >= 0).sum(axis=1).max()]


_tables: list[np.ndarray] = []
_PAIRS = list(combinations(range(4), 2))


def keys(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(key, place in fp, side): sides 0 meet one another; 1 meets 2."""
    if not _tables:
        _tables.extend(_golay())
    own, near = _tables
    seg = [((fp >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    every = np.arange(len(fp))
    for k, (a, b) in enumerate(_PAIRS):
        yield (k << 32) | (seg[a] << 16) | seg[b], every, 0
    for k in range(4):
        base = ((6 + k) << 32) | (seg[k] << 12)
        nxt = seg[(k + 1) % 4]
        yield base | own[nxt], every, 1
        codes = near[nxt]
        row, col = np.nonzero(codes >= 0)
        yield base[row] | codes[row, col], row, 2


def _forest(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between left and right, or within left."""
    found: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    other = left if right is None else right
    step = max(1, (1 << 20) // max(1, len(other)))
    for i in range(0, len(left), step):
        near = np.bitwise_count(left[i : i + step, None] ^ other[None, :]) <= BITS
        for a, b in zip(*np.nonzero(near), strict=True):
            x, y = int(left[i + a]), int(other[b])
            if x != y and (rx := root(x)) != (ry := root(y)):
                parent[max(rx, ry)] = min(rx, ry)
                found.append((x, y))
    return found


def _open_bits(kind: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The bits of a fingerprint that neither its key nor the mask fixes; kind is the key's number."""
    fixed = np.array([sum(0xFFFF << 16 * x for x in p) for p in _PAIRS] + [0xFFFF << 16 * k for k in range(4)], np.uint64)
    return ~(fixed[kind] | mask)


def _quarters(bits: int) -> list[int]:
    """Four masks that share out the set bits."""
    at = [b for b in range(64) if bits >> b & 1]
    return [sum(1 << b for b in at[len(at) * q // 4 : len(at) * (q + 1) // 4]) for q in range(4)]


def _finer(key: np.ndarray, mask: np.ndarray, side: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """Rows of a group that meets again: each under its key and one part more of the bits that were open."""
    bits = int(_open_bits(key[:1] >> 32, mask[:1])[0])
    masks = np.array([int(mask[0]) | q for q in _quarters(bits)], np.uint64)
    n = len(fp)
    return [np.ones(4 * n, np.int32), np.tile(key, 4), np.repeat(masks, n).view(np.int64), (np.tile(fp, 4) & np.repeat(masks, n)).view(np.int64), np.tile(side, 4), np.tile(fp, 4).view(np.int64)]


#: Edges (kind 0: a and b in val and fp), and rows of groups that meet again (kind 1).
_MET = "kind int, key long, mask long, val long, side int, fp long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, mask, val, side, fp) sorted by the first three: edges, and the rows of large groups under finer keys."""
    names, types = ["kind", "key", "mask", "val", "side", "fp"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def edges(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        none = np.zeros(len(a), np.int64)
        return [none, none, none, a.view(np.int64), none, b.view(np.int64)]

    def made(rows: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [[]]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(t.to_pandas_dtype()), t) for c, t in zip(cols, types, strict=True)], names=names)

    def large(key: np.ndarray, mask: np.ndarray, n: int) -> bool:
        return n > BLOCK and int(_open_bits(key[:1] >> 32, mask[:1])[0]).bit_count() > SMALL

    def settle(key: np.ndarray, mask: np.ndarray, val: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (mask[1:] != mask[:-1]) | (val[1:] != val[:-1]), True])
        size = np.diff(edge)
        # two fingerprints are most often all there is under a key
        pair = edge[:-1][size == 2]
        ok = (np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= BITS) & (fp[pair] != fp[pair + 1]) & ((side[pair] == 0) | (side[pair] != side[pair + 1]))
        rows = [edges(fp[pair[ok]], fp[pair[ok] + 1])]
        for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            k, f = side[s : s + n], fp[s : s + n]
            if large(key[s:], mask[s:], n):
                rows.append(_finer(key[s : s + n], mask[s : s + n], k, f))
                continue
            left, right = (f, None) if not k[0] else (f[k == 1], f[k == 2])
            if len(left) and (right is None or len(right)) and (found := _forest(left, right)):
                e = np.array(found, np.uint64)
                rows.append(edges(e[:, 0].copy(), e[:, 1].copy()))
        yield from made(rows)

    held: list[list[np.ndarray]] = []  # of the last group, which may go on
    at, streams = None, False  # its key, and whether it is known to be large
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[c].to_numpy() for c in ("key", "mask", "val", "side", "fp")]
        cols[1], cols[4] = cols[1].view(np.uint64), cols[4].view(np.uint64)
        if at is not None:
            more = int((~((cols[0] == at[0]) & (cols[1] == at[1]) & (cols[2] == at[2]))).argmax()) if (cols[0][-1], cols[1][-1], cols[2][-1]) != at else len(cols[0])
            part, cols = [c[:more] for c in cols], [c[more:] for c in cols]
            if more and streams:
                yield from made([_finer(part[0], part[1], part[3], part[4])])
            elif more:
                held.append(part)
                if large(part[0], part[1], sum(len(h[0]) for h in held)):
                    yield from made([_finer(h[0], h[1], h[3], h[4]) for h in held])
                    held, streams = [], True
            if not len(cols[0]):
                continue
            if held:
                yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
        at, streams = (cols[0][-1], cols[1][-1], cols[2][-1]), False
        last = int(((cols[0] == at[0]) & (cols[1] == at[1]) & (cols[2] == at[2])).argmax())
        if last:
            yield from settle(*(c[:last] for c in cols))
        held = [[c[last:] for c in cols]]
        if large(held[0][0], held[0][1], len(held[0][0])):
            yield from made([_finer(held[0][0], held[0][1], held[0][3], held[0][4])])
            held, streams = [], True
    if held:
        yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (a, b) of a forest whose components are those of all links between the distinct fingerprints given."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b[fp].to_numpy().view(np.uint64)
            for s in range(0, len(x), 1 << 13):
                part = x[s : s + (1 << 13)]
                for key, at, side in keys(part):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(at), side, np.int32)), pa.array(part[at].view(np.int64))], names=["key", "side", "fp"])

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(0).cast("long")
    rows = prints.select(fp).mapInArrow(tidy(spread), "key long, side int, fp long").select("key", none.alias("mask"), none.alias("val"), "side", "fp")
    dealt, found = ["key"], None
    while True:  # six times at most, as each round fixes a quarter of the open bits
        met = checkpoint(rows.repartition(n, *dealt).sortWithinPartitions("key", "mask", "val").mapInArrow(tidy(_meet), _MET))
        edges = met.where("kind = 0").select(F.col("val").alias("a"), F.col("fp").alias("b"))
        found = edges if found is None else found.unionByName(edges)
        rows = met.where("kind = 1").drop("kind")
        if rows.isEmpty():
            return found
        dealt = ["key", "mask", "val"]


def _placed(documents: DataFrame, text: str, doc_id: str, extra: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """doc_id, fp and the extra columns of every row; of every fp its smallest doc_id, its rows and its component's root; and the names of these four."""
    ship(documents.sparkSession)
    keep = [doc_id, *extra]
    fp, least, n, root, node = (free_name(documents, c) for c in ("fp", "least", "n", "root", "node"))
    schema = plus(documents.select(*keep), **{fp: "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprints(raw, off) for _, _, raw, off in text_slices(b[text], 1 << 19)]
            made = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(made)], names=schema.names)

    rows = checkpoint(documents.select(*keep, text).mapInArrow(tidy(run), schema))
    prints = checkpoint(rows.groupBy(fp).agg(F.min(doc_id).alias(least), F.count("*").alias(n)))
    roots = components(links(prints, fp)).withColumnsRenamed({"node": node, "root": root})
    # a root is the smallest fingerprint of its component
    return rows, prints.join(roots, F.col(fp) == F.col(node), "left").select(fp, least, n, F.coalesce(root, fp).alias(root)), [fp, least, n, root]


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """doc_id, fp (long) and component_id of every row, with the extra columns asked for; fp and component_id get underscores
    more if the documents have columns of these names."""
    rows, placed, (fp, least, n, root) = _placed(documents, text, doc_id, extra or [])
    component_id = free_name(documents, "component_id")
    # the component takes the smallest doc_id in it
    size = free_name(documents, "size")
    sizes = placed.groupBy(root).agg(F.min(least).alias(component_id), F.count("*").alias(size))
    spark = documents.sparkSession
    n_rows, n_prints = placed.agg(F.coalesce(F.sum(n), F.lit(0)), F.count("*")).first()
    known = join_in_parts(placed.select(fp, n, root), sizes, root, fp, size, share_of_a_task(spark, n_prints)).select(fp, n, component_id)
    # rows of a fingerprint that very many have are dealt out by their id
    return join_in_parts(rows, known, fp, doc_id, n, share_of_a_task(spark, n_rows)).select(doc_id, *(extra or []), fp, component_id)


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, one of each component: the row with its smallest doc_id, nulls last, and of these the one with
    the smallest hash of its text (rows that repeat both are one)."""
    th, its_th, its_id = (free_name(documents, c) for c in ("th", "its_th", "its_id"))
    keyed = documents.withColumn(th, F.xxhash64("text"))
    rows, placed, (fp, _, _, root) = _placed(keyed.select("doc_id", "text", th), "text", "doc_id", [th])
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(th).alias("th"))
    least = rows.groupBy(fp).agg(F.min(row).alias("row"))  # so that copies combine before they are joined
    keepers = least.join(placed, fp).groupBy(root).agg(F.min("row").alias("row")).select(F.col("row.id").alias(its_id), F.col("row.th").alias(its_th))
    return keyed.join(keepers, (F.col(th) == F.col(its_th)) & F.col("doc_id").eqNullSafe(F.col(its_id)), "left_semi").select(*documents.columns)


def digest(documents: DataFrame) -> DataFrame:
    """The contract of op6."""
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
