"""Approximate nearest neighbours by largest inner product: inverted lists scanned with adaptive dimension tests.

A vector x becomes (x, sqrt(M^2 - |x|^2)), M the largest norm, and a query is scaled to
norm M, which turns the largest inner product into the smallest distance. There are
about 2 sqrt(n) lists (MAX_LISTS at most) by k-means on a sample of PER_LIST vectors a
list (524,288 at most, 4,096 at least), drawn by a hash; every row
is put on a list. The number of lists probed is measured on the quarter of the sample
that k-means does not see: the least for which its vectors find TARGET of their true
neighbours in it. Beyond FLAT lists the
centroids are made in two levels, so that neither the fit nor placing a row looks at all.

Within a list the vectors are turned by one random rotation and scanned in blocks of
COLUMNS columns. After each block a pair is abandoned if the distance so far, scaled to
all columns, exceeds the query's bound by more than the test allows: (1 + EPSILON /
sqrt(m))^2 after m columns, which a pair within the bound fails with small probability.
Pairs that survive are scored exactly, in double precision on the original vectors. A
query's bound starts at its (k+1)-th best score among a small part of the sample (an
eighth, BOUND vectors at most), which no answer can fall below; those vectors are
answers only where the lists lead to them.

Equal vectors are one before anything is searched: a vector asks once however many rows
ask with it, and of its rows only those with the k + 1 smallest ids can be among
anyone's k nearest, since ties go to the smaller id. So a vector that a third of all rows
hold is k + 1 candidates and one query. Lists longer than BLOCK are cut into units by a
hash of the id, by their share of the sample, and units that lie near one another are
packed into shards of even size: LEAST_SHARDS of them, or as many as hold SHARD rows each.
A shard's rows are one task's; a query goes once to each shard that holds a list it
probes, with the numbers of those units. It scans them one after another, its bound
tightening from list to list, and leaves the shard with its k + 1 best, which meet those
of other shards in one aggregate. What is broadcast is the rotation, at most MAX_LISTS
centroids and BOUND vectors.

Vectors that are null, zero, hold null or non-finite numbers, or have no id take no part;
vectors of different lengths are searched apart, as they have no inner product. Rows
that repeat are one candidate; an id with several vectors counts with its best. Other
columns, whatever their names, are not looked at and do not come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, tidy

MAX_LISTS, PER_LIST, LEAST_SAMPLE, FLAT, BOUND = 32_768, 16, 4096, 2048, 2048
TARGET, EPSILON, COLUMNS, BLOCK = 0.96, 2.1, 16, 8192
SHARD, LEAST_SHARDS, QUERIES = 65_536, 16, 1024
_SLACK = 1e-5


@dataclass
class Index:
    rotation: np.ndarray
    norm: float
    coarse: np.ndarray  # centroids of groups of lists
    first: np.ndarray  # the first list of each group, and the number of lists
    centroids: np.ndarray  # of the lists, by group
    share: np.ndarray  # rows of each list, as the sample has it
    unit: np.ndarray  # the first unit of each list, and the number of units
    shard: np.ndarray  # of each unit
    probes: int
    bound: np.ndarray  # sampled vectors that bounds are made from

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the column that makes their norms equal, turned."""
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(0, self.norm**2 - (x**2).sum(axis=1)))
        return (np.c_[x, rest] @ self.rotation).astype(np.float32)

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries brought to the vectors' norm, turned."""
        q = q.astype(np.float64)
        q = q * (self.norm / np.sqrt((q**2).sum(axis=1)))[:, None]
        return (np.c_[q, np.zeros(len(q))] @ self.rotation).astype(np.float32)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The list of each lifted vector."""
        group = _nearest(x, self.coarse)
        out = np.zeros(len(x), np.int64)
        for g in np.unique(group).tolist():
            here = np.flatnonzero(group == g)
            out[here] = self.first[g] + _nearest(x[here], self.centroids[self.first[g] : self.first[g + 1]])
        return out

    def order(self, q: np.ndarray) -> np.ndarray:
        """All lists for each aimed query, nearest first."""
        return ((self.centroids**2).sum(axis=1)[None, :] - 2 * q @ self.centroids.T).argsort(axis=1)

    def floor(self, q: np.ndarray, k: int) -> np.ndarray:
        """A score that the k best of each query reach: the k-th best in a part of the sample."""
        out = np.full(len(q), -np.inf)
        x = self.bound.astype(np.float64)
        if len(x) >= k:
            for s in range(0, len(q), 256):
                part = q[s : s + 256].astype(np.float64)
                at = np.argpartition(-(part @ x.T), k - 1, axis=1)[:, :k]
                of = np.repeat(np.arange(len(part)), k)
                out[s : s + 256] = _exact(part, x, of, at.ravel()).reshape(len(part), k).min(axis=1)
        return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    norm = (c**2).sum(axis=1)[None, :]
    return np.concatenate([(norm - 2 * part @ c.T).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 2048))]) if len(c) > 1 else np.zeros(len(x), np.int64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        order = np.argsort(at, kind="stable")
        filled = np.flatnonzero(n)
        c[filled] = np.add.reduceat(x[order], np.cumsum(np.r_[0, n[filled][:-1]]), axis=0) / n[filled][:, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.integers(0, len(x), len(empty))]
    return c


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, always by the same sums, so that equal vectors score the same."""
    return np.concatenate([np.einsum("ij,ij->i", q[qi[s : s + 65536]], x[xi[s : s + 65536]]) for s in range(0, max(1, len(qi)), 65536)])


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.float32)


def lists_for(rows: int) -> int:
    return min(MAX_LISTS, max(1, round(2 * rows**0.5)))


def fit(sample: np.ndarray, rows: int, norm: float, k: int, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    sample = np.unique(sample, axis=0)
    sample = sample[rng.permutation(len(sample))]
    index = Index(np.linalg.qr(rng.standard_normal((d, d)))[0], norm, *[np.zeros(0)] * 6, 1, sample[: min(BOUND, max(k, len(sample) // 8))])
    held = len(sample) // 4
    x, seen = index.lift(sample[:held]), index.lift(sample[held:])
    n = min(lists_for(rows), max(1, len(seen) // (PER_LIST // 2)))
    index.coarse = _kmeans(seen, 1 if n <= FLAT else round(n**0.5), rng)
    group = _nearest(seen, index.coarse)
    parts = [_kmeans(seen[group == g], min(m, max(1, round(n * m / len(seen)))), rng) if (m := int((group == g).sum())) else index.coarse[g : g + 1] for g in range(len(index.coarse))]
    index.first, index.centroids = np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
    at = index.place(x)
    index.share = np.bincount(np.r_[at, index.place(seen)], minlength=len(index.centroids)) * rows / len(sample)
    blocks = np.maximum(1, np.ceil(index.share / BLOCK)).astype(np.int64)
    index.unit = np.r_[0, np.cumsum(blocks)]
    # lists by group, and in a group along the line between its ends
    group = np.repeat(np.arange(len(parts)), np.diff(index.first))
    along = index.centroids @ (index.centroids[0] - index.centroids[-1])
    order = np.repeat(np.lexsort((along, group)), blocks[np.lexsort((along, group))])
    nth = np.concatenate([np.arange(n) for n in blocks[np.lexsort((along, group))]])
    size = 1 + index.share[order] / blocks[order]
    index.shard = np.zeros(len(order), np.int64)
    index.shard[index.unit[order] + nth] = (np.cumsum(size) - size) * max(LEAST_SHARDS, -(-rows // SHARD)) // size.sum()
    # as many neighbours in the part held out as it has of a query's k nearest rows
    near = min(held - 1, max(1, -(-k * held // rows)))
    if near > 0:
        ask, part = np.arange(min(held, 1024)), sample[:held].astype(np.float64)
        score = part[ask] @ part.T
        score[ask, ask] = -np.inf
        best = np.argpartition(-score, near - 1, axis=1)[:, :near]
        place = index.order(index.aim(part[ask])).argsort(axis=1)
        reached = np.sort(np.take_along_axis(place, at[best], axis=1).ravel())
        index.probes = int(reached[min(len(reached) - 1, int(np.ceil(TARGET * len(reached))))]) + 1
    return index


class Scan:
    """Queries on their way through the units of a shard, with the best k that each has met and the bound these give.

    What scores below a query's floor may be left out.
    """

    def __init__(self, index: Index, q: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.index, self.k, self.turned, self.q = index, k, index.aim(q), q.astype(np.float64)
        self.scale = index.norm / np.sqrt((self.q**2).sum(axis=1))
        self.bound = 2 * index.norm**2 - 2 * self.scale * floor
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.new: list[tuple] = []
        self.waiting = 0

    def meet(self, at: np.ndarray, x: np.ndarray, xr: np.ndarray, ids: np.ndarray) -> None:
        """Scans the rows (their vectors, the same lifted, their ids) for the queries at some places."""
        d, m2 = xr.shape[1], self.index.norm**2
        cuts = [*range(0, d, COLUMNS), d]
        tile = min(1024, max(64, (1 << 20) // max(1, len(at))))
        for begin in range(0, len(x), tile):
            b, bound = xr[begin : begin + tile], self.bound[at]
            test = lambda seen, m, limit: seen * (d / m) <= limit * ((1 + EPSILON / m**0.5) ** 2 if m < d else 1) * (1 + _SLACK) + _SLACK * m2
            first, rest = self.turned[at, : cuts[1]], b[:, : cuts[1]]
            part = (first**2).sum(axis=1)[:, None] + (rest**2).sum(axis=1)[None, :] - 2 * first @ rest.T
            qi, ci = np.nonzero(test(part, cuts[1], bound[:, None]))
            seen, qi = part[qi, ci], at[qi]
            for s, e in zip(cuts[1:], cuts[2:], strict=False):
                seen = seen + ((self.turned[qi, s:e] - b[ci, s:e]) ** 2).sum(axis=1)
                ok = test(seen, e, self.bound[qi])
                qi, ci, seen = qi[ok], ci[ok], seen[ok]
            if len(qi):
                self.new.append((qi, ids[begin + ci], _exact(self.q, x, qi, begin + ci)))
                self.waiting += len(qi)
            if self.waiting > 2 * len(self.q):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, id, score) of the best k so far, an id once with its best; bounds follow."""
        if self.new:
            q, i, score = (np.concatenate(z) for z in zip(self.kept, *self.new, strict=True))
            order = np.lexsort((i, -score, q))
            q, i, score = q[order], i[order], score[order]
            again = np.zeros(len(q), bool)
            pair = np.lexsort((i, q))  # stable: an id's best comes first
            again[pair[1:]] = (q[pair[1:]] == q[pair[:-1]]) & (i[pair[1:]] == i[pair[:-1]])
            q, i, score = q[~again], i[~again], score[~again]
            rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.q)))[q]
            last = rank == self.k - 1
            self.bound[q[last]] = np.minimum(self.bound[q[last]], 2 * self.index.norm**2 - 2 * self.scale[q[last]] * score[last])
            self.kept, self.new, self.waiting = (q[rank < self.k], i[rank < self.k], score[rank < self.k]), [], 0
        return self.kept


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows to each row for which the condition is_query holds."""
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    e = F.col("v")
    sound = F.col("id").isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(sound)
    norm2 = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    shapes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm2).alias("m2")).orderBy("d").collect()  # a row a length
    parts = [_search(rows.where(F.size("v") == s["d"]), s["n"], float(np.sqrt(s["m2"])) * (1 + 1e-9), k, kind) for s in shapes]
    if not parts:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, n_rows: int, norm: float, k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score) of vectors of one length: at least the k best found for each row that asks."""
    spark = rows.sparkSession
    # k + 1 candidates, as the best one may be the asking row itself
    want = k + 1
    size = min(n_rows, max(LEAST_SAMPLE, lists_for(n_rows) * PER_LIST))
    drawn = rows.select("v") if size == n_rows else rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) < int((1 << 40) * size / n_rows)).select("v")
    index = spark.sparkContext.broadcast(fit(_matrix(drawn.limit(2 * size).toArrow()["v"]), n_rows, norm, want))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for b in batches:
            if b.num_rows:
                ids = b["id"].to_numpy()
                at = ix.place(ix.lift(_matrix(b["v"])))
                block = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % np.diff(ix.unit)[at]
                unit = ix.unit[at] + block
                yield dealt(b, np.arange(len(ids)), ix.shard[unit], np.zeros(len(ids)), unit[:, None], np.ones(len(ids), np.int64), False)

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                b = whole.slice(begin, 256)
                q = _matrix(b["v"])
                floor, order = ix.floor(q, want), ix.order(ix.aim(q))
                enough = np.minimum(np.maximum(ix.probes, 1 + (np.cumsum(ix.share[order], axis=1) < 20 * want).sum(axis=1)), order.shape[1])
                lists = order[np.arange(order.shape[1])[None, :] < enough[:, None]]
                place, blocks = np.repeat(np.arange(len(q)), enough), np.diff(ix.unit)[lists]
                unit = np.repeat(ix.unit[lists], blocks) + np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                place = np.repeat(place, blocks)
                # one row for each query and shard, its units nearest first
                by = np.lexsort((np.arange(len(unit)), ix.shard[unit], place))
                place, unit = place[by], unit[by]
                new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (ix.shard[unit[1:]] != ix.shard[unit[:-1]])])
                yield dealt(b, place[new], ix.shard[unit[new]], floor[place[new]], unit, np.diff(np.r_[new, len(unit)]), True)

    def dealt(b: pa.RecordBatch, place, shard, floor, units, n_units, asked: bool) -> pa.RecordBatch:
        take = pa.array(place)
        off = pa.array(np.r_[0, np.cumsum(n_units)].astype(np.int32))
        cols = [pa.array(shard), pa.array(np.full(len(place), asked)), pa.array(floor), pa.ListArray.from_arrays(off, pa.array(units.ravel().astype(np.int32))), b["id"].take(take), b["h"].take(take), b["v"].take(take)]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "asked", "floor", "units", "id", "h", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        at, base, asks, n_asks = None, [], [], 0

        def answer(asks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal base
            if not base or not asks:
                return
            if isinstance(base, list):
                x, ids = np.concatenate([_matrix(p["v"]) for p in base]).astype(np.float64), np.concatenate([p["id"].to_numpy() for p in base])
                unit = np.concatenate([p["units"].flatten().to_numpy() for p in base])
                order = np.argsort(unit, kind="stable")
                x, unit = x[order], unit[order]
                base = (x, ix.lift(x), ids[order], unit)
            x, xr, ids, unit = base
            b = pa.Table.from_batches(asks).combine_chunks()
            units, n_units = b["units"].combine_chunks().flatten().to_numpy(), np.diff(b["units"].combine_chunks().offsets.to_numpy())
            scan = Scan(ix, _matrix(b["v"]), b["floor"].to_numpy(), want)
            place = np.repeat(np.arange(b.num_rows), n_units)
            by = np.argsort(units, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(units[by]) > 0, True])
            # units that are near to many of the queries come first
            near = np.arange(len(units)) - np.repeat(np.cumsum(n_units) - n_units, n_units)
            for k in np.argsort(np.add.reduceat(near[by], edge[:-1]) / np.diff(edge), kind="stable").tolist():
                u = units[by[edge[k]]]
                lo, hi = np.searchsorted(unit, (u, u + 1))
                scan.meet(place[by[edge[k] : edge[k + 1]]], x[lo:hi], xr[lo:hi], ids[lo:hi])
            i, found, score = scan.settle()
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays([b["id"].combine_chunks().take(take), b["h"].combine_chunks().take(take), pa.array(found), pa.array(score)], names=["id", "h", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b["shard"].to_numpy(), b["asked"].to_numpy(zero_copy_only=False)]
            edge = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]), True]).tolist()
            for s, e in zip(edge, edge[1:], strict=False):
                if cols[0][s] != at:
                    yield from answer(asks)
                    at, base, asks, n_asks = cols[0][s], [], [], 0
                if not cols[1][s]:
                    base.append(b.slice(s, e - s))
                    continue
                while s < e:
                    part = b.slice(s, min(e - s, QUERIES - n_asks))
                    asks.append(part)
                    s, n_asks = s + part.num_rows, n_asks + part.num_rows
                    if n_asks == QUERIES:
                        yield from answer(asks)
                        asks, n_asks = [], 0
        yield from answer(asks)

    # of the rows of one vector those with the smallest ids; map tasks pass on `want` of a vector at most
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    candidates = rows.select("id", "v").distinct().withColumn("nth", nth).where(F.col("nth") <= want).select("id", F.lit(0).cast("long").alias("h"), "v")
    queries = rows.where("asks").groupBy("v").agg(F.min("id").alias("id")).select("id", F.xxhash64("v").alias("h"), "v")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = f"shard long, asked boolean, floor double, units array<int>, id long, h long, v {kind}"
    both = candidates.mapInArrow(tidy(deal), kinds).unionByName(queries.mapInArrow(tidy(deal_queries), kinds))
    found = both.repartition(n, "shard").sortWithinPartitions("shard", "asked").mapInArrow(tidy(meet), "id long, h long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.desc("score"), "vec_id"))
    best = found.groupBy("id", "h", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= want)
    best = best.groupBy("id", "h").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))  # `want` at most
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "v").distinct().join(queries, "v").select("query_id", "id", "h")
    answers = asking.join(best, ["id", "h"]).select("query_id", F.inline("found")).where("query_id <> vec_id")
    return answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract of op8."""
    return search(embeddings, F.col("vec_id") % 20 == 0)
