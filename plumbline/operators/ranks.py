"""Cumulative counts and the rank statistics that rest on them, without a global sort in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.storagelevel import StorageLevel

from ..functions.lineage import ship

#: Least and most ranges that the values of one group are cut into; each is one window partition.
RANGES, MOST_RANGES = 64, 4096


def range_count(spark: SparkSession) -> int:
    """Ranges for one group: some for each shuffle partition, so that all tasks have a share of even a single column."""
    return min(MOST_RANGES, max(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _cuts(value: Column, ranges: int) -> Column:
    return F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10 * ranges)


def _range_of(cuts: Column, value: Column, ranges: int) -> Column:
    """How many of the sorted cuts lie below the value, found in two steps of about 64 comparisons."""
    if ranges <= RANGES:
        return F.size(F.filter(cuts, lambda c: c < value))
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(RANGES - 1), F.lit(ranges - 2), F.lit(RANGES)), lambda k: F.get(cuts, k)), lambda c: c < value))
    return coarse * RANGES + F.size(F.filter(F.slice(cuts, coarse * RANGES + 1, F.lit(RANGES - 1)), lambda c: c < value))


def cumulative(df: DataFrame, group: list[str], value: str, weights: dict[str, str], ranges: int | None = None) -> DataFrame:
    """df with sums over the smaller values of the same group: of each weight column, under the name given for it.

    Values must be unique in a group. Approximate quantiles, a bounded table of at most
    MOST_RANGES numbers a group, cut each group into ranges; the running sums are taken
    inside a range, all in one window, and what lies below the range comes from a window
    over the ranges' totals. No task sorts a whole column.
    """
    ranges = ranges or range_count(df.sparkSession)
    cuts = df.groupBy(*group).agg(_cuts(F.col(value), ranges).alias("__cuts"))
    x = df.join(F.broadcast(cuts), group).withColumn("__range", _range_of(F.col("__cuts"), F.col(value), ranges)).drop("__cuts")
    total = x.groupBy(*group, "__range").agg(*[F.sum(w).alias(f"__w{k}") for k, w in enumerate(weights)])
    lower = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    below = total.select(*group, "__range", *[F.coalesce(F.sum(f"__w{k}").over(lower), F.lit(0)).alias(f"__below{k}") for k in range(len(weights))])
    smaller = Window.partitionBy(*group, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"__inside{k}": F.coalesce(F.sum(w).over(smaller), F.lit(0)) for k, w in enumerate(weights)}).join(F.broadcast(below), [*group, "__range"])
    return x.select(*df.columns, *[(F.col(f"__inside{k}") + F.col(f"__below{k}")).alias(out) for k, out in enumerate(weights.values())])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, np.ndarray, np.ndarray]]:
    """(group, values, counts as a matrix) of each stretch of a group in sorted batches of (group, value, counts)."""
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).dictionary_encode()
        at = g.indices.to_numpy(zero_copy_only=False)
        v = b.column(1).to_numpy(zero_copy_only=False)
        m = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2, b.num_columns)], axis=1)
        ends = np.flatnonzero(np.diff(at, append=-1)) + 1
        for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True):
            yield g.dictionary[int(at[s])].as_py(), v[s:e], m[s:e]


def _sorted(df: DataFrame, group: str, value: str, counts: list[str]) -> DataFrame:
    """(group, value, counts), cut into ranges of both, one a partition in the order of the ranges, and sorted inside."""
    ship(df.sparkSession)
    n = min(MOST_RANGES, max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    x = df.select(group, F.col(value).cast("double").alias(value), *[F.col(c).cast("long").alias(c) for c in counts])
    return x.repartitionByRange(n, group, value).sortWithinPartitions(group, value)


def _walked(x: DataFrame, walk: Callable[[int, Iterator[tuple[Any, np.ndarray, np.ndarray]]], list[tuple]], more: str) -> list:
    """What walk(range, stretches) says of each range of a sorted table, (group, ...) a group: at most a row a range and group, in the order of the ranges."""
    kind, held = x.schema[0].dataType.simpleString(), to_arrow_type(x.schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        rows = walk(at, _stretches(batches))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.int32()), *[pa.array(c, held if k == 0 else None) for k, c in enumerate(zip(*rows, strict=True))]], names=names)

    schema = f"at int, g {kind}, {more}"
    names = [c.strip().split()[0] for c in schema.split(",")]
    return sorted(x.mapInArrow(run, schema).collect(), key=lambda r: r["at"])


def rank_sums(df: DataFrame, group: str, value: str, counts: list[str]) -> dict[Any, tuple[list[int], list[int], float]]:
    """Of each group the sum of every count, twice the sum of the average ranks that the counted rows have among all, and the largest size of a value.

    Values must be unique in a group. A range sums the ranks inside it; the rows below it add their number for each of its rows.
    """
    def walk(at: int, stretches: Iterator[tuple[Any, np.ndarray, np.ndarray]]) -> list[tuple]:
        got: dict[Any, list] = {}
        for g, v, m in stretches:
            s = got.setdefault(g, [np.zeros(m.shape[1], np.int64), np.zeros(m.shape[1], np.int64), 0.0])
            t = m.sum(axis=1)
            s[1] += (2 * (s[0].sum() + np.cumsum(t) - t) + t + 1) @ m
            s[0] += m.sum(axis=0)
            s[2] = max(s[2], float(np.abs(v).max()))
        return [(g, n.tolist(), r.tolist(), top) for g, (n, r, top) in got.items()]

    out: dict[Any, tuple[list[int], list[int], float]] = {}
    for row in _walked(_sorted(df, group, value, counts), walk, "n array<long>, r array<long>, top double"):
        n, r, top = out.get(row["g"], ([0] * len(counts), [0] * len(counts), 0.0))
        below = sum(n)
        out[row["g"]] = [a + b for a, b in zip(n, row["n"], strict=True)], [a + b + 2 * below * c for a, b, c in zip(r, row["r"], row["n"], strict=True)], max(top, row["top"])
    return out


@contextmanager
def _summed(df: DataFrame, group: str, value: str, counts: list[str]) -> Iterator[tuple[DataFrame, dict, dict, dict]]:
    """The sorted table, kept while in use; sums of the counts of each group, those below each (range, group), and the first value after it."""
    def walk(at: int, stretches: Iterator[tuple[Any, np.ndarray, np.ndarray]]) -> list[tuple]:
        got: dict[Any, list] = {}
        for g, v, m in stretches:
            s = got.setdefault(g, [np.zeros(m.shape[1], np.int64), float(v[0])])
            s[0] += m.sum(axis=0)
        return [(g, n.tolist(), first) for g, (n, first) in got.items()]

    x = _sorted(df, group, value, counts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total: dict[Any, np.ndarray] = {}
        below, after, last = {}, {}, {}
        for r in _walked(x, walk, "n array<long>, first double"):
            g = r["g"]
            below[r["at"], g] = total.get(g, np.zeros(len(counts), np.int64))
            total[g] = below[r["at"], g] + np.array(r["n"], np.int64)
            if g in last:
                after[last[g], g] = r["first"]
            last[g] = r["at"]
        yield x, total, below, after
    finally:
        x.unpersist()


def _by_value(df: DataFrame, features: list[str], kinds: list[Column]) -> DataFrame:
    """(at, value, c0, ...): rows of each kind for each distinct value, missing ones left out, of the feature of that number."""
    wide = df.select(*[k.alias(f"k{i}") for i, k in enumerate(kinds)], F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("at", "value"))
    long = wide.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("at", "value").agg(*[F.count_if(f"k{i}").alias(f"c{i}") for i in range(len(kinds))])


def _known(df: DataFrame, label: str) -> list:
    return sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())  # one row a class


def feature_auc(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, cls, n, n_class, auc): Mann-Whitney AUC of every numeric feature for every class against the rest, ties at half; a feature that holds an infinity is left out."""
    known = _known(df, label)
    schema = StructType().add("feature", StringType()).add("cls", df.schema[label].dataType).add("n", LongType()).add("n_class", LongType()).add("auc", DoubleType())
    sums = rank_sums(_by_value(df.where(F.col(label).isNotNull()), features, [F.col(label) == F.lit(v) for v in known]), "at", "value", [f"c{k}" for k in range(len(known))]) if known else {}
    rows = []
    for at, (ns, rs, top) in sums.items():
        for cls, m, r in zip(known, ns, rs, strict=True):
            n = sum(ns)
            if 0 < m < n and top < float("inf"):
                auc = (r - m * (m + 1)) / (2 * m * (n - m))
                rows.append((features[at], cls, n, m, max(auc, 1 - auc)))
    return df.sparkSession.createDataFrame(rows, schema)


def score_auc(counts: DataFrame, group: str = "cls") -> DataFrame:
    """(group, support, auc) from rows (group, score, pos, neg) of counts: the chance that a positive scores above a negative."""
    by = counts.groupBy(group, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = [(g, p, (r - p * (p + 1)) / (2 * p * q)) for g, ((p, q), (r, _), _) in rank_sums(by, group, "score", ["pos", "neg"]).items() if p > 0 and q > 0]
    return counts.sparkSession.createDataFrame(rows, StructType().add(group, counts.schema[group].dataType).add("support", LongType()).add("auc", DoubleType()))


def two_sample_ks(left: DataFrame, right: DataFrame, features: list[str]) -> DataFrame:
    """(feature, ks): largest distance between the empirical distributions of each feature."""
    both = left.select(*features, F.lit(True).alias("__left")).unionByName(right.select(*features, F.lit(False).alias("__left")))
    with _summed(_by_value(both, features, [F.col("__left"), ~F.col("__left")]), "at", "value", ["c0", "c1"]) as (x, total, below, _):
        def walk(at: int, stretches: Iterator[tuple[Any, np.ndarray, np.ndarray]]) -> list[tuple]:
            got: dict[Any, float] = {}
            up: dict[Any, np.ndarray] = {}
            for g, _, m in stretches:
                if total[g].min() > 0:
                    here = up.get(g, below[at, g]) + np.cumsum(m, axis=0)
                    up[g] = here[-1]
                    got[g] = max(got.get(g, 0.0), float(np.abs(here[:, 0] / total[g][0] - here[:, 1] / total[g][1]).max()))
            return list(got.items())

        ks: dict[int, float] = {}
        for r in _walked(x, walk, "ks double"):
            ks[r["g"]] = max(ks.get(r["g"], 0.0), r["ks"])
    return left.sparkSession.createDataFrame([(features[g], v) for g, v in ks.items()], "feature string, ks double")


def best_stump(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row (feature, threshold, gini, left_cls, right_cls): the split of one feature with the least weighted Gini impurity.

    Exact: all values are candidates. Ties go to the lower feature name, then threshold, and a leaf's to its lower class.
    """
    known = _known(df, label)
    kind = df.schema[label].dataType
    schema = StructType().add("feature", StringType()).add("threshold", DoubleType()).add("gini", DoubleType()).add("left_cls", kind).add("right_cls", kind)
    if not known:
        return df.sparkSession.createDataFrame([], schema)
    by = _by_value(df.where(F.col(label).isNotNull()), features, [F.col(label) == F.lit(v) for v in known])
    with _summed(by, "at", "value", [f"c{k}" for k in range(len(known))]) as (x, total, below, after):
        def walk(at: int, stretches: Iterator[tuple[Any, np.ndarray, np.ndarray]]) -> list[tuple]:
            best: dict[Any, list] = {}
            up: dict[Any, np.ndarray] = {}
            for g, v, m in stretches:
                if g in best and best[g][5] is None:
                    best[g][5] = float(v[0])  # the threshold lies half-way to the next value
                left = up.get(g, below[at, g]) + np.cumsum(m, axis=0)
                up[g] = left[-1]
                right = total[g] - left
                nl, nr = left.sum(axis=1), right.sum(axis=1)
                some = nr > 0
                left, right, nl, nr = left[some], right[some], nl[some], nr[some]
                if not len(nl):
                    continue
                gini = ((nl - (left * left).sum(axis=1) / nl) + (nr - (right * right).sum(axis=1) / nr)) / (nl + nr)
                flat = np.round(gini, 12)
                k = int(flat.argmin())
                if g not in best or flat[k] < best[g][0]:
                    best[g] = [float(flat[k]), float(v[k]), float(gini[k]), int(left[k].argmax()), int(right[k].argmax()), float(v[k + 1]) if k + 1 < len(v) else None]
            return [(g, *b[:5], after[at, g] if b[5] is None else b[5]) for g, b in best.items()]

        rows = _walked(x, walk, "flat double, value double, gini double, l long, r long, next double")
    rows = sorted(rows, key=lambda r: (r["flat"], features[r["g"]], r["value"]))[:1]
    return df.sparkSession.createDataFrame([(features[r["g"]], (r["value"] + r["next"]) / 2, r["gini"], known[r["l"]], known[r["r"]]) for r in rows], schema)


def average_rank(df: DataFrame, value: str) -> DataFrame:
    """(value, n, rank) of one column, equal values sharing the mean of their ranks."""
    by = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n")).withColumn("feature", F.lit(value))
    return cumulative(by, ["feature"], "value", {"n": "before"}).select("value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def transitions(df: DataFrame, order: str, label: str, ranges: int | None = None) -> DataFrame:
    """One row (rows, changes): how often the label differs from the row before, in the given order.

    Rows are compared inside ranges of the order; the last label of a range meets the first of the next in a window over the ranges.
    """
    ranges = ranges or range_count(df.sparkSession)
    x = df.select(F.col(order).alias("o"), F.col(label).alias("y"))
    cuts = x.agg(_cuts(F.col("o"), ranges).alias("cuts"))
    x = x.crossJoin(F.broadcast(cuts)).withColumn("r", _range_of(F.col("cuts"), F.col("o"), ranges)).drop("cuts")  # cuts is one row
    w = Window.partitionBy("r").orderBy("o")
    differ: Column = ~F.col("y").eqNullSafe(F.col("before")) | (F.col("y").isNull() & F.col("before").isNull())
    inner = x.withColumn("before", F.lag("y").over(w)).withColumn("k", F.row_number().over(w))
    per = inner.groupBy("r").agg(F.count("*").alias("n"), F.count_if((F.col("k") > 1) & differ).alias("c"), F.min_by("y", "o").alias("first"), F.max_by("y", "o").alias("last"))
    seam = per.withColumn("before", F.lag("last").over(Window.orderBy("r"))).withColumn("k", F.row_number().over(Window.orderBy("r")))  # at most `ranges` rows
    cross = (F.col("k") > 1) & (~F.col("first").eqNullSafe(F.col("before")) | (F.col("first").isNull() & F.col("before").isNull()))
    return seam.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c") + cross.cast("long")), F.lit(0)).alias("changes"))
