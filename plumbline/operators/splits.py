"""Splits, folds and samples that are exact, seeded, and the same for any partitioning.

A row's place in a random order is the hash of the seed and its id. To take an exact
number of the first rows of each class without sorting a class in one task, the hashes
are counted by their top bits, the bucket in which the number is reached is found from
those counts, and of that bucket's rows the last one that is taken. Both are found when
the split is made; after that a row is compared with the last one of its group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

BUCKET_BITS = 14
#: Groups whose last rows are written into the expression; of more they are a table that is sent to all tasks.
FEW_GROUPS = 64
#: The largest groups are assigned one by one on the driver, these many; those smaller still go by hash, which evens them out.
GREEDY_GROUPS = 20_000


def order_of(seed: int, row_id: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(row_id))


def shuffled(seed: int, row_id: str) -> Column:
    """A number below 2^62 for each number below 2^62, one-to-one, in an order that the seed decides: four rounds that mix one half of the bits with a hash of the other."""
    half = F.lit((1 << 31) - 1)
    left, right = F.shiftright(F.col(row_id), 31).cast("long"), F.col(row_id).cast("long").bitwiseAND(half)
    for k in range(4):
        left, right = right, left.bitwiseXOR(F.hash(F.lit(seed), F.lit(k), right).cast("long").bitwiseAND(half))
    return F.shiftleft(left, 31).bitwiseOR(right)


def first_of_each(df: DataFrame, group: str | None, count: Column, seed: int, row_id: str, flag: str = "__taken") -> DataFrame:
    """df with a boolean: whether a row is among the first count(n) rows of its group of n rows in the seeded order.

    count is an expression over the column n. Nulls are a group of their own. The last row
    that is taken of each group is found at once, in two passes over group, hash and id;
    what is returned compares each row with it, without a shuffle.
    """
    key = F.col(group) if group else F.lit(1)
    x = df.select(key.alias("g"), F.col(row_id).alias("i")).withColumn("h", order_of(seed, "i")).withColumn("b", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    by = x.groupBy("g", "b").agg(F.count("*").alias("m"))
    w = Window.partitionBy("g").orderBy("b")
    whole = Window.partitionBy("g")
    cuts = by.withColumn("before", F.sum("m").over(w) - F.col("m")).withColumn("n", F.sum("m").over(whole)).withColumn("want", count.cast("long"))
    # the bucket in which the wanted number is reached, and how many of its rows are needed
    cuts = cuts.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("m") >= F.col("want"))).select("g", "n", "want", F.col("b").alias("edge"), (F.col("want") - F.col("before")).alias("need"))
    spark, named = df.sparkSession, StructType([StructField("g", x.schema["g"].dataType)])
    found = cuts.collect()  # one row a group
    everything, some = [r for r in found if r["want"] >= r["n"]], [r for r in found if r["want"] < r["n"]]
    last: list[tuple] = []
    twice = False
    if some:
        edges = spark.createDataFrame([(r["g"], r["edge"], r["need"]) for r in some], StructType([*named, StructField("edge", LongType()), StructField("need", LongType())]))
        held = x.join(F.broadcast(edges.withColumnRenamed("g", "gg")), F.col("g").eqNullSafe(F.col("gg")) & (F.col("b") == F.col("edge")))
        # rows of one hash and id are alike in the order: counted as one, and told apart only where the number is reached among them
        alike = held.groupBy("g", "need", "h", "i").agg(F.count("*").alias("m"))
        up = F.sum("m").over(Window.partitionBy("g").orderBy("h", "i").rowsBetween(Window.unboundedPreceding, 0))
        ends = alike.withColumn("up", up).where((F.col("up") >= F.col("need")) & (F.col("up") - F.col("m") < F.col("need"))).collect()  # one row a group
        last = [(r["g"], r["h"], r["i"], r["need"] - (r["up"] - r["m"])) for r in ends]
        twice = any(r["up"] > r["need"] for r in ends)
    flipped = -(1 << 63)  # hashes are ordered without their sign, as the buckets are
    h = order_of(seed, row_id)
    if len(found) <= FEW_GROUPS:
        is_of = lambda v: key.eqNullSafe(F.lit(v).cast(x.schema["g"].dataType))
        before = lambda eh, ei: (h.bitwiseXOR(F.lit(flipped)) < F.lit(eh ^ flipped)) | ((h == F.lit(eh)) & (F.col(row_id) <= F.lit(ei)))
        taken, on, need = F.lit(False), F.lit(False), F.lit(0)
        for g, eh, ei, k in last:
            taken, need = F.when(is_of(g), before(eh, ei)).otherwise(taken), F.when(is_of(g), F.lit(k)).otherwise(need)
            on = on | (is_of(g) & (h == F.lit(eh)) & (F.col(row_id) == F.lit(ei)))
        for r in everything:
            taken = F.when(is_of(r["g"]), True).otherwise(taken)
        out = df.withColumn(flag, F.coalesce(taken, F.lit(False)))
        if not twice:
            return out
        out = out.withColumns({"__on": F.coalesce(on, F.lit(False)), "__need": need, "__g": F.struct(key.alias("g"))})
    else:
        edge = StructType([*named, StructField("__eh", LongType()), StructField("__ei", df.schema[row_id].dataType), StructField("__need", LongType()), StructField("__all", BooleanType())])
        table = spark.createDataFrame([*[(*r, False) for r in last], *[(r["g"], None, None, None, True) for r in everything]], edge).withColumnRenamed("g", "__gg")
        out = df.withColumns({"__k": key, "__h": h}).join(F.broadcast(table), F.col("__k").eqNullSafe(F.col("__gg")), "left")  # one row a group
        at = F.col("__h") == F.col("__eh")
        taken = F.col("__all") | (F.col("__h").bitwiseXOR(F.lit(flipped)) < F.col("__eh").bitwiseXOR(F.lit(flipped))) | (at & (F.col(row_id) <= F.col("__ei")))
        out = out.withColumns({flag: F.coalesce(taken, F.lit(False)), "__on": F.coalesce(at & (F.col(row_id) == F.col("__ei")), F.lit(False)), "__g": F.struct(F.col("__k").alias("g"))})
        out = out.drop("__k", "__gg", "__h", "__eh", "__ei", "__all")
        if not twice:
            return out.drop("__on", "__need", "__g")
    rank = F.row_number().over(Window.partitionBy("__g").orderBy(F.lit(1)))  # rows of one hash and id
    ties = out.where("__on").withColumn(flag, rank <= F.col("__need"))
    return out.where("not __on").unionByName(ties).drop("__on", "__need", "__g")


def stratified_split(df: DataFrame, label: str, ratio: float, seed: int, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Train and test with a share of 1 - ratio of every class in test, to the nearest row. A class of one row is in train."""
    want = F.when(F.col("n") < 2, 0).otherwise(F.least(F.col("n") - 1, F.greatest(F.lit(1), F.round(F.col("n") * (1 - ratio)))))
    x = first_of_each(df, label, want, seed, row_id)
    return x.where("not __taken").drop("__taken"), x.where("__taken").drop("__taken")


def group_key(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def assign_groups(sizes: np.ndarray, folds: int, order: np.ndarray) -> np.ndarray:
    """A fold for each row of a group x class table: large, uneven groups first, each to the fold that keeps class shares most even."""
    total = sizes.sum(axis=0).astype(float)
    held = np.zeros((folds, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int64)
    shuffled = order[np.argsort(-sizes[order].std(axis=1) if sizes.shape[1] > 1 else -sizes[order, 0], kind="stable")]
    scale = np.maximum(total, 1)
    for g in shuffled:
        share = held / scale
        with_group = (held + sizes[g]) / scale
        # spread over folds of each class's share, if the group went to fold f
        s1, s2 = share.sum(axis=0), (share**2).sum(axis=0)
        m1 = s1[None, :] - share + with_group
        m2 = s2[None, :] - share**2 + with_group**2
        spread = np.sqrt(np.maximum(0, m2 / folds - (m1 / folds) ** 2)).mean(axis=1)
        f = int(np.lexsort((held.sum(axis=1), np.round(spread, 12)))[0])
        out[g] = f
        held[f] += sizes[g]
    return out


def group_folds(df: DataFrame, label: str, groups: list[str], folds: int, seed: int, out: str = "__fold") -> DataFrame:
    """df with a fold number; all rows of a group share it. Classes are kept even by the groups of most rows."""
    present = [c for c in groups if c in df.columns]
    if not present:
        raise ValueError(f"none of the group columns {groups} is in the data")
    if folds < 2:
        raise ValueError("a grouped split needs two folds at least")
    key = group_key(present)
    hashed = df.withColumn("__key", F.xxhash64(F.lit(seed), key))
    by = hashed.groupBy("__key", F.col(label).cast("string").alias("y")).agg(F.count("*").alias("n"))
    largest = by.groupBy("__key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "__key").limit(GREEDY_GROUPS).select("__key")
    rows = by.join(largest, "__key", "left_semi").collect()  # GREEDY_GROUPS groups at most, times the classes
    keys = sorted({r["__key"] for r in rows})
    classes = sorted({r["y"] or "" for r in rows})
    at, col = {k: i for i, k in enumerate(keys)}, {c: i for i, c in enumerate(classes)}
    sizes = np.zeros((len(keys), len(classes)))
    for r in rows:
        sizes[at[r["__key"]], col[r["y"] or ""]] += r["n"]
    fold = assign_groups(sizes, folds, np.random.default_rng(seed).permutation(len(keys)))
    table = df.sparkSession.createDataFrame([(int(k), int(f)) for k, f in zip(keys, fold, strict=True)] or [(0, 0)], f"__key long, {out} int")
    placed = hashed.join(F.broadcast(table), "__key", "left")  # at most GREEDY_GROUPS pairs of numbers
    return placed.withColumn(out, F.coalesce(out, F.pmod("__key", F.lit(folds)).cast("int"))).drop("__key")


def grouped_split(df: DataFrame, label: str, groups: list[str], ratio: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Train and test that share no group; test is one of round(1 / (1 - ratio)) folds."""
    x = group_folds(df, label, groups, round(1 / (1 - ratio)), seed)
    return x.where("__fold <> 0").drop("__fold"), x.where("__fold = 0").drop("__fold")


def shared_groups(train: DataFrame, test: DataFrame, groups: list[str]) -> int:
    present = [c for c in groups if c in train.columns]
    return train.select(group_key(present).alias("k")).intersect(test.select(group_key(present).alias("k"))).count()


def stratified_folds(df: DataFrame, label: str, folds: int, seed: int, row_id: str, out: str = "__fold") -> DataFrame:
    """df with a fold number; each class is spread evenly, to the nearest row for the first folds and the rest for the last."""
    x = df.withColumn(out, F.lit(folds - 1))
    for k in range(folds - 1):
        n = F.round(F.col("n") * (k + 1) / folds)
        x = first_of_each(x, label, n, seed, row_id, "__in").withColumn(out, F.when(F.col("__in") & (F.col(out) == folds - 1), k).otherwise(F.col(out))).drop("__in")
    return x


def sample_rows(df: DataFrame, k: int, seed: int, row_id: str) -> DataFrame:
    """Exactly min(n, k) rows, uniform, the same for any partitioning."""
    x = first_of_each(df, None, F.least(F.col("n"), F.lit(k)), seed, row_id)
    return x.where("__taken").drop("__taken")


def sample_by_class(df: DataFrame, label: str, k: int, seed: int, row_id: str) -> DataFrame:
    """At most k rows of each class, the first in the seeded order; each map task passes on k a class at most."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order_of(seed, row_id), row_id))
    return df.where(F.col(label).isNotNull()).withColumn("__k", rank).where(F.col("__k") <= k).drop("__k")


def undersample(df: DataFrame, label: str, seed: int, row_id: str) -> DataFrame:
    """As many rows of each class as the smallest has."""
    least = df.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.min("count")).first()[0]
    if least is None:
        return df
    x = first_of_each(df.where(F.col(label).isNotNull()), label, F.lit(least), seed, row_id)
    return x.where("__taken").drop("__taken")


def permuted(df: DataFrame, column: str, seed: int, row_id: str, parts: int = 4096) -> DataFrame:
    """df with one column's values dealt out anew among the rows.

    Rows and values are numbered in two seeded orders and joined on the number. The
    numbers are made inside hash ranges and shifted by the ranges' totals, so no task
    sorts the whole table.
    """
    def numbered(x: DataFrame, s: int, *keep: str) -> DataFrame:
        y = x.select(*keep, row_id, order_of(s, row_id).alias("__h")).withColumn("__p", F.shiftrightunsigned("__h", 64 - parts.bit_length() + 1))
        sizes = y.groupBy("__p").agg(F.count("*").alias("m")).withColumn("__base", F.sum("m").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", F.coalesce("__base", F.lit(0)).alias("__base"))
        y = y.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy("__h", row_id))).join(F.broadcast(sizes), "__p")
        return y.withColumn("__n", F.col("__k") + F.col("__base")).drop("__p", "__h", "__k", "__base")

    rows = numbered(df, seed, *[c for c in df.columns if c not in (column, row_id)])
    values = numbered(df.select(column, row_id), seed + 7919, column).drop(row_id)
    return rows.join(values, "__n").select(*df.columns)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
