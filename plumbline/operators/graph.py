"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint


#: A node with more edges than this, and than a sixteenth of a task's even share, is dealt out in parts.
HUB_EDGES, HUB_SHARE = 128, 16


def share_of_a_task(spark: SparkSession, rows: int) -> int:
    """How many rows of one key may go to one task."""
    return max(HUB_EDGES, rows // (int(spark.conf.get("spark.sql.shuffle.partitions")) * HUB_SHARE))


def join_in_parts(many: DataFrame, one: DataFrame, key: str, by: str, n: str, limit: int) -> DataFrame:
    """many with the columns of one, which has a row for each key and in n how many rows of many have it. The row of a key
    with more than limit is copied to as many parts as its rows are dealt to by another column; of such keys there are at
    most rows / limit, HUB_SHARE a task, so their list is small."""
    taken = max(len(c) for c in [*many.columns, *one.columns]) * "_"  # longer than any name, so free
    parts, hub, part = F.ceil(F.col(n) / limit).cast("int"), f"parts{taken}", f"part{taken}"
    hubs = one.where(F.col(n) > limit).select(key, parts.alias(hub))
    dealt = many.join(F.broadcast(hubs), key, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(by), F.col(hub)), F.lit(0)).cast("int")).drop(hub)
    copied = one.withColumn(part, F.explode(F.when(F.col(n) > limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied.drop(n), [key, part]).drop(part)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node on an edge (a, b) of longs.

    Rounds alternate two contractions: each node sends its larger neighbours, then its
    smaller ones, to the least it knows. The minima combine before the shuffle and are
    joined back, the edges of hubs in parts, so no task has all edges of a large group's
    centre. Rounds grow with the logarithm of the longest chain.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))"), F.lit(0))).first())
    e = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(e)
    for _ in range(max_rounds):
        limit = share_of_a_task(edges.sparkSession, 2 * before[0])
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_in_parts(both.where("b > a"), low, "a", "b", "n", limit).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_in_parts(large, low, "a", "b", "n", limit).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = checkpoint(small.where("a <> b").distinct())
        now = state(e)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def bipartite_components(df: DataFrame, left: str, right: str) -> DataFrame:
    """(left value, component): values of one column that are linked through shared values of another, named by the least."""
    values = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).cast("long").alias("l"), F.col(right).alias("r")).distinct()
    hub = values.groupBy("r").agg(F.min("l").alias("m"))
    edges = values.join(hub, "r").select(F.col("l").alias("a"), F.col("m").alias("b"))
    linked = components(edges)
    mine = values.select("l").distinct()
    return mine.join(linked, mine["l"] == linked["node"], "left").select(F.col("l").alias(left), F.coalesce("root", "l").alias("component"))
