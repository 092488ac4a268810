"""Checks that stay up to date on a stream: counts that add up, merged batch by batch, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lineage import shared_folder


def class_counts_stream(stream: DataFrame, label: str) -> DataFrame:
    """(cls, n) of all rows so far; state is a row a class."""
    return stream.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("cls")).agg(F.count("*").alias("n"))


def windowed_class_counts(stream: DataFrame, time: str, label: str, width: str, late: str) -> DataFrame:
    """(start, cls, n) of event-time windows; rows later than the watermark are left out and old windows leave the state."""
    x = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(label).alias("cls")).agg(F.count("*").alias("n"))
    return x.select(F.col("w.start").alias("start"), "cls", "n")


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The stream without rows that repeat a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class Running:
    """Aggregates that add up (counts, sums, minima, maxima), kept as a small Parquet table that each batch replaces.

    A batch writes its own version and reads the one before it, so a batch that is run
    again after a failure gives the same table.
    """

    def __init__(self, spark: SparkSession, by: list[str], partial: dict[str, Column], merged: dict[str, Callable[[str], Column]], folder: str | None = None) -> None:
        self.spark, self.by, self.partial, self.merged = spark, by, partial, merged
        self.folder = folder or f"{shared_folder(spark).rstrip('/')}/running-{id(self)}"
        self.version = -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*self.by).agg(*[c.alias(n) for n, c in self.partial.items()])
        if number > 0:
            old = self.spark.read.parquet(f"{self.folder}/{number - 1}")
            new = old.unionByName(new).groupBy(*self.by).agg(*[f(n).alias(n) for n, f in self.merged.items()])
        new.write.mode("overwrite").parquet(f"{self.folder}/{number}")
        self.version = number

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.version}")


def running_integrity(spark: SparkSession, features: list[str], label: str) -> Running:
    """Rows, gaps and infinities of a stream by label."""
    partial = {"n": F.count("*")}
    for c in features:
        partial[f"missing_{c}"] = F.count_if(F.col(c).isNull())
    return Running(spark, [label], partial, dict.fromkeys(partial, lambda n: F.sum(n)))


def drain(stream: DataFrame, sink: Running) -> Running:
    """Feeds all that the source holds now to the sink, and waits."""
    checkpoint = f"{sink.folder}-offsets"
    query: StreamingQuery = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sink
