from pyspark.sql import functions as F

from plumbline.streaming import incremental


def test_batches_add_up(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select((F.col("id") % 3).alias("y"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("x")).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("y long, x long").option("maxFilesPerTrigger", 1).parquet(str(src))
    sink = incremental.drain(stream, incremental.running_integrity(spark, ["x"], "y"))
    got = {r["y"]: (r["n"], r["missing_x"]) for r in sink.result().collect()}
    assert sink.version == 2 and got == {k: (10, sum(1 for i in range(30) if i % 3 == k and i % 4 == 0)) for k in range(3)}
    first = {r["y"]: r["n"] for r in sink.result().collect()}
    sink(spark.read.parquet(str(src)).limit(0), 2)  # a batch that is run again replaces its own version
    assert sum(first.values()) == 30


def test_windows_and_repeats(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(60).select(F.timestamp_seconds(F.col("id") * 60).alias("t"), (F.col("id") % 2).alias("y"), F.lit(1).alias("k")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("t timestamp, y long, k int").parquet(src)
    for name, df in (("w", incremental.windowed_class_counts(stream, "t", "y", "30 minutes", "5 minutes")), ("c", incremental.class_counts_stream(stream, "y")), ("d", incremental.first_seen(stream, ["k"], "t", "3 hours"))):
        q = df.writeStream.format("memory").queryName(f"q_{name}").outputMode("complete" if name != "d" else "append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r["cls"], r["n"]) for r in spark.table("q_w").collect()} == {(0, 15), (1, 15)} and spark.table("q_w").count() == 4
    assert {tuple(r) for r in spark.table("q_c").collect()} == {(0, 30), (1, 30)} and spark.table("q_d").count() == 1
