import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import splits


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 600, "a").when(F.col("id") == 601, "one").otherwise("b").alias("y"), (F.col("id") % 37).alias("g")).persist()


def counts(df):
    return {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}


def test_stratified_is_exact_seeded_and_the_same_for_any_partitioning(rows):
    train, test = splits.stratified_split(rows, "y", 0.8, 1, "id")
    n, m = counts(rows), counts(test)
    assert m["a"] == round(n["a"] * 0.2) and m["b"] == round(n["b"] * 0.2) and m[None] == round(n[None] * 0.2) and "one" not in m
    assert train.count() + test.count() == 2000 and train.join(test, "id").count() == 0
    ids = {r["id"] for r in test.collect()}
    assert {r["id"] for r in splits.stratified_split(rows.repartition(9), "y", 0.8, 1, "id")[1].collect()} == ids
    assert {r["id"] for r in splits.stratified_split(rows, "y", 0.8, 2, "id")[1].collect()} != ids


def test_grouped(rows):
    train, test = splits.grouped_split(rows, "y", ["g"], 0.8, 3)
    assert splits.shared_groups(train, test, ["g"]) == 0 and train.count() + test.count() == 2000 and 300 < test.count() < 500
    with pytest.raises(ValueError, match="none of the group columns"):
        splits.grouped_split(rows, "y", ["nope"], 0.8, 3)
    with pytest.raises(ValueError, match="two folds"):
        splits.grouped_split(rows, "y", ["g"], 0.2, 3)


def test_grouped_by_hash_beyond_the_limit(rows, monkeypatch):
    monkeypatch.setattr(splits, "GREEDY_GROUPS", 10)
    train, test = splits.grouped_split(rows, "y", ["g"], 0.8, 3)
    assert splits.shared_groups(train, test, ["g"]) == 0 and train.count() + test.count() == 2000


def test_groups_are_spread_evenly():
    sizes = np.random.default_rng(0).integers(1, 50, (200, 3)).astype(float)
    fold = splits.assign_groups(sizes, 5, np.arange(200))
    share = np.array([sizes[fold == k].sum(axis=0) for k in range(5)]) / sizes.sum(axis=0)
    assert np.abs(share - 0.2).max() < 0.02


def test_folds_samples_and_undersampling(rows):
    f = splits.stratified_folds(rows, "y", 5, 1, "id").groupBy("y", "__fold").count().where("y = 'b'").collect()
    assert len(f) == 5 and max(r["count"] for r in f) - min(r["count"] for r in f) <= 1
    assert splits.sample_rows(rows, 77, 1, "id").count() == 77 and splits.sample_rows(rows, 10**6, 1, "id").count() == 2000
    assert splits.sample_rows(rows.limit(0), 5, 1, "id").count() == 0
    assert counts(splits.sample_by_class(rows, "y", 50, 1, "id")) == {"a": 50, "b": 50, "one": 1}
    assert set(counts(splits.undersample(rows.where("y <> 'one'"), "y", 1, "id")).values()) == {540}


def test_permuted_keeps_rows_and_values(rows):
    out = splits.permuted(rows, "g", 5, "id")
    assert out.count() == 2000 and sorted(r["g"] for r in out.collect()) == sorted(r["g"] for r in rows.collect())
    both = out.select("id", F.col("g").alias("h")).join(rows, "id")
    assert both.where("g = h").count() < 200
    old = rows.select("id", F.col("y").alias("z"))
    assert out.join(old, "id").where("not (y <=> z)").count() == 0


def test_shuffled_numbers_are_unique(spark):
    n = 200_000
    x = spark.range(n).union(spark.range((1 << 62) - n, 1 << 62)).select("id", splits.shuffled(3, "id").alias("s"))
    r = x.agg(F.countDistinct("s").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.corr("id", "s").alias("c")).first()
    assert r["n"] == 2 * n and r["lo"] >= 0 and r["hi"] < 1 << 62 and abs(r["c"]) < 0.05


def test_groups_beyond_those_assigned_one_by_one_go_by_hash(spark, monkeypatch):
    monkeypatch.setattr(splits, "GREEDY_GROUPS", 3)
    x = spark.range(6000).select("id", F.when(F.col("id") < 3000, F.col("id") % 3).otherwise(F.col("id") % 500 + 10).alias("g"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
    got = splits.group_folds(x, "y", ["g"], 3, 5).persist()
    assert got.count() == 6000 and got.select("g", "__fold").distinct().count() == 503
    # the three large groups lie apart, and the small ones are dealt out
    assert got.where("g < 3").select("__fold").distinct().count() == 3
    assert max(r["count"] for r in got.groupBy("__fold").count().collect()) < 2600
