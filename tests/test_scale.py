"""What must hold on tables too large for one machine, tried on small ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators import classifiers, neighbours, ranks, splits
from plumbline.plans import benchmark
from plumbline.plans.registry import Subject, checks
from plumbline.sources.reading import ROW_ID


@pytest.mark.parametrize("decimals", [1, 9])
def test_neighbours_in_cells_equal_brute_force(spark, monkeypatch, decimals):
    monkeypatch.setattr(neighbours, "CELL", 40)
    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(size=(500, 3)), decimals), rng.integers(0, 3, 500)
    x = np.r_[x, x[:100]]  # equal rows, some under another class
    y = np.r_[y, y[:50], rng.integers(0, 3, 50)]
    q = np.r_[x[:30], np.round(rng.normal(size=(70, 3)) * 2, decimals), [[50.0, 0, 0]]]
    index = neighbours.Nearest(spark.createDataFrame(pd.DataFrame({"v": x.tolist(), "y": y.astype(float)})), 5)
    assert len(index.boxes[0]) > 8
    got = {r["i"]: r["votes"] for r in index.votes(spark.createDataFrame(pd.DataFrame({"v": q.tolist(), "i": range(len(q))})), 3).collect()}
    for i, v in enumerate(q):
        near = np.lexsort((y, ((v - x) ** 2).sum(axis=1)))[:5]
        assert got[i] == np.bincount(y[near], minlength=3).tolist()


def test_neighbours_are_fitted_without_the_rows_on_the_driver(spark, monkeypatch):
    f = pd.DataFrame({"v": np.random.default_rng(0).normal(size=(300, 2)).tolist(), "y": np.arange(300) % 2.0})
    rows = spark.createDataFrame(f).select("y", array_to_vector("v").alias("features"))
    seen = []
    whole = type(rows).toPandas
    monkeypatch.setattr(type(rows), "toPandas", lambda self: seen.append(1) or whole(self))
    classifiers.build("KNN", 2, 2, 300, 0)(rows)
    assert not seen


def test_rows_are_scored_once(spark):
    n = spark.sparkContext.accumulator(0)

    def answer(frames):
        for f in frames:
            n.add(len(f))
            yield f

    x = spark.range(60).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("__label"), (F.col("id") % 2).cast("double").alias("y"), F.lit(0.0).alias("prediction"), F.array((F.col("id") % 3) / 3, 1 - (F.col("id") % 3) / 3).alias("p"))
    scored = x.mapInPandas(answer, x.schema).withColumn("probability", array_to_vector("p")).drop("p")
    m = benchmark.score(scored, ["a", "b"])
    assert n.value == 60 and m["accuracy"] == 0.5 and m["auc"] == pytest.approx(0.5)


def subject(spark, train, test):
    cfg = config.merge(config.DEFAULTS, {"dataset": {"name": "t"}, "schema": {"label_column": "y"}})
    frames = [spark.createDataFrame(f.assign(**{ROW_ID: range(len(f))})) for f in (train, test)]
    return Subject(*frames, cfg)


def numbers(n, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"x": rng.normal(size=n), "y": rng.choice(["a", "b"], n)})


def test_all_rows_under_another_label_are_counted(spark):
    f = numbers(3000)
    bad = pd.concat([f, f.assign(y=f.y.map({"a": "b", "b": "a"}))], ignore_index=True)
    assert checks()["near_duplicate_class_check"].run(subject(spark, bad, f))["details"]["affected_rows"] == 6000


def test_all_rows_are_asked_whether_they_lie_on_train(spark):
    train, test = numbers(4000), numbers(2000, 1)
    test.loc[test.index % 5 == 0, "x"] = train.x.iloc[: (test.index % 5 == 0).sum()].to_numpy()
    found = checks()["homogeneity_test"].run(subject(spark, train, test))["details"]["per_class"]
    near = lambda q: (np.abs(q[:, None] - train.x.to_numpy()[None, :]) / train.x.std(ddof=0) < 1e-6).sum(axis=1)
    for c in "ab":
        assert found[c]["test_near_zero_rate"] == pytest.approx((near(test.x[test.y == c].to_numpy()) > 0).mean())
        assert found[c]["control_near_zero_rate"] == pytest.approx((near(train.x[train.y == c].to_numpy()) > 1).mean())


def test_ranks_read_the_table_once_besides_its_classes(spark):
    read = spark.sparkContext.accumulator(0)

    def pass_on(frames):
        for f in frames:
            read.add(len(f))
            yield f

    rng = np.random.default_rng(0)
    f = pd.DataFrame({"x": rng.normal(size=900), "z": rng.integers(0, 9, 900) * 1.0, "y": rng.choice(["a", "b", "c"], 900)})
    df = spark.createDataFrame(f)
    df = df.mapInPandas(pass_on, df.schema)
    auc = {(r["feature"], r["cls"]): r["auc"] for r in ranks.feature_auc(df, ["x", "z"], "y").collect()}
    assert read.value == 2 * len(f)
    for c, v in (("x", f.x), ("z", f.z)):
        k = v.rank()
        for y in "abc":
            n = (f.y == y).sum()
            u = (k[f.y == y].sum() - n * (n + 1) / 2) / (n * (len(f) - n))
            assert auc[c, y] == pytest.approx(max(u, 1 - u))
    ranks.best_stump(df, ["x", "z"], "y").collect()
    assert read.value == 4 * len(f)
    ks = {r["feature"]: r["ks"] for r in ranks.two_sample_ks(df.where("y = 'a'"), df.where("y = 'b'"), ["x"]).collect()}
    a, b, at = np.sort(f.x[f.y == "a"]), np.sort(f.x[f.y == "b"]), f.x.to_numpy()
    assert read.value == 6 * len(f)  # one of each side
    assert ks["x"] == pytest.approx(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max())


def test_a_split_costs_no_shuffle_when_it_is_read(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 900, "a").otherwise("b").alias("y"))
    for part in (*splits.stratified_split(df, "y", 0.8, 1, "id"), splits.sample_rows(df, 100, 1, "id")):
        assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [64, 0])
def test_a_sample_is_exact_where_ids_repeat(spark, monkeypatch, few):
    monkeypatch.setattr(splits, "FEW_GROUPS", few)
    df = spark.range(1000).select((F.col("id") % 7).alias("id"), (F.col("id") % 2).alias("y"))
    assert splits.sample_rows(df, 100, 1, "id").count() == 100
    train, test = splits.stratified_split(df, "y", 0.8, 1, "id")
    assert {r["y"]: r["count"] for r in test.groupBy("y").count().collect()} == {0: 100, 1: 100} and train.count() == 800


def test_groups_in_a_table_are_split_as_those_in_the_expression(spark, monkeypatch):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 900, "a").otherwise("b").alias("y"))
    ids = lambda: {r["id"] for r in splits.stratified_split(df, "y", 0.8, 1, "id")[1].collect()}
    one = ids()
    monkeypatch.setattr(splits, "FEW_GROUPS", 0)
    assert ids() == one and len(one) > 500
