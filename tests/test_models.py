import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators import classifiers, neighbours
from plumbline.plans import benchmark
from plumbline.sources.reading import ROW_ID

QUICK = {"RandomForest": {"n_estimators": 5, "max_depth": 4}, "ExtraTrees": {"n_estimators": 5, "max_depth": 4}, "XGBoost": {"n_estimators": 3, "max_depth": 3}, "HistGradientBoosting": {"max_iter": 3, "max_depth": 3}, "LogisticRegression": {"max_iter": 20}, "MLP": {"max_iter": 30, "hidden_layer_sizes": [8]}, "SVM": {"max_iter": 5}, "DecisionTree": {"max_depth": 5}, "AdaBoost": {"n_estimators": 20}}


def rows(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 3)) * 0.5 + np.array([[0, 0, 0], [3, 0, 1], [0, 3, -1]])[y]
    f = pd.DataFrame({"v": x.tolist(), "y": y.astype(float), "__id": range(n)})
    return spark.createDataFrame(f).select("y", "__id", array_to_vector("v").alias("features")).coalesce(1)


@pytest.mark.parametrize("name", [c for c in config.CLASSIFIERS if c not in ("Voting", "Stacking")])
def test_each_method_learns(spark, name):
    fit = classifiers.build(name, 3, 3, 300, 0, QUICK.get(name))
    out = fit(rows(spark))(rows(spark, 150, 1))
    r = out.agg(F.avg((F.col("y") == F.col("prediction")).cast("double")), F.max(F.abs(F.aggregate(classifiers.MF.vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x) - 1))).first()
    assert r[0] > 0.85 and r[1] < 1e-6


def test_ensembles_learn(spark):
    base = [classifiers.build(n, 3, 3, 300, 0, QUICK.get(n)) for n in ("DecisionTree", "LDA")]
    for fit in (classifiers.voting(base), classifiers.stacking(base, 0, 2), classifiers.calibrated(base[0], 3, "isotonic", 0, 2)):
        assert fit(rows(spark))(rows(spark, 150, 1)).agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0] > 0.85
    with pytest.raises(ValueError):
        classifiers.build("Nope", 2, 1, 1, 0)


def test_scalers(spark):
    r = rows(spark)
    x = lambda df: np.array([v.toArray() for v in df.select("features").toPandas()["features"]])
    z = x(classifiers.scaling("standard")(r)(r))
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9) and np.allclose(z.std(axis=0), 1)
    m = x(classifiers.scaling("minmax")(r)(r))
    assert np.allclose(m.min(axis=0), 0) and np.allclose(m.max(axis=0), 1)
    assert np.abs(np.median(x(classifiers.scaling("robust")(r)(r)), axis=0)).max() < 0.05 and np.array_equal(x(classifiers.scaling("none")(r)(r)), x(r))


def test_samplers():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(120, 2)), np.r_[np.zeros(100, int), np.ones(20, int)]
    x[y == 1] += 5
    xs, ys = classifiers.smote(x, y, 0)
    assert np.bincount(ys).tolist() == [100, 100] and xs[ys == 1].min() > 1
    assert np.bincount(classifiers.smote(x[:103], y[:103], 0)[1]).tolist() == [100, 3]
    x[0] = [5, 5]
    xe, ye = classifiers.edited(x, y)
    assert len(xe) < 120 and (ye == 1).sum() == 20 and not (xe == [5, 5]).all(axis=1).any()


def test_metrics():
    m = benchmark.metrics([("a", "a", 8), ("a", "b", 2), ("b", "b", 5), ("c", "a", 5)])
    assert m["accuracy"] == 0.65 and m["worst_recall"] == 0 and m["confusion_matrix"][0] == [8, 2, 0]


def test_benchmark_combinations(spark):
    rng = np.random.default_rng(0)
    y = rng.choice(["a", "b"], 240, p=[0.7, 0.3])
    f = pd.DataFrame({"x": (y == "a") * 2 + rng.normal(size=240), "c": rng.choice(["u", "v"], 240), "y": y, ROW_ID: range(240)})
    df = spark.createDataFrame(f).coalesce(1)
    cfg = config.merge(config.DEFAULTS, {"schema": {"label_column": "y"}, "preprocessing": {"scaling": ["none", "standard"], "sampling": {"binary": ["none", "smote", "enn", "random_undersample", "smoteenn"]}}, "classifiers": {"list": ["LDA"]}})
    rows, extras = benchmark.run_benchmark(spark, df.where(f"{ROW_ID} % 4 > 0"), df.where(f"{ROW_ID} % 4 = 0").withColumn("y", F.when(F.col(ROW_ID) == 0, "new").otherwise(F.col("y"))), cfg)
    assert len(rows) == 10 and not extras["failures"] and min(r["accuracy"] for r in rows) > 0.6
    cfg = config.merge(cfg, {"preprocessing": {"scaling": "none", "sampling": {"binary": "none"}}, "classifiers": {"list": ["DecisionTree"], "tuning": True, "calibration": "platt", "search_space": {"DecisionTree": {"max_depth": [1, 3]}}}})
    rows, extras = benchmark.run_benchmark(spark, df.where(f"{ROW_ID} % 4 > 0"), df.where(f"{ROW_ID} % 4 = 0"), cfg)
    assert not extras["failures"] and len(rows) == 1 and "maxDepth" not in str(rows) and extras["details"][0]["parameters"]["max_depth"] in (1, 3)


def test_near_zero_join_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    x[100:150] = x[:50] + rng.choice([1e-8, 3e-7, 2e-6], (50, 1)) / 5**0.5
    x[150:170] = x[:20]
    f = pd.DataFrame({"v": x.tolist(), "i": range(400), "y": rng.choice(["a", "b"], 400)})
    df = spark.createDataFrame(f)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.eye(400)
    want = {i for i in range(400) if (d[i] < 1e-6).any()}
    assert {r["i"] for r in neighbours.near_zero(df, df, 5, "i").where("near").collect()} == want
    y = f.y.to_numpy()
    bad = set()
    for i in range(400):
        near = np.flatnonzero(d[i] < 1e-6)
        mine, theirs = [d[i, j] for j in near if y[j] == y[i]], [d[i, j] for j in near if y[j] != y[i]]
        if theirs and (not mine or min(theirs) <= min(mine)):
            bad.add(i)
    assert {r["i"] for r in neighbours.confused_rows(df, 5, "y", "i").collect()} == bad
