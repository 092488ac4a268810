import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators import graph, splits
from plumbline.plans import studies
from plumbline.plans.registry import Subject
from plumbline.sources.reading import ROW_ID


def test_cluster_bootstrap_is_wider_than_rows_alone(spark):
    rng = np.random.default_rng(0)
    c = rng.integers(0, 40, 2000)
    f = pd.DataFrame({"c": c, "hit": (rng.random(40) < 0.5)[c], "arm": rng.random(2000) < 0.5})
    r = studies.cluster_bootstrap(spark.createDataFrame(f), "c", F.col("hit"))
    assert r["value"] == pytest.approx(f.hit.mean()) and r["low"] < r["value"] < r["high"] and r["high"] - r["low"] > 0.15
    d = studies.cluster_bootstrap(spark.createDataFrame(f), "c", F.col("hit"), F.col("arm"))
    assert d["value"] == pytest.approx(f.hit[f.arm].mean() - f.hit[~f.arm].mean())
    # whole clusters drawn by a multinomial, as a brute force would
    sums = np.array([[(g.hit & g.arm).sum(), g.arm.sum(), (g.hit & ~g.arm).sum(), (~g.arm).sum()] for _, g in f.groupby("c")])
    k1, n1, k0, n0 = (rng.multinomial(len(sums), np.full(len(sums), 1 / len(sums)), 20_000) @ sums).T
    for got, rates in ((r, (k1 + k0) / (n1 + n0)), (d, k1 / n1 - k0 / n0)):
        low, high = np.percentile(rates, [2.5, 97.5])
        assert got["low"] == pytest.approx(low, abs=0.08 * (high - low)) and got["high"] == pytest.approx(high, abs=0.08 * (high - low))


def test_advantage_bootstrap():
    r = studies.advantage_bootstrap([(1000, 900, 500, 300), (3000, 1500, 800, 400)])
    assert r["value"] == pytest.approx(0.25 * 0.3) and r["low"] < r["value"] < r["high"]


def test_models_over_folds_seeds_and_caps(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 30, 400)
    y = np.where(rng.random(30)[g] < 0.5, "a", "b")
    f = pd.DataFrame({"x": (y == "a") + rng.normal(size=400) * 0.1, "g": g, "y": y, ROW_ID: range(400)})
    df = spark.createDataFrame(f).coalesce(1)
    cfg = config.merge(config.DEFAULTS, {"schema": {"label_column": "y", "drop_columns": ["g"]}, "audit": {"forest_trees": 3, "forest_depth": 3}})
    s = Subject(df.where(f"{ROW_ID} % 4 > 0"), df.where(f"{ROW_ID} % 4 = 0"), cfg, lambda: df)
    folds = studies.group_cross_validation(s, ["g"], 2)
    assert sum(r["rows"] for r in folds) == 400 and sum(r["groups"] for r in folds) == len(set(g)) and min(r["accuracy"] for r in folds) > 0.9
    assert studies.seed_metrics(s, [0, 1])["f1_macro"]["mean"] > 0.9
    assert min(studies.cap_sensitivity(s, [50, 300]).values()) > 0.9
    assert abs(studies.model_sensitivity(s, ["LogisticRegression"], lambda raw, seed: splits.grouped_split(raw, "y", ["g"], 0.8, seed), {"LogisticRegression": {"max_iter": 10}})["LogisticRegression"]) < 0.1


@pytest.mark.parametrize("hub", [128, 1])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB_EDGES", hub)
    monkeypatch.setattr(graph, "HUB_SHARE", 16 if hub > 1 else 10**6)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(50)] + [(5, 5)] + [(2000, 2001 + k) for k in range(400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if n in got} and all(find(n) == n and sum(find(m) == n for m in root) == 1 for n in root if n not in got)


def test_interval_coverage(spark):
    got = {(r["regime"], r["method"]): r for r in studies.interval_coverage(spark, 60, draws=300).collect()}
    assert len(got) == 16 and all(0 <= r["coverage"] <= 1 for r in got.values())
    # rows that are their own vectors never match; copies planted are seen
    assert got["distinct", "row"]["coverage"] == 1 and got["distinct", "row"]["leakage"] == 0
    assert got["leak_20", "row"]["truth"] > 0.05 > abs(got["mixed", "row"]["truth"]) and got["leak_20", "row"]["leakage"] > got["leak_05", "row"]["leakage"]
    assert got["templates", "row"]["coverage"] > 0.9 and studies.interval_coverage(spark, 60, draws=300).where("regime = 'mixed' and method = 'row'").first()["coverage"] == got["mixed", "row"]["coverage"]


def test_decision_rules():
    c = studies.Case
    cases = [c(True, 0.3, True, False, "material", True), c(False, 0.1, True, False, "not material", True), c(True, 0.2, True, False, "material"), c(False, 0.05, False, True, "material"), c(True, 0.0, False, True, "material"), c(False, 0.4, True, False, "inconclusive")]
    r = studies.decision_rules(cases)
    assert r["share of reuse"] == {"correct": 2, "inconclusive": 0, "wrong": 2, "experiments_made": 0, "cutoff": 0.1}
    assert r["experiments"] == {"correct": 2, "inconclusive": 1, "wrong": 1, "experiments_made": 4}
    assert r["experiments for cause"] == {"correct": 2, "inconclusive": 1, "wrong": 1, "experiments_made": 2}
