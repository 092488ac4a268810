"""Studies around the checks: intervals by resampling, sensitivity to cutoffs, caps, models and seeds, and cross-validation by group."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from ..functions.stats import mean_interval, newcombe
from ..operators import classifiers, forest, neighbours, ranks, splits
from . import benchmark
from .registry import Subject, checks, outcome

REPLICATES, REPLICATE_BLOCK = 4000, 500


def _poisson(cluster: Column, replicate: Column, seed: int) -> Column:
    """How often a cluster is drawn in a replicate: Poisson with mean 1, from a hash, so that no draw is stored."""
    u = F.pmod(F.xxhash64(F.lit(seed), cluster, replicate), F.lit(1 << 40)) / float(1 << 40)
    bounds = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)]).tolist()
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda p: p <= u)).cast("long")


def cluster_bootstrap(df: DataFrame, cluster: str, hit: Column, arm: Column | None = None, replicates: int = REPLICATES, seed: int = 0) -> dict[str, float]:
    """Rate of hits and its 95 % percentile interval when whole clusters are resampled; with an arm, the rate where it holds less that where it does not.

    Clusters are summed first. A cluster's row meets REPLICATE_BLOCK replicates at a time
    and is summed with the other rows of its task at once, so what is shuffled is a row a
    replicate from each task, however many clusters there are.
    """
    a = arm if arm is not None else F.lit(True)
    names = ("k1", "n1", "k0", "n0")
    by = df.groupBy(F.col(cluster).alias("c")).agg(*[F.sum(F.when(x, y).otherwise(0)).alias(n) for n, x, y in zip(names, (a, a, ~a, ~a), (hit.cast("int"), F.lit(1)) * 2, strict=True)])
    by = checkpoint(by)
    whole = by.agg(*[F.sum(n).alias(n) for n in names]).first()
    rate = lambda r: (r["k1"] / r["n1"] if r["n1"] else np.nan) - ((r["k0"] / r["n0"] if r["n0"] else np.nan) if arm is not None else 0.0)
    drawn = []
    for start in range(0, replicates, REPLICATE_BLOCK):
        x = by.select("*", F.explode(F.sequence(F.lit(start), F.lit(min(replicates, start + REPLICATE_BLOCK) - 1))).alias("b")).withColumn("w", _poisson(F.col("c"), F.col("b"), seed)).where("w > 0")
        drawn += [rate(r) for r in x.groupBy("b").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names]).collect()]  # a row a replicate
    lo, hi = np.nanpercentile(drawn, [2.5, 97.5])
    return {"value": float(rate(whole)), "low": float(lo), "high": float(hi)}


def advantage_bootstrap(strata: Iterable[tuple[int, int, int, int]], replicates: int = 2000, seed: int = 0) -> dict[str, float]:
    """The standardised advantage of reused over novel rows, with an interval; strata are (reused rows, right, novel rows, right)."""
    s = np.array(list(strata), float)
    rng = np.random.default_rng(seed)
    weight = s[:, 0] / s[:, 0].sum()
    value = lambda a, b: (weight * (a / s[:, 0] - b / s[:, 2])).sum(axis=-1)
    drawn = value(*(rng.binomial(s[:, k].astype(int), s[:, k + 1] / s[:, k], (replicates, len(s))) for k in (0, 2)))
    lo, hi = np.percentile(drawn, [2.5, 97.5])
    return {"value": float(value(s[:, 1], s[:, 3])), "low": float(lo), "high": float(hi)}


def cutoff_grid(asked: DataFrame, control: DataFrame, index: DataFrame, dims: int, row_id: str, cutoffs: Iterable[float] = (1e-7, 1e-6, 1e-5), margins: Iterable[float] = (0.02, 0.05, 0.10)) -> list[dict]:
    """The verdict of the near-neighbour comparison for each cutoff and margin; vectors are in column v."""
    out = []
    for eps in cutoffs:
        (k1, n1), (k2, n2) = (neighbours.near_zero(x, index, dims, row_id, eps).agg(F.count_if("near"), F.count("*")).first() for x in (asked, control))
        lo, hi = newcombe(k1, n1, k2, n2) if n1 and n2 else (-1.0, 1.0)
        out += [{"cutoff": eps, "margin": m, "low": lo, "high": hi, "verdict": "leakage" if lo > m else "equivalent" if hi < m else "inconclusive"} for m in margins]
    return out


def group_cross_validation(s: Subject, groups: list[str], folds: int = 5) -> list[dict]:
    """Accuracy of each fold of groups held out, with its rows, groups and the labels that train lacked."""
    x = splits.group_folds(s.raw() if s.raw else s.train.unionByName(s.test), s.label, groups, folds, s.seed).persist()
    out = []
    for k in range(folds):
        train, test = x.where(F.col("__fold") != k).drop("__fold"), x.where(F.col("__fold") == k).drop("__fold")
        f = forest.fit_forest(train, s.features, s.label, s.cfg, s.row_id, s.seed)
        lacking = test.select(s.label).distinct().join(train.select(s.label).distinct(), s.label, "left_anti").count()
        out.append({"fold": k, "rows": test.count(), "groups": test.select(*groups).distinct().count(), "accuracy": f.accuracy(test), "labels_not_in_train": lacking})
    x.unpersist()
    return out


def seed_metrics(s: Subject, seeds: Iterable[int]) -> dict[str, dict[str, float]]:
    """Balanced accuracy, macro F1 and worst recall over seeds of the split and the forest, each with a t interval."""
    rows = []
    raw = s.raw() if s.raw else s.train.unionByName(s.test)
    for seed in seeds:
        train, test = splits.stratified_split(raw, s.label, s.cfg["dataset"]["split_ratio"], seed, s.row_id)
        f = forest.fit_forest(train, s.features, s.label, s.cfg, s.row_id, seed)
        rows.append(benchmark.score(f.scored(test), f.encoder.classes))
    return {k: dict(zip(("mean", "low", "high"), mean_interval([r[k] for r in rows]), strict=True)) for k in ("balanced_accuracy", "f1_macro", "worst_recall")}


def cap_sensitivity(s: Subject, caps: Iterable[int]) -> dict[int, float]:
    """Test accuracy for each cap on the rows of a fit."""
    return {c: forest.fit_and_score(s.train, s.test, s.features, s.label, s.cfg | {"audit": s.cfg["audit"] | {"fit_rows": c}}, s.row_id, s.seed) for c in caps}


def model_sensitivity(s: Subject, names: Iterable[str], split: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]], parameters: dict | None = None) -> dict[str, float]:
    """Accuracy lost from a random split to another one, for each method."""
    raw, out = (s.raw() if s.raw else s.train.unionByName(s.test)), {}
    sides = {"random": splits.stratified_split(raw, s.label, s.cfg["dataset"]["split_ratio"], s.seed, s.row_id), "other": split(raw, s.seed)}
    for name in names:
        acc = {}
        for k, (train, test) in sides.items():
            rows = splits.sample_rows(train.where(F.col(s.label).isNotNull()), s.cfg["audit"]["fit_rows"], s.seed, s.row_id)
            encoder = forest.fit_encoder(rows, s.features, s.label)
            ready = encoder(rows, [s.row_id]).withColumnRenamed(s.row_id, "__id").where("y is not null")
            fit = classifiers.build(name, len(encoder.classes), len(s.features), ready.count(), s.seed, (parameters or {}).get(name))
            shape = classifiers.scaling("standard")(ready)
            acc[k] = benchmark.score(fit(shape(ready))(shape(encoder(test, [s.row_id]).withColumnRenamed(s.row_id, "__id"))), encoder.classes)["accuracy"]
        out[name] = acc["random"] - acc["other"]
    return out


def best_feature_of_each_class(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(cls, feature, auc): the column that alone ranks each class best; ties go to the lower name."""
    auc = ranks.feature_auc(df, features, label).withColumn("auc", F.round("auc", 12))
    best = auc.groupBy("cls").agg(F.min(F.struct((-F.col("auc")).alias("a"), "feature")).alias("b"))
    return best.select("cls", F.col("b.feature").alias("feature"), (-F.col("b.a")).alias("auc"))


def filled_auc(df: DataFrame, columns: list[str], label: str, fill: float = -2.0) -> DataFrame:
    """AUC of each column for each class, gaps taken as one value below the others, which for counters means that nothing was counted."""
    return ranks.feature_auc(df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(fill)) for c in columns}), columns, label)


def identifier_ablation(s: Subject, groups: dict[str, list[str]], seeds: Iterable[int]) -> dict[str, dict[str, dict[str, float]]]:
    """Accuracy, balanced accuracy and macro F1, each with a t interval over seeds of split and forest, on all features and without each group of columns."""
    raw = s.raw() if s.raw else s.train.unionByName(s.test)
    kept = {"all": s.features} | {f"without {g}": [c for c in s.features if c not in cs] for g, cs in groups.items()}
    names, rows = ("accuracy", "balanced_accuracy", "f1_macro"), {k: [] for k in kept}
    for seed in seeds:
        train, test = splits.stratified_split(raw, s.label, s.cfg["dataset"]["split_ratio"], seed, s.row_id)
        for k, columns in kept.items():
            f = forest.fit_forest(train, columns, s.label, s.cfg, s.row_id, seed)
            rows[k].append(benchmark.score(f.scored(test), f.encoder.classes))
    return {k: {n: dict(zip(("mean", "low", "high"), mean_interval([r[n] for r in rs]), strict=True)) for n in names} for k, rs in rows.items()}


@dataclass(frozen=True)
class Regime:
    """A population whose rows are numbers of vectors: how many rows, what share of them comes from a pool of vectors that
    repeat, how uneven the pool is drawn (an exponent of the rank), and what share of test rows is copied from train."""

    name: str
    rows: int = 2500
    repeated: float = 0.5
    pool: int = 20
    uneven: float = 0.0
    leak: float = 0.0


#: The populations that the interval was first tried on.
REGIMES = (
    Regime("distinct", repeated=0.0), Regime("templates", repeated=1.0, pool=50), Regime("zipf", repeated=1.0, pool=5000, uneven=1.3), Regime("mixed"),
    Regime("mixed_small", rows=150), Regime("leak_05", leak=0.05), Regime("leak_10", leak=0.10), Regime("leak_20", leak=0.20),
)


def _simulate(r: Regime, rng: np.random.Generator, asked: int, draws: int) -> dict[str, float]:
    """One draw, split and test: the whole populations' difference, and of the sampled rows both intervals."""
    weight = np.arange(1, r.pool + 1.0) ** -r.uneven
    pooled = rng.choice(r.pool, round(r.rows * r.repeated), p=weight / weight.sum())
    rows = rng.permutation(np.r_[pooled, r.pool + np.arange(r.rows - len(pooled))])
    test, train = np.split(rows, [r.rows // 5])
    copies = rng.permutation(len(test))[: round(r.leak * len(test))]
    test[copies] = rng.choice(train, len(copies))
    times = np.bincount(train, minlength=r.pool + r.rows)
    sides = [(rng.permutation(test)[:asked], 1), (rng.permutation(train)[:asked], 2)]
    counts, drawn = [], []
    for side, least in sides:
        vectors, n = np.unique(side, return_counts=True)
        hit = times[vectors] >= least
        counts += [int(n[hit].sum()), len(side)]
        w = rng.multinomial(len(vectors), np.full(len(vectors), 1 / len(vectors)), draws) * n  # whole vectors are drawn
        drawn.append((w @ hit) / w.sum(axis=1))
    low, high = newcombe(*counts)
    c_low, c_high = np.percentile(drawn[0] - drawn[1], [2.5, 97.5])
    return {"difference": float((times[test] >= 1).mean() - (times[train] >= 2).mean()), "row_low": low, "row_high": high, "vector_low": float(c_low), "vector_high": float(c_high)}


def interval_coverage(spark: SparkSession, simulations: int = 200, regimes: Iterable[Regime] = REGIMES, margin: float = 0.05, asked: int = 500, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(regime, method, truth, coverage, width, leakage, cleared): how often the interval of the near-neighbour comparison covers
    the true difference and what it says, by rows taken as independent and by whole vectors. Simulations run on the executors.
    The truth is 0, as train and test are drawn alike, or the mean difference of the whole populations where copies were planted."""
    known = {r.name: r for r in regimes}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([{"regime": name, **_simulate(known[name], np.random.default_rng([seed, int(k)]), asked, draws)} for k, name in zip(f["id"], f["regime"], strict=True)])

    names = F.array(*map(F.lit, known))
    tasks = spark.range(0, simulations * len(known), 1, min(simulations * len(known), 4 * spark.sparkContext.defaultParallelism)).select("id", F.get(names, (F.col("id") % len(known)).cast("int")).alias("regime"))
    done = tasks.mapInPandas(run, "regime string, difference double, row_low double, row_high double, vector_low double, vector_high double")
    leaks = F.array(*[F.lit(n) for n, r in known.items() if r.leak]) if any(r.leak for r in known.values()) else F.array().cast("array<string>")
    by = checkpoint(done)
    truth = by.groupBy("regime").agg(F.when(F.array_contains(leaks, F.first("regime")), F.avg("difference")).otherwise(0.0).alias("truth"))
    each = by.select("regime", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_low").alias("low"), F.col(f"{m}_high").alias("high")) for m in ("row", "vector")])).alias("i")).select("regime", "i.*")
    share = lambda c: F.avg(c.cast("double"))
    return each.join(truth, "regime").groupBy("regime", "method", "truth").agg(share((F.col("low") <= F.col("truth")) & (F.col("truth") <= F.col("high"))).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"), share(F.col("low") > margin).alias("leakage"), share(F.col("high") < margin).alias("cleared"))


@dataclass(frozen=True)
class Case:
    """A data set whose inflated or honest accuracy is known, and what the checks said of it."""

    material: bool
    reused: float
    duplicates_flagged: bool
    cleared: bool
    verdict: str  # of the experiments: material, not material or inconclusive
    fitting: bool = False


def case(s: Subject, material: bool, fitting: bool = False) -> Case:
    """The checks that the decision rules rest on, run on one data set."""
    found = {n: checks()[n].run(s) for n in ("dedup_check", "homogeneity_test", "repeated_seed_falsification_check")}
    d, kinds = found["dedup_check"]["details"], [c["classification"] for c in found["homogeneity_test"]["details"].get("per_class", {}).values()]
    verdict = {"material": "material", "investigated_not_material": "not material"}.get(outcome(found["repeated_seed_falsification_check"]), "inconclusive")
    return Case(material, d["test_leakage_dropped"] / max(1, d["test_rows_raw"]), found["dedup_check"]["status"] == "flag", bool(kinds) and set(kinds) <= {"equivalent", "below_control"}, verdict, fitting)


def decision_rules(cases: Iterable[Case]) -> dict[str, dict[str, float]]:
    """How three ways to decide whether accuracy is inflated fare on the cases not used for fitting: by the share of reused test
    rows against a cutoff (the one with most right answers on the fitting cases, the lower of equals), by experiments alone, and by
    experiments that are only made where a cheap check gives cause."""
    cases = list(cases)
    fitting, rest = [c for c in cases if c.fitting], [c for c in cases if not c.fitting]
    right = lambda t: sum((c.reused > t) == c.material for c in fitting)
    cutoff = max(sorted({0.0, *(c.reused for c in fitting)}), key=lambda t: (right(t), -t))
    cause = lambda c: c.duplicates_flagged or not c.cleared
    say = {
        "share of reuse": lambda c: "material" if c.reused > cutoff else "not material",
        "experiments": lambda c: c.verdict,
        "experiments for cause": lambda c: c.verdict if cause(c) else "not material",
    }
    out: dict[str, dict[str, float]] = {}
    for name, rule in say.items():
        said = [(rule(c), "material" if c.material else "not material") for c in rest]
        out[name] = {"correct": sum(a == b for a, b in said), "inconclusive": sum(a == "inconclusive" for a, _ in said), "wrong": sum(a not in (b, "inconclusive") for a, b in said), "experiments_made": {"share of reuse": 0, "experiments": len(rest)}.get(name, sum(map(cause, rest)))}
    out["share of reuse"]["cutoff"] = cutoff
    return out
