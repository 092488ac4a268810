"""Fourteen classifiers under one interface, the scalers and samplers before them, and calibration after.

fit(rows) takes rows with `y` (class number) and `features`; the model's transform adds
`probability` (a vector over all classes) and `prediction`. Rows are a bounded sample
(the benchmark's cap), which lets the few methods that Spark lacks be computed from
small aggregates; nearest neighbours take an index of any size.

Where Spark has no such method the nearest is used and named in APPROXIMATE.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import functions as MF
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, RobustScaler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import Nearest

APPROXIMATE = {
    "XGBoost": "gradient-boosted trees of depth 6, one set a class", "HistGradientBoosting": "gradient-boosted trees on binned columns, one set a class",
    "ExtraTrees": "a forest without bootstrap; thresholds are the best ones, not random ones", "MLP": "a sigmoid network without early stopping", "RandomForest": "trees are at most 30 deep",
}
Model = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame], Model]


def _with_probability(df: DataFrame, p: Any) -> DataFrame:
    """df with an array column of class scores as a probability vector that adds to 1, and the class of the largest."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    even = F.transform(p, lambda x: F.lit(1.0) / F.size(p))
    out = df.withColumn("__p", F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(even))
    out = out.withColumn("prediction", (F.array_position("__p", F.array_max("__p")) - 1).cast("double"))
    return out.withColumn("probability", MF.array_to_vector("__p")).drop("__p")


def _spark(estimator: Any) -> Fit:
    def fit(rows: DataFrame) -> Model:
        model = estimator.setParams(labelCol="y", featuresCol="features").fit(rows)
        return lambda df: model.transform(df).drop("rawPrediction")

    return fit


def one_against_rest(make: Callable[[], Any], n: int, score: str) -> Fit:
    """A two-class method for each class; score: its column, probability or rawPrediction (squashed)."""
    def fit(rows: DataFrame) -> Model:
        def one(k: int) -> Any:
            est = make()
            for name, col in (("labelCol", "__t"), ("featuresCol", "features"), ("predictionCol", "__o"), ("rawPredictionCol", "__r"), *([("probabilityCol", "__q")] if score == "probability" else [])):
                est.set(est.getParam(name), col)
            return est.fit(rows.withColumn("__t", (F.col("y") == k).cast("double")))

        models = [one(k) for k in (range(n) if n > 2 else [1])]

        def run(df: DataFrame) -> DataFrame:
            names = []
            for k, m in enumerate(models):
                col = MF.vector_to_array("__q" if score == "probability" else "__r")
                s = F.get(col, F.lit(1))
                df = m.transform(df).withColumn(f"__s{k}", s if score == "probability" else 1 / (1 + F.exp(-s))).drop("__o", "__r", "__q")
                names.append(f"__s{k}")
            p = F.array(*[F.col(c) for c in names]) if n > 2 else F.array(1 - F.col(names[0]), F.col(names[0]))
            return _with_probability(df, p).drop(*names)

        return run

    return fit


def discriminant(n: int) -> Fit:
    """Linear discriminants from class means and the pooled covariance."""
    def fit(rows: DataFrame) -> Model:
        d = len(rows.select("features").first()[0])

        def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = np.array(f["x"].tolist(), float).reshape(len(f), -1)
                y = f["y"].to_numpy().astype(int)
                sums = np.zeros((n, d))
                np.add.at(sums, y, x)
                yield pd.DataFrame({"n": [np.bincount(y, minlength=n).astype(float).tolist()], "s": [sums.ravel().tolist()], "g": [(x.T @ x).ravel().tolist()]})

        parts = rows.select("y", MF.vector_to_array("features").alias("x")).mapInPandas(moments, "n array<double>, s array<double>, g array<double>").toPandas()  # one row a batch of a bounded sample
        count = np.sum(parts["n"].tolist(), axis=0)
        mean = np.sum(parts["s"].tolist(), axis=0).reshape(n, d) / np.maximum(count, 1)[:, None]
        gram = np.sum(parts["g"].tolist(), axis=0).reshape(d, d)
        pooled = (gram - (mean * count[:, None]).T @ mean) / max(1.0, count.sum() - n)
        w = mean @ np.linalg.pinv(pooled + 1e-9 * np.eye(d))
        b = np.log(np.maximum(count, 1e-9) / count.sum()) - 0.5 * (w * mean).sum(axis=1)
        return lambda df: _linear(df, w, b)

    return fit


def _linear(df: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    x = MF.vector_to_array("features")
    dot = lambda row: F.aggregate(F.zip_with("__x", F.array(*[F.lit(float(v)) for v in row]), lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
    z = df.withColumn("__x", x).withColumn("__z", F.array(*[dot(r) + F.lit(float(c)) for r, c in zip(w, b, strict=True)]))
    z = z.withColumn("__z", F.transform("__z", lambda v: F.exp(v - F.array_max("__z"))))
    return _with_probability(z, F.col("__z")).drop("__x", "__z")


def neighbours_vote(n: int, k: int = 5) -> Fit:
    def fit(rows: DataFrame) -> Model:
        index = Nearest(rows.select(MF.vector_to_array("features").alias("v"), "y"), k)

        def run(df: DataFrame) -> DataFrame:
            found = index.votes(df.withColumn("v", MF.vector_to_array("features")).drop("features"), n)
            return _with_probability(found, F.col("votes")).drop("v", "votes")

        return run

    return fit


def boosted_stumps(n: int, rounds: int = 50, rate: float = 1.0) -> Fit:
    """Stumps fitted one after another to reweighted rows (SAMME); stops where a stump is no better than chance."""
    def fit(rows: DataFrame) -> Model:
        got = rows.select("features", "y").toPandas()  # a bounded sample
        x, y = np.array([v.toArray() for v in got["features"]]), got["y"].to_numpy().astype(int)
        order = np.argsort(x, axis=0, kind="stable")
        w = np.full(len(x), 1 / len(x))
        stumps: list[tuple[int, float, int, int, float]] = []
        for _ in range(rounds):
            best = (-1.0, 0, 0.0, 0, 0)
            whole = np.bincount(y, weights=w, minlength=n)
            for f in range(x.shape[1]):
                o = order[:, f]
                v = x[o, f]
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                left = np.zeros((len(cut), n))
                for c in range(n):
                    left[:, c] = np.cumsum(w[o] * (y[o] == c))[cut]
                right = whole - left
                gain = (left**2).sum(axis=1) / np.maximum(left.sum(axis=1), 1e-300) + (right**2).sum(axis=1) / np.maximum(right.sum(axis=1), 1e-300)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-15:
                    best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2), int(left[k].argmax()), int(right[k].argmax()))
            if best[0] < 0:
                break
            said = np.where(x[:, best[1]] <= best[2], best[3], best[4])
            wrong = float(w[said != y].sum())
            if wrong >= 1 - 1 / n:
                break
            alpha = rate * (np.log((1 - wrong) / max(wrong, 1e-12)) + np.log(n - 1))
            stumps.append((*best[1:], alpha))
            if wrong <= 1e-12:
                break
            w = w * np.exp(alpha * (said != y))
            w /= w.sum()
        if not stumps:
            stumps.append((0, np.inf, int(np.bincount(y).argmax()), 0, 1.0))

        def run(df: DataFrame) -> DataFrame:
            votes = [F.lit(0.0)] * n
            for f, t, a, b, alpha in stumps:
                for c in {a, b}:
                    here = F.when(F.get("__x", F.lit(f)) <= t, F.lit(alpha if c == a else 0.0)).otherwise(F.lit(alpha if c == b else 0.0))
                    votes[c] = votes[c] + here
            total = sum(s[4] for s in stumps)
            out = df.withColumn("__x", MF.vector_to_array("features")).withColumn("__z", F.array(*[F.exp((v / total - 1 / n) * n / max(1, n - 1)) for v in votes]))
            return _with_probability(out, F.col("__z")).drop("__x", "__z")

        return run

    return fit


def _folded(rows: DataFrame, folds: int, seed: int) -> DataFrame:
    return rows.withColumn("__fold", F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(folds)))


def _out_of_fold(fits: list[Fit], rows: DataFrame, folds: int, seed: int) -> DataFrame:
    """rows with `__p{k}`: probabilities of each method for each row, from a model that did not see it."""
    x, parts = _folded(rows, folds, seed).persist(), []
    for k in range(folds):
        rest, own = x.where(F.col("__fold") != k), x.where(F.col("__fold") == k)
        for j, fit in enumerate(fits):
            own = fit(rest)(own).withColumn(f"__p{j}", MF.vector_to_array("probability")).drop("probability", "prediction")
        parts.append(own.drop("__fold"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calibrated(fit: Fit, n: int, how: str, seed: int, folds: int = 5) -> Fit:
    """A method whose scores are brought to probabilities on out-of-fold rows, class by class."""
    def whole(rows: DataFrame) -> Model:
        held = _out_of_fold([fit], rows, folds, seed).select("y", "__p0").persist()
        model = fit(rows)
        curves = []
        for c in range(n):
            s = held.select(F.get("__p0", F.lit(c)).alias("s"), (F.col("y") == c).cast("double").alias("t"))
            if how == "isotonic":
                m = IsotonicRegression(labelCol="t", featuresCol="s").fit(s)
                curves.append((np.array(m.boundaries.toArray()), np.array(m.predictions.toArray())))
            else:
                logit = F.log(F.greatest("s", F.lit(1e-6)) / F.greatest(1 - F.col("s"), F.lit(1e-6)))
                m = LogisticRegression(labelCol="t", featuresCol="v", maxIter=50).fit(s.select("t", MF.array_to_vector(F.array(logit)).alias("v")))
                curves.append((float(m.coefficients[0]), float(m.intercept)))
        held.unpersist()

        def bend(c: int, s: Any) -> Any:
            if how != "isotonic":
                a, b = curves[c]
                return 1 / (1 + F.exp(-(F.log(F.greatest(s, F.lit(1e-6)) / F.greatest(1 - s, F.lit(1e-6))) * a + b)))
            xs, ys = curves[c]
            out = F.when(s <= float(xs[0]), F.lit(float(ys[0])))
            for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
                out = out.when(s <= float(x1), F.lit(float(y0)) + (s - float(x0)) * (float(y1 - y0) / max(float(x1 - x0), 1e-12)))
            return out.otherwise(F.lit(float(ys[-1])))

        def run(df: DataFrame) -> DataFrame:
            out = model(df).withColumn("__q", MF.vector_to_array("probability")).drop("probability", "prediction")
            return _with_probability(out, F.array(*[bend(c, F.get("__q", F.lit(c))) for c in range(n)])).drop("__q")

        return run

    return whole


def voting(fits: list[Fit]) -> Fit:
    """The mean of the methods' probabilities."""
    def fit(rows: DataFrame) -> Model:
        models = [f(rows) for f in fits]

        def run(df: DataFrame) -> DataFrame:
            for k, m in enumerate(models):
                df = m(df).withColumn(f"__p{k}", MF.vector_to_array("probability")).drop("probability", "prediction")
            total = F.col("__p0")
            for k in range(1, len(models)):
                total = F.zip_with(total, F.col(f"__p{k}"), lambda a, b: a + b)
            return _with_probability(df, total).drop(*[f"__p{k}" for k in range(len(models))])

        return run

    return fit


def stacking(fits: list[Fit], seed: int, folds: int = 5) -> Fit:
    """Logistic regression on the methods' out-of-fold probabilities."""
    def fit(rows: DataFrame) -> Model:
        names = [f"__p{k}" for k in range(len(fits))]
        held = _out_of_fold(fits, rows, folds, seed)
        top = LogisticRegression(labelCol="y", featuresCol="__m", maxIter=200).fit(held.select("y", MF.array_to_vector(F.concat(*names)).alias("__m")))
        models = [f(rows) for f in fits]

        def run(df: DataFrame) -> DataFrame:
            for k, m in enumerate(models):
                df = m(df).withColumn(f"__p{k}", MF.vector_to_array("probability")).drop("probability", "prediction")
            out = top.transform(df.withColumn("__m", MF.array_to_vector(F.concat(*names))))
            return out.drop("rawPrediction", "__m", *names)

        return run

    return fit


#: Names of tuning and configuration parameters, by what Spark calls them.
PARAMETERS = {"n_estimators": "numTrees", "max_depth": "maxDepth", "max_iter": "maxIter", "learning_rate": "stepSize", "min_samples_leaf": "minInstancesPerNode", "C": "C", "n_neighbors": "n_neighbors", "hidden_layer_sizes": "hidden_layer_sizes", "random_state": "seed"}


def build(name: str, n: int, d: int, rows: int, seed: int, given: dict[str, Any] | None = None) -> Fit:
    """The method of that name for n classes, d columns and so many training rows."""
    p = {PARAMETERS.get(k, k): v for k, v in (given or {}).items()}
    seed = int(p.pop("seed", seed))
    own = lambda **default: default | {k: v for k, v in p.items() if v is not None}
    trees = lambda rounds, depth, step: own(maxIter=rounds, maxDepth=depth, stepSize=step)

    def boost(rounds: int, depth: int, step: float) -> Fit:
        q = trees(rounds, depth, step)
        q["maxIter"] = q.pop("numTrees", q["maxIter"])
        return one_against_rest(lambda: GBTClassifier(seed=seed, **q), n, "probability")

    if name == "RandomForest":
        return _spark(RandomForestClassifier(seed=seed, **own(numTrees=100, maxDepth=12)))
    if name == "ExtraTrees":
        return _spark(RandomForestClassifier(seed=seed, bootstrap=False, **own(numTrees=100, maxDepth=12)))
    if name == "DecisionTree":
        return _spark(DecisionTreeClassifier(seed=seed, **own(maxDepth=20)))
    if name == "NaiveBayes":
        return _spark(NaiveBayes(modelType="gaussian", **p))
    if name == "LogisticRegression":
        q = own(maxIter=2000)
        return _spark(LogisticRegression(regParam=1 / (float(q.pop("C", 1.0)) * max(rows, 1)), **q))
    if name == "SVM":
        q = own(maxIter=2000)
        q["maxIter"] = min(q["maxIter"], 200)
        reg = 1 / (float(q.pop("C", 1.0)) * max(rows, 1))
        return calibrated(one_against_rest(lambda: LinearSVC(regParam=reg, **q), n, "rawPrediction"), n, "platt", seed)
    if name == "MLP":
        q = own(maxIter=300)
        hidden = q.pop("hidden_layer_sizes", (64,))
        return _spark(MultilayerPerceptronClassifier(layers=[d, *[int(h) for h in hidden], n], seed=seed, **q))
    if name == "XGBoost":
        return boost(100, 6, 0.1)
    if name == "HistGradientBoosting":
        return boost(100, 5, 0.1)
    if name == "AdaBoost":
        return boosted_stumps(n, int(p.get("numTrees", 50)), float(p.get("stepSize", 1.0)))
    if name == "LDA":
        return discriminant(n)
    if name == "KNN":
        return neighbours_vote(n, int(p.get("n_neighbors", 5)))
    if name in ("Voting", "Stacking"):
        base = [build(b, n, d, rows, 50) for b in ("RandomForest", "XGBoost", "DecisionTree")]
        return voting(base) if name == "Voting" else stacking(base, seed)
    raise ValueError(f"there is no classifier {name}")


# --- before the fit -------------------------------------------------------


def scaling(name: str) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    """fit(rows) -> transform, both on `features`; a constant column becomes 0."""
    def affine(center: np.ndarray, width: np.ndarray) -> Callable[[DataFrame], DataFrame]:
        width = np.where(width == 0, 1.0, width)
        a, b = (F.array(*[F.lit(float(v)) for v in x]) for x in (center, width))
        return lambda df: df.withColumn("features", MF.array_to_vector(F.zip_with(F.zip_with(MF.vector_to_array("features"), a, lambda x, c: x - c), b, lambda x, w: x / w)))

    def fit(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        if name == "none":
            return lambda df: df
        if name == "standard":
            d = len(rows.select("features").first()[0])
            x = rows.select(MF.vector_to_array("features").alias("x"))
            r = x.agg(*[F.avg(F.get("x", F.lit(k))).alias(f"m{k}") for k in range(d)], *[F.stddev_pop(F.get("x", F.lit(k))).alias(f"s{k}") for k in range(d)]).first()
            return affine(np.array([r[f"m{k}"] for k in range(d)]), np.array([r[f"s{k}"] for k in range(d)]))
        if name == "minmax":
            m = MinMaxScaler(inputCol="features", outputCol="__f").fit(rows)
            low, high = m.originalMin.toArray(), m.originalMax.toArray()
            return affine(low, high - low)
        m = RobustScaler(inputCol="features", outputCol="__f", withCentering=True, relativeError=0.0001).fit(rows)
        return affine(m.median.toArray(), m.range.toArray())

    return fit


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.select("features", "y").orderBy("__id").toPandas()  # a bounded sample
    return np.array([v.toArray() for v in got["features"]]), got["y"].to_numpy().astype(int)


def _frame(rows: DataFrame, x: np.ndarray, y: np.ndarray) -> DataFrame:
    data = [(float(c), Vectors.dense(v), k) for k, (v, c) in enumerate(zip(x, y, strict=True))]
    from pyspark.sql.types import DoubleType, LongType, StructType

    return rows.sparkSession.createDataFrame(data, StructType().add("y", DoubleType()).add("features", VectorUDT()).add("__id", LongType()))


def _near(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Places in x of the k nearest to each q, itself left out where q is x."""
    out = []
    for s in range(0, len(q), 512):
        d = ((q[s : s + 512] ** 2).sum(axis=1))[:, None] + (x**2).sum(axis=1)[None, :] - 2 * q[s : s + 512] @ x.T
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.concatenate(out)


def smote(x: np.ndarray, y: np.ndarray, seed: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Every class brought to the size of the largest by points between a row and a near one of its class; a class too small for that stays."""
    rng, n = np.random.default_rng(seed), np.bincount(y)
    xs, ys = [x], [y]
    for c in np.flatnonzero(n):
        want, own = int(n.max() - n[c]), x[y == c]
        if want and len(own) > k:
            near = _near(own, own, k)
            i = rng.integers(0, len(own), want)
            j = near[i, rng.integers(0, k, want)]
            xs.append(own[i] + rng.random((want, 1)) * (own[j] - own[i]))
            ys.append(np.full(want, c))
    return np.concatenate(xs), np.concatenate(ys)


def edited(x: np.ndarray, y: np.ndarray, k: int = 3, all_classes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all but the smallest class go where any of their nearest k is of another class."""
    if len(x) <= k:
        return x, y
    near = _near(x, x, k)
    n = np.bincount(y)
    least = int(np.where(n > 0, n, n.max() + 1).argmin())
    keep = (y[near] == y[:, None]).all(axis=1) | ((y == least) & (not all_classes))
    return (x[keep], y[keep]) if len(np.unique(y[keep])) == len(np.unique(y)) else (x, y)


def sampling(name: str, rows: DataFrame, seed: int) -> DataFrame:
    """Training rows resampled; never applied to test rows. SMOTE and editing compare a bounded sample with itself."""
    if name == "none":
        return rows
    if name == "random_undersample":
        from .splits import undersample

        return undersample(rows, "y", seed, "__id")
    x, y = _collected(rows)
    if name in ("smote", "smoteenn"):
        x, y = smote(x, y, seed)
    if name in ("enn", "smoteenn"):
        x, y = edited(x, y, all_classes=name == "smoteenn")
    return _frame(rows, x, y)
