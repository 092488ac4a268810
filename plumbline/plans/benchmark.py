"""Fits each classifier under each scaling and sampling, for the label and for the attack category, and scores it on all test rows."""

from __future__ import annotations

import csv
import itertools
import logging
import time
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..config import CLASSIFIERS, UNTUNED
from ..operators import classifiers, forest, relational, splits
from ..sources.reading import ROW_ID
from .registry import feature_columns
from .report import write_json

log = logging.getLogger("plumbline")
#: Rows that a fit reads at most, and folds of a parameter search.
CAP, TUNING_FOLDS = 200_000, 3


def metrics(counts: list[tuple[str, str, int]]) -> dict[str, Any]:
    """Accuracy, F1 by support and by class, and figures of each class, from (true, predicted, rows)."""
    names = sorted({a for a, _, _ in counts} | {b for _, b, _ in counts})
    at = {c: k for k, c in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, n in counts:
        m[at[a], at[b]] += n
    hit, support, said = np.diag(m), m.sum(axis=1), m.sum(axis=0)
    precision, recall = (np.divide(hit, x, out=np.zeros_like(hit), where=x > 0) for x in (said, support))
    f1 = np.divide(2 * precision * recall, precision + recall, out=np.zeros_like(hit), where=precision + recall > 0)
    total = m.sum()
    return {
        "accuracy": float(hit.sum() / total) if total else 0.0, "f1_weighted": float((f1 * support).sum() / total) if total else 0.0, "f1_macro": float(f1.mean()) if len(names) else 0.0,
        "balanced_accuracy": float(recall[support > 0].mean()) if (support > 0).any() else 0.0, "worst_recall": float(recall[support > 0].min()) if (support > 0).any() else 0.0,
        "classes": names, "confusion_matrix": m.astype(int).tolist(), "per_class": [{"class": c, "precision": float(p), "recall": float(r), "f1": float(f), "support": int(s)} for c, p, r, f, s in zip(names, precision, recall, f1, support, strict=True)],
    }


def score(scored: DataFrame, classes: list[str]) -> dict[str, Any]:
    """Metrics of rows with __label, y, prediction and probability. A label that train lacks counts as a class of its own, never predicted."""
    name = F.get(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int"))
    answers = forest.told(scored).persist(StorageLevel.MEMORY_AND_DISK)  # the rows are scored once
    try:
        rows = answers.where(F.col("__label").isNotNull()).groupBy("__label", name.alias("said")).agg(F.sum("n").alias("n")).collect()  # a row a pair of classes
        return metrics([(r["__label"], r["said"], r["n"]) for r in rows]) | {"auc": forest.auc_of(answers, classes)}
    finally:
        answers.unpersist()


def _search(name: str, rows: DataFrame, classes: list[str], d: int, n: int, cfg: dict, given: dict) -> dict:
    """The parameters with the best accuracy over TUNING_FOLDS folds."""
    space = cfg["classifiers"]["search_space"].get(name) or {}
    grid = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
    if len(grid) < 2:
        return given | (grid[0] if grid else {})
    folds = rows.withColumn("__cv", F.pmod(F.xxhash64(F.lit(cfg["random_seed"]), "__id"), F.lit(TUNING_FOLDS))).persist()
    best: tuple[float, dict] = (-1.0, given)
    for p in grid:
        fit = classifiers.build(name, len(classes), d, n, cfg["random_seed"], given | p)
        acc = []
        for k in range(TUNING_FOLDS):
            model = fit(folds.where(F.col("__cv") != k).drop("__cv"))
            acc.append(model(folds.where(F.col("__cv") == k).drop("__cv")).agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0] or 0.0)
        if sum(acc) / len(acc) > best[0]:
            best = (sum(acc) / len(acc), given | p)
    folds.unpersist()
    return best[1]


def _list(x: Any) -> list:
    return x if isinstance(x, list) else [x]


def run_benchmark(spark: SparkSession, train: DataFrame, test: DataFrame, cfg: dict, row_id: str = ROW_ID) -> tuple[list[dict], dict]:
    """(rows, extras): a row for each stage, sampling, scaling and classifier; what fails is logged and left out."""
    c, seed = cfg["classifiers"], cfg["random_seed"]
    names = list(CLASSIFIERS) if c["list"] == "all" else c["list"]
    columns = [x for x in feature_columns(train, cfg) if x in test.columns]
    stages = [("binary", cfg["schema"]["label_column"])]
    if (category := cfg["schema"]["attack_category_column"]) and category in train.columns and category in test.columns:
        stages.append(("type", category))
    out: list[dict] = []
    extras: dict[str, Any] = {"per_class_metrics": [], "details": [], "failures": [], "class_distributions": {}, "approximations": {k: v for k, v in classifiers.APPROXIMATE.items() if k in names}}
    for stage, label in stages:
        rows = splits.sample_rows(train.where(F.col(label).isNotNull()).select(*dict.fromkeys([*columns, label, row_id])), CAP, seed, row_id)
        encoder = forest.fit_encoder(rows, columns, label, unseen="code")
        encoded = encoder(rows, [row_id]).withColumnRenamed(row_id, "__id").where("y is not null").drop("__label").persist()
        n = encoded.count()
        asked = encoder(test.where(F.col(label).isNotNull()), [row_id]).withColumnRenamed(row_id, "__id").persist()
        extras["class_distributions"][stage] = {side: {str(r["cls"]): r["n"] for r in relational.class_counts(df, label).orderBy("cls").collect()} for side, df in (("train", train), ("test", test))}
        for sample, scale in itertools.product(_list(cfg["preprocessing"]["sampling"][stage]), _list(cfg["preprocessing"]["scaling"])):
            shape = classifiers.scaling(scale)(encoded)
            ready = classifiers.sampling(sample, shape(encoded), seed).persist()
            for name in names:
                key = {"stage": stage, "sampling": sample, "scaling": scale, "classifier": name}
                try:
                    given = dict(c["hyperparameters"].get(name) or {})
                    if c["tuning"] and name not in UNTUNED:
                        given = _search(name, ready, encoder.classes, len(columns), n, cfg, given)
                    fit = classifiers.build(name, len(encoder.classes), len(columns), n, seed, given)
                    if c["calibration"] != "none" and name != "SVM":
                        fit = classifiers.calibrated(fit, len(encoder.classes), c["calibration"], seed)
                    began = time.time()
                    model = fit(ready)
                    fitted = time.time()
                    m = score(model(shape(asked)), encoder.classes)
                    done = time.time()
                except Exception as e:  # one method must not end the others
                    log.warning("%s failed: %s", key, e)
                    extras["failures"].append(key | {"error": str(e)[:500]})
                    continue
                out.append(key | {k: m[k] for k in ("accuracy", "f1_weighted", "f1_macro", "auc")} | {"fit_seconds": round(fitted - began, 3), "predict_seconds": round(done - fitted, 3), "train_rows": n})
                extras["per_class_metrics"] += [key | x for x in m["per_class"]]
                extras["details"].append(key | {"confusion_matrix": m["confusion_matrix"], "classes": m["classes"], "parameters": given, "balanced_accuracy": m["balanced_accuracy"], "worst_recall": m["worst_recall"]})
            ready.unpersist()
        encoded.unpersist()
        asked.unpersist()
    return out, extras


def write(rows: list[dict], extras: dict, at: Path) -> None:
    for name, table in (("benchmark_results.csv", rows), ("per_class_metrics.csv", extras["per_class_metrics"])):
        with (at / name).open("w", newline="") as f:
            if table:
                w = csv.DictWriter(f, list(table[0]))
                w.writeheader()
                w.writerows(table)
    write_json(at / "benchmark_details.json", extras)
