"""Checks of what a value alone gives away: smoothed value-to-class tables made on train, scored on test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranks, relational
from .registry import FLAG, NOT_APPLICABLE, OK, Subject, check, finding

AUC_FLAG, CLASSES = 0.8, 25


def keyed(s: Subject, columns: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns under names of their own: doubles where both sides hold numbers, else text."""
    from ..functions.exprs import is_numeric

    names = [f"__k{i}" for i in range(len(columns))]
    kinds = ["double" if is_numeric(s.train, c) and is_numeric(s.test, c) else "string" for c in columns]
    shape = lambda df: df.select(*[F.col(c).cast(k).alias(n) for c, k, n in zip(columns, kinds, names, strict=True)], F.col(s.label).cast("string").alias("__y"))
    return shape(s.train), shape(s.test), names


def lookup_auc(scores: DataFrame) -> tuple[float | None, dict[str, float]]:
    """The AUC of the second class of two, or the support-weighted mean, and the AUC of each class present among the test rows."""
    by = scores.groupBy("cls").agg(F.sum("y_n").alias("s"))
    some = [r["cls"] for r in by.where("s > 0").orderBy("cls").collect()]  # one row a class
    if len(some) < 2:
        return None, {}
    # classes that test lacks take no part; what remains is brought to a sum of 1
    rows = scores.where(F.col("cls").isin(some))
    total = F.sum("p").over(_per_key(scores))
    rows = rows.withColumn("score", F.round(F.when(total > 0, F.col("p") / total).otherwise(1 / len(some)), 12))
    counts = rows.select("cls", "score", F.col("y_n").alias("pos"), (F.col("n") - F.col("y_n")).alias("neg"))
    auc = {r["cls"]: (r["auc"], r["support"]) for r in ranks.score_auc(counts).collect()}
    each = {c: float(auc[c][0]) for c in some if c in auc}
    if len(some) == 2:
        return each.get(some[1]), each
    weight = sum(auc[c][1] for c in each)
    return sum(each[c] * auc[c][1] for c in each) / weight, each


def _per_key(scores: DataFrame):
    from pyspark.sql import Window

    return Window.partitionBy(*[c for c in scores.columns if c.startswith("__k")])


@check("identity_column_flag", "How well each id column's value predicts the label of test rows, by a table made on train. Flags an AUC over 0.8.", suspects=("suggested_drop",))
def identity(s: Subject) -> dict:
    name = "identity_column_flag"
    if not s.ids:
        return finding(name, NOT_APPLICABLE, "no id columns")
    whole, seen, coverage, by_class = {}, {}, {}, {}
    for c in s.ids:
        train, test, keys = keyed(s, [c])
        scores = relational.lookup_scores(train, test, keys, "__y").persist()
        try:
            whole[c], each = lookup_auc(scores)
            seen[c], _ = lookup_auc(scores.where("seen"))
            n = scores.select(*keys, "n", "seen").distinct().agg(F.sum("n"), F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0))).first()
            coverage[c] = n[1] / n[0] if n[0] else None
            if whole[c] is not None and whole[c] > AUC_FLAG and len(each) <= CLASSES:
                by_class[c] = each
        finally:
            scores.unpersist()
    bad = sorted(c for c, x in whole.items() if x is not None and x > AUC_FLAG)
    text = ", ".join(f"{c}: AUC {x:.3f}" if x is not None else f"{c}: too few classes" for c, x in whole.items())
    return finding(name, FLAG if bad else OK, text, standalone_auc=whole, seen_only_auc=seen, seen_coverage=coverage, suggested_drop=bad, method="smoothed value table", **({"by_class": by_class} if by_class else {}))


def port_and_protocol(s: Subject) -> tuple[str | None, str | None]:
    port = next((c for c in s.ids if "port" in c.lower()), None)
    protocol = next((c for c in s.train.columns if "proto" in c.lower() and c in s.test.columns), None)
    return port, protocol


@check("port_protocol_shortcut_check", "How well port and protocol together predict the label of test rows. Flags an AUC over 0.8.", suspects=("port_column", "protocol_column"))
def port_protocol(s: Subject) -> dict:
    name = "port_protocol_shortcut_check"
    port, protocol = port_and_protocol(s)
    if port is None or protocol is None:
        return finding(name, NOT_APPLICABLE, "no port among the id columns, or no protocol column")
    auc, _ = lookup_auc(relational.lookup_scores(*keyed(s, [port, protocol]), "__y"))
    if auc is None:
        return finding(name, NOT_APPLICABLE, "test has fewer than two of train's classes")
    return finding(name, FLAG if auc > AUC_FLAG else OK, f"{port} with {protocol}: AUC {auc:.3f}", port_column=port, protocol_column=protocol, standalone_auc=auc)
