"""Checks that are aggregates and joins over the tables: one or two jobs each, whose collected result is a row a class or column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import threshold
from ..functions.exprs import epoch
from ..functions.stats import newcombe
from ..operators import neighbours, ranks, relational
from .registry import FLAG, NOT_APPLICABLE, OK, WARNING, Subject, check, finding

#: Rows that a class needs before anything is said about it alone.
LEAST = 20


def _by(df: DataFrame, key: str, value: str) -> dict:
    return {str(r[key]): r[value] for r in df.collect()}


def _share(x: float) -> str:
    return f"{100 * x:.2f} %"


@check("dedup_check", "Rows that repeat within train, between train and test, and within test. Flags any test row that is also in train; warns of any other repeat.")
def dedup(s: Subject) -> dict:
    d = {k: int(v) for k, v in relational.duplicate_stats(s.train, s.test, s.features).first().asDict().items()}
    rates = _by(relational.duplicate_rates(s.train, s.features, s.cls, s.row_id, LEAST), "cls", "rate")
    leaks = _by(relational.leak_rates(s.train, s.test, s.features, s.cls), "cls", "rate")
    d["by_class"] = {c: {"train_duplicate_rate": r, "test_leak_rate": leaks.get(c)} for c, r in sorted(rates.items())}
    status = FLAG if d["test_leakage_dropped"] else WARNING if d["train_duplicates_dropped"] or d["test_duplicates_dropped"] else OK
    return finding("dedup_check", status, f"{d['train_duplicates_dropped']} of {d['train_rows_raw']} train rows repeat another; {d['test_leakage_dropped']} of {d['test_rows_raw']} test rows are also in train, and {d['test_duplicates_dropped']} more repeat within test", **d)


@check("label_conflict_check", "Equal feature rows that carry more than one label. Flags any.")
def label_conflict(s: Subject) -> dict:
    r = relational.label_conflicts(s.train, s.test, s.features, s.label).first()
    if not r["conflicting_groups"]:
        return finding("label_conflict_check", OK, "no feature row carries two labels")
    rates = _by(relational.conflict_rates(s.train, s.test, s.features, s.label, s.cls, LEAST), "cls", "rate")
    return finding(
        "label_conflict_check", FLAG, f"{r['conflicting_groups']} feature rows carry more than one label: {r['conflicting_rows']} rows ({r['pct']:.2f} %); {r['cross_split_conflicting_groups']} of them are in train and test",
        conflicting_groups=r["conflicting_groups"], conflicting_rows=r["conflicting_rows"], cross_split_conflicting_groups=r["cross_split_conflicting_groups"], by_class={c: {"conflicting_rate": x} for c, x in sorted(rates.items())},
    )


@check("near_duplicate_class_check", "Rows whose nearest other row, at practically no distance, has another label. Flags any.")
def near_duplicate_class(s: Subject) -> dict:
    name = "near_duplicate_class_check"
    sizes = [r["cls"] for r in relational.class_counts(s.train, s.cls).where(F.col("n") >= LEAST).collect()]
    if len(sizes) < 2 or not s.features:
        return finding(name, NOT_APPLICABLE, f"fewer than two classes with {LEAST} rows")
    rows = s.train.where(F.col(s.cls).isin(sizes))
    v = neighbours.scaled(rows, s.features, neighbours.scaler(rows, s.features)).select("v", F.col(s.cls).cast("string").alias("__cls"), s.row_id)
    bad = neighbours.confused_rows(v, neighbours.width(rows, s.features), "__cls", s.row_id, seed=s.seed).persist()
    try:
        n = bad.count()
        pairs = bad.groupBy(F.concat_ws(" / ", F.least("__cls", "other"), F.greatest("__cls", "other")).alias("pair")).count().orderBy(F.desc("count"), "pair").limit(5)
        top = {r["pair"]: r["count"] for r in pairs.collect()}
    finally:
        bad.unpersist()
    text = f"{n} rows of {len(sizes)} classes lie on a row of another class" + (f", most often {next(iter(top))}" if top else "")
    return finding(name, FLAG if n else OK, text, classes_tested=len(sizes), affected_rows=n, top_pairs=top)


@check("one_rule_check", "The best single threshold on a single column. Flags if it alone is right in over 95 % and removes half of the majority guess's errors.")
def one_rule(s: Subject) -> dict:
    name = "one_rule_check"
    stump = ranks.best_stump(s.train, s.numeric, s.label).first() if s.numeric else None
    if stump is None:
        return finding(name, NOT_APPLICABLE, "no numeric column can be cut in two")
    major = [r["cls"] for r in relational.class_counts(s.train, s.label).orderBy(F.desc("n"), "cls").limit(1).collect()][0]
    x = F.coalesce(F.col(stump["feature"]).cast("double"), F.lit(0.0))
    said = F.when(x <= stump["threshold"], F.lit(stump["left_cls"])).otherwise(F.lit(stump["right_cls"]))

    def accuracy(df: DataFrame) -> tuple[float, float]:
        r = df.where(F.col(s.label).isNotNull()).agg(F.avg((said == F.col(s.label)).cast("double")), F.avg((F.col(s.label) == F.lit(major)).cast("double"))).first()
        return r[0] or 0.0, r[1] or 0.0

    (train, _), (test, base) = accuracy(s.train), accuracy(s.test)
    gain = (test - base) / (1 - base) if base < 1 else 0.0
    rule = f"{stump['feature']} <= {stump['threshold']:.6g}: {stump['left_cls']}, else {stump['right_cls']}"
    return finding(name, FLAG if test > 0.95 and gain >= 0.5 else OK, f"{rule}; right for {_share(test)} of test rows, where the commonest class is {_share(base)}", rule=rule, train_accuracy=train, test_accuracy=test, majority_baseline_accuracy=base, error_reduction_vs_baseline=gain)


@check("feature_auc_ranking_check", "AUC of every numeric column for every class against the rest. Flags over 0.95, warns over 0.90.")
def feature_auc(s: Subject) -> dict:
    name = "feature_auc_ranking_check"
    rows = ranks.feature_auc(s.train, s.numeric, s.label) if s.numeric else None
    best = rows.groupBy("feature").agg(F.max(F.struct(F.round("auc", 12).alias("auc"), F.col("cls").cast("string").alias("c"))).alias("top"), F.min(F.struct((-F.round("auc", 12)).alias("a"), F.col("cls").cast("string").alias("cls"))).alias("b")) if rows is not None else None
    top = best.select("feature", (-F.col("b.a")).alias("auc"), F.col("b.cls").alias("cls")).orderBy(F.desc("auc"), "feature").limit(5).collect() if best is not None else []
    if not top:
        return finding(name, NOT_APPLICABLE, "no numeric column with two classes to rank")
    a = top[0]
    return finding(name, FLAG if a["auc"] > 0.95 else WARNING if a["auc"] > 0.90 else OK, f"{a['feature']} alone ranks class {a['cls']} with an AUC of {a['auc']:.4f}", top_features={r["feature"]: r["auc"] for r in top}, best_feature=a["feature"], best_class=a["cls"])


@check("temporal_realism_check", "Time span of each class over that of all rows. Flags under 5 %, warns under 15 %.")
def temporal_realism(s: Subject) -> dict:
    name, c = "temporal_realism_check", s.cfg["schema"]["timestamp_column"]
    if not c or c not in s.train.columns:
        return finding(name, NOT_APPLICABLE, "no timestamp column")
    spans = {str(r["cls"]): r["ratio"] for r in relational.class_spans(s.train, epoch(s.train, c), s.cls, LEAST).orderBy("cls").collect() if r["ratio"] is not None}
    if not spans:
        return finding(name, NOT_APPLICABLE, f"no class has {LEAST} timestamps over a span of time")
    worst = min(spans, key=lambda k: (spans[k], k))
    return finding(name, FLAG if spans[worst] < 0.05 else WARNING if spans[worst] < 0.15 else OK, f"{worst} fills {_share(spans[worst])} of the time span, the least of any class", span_ratio_by_class=spans)


@check("flow_group_leakage_check", "Identities found in train and in test. Flags any.")
def flow_group_leakage(s: Subject) -> dict:
    name = "flow_group_leakage_check"
    keys = [c for c in s.cfg["schema"]["flow_id_columns"] if c in s.train.columns and c in s.test.columns]
    if not keys:
        return finding(name, NOT_APPLICABLE, "no flow id columns")
    r = relational.group_overlap(s.train, s.test, keys).first()
    return finding(name, FLAG if r[0] else OK, f"{r[0]} identities are on both sides: {r[1]} train rows and {r[2]} test rows", flow_id_columns=keys, overlapping_identities=r[0], train_rows_affected=r[1], test_rows_affected=r[2])


def contiguity(df: DataFrame, order: str, label: str) -> float | None:
    """How often the label changes from row to row, over how often it would in random order."""
    t = ranks.transitions(df, order, label).first()
    p = [r["share"] for r in relational.class_counts(df, label).collect()]
    mixed = 1 - sum(x * x for x in p)
    return t["changes"] / (t["rows"] - 1) / mixed if t["rows"] > 1 and len(p) > 1 and mixed > 0 else None


@check("row_order_leakage_check", "Label changes between neighbouring rows, relative to random order. Flags under 0.3, warns under 0.6.")
def row_order(s: Subject) -> dict:
    name = "row_order_leakage_check"
    got = {k: contiguity(df, s.row_id, s.label) for k, df in (("train", s.train), ("test", s.test))}
    known = [x for x in got.values() if x is not None]
    if not known:
        return finding(name, NOT_APPLICABLE, "neither side has two rows of two classes")
    low = min(known)
    return finding(name, FLAG if low < 0.3 else WARNING if low < 0.6 else OK, f"labels change {low:.3f} times as often from row to row as in random order", contiguity_ratio=got)


@check("homogeneity_test", "Share of test rows that lie on a train row, less the share of train rows that lie on another. Per class, with an interval against a margin of 5 points. Flags leakage, warns if inconclusive.")
def homogeneity(s: Subject) -> dict:
    name, margin = "homogeneity_test", float(threshold(s.cfg, "homogeneity_test", 0.05))
    index = s.train
    enough = lambda df: {str(r["cls"]) for r in relational.class_counts(df, s.cls).where(F.col("n") >= LEAST).collect()}
    classes = enough(s.train) & enough(s.test)
    if not classes or not s.features:
        return finding(name, NOT_APPLICABLE, f"no class has {LEAST} rows on both sides")
    scale = neighbours.scaler(index, s.features)
    # a test row is no row of the index, whatever its number
    shape = lambda df, side="control": neighbours.scaled(df, s.features, scale).select("v", F.col(s.cls).cast("string").alias("__cls"), F.struct(F.lit(side == "test").alias("t"), F.col(s.row_id).alias("i")).alias("__id"), F.lit(side).alias("__side"))
    asked = lambda df: df.where(F.col(s.cls).cast("string").isin(sorted(classes)))
    rows = shape(asked(s.test), "test").unionByName(shape(asked(index)))
    near = neighbours.near_zero(rows, shape(index), neighbours.width(index, s.features), "__id", seed=s.seed)
    counts = {(r["__cls"], r["__side"]): (r["k"], r["n"]) for r in near.groupBy("__cls", "__side").agg(F.count_if("near").alias("k"), F.count("*").alias("n")).collect()}
    out = {}
    for c in sorted(classes):
        (k1, n1), (k2, n2) = counts.get((c, "test"), (0, 0)), counts.get((c, "control"), (0, 0))
        if not n1 or not n2:
            continue
        lo, hi = newcombe(k1, n1, k2, n2)
        kind = "leakage" if lo > margin else ("below_control" if hi < -margin else "equivalent") if hi < margin else "inconclusive"
        out[c] = {"test_near_zero_rate": k1 / n1, "control_near_zero_rate": k2 / n2, "rate_diff_ci_95": [lo, hi], "equivalence_margin": margin, "classification": kind}
    kinds = {x["classification"] for x in out.values()}
    status = FLAG if "leakage" in kinds else WARNING if "inconclusive" in kinds else OK
    return finding(name, status, ", ".join(f"{c}: {x['classification']}" for c, x in out.items()), per_class=out, equivalence_margin=margin)


@check("class_distribution_report", "Rows of each class. Warns if the largest is over 100 times the smallest, or a class is under 1 % of train.")
def class_distribution(s: Subject) -> dict:
    sides = {}
    for side, df in (("train", s.train), ("test", s.test)):
        rows = relational.class_counts(df, s.label).orderBy(F.desc("n"), "cls").collect()
        sides[side] = {"counts": {str(r["cls"]): r["n"] for r in rows}, "shares": {str(r["cls"]): r["share"] for r in rows}}
    n = sides["train"]["counts"].values()
    ratio = max(n) / min(n) if n else None
    rare = sorted(c for c, x in sides["train"]["shares"].items() if x < 0.01)
    bad = (ratio or 0) > 100 or bool(rare)
    return finding("class_distribution_report", WARNING if bad else OK, f"{len(n)} classes; the largest has {ratio or 0:.1f} times the rows of the smallest" + (f"; under 1 %: {', '.join(rare)}" if rare else ""), **sides, imbalance_ratio=ratio, rare_classes=rare)


@check("low_cardinality_warning", "Distinct values of each id column. Warns under 50.", suspects=("flagged",))
def low_cardinality(s: Subject) -> dict:
    name = "low_cardinality_warning"
    if not s.ids:
        return finding(name, NOT_APPLICABLE, "no id columns")
    n = _by(relational.distinct_counts(s.train, s.ids), "feature", "n_distinct")
    few = sorted(c for c, x in n.items() if x < 50)
    return finding(name, WARNING if few else OK, ", ".join(f"{c}: {n[c]} values" for c in sorted(n)), cardinalities=n, flagged=few)


# Column names by which the output of an extraction tool is known.
SIGNATURES = {"CICFlowMeter": ("Flow Duration", "Fwd Packet Length Mean", "Bwd Packet Length Mean", "Flow Bytes/s", "Flow Packets/s", "Fwd IAT Mean", "Bwd IAT Mean", "Init_Win_bytes_forward", "Init_Win_bytes_backward")}
SIGNATURE_SHARE = 0.6


@check("schema_fingerprint_check", "Column names of extraction tools with known faults. Warns if 60 % of a tool's are there.", structural=True, evidence="documented")
def schema_fingerprint(s: Subject) -> dict:
    shares = {t: sum(c in s.train.columns for c in names) / len(names) for t, names in SIGNATURES.items()}
    hits = {t: {"match_share": x, "warning": f"{t}: early releases computed a number of features wrongly (Rosay et al. 2021); find out which version made this table"} for t, x in shares.items() if x >= SIGNATURE_SHARE}
    return finding("schema_fingerprint_check", WARNING if hits else OK, "; ".join(h["warning"] for h in hits.values()) or "no known extraction tool's columns", **hits)


@check("data_integrity_check", "Missing labels, missing or infinite values, and constant columns. Flags missing labels, warns of the rest.", suspects=("constant_features", "missing_by_feature", "inf_by_feature"))
def data_integrity(s: Subject) -> dict:
    rows = {r["feature"]: r for r in relational.integrity(s.train, s.features, s.label).collect()}
    lost = int(rows[s.label]["missing"])
    missing = {c: int(rows[c]["missing"]) for c in s.features if rows[c]["missing"]}
    infinite = {c: int(rows[c]["infinite"]) for c in s.features if rows[c]["infinite"]}
    constant = [c for c in s.features if rows[c]["constant"]]
    status = FLAG if lost else WARNING if missing or infinite or constant else OK
    return finding("data_integrity_check", status, f"{lost} rows without a label; {len(missing)} columns with gaps, {len(infinite)} with infinities, {len(constant)} constant", missing_label_count=lost, missing_by_feature=missing, inf_by_feature=infinite, constant_features=constant)


# Published facts about public data sets, by a part of their name.
KNOWN_ISSUES: dict[str, list[dict[str, str]]] = {
    "cic-ids2018": [
        {"issue": "172 of 362 flows labelled Brute Force-Web on 2018-02-23 are no attack (21 malformed addresses, 151 background)", "citation": "Liu et al. 2022, IEEE CNS", "release": "original CSVs"},
        {"issue": "7.53 % of labels are wrong, over 75 % in some classes", "citation": "Liu et al. 2022, IEEE CNS", "release": "original CSVs"},
    ],
    "cic-ids2017": [
        {"issue": "packets are out of order and doubled, and some attacks that ran are not labelled", "citation": "Engelen et al. 2021, IEEE S&P Workshops", "release": "original CSVs"},
        {"issue": "6.67 % of labels are wrong, over 75 % in some classes", "citation": "Liu et al. 2022, IEEE CNS", "release": "original CSVs"},
        {"issue": "Heartbleed has 11 rows, too few to judge", "citation": "Cantone et al. 2024, IEEE Access", "release": "all releases"},
    ],
    "nsl-kdd": [{"issue": "the test set has attack types that train lacks, by design", "citation": "Tavallaee et al. 2009, IEEE CISDA"}],
    "bot-iot": [{"issue": "the NetFlow version is almost all attack (129,437 of 30,420,086 rows benign), so accuracy says little about normal traffic", "citation": "Koroniotis et al. 2019, FGCS"}],
    "bot-iot-official": [{"issue": "477 of 3,668,522 rows are benign, so accuracy says little about normal traffic", "citation": "Koroniotis et al. 2019, FGCS"}],
    "cic-ddos2019": [
        {"issue": "the two days cover different attacks, by design", "citation": "Sharafaldin et al. 2019, IEEE ICCST"},
        {"issue": "the two days spell labels of the same attack differently (UDPLag, UDP-lag); map them before comparing", "citation": "the label columns of the release"},
    ],
    "unsw-nb15": [{"issue": "some copies swap the names of the training and testing files (82,332 and 175,341 rows)", "citation": "row counts of the release"}],
}


@check("known_issue_lookup", "Published faults of the data set, by its name. Warns of any.", structural=True, evidence="documented")
def known_issues(s: Subject) -> dict:
    name = (s.cfg["dataset"]["name"] or "").strip().lower()
    keys = sorted((k for k in KNOWN_ISSUES if k in name), key=len, reverse=True)
    kept: list[str] = []
    for k in keys:  # a longer name that holds a shorter one speaks for it
        if not any(k in longer for longer in kept):
            kept.append(k)
    found = [x for k in kept for x in KNOWN_ISSUES[k]]
    text = "; ".join(f"{x['issue']} ({x['citation']})" for x in found)
    return finding("known_issue_lookup", WARNING if found else OK, text or f"nothing is on record for '{name}'", matches=found)
