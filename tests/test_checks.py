"""Each check on a table with a planted fault, on one without, and where it does not apply."""

import numpy as np
import pandas as pd
import pytest

from plumbline import config
from plumbline.plans.registry import Subject, checks
from plumbline.sources.reading import ROW_ID


def base(n=600, seed=0, **columns):
    rng = np.random.default_rng(seed)
    d = {"x1": rng.normal(size=n), "x2": rng.normal(size=n), "y": rng.choice(["a", "b"], n)}
    return pd.DataFrame(d | {k: f(rng, n, d) for k, f in columns.items()})


@pytest.fixture(scope="module")
def run(spark):
    def go(check, frame, test=None, raw=True, reference=None, **cfg):
        c = config.merge(config.DEFAULTS, {"dataset": {"name": "t"}, "schema": {"label_column": "y"}, "audit": {"forest_trees": 10, "forest_depth": 6}})
        c = config.merge(c, cfg)
        whole = spark.createDataFrame(frame.assign(**{ROW_ID: range(len(frame))})).coalesce(2)
        if test is None:
            train, held = whole.where(f"{ROW_ID} % 4 <> 0"), whole.where(f"{ROW_ID} % 4 = 0")
        else:
            train, held = whole, spark.createDataFrame(test.assign(**{ROW_ID: range(len(test))}))
        ref = None if reference is None else spark.createDataFrame(reference.assign(**{ROW_ID: range(len(reference))}))
        return checks()[check].run(Subject(train, held, c, (lambda: whole) if raw else None, None if ref is None else (lambda: ref)))

    return go


def test_all_are_there():
    assert tuple(checks()) == config.CHECKS and sum(c.structural for c in checks().values()) == 7


def test_dedup(run):
    f = base()
    twice = pd.concat([f, f.iloc[:41], f.iloc[:42]], ignore_index=True)
    got = run("dedup_check", twice)
    assert got["status"] == "flag" and got["details"]["test_leakage_dropped"] > 0 and set(got["details"]["by_class"]) == {"a", "b"}
    assert run("dedup_check", f)["status"] == "ok"


def test_dedup_counts_only_repeats_that_do_not_leak(run):
    train = pd.DataFrame({"x": [1.0, 1.0, 2.0, None, None], "y": list("ababa")})
    test = pd.DataFrame({"x": [1.0, 3.0, 3.0, None, 4.0], "y": list("ababa")})
    d = run("dedup_check", train, test)["details"]
    assert (d["train_duplicates_dropped"], d["test_leakage_dropped"], d["test_duplicates_dropped"], d["test_rows_deduped"]) == (2, 2, 1, 2)


def test_label_conflict(run):
    f = base()
    assert run("label_conflict_check", f)["status"] == "ok"
    bad = pd.concat([f, f.iloc[:5].assign(y=f.y.iloc[:5].map({"a": "b", "b": "a"}))], ignore_index=True)
    got = run("label_conflict_check", bad)
    assert got["status"] == "flag" and got["details"]["conflicting_groups"] == 5 and got["details"]["conflicting_rows"] == 10


def test_null_places_do_not_mix(run):
    f = pd.DataFrame({"p": [None, 1.0], "q": [1.0, None], "y": ["a", "b"]})
    got = run("label_conflict_check", pd.concat([f] * 30, ignore_index=True))
    assert got["status"] == "ok"


def test_near_duplicate_class(run):
    f = base()
    assert run("near_duplicate_class_check", f)["status"] == "ok"
    bad = pd.concat([f, f.iloc[:30].assign(x1=f.x1.iloc[:30] + 1e-9, y=f.y.iloc[:30].map({"a": "b", "b": "a"}))], ignore_index=True)
    got = run("near_duplicate_class_check", bad)
    assert got["status"] == "flag" and got["details"]["affected_rows"] > 20 and list(got["details"]["top_pairs"]) == ["a / b"]
    assert run("near_duplicate_class_check", f.assign(y="a"))["status"] == "not_applicable"


def leak(rng, n, d):
    return (d["y"] == "a") * 10.0 + rng.normal(size=n) * 0.01


def test_shortcuts_in_one_column(run):
    bad, good = base(leak=leak), base()
    for name in ("one_rule_check", "feature_auc_ranking_check", "leakage_screen"):
        assert run(name, bad)["status"] == "flag"
        assert "leak" in str(run(name, bad)["details"])
    assert run("one_rule_check", good)["status"] == "ok" and run("feature_auc_ranking_check", good)["status"] == "ok" and run("leakage_screen", good)["status"] in ("ok", "flag")
    assert run("one_rule_check", good[["y"]].assign(z=1.0))["status"] == "not_applicable"
    assert run("feature_auc_ranking_check", good[["y"]].assign(z="t"))["status"] == "not_applicable"


def test_infinite_columns_are_not_ranked(run):
    f = base(leak=lambda rng, n, d: np.where(d["y"] == "a", np.inf, 0.0))
    assert run("feature_auc_ranking_check", f)["details"]["best_feature"] != "leak"


def test_identity(run):
    ids = {"schema": {"label_column": "y", "id_like_columns": ["host"]}}
    bad = base(host=lambda rng, n, d: np.where(d["y"] == "a", "h", "k") + pd.Series(rng.integers(0, 20, n)).astype(str).to_numpy())
    got = run("identity_column_flag", bad, **ids)
    assert got["status"] == "flag" and got["details"]["suggested_drop"] == ["host"] and got["details"]["seen_coverage"]["host"] > 0.9
    renamed = run("identity_column_flag", bad.assign(host=bad.host.map(lambda h: h[::-1] + "!")), **ids)
    assert renamed["details"]["standalone_auc"]["host"] == pytest.approx(got["details"]["standalone_auc"]["host"])
    good = base(host=lambda rng, n, d: rng.integers(0, 20, n))
    assert run("identity_column_flag", good, **ids)["status"] == "ok" and run("identity_column_flag", good)["status"] == "not_applicable"
    low = run("low_cardinality_warning", good, **ids)
    assert low["status"] == "warning" and low["details"]["cardinalities"] == {"host": 20} and run("low_cardinality_warning", good)["status"] == "not_applicable"


def test_port_and_protocol(run):
    cfg = {"schema": {"label_column": "y", "id_like_columns": ["dst_port"]}}
    bad = base(dst_port=lambda rng, n, d: np.where(d["y"] == "a", 80, 443), proto=lambda rng, n, d: rng.choice(["t", "u"], n))
    assert run("port_protocol_shortcut_check", bad, **cfg)["status"] == "flag"
    assert run("port_protocol_shortcut_check", bad.assign(dst_port=1), **cfg)["status"] == "ok"
    assert run("port_protocol_shortcut_check", bad)["status"] == "not_applicable"


def test_time(run):
    cfg = {"schema": {"label_column": "y", "timestamp_column": "t"}}
    f = base(t=lambda rng, n, d: np.where(d["y"] == "a", rng.uniform(0, 10, n), rng.uniform(10, 1000, n)))
    assert run("temporal_realism_check", f, **cfg)["status"] == "flag" and run("temporal_leakage_check", f, **cfg)["status"] == "flag"
    text = f.assign(t=pd.to_datetime(f.t, unit="s").dt.strftime("%Y-%m-%d %H:%M:%S"))
    assert run("temporal_realism_check", text, **cfg)["status"] == "flag"
    good = base(t=lambda rng, n, d: rng.uniform(0, 1000, n))
    assert run("temporal_realism_check", good, **cfg)["status"] == "ok" and run("temporal_leakage_check", good, **cfg)["status"] == "ok"
    assert run("temporal_realism_check", good)["status"] == run("temporal_leakage_check", good)["status"] == "not_applicable"


def test_flow_groups(run):
    cfg = {"schema": {"label_column": "y", "flow_id_columns": ["f"]}}
    got = run("flow_group_leakage_check", base(f=lambda rng, n, d: np.arange(n) // 2), **cfg)
    assert got["status"] == "flag" and got["details"]["overlapping_identities"] == 150
    assert run("flow_group_leakage_check", base(f=lambda rng, n, d: np.arange(n)), **cfg)["status"] == "ok" and run("flow_group_leakage_check", base())["status"] == "not_applicable"


def test_row_order(run):
    f = base()
    assert run("row_order_leakage_check", f.sort_values("y").reset_index(drop=True))["status"] == "flag" and run("row_order_leakage_check", f)["status"] == "ok"
    assert run("row_order_leakage_check", f.assign(y="a"))["status"] == "not_applicable"


def test_homogeneity(run):
    f = base(1200)
    assert run("homogeneity_test", f.iloc[:900], f.iloc[900:])["status"] == "ok"
    bad = run("homogeneity_test", f.iloc[:900], f.iloc[:300])
    assert bad["status"] == "flag" and bad["details"]["per_class"]["a"]["test_near_zero_rate"] == 1
    assert run("homogeneity_test", f.iloc[:10])["status"] == "not_applicable"


def test_class_distribution(run):
    f = base()
    got = run("class_distribution_report", f)
    assert got["status"] == "ok" and sum(got["details"]["train"]["counts"].values()) == 450
    assert run("class_distribution_report", f.assign(y=["r"] * 3 + ["a"] * 597))["details"]["rare_classes"] == ["r"]


def test_integrity(run):
    f = base()
    assert run("data_integrity_check", f)["status"] == "ok"
    bad = f.assign(c=1.0, m=f.x1.where(f.x1 > 0), i=f.x1.where(f.x1 > 0, np.inf))
    d = run("data_integrity_check", bad)
    assert d["status"] == "warning" and d["details"]["constant_features"] == ["c"] and d["details"]["inf_by_feature"].keys() == {"i"} and d["details"]["missing_by_feature"].keys() == {"m"}
    assert run("data_integrity_check", f.assign(y=[None] + list(f.y[1:])), f)["status"] == "flag"


def test_names(run):
    f = base()
    many = f.assign(**{c: f.x1 for c in ("Flow Duration", "Flow Bytes/s", "Flow Packets/s", "Fwd IAT Mean", "Bwd IAT Mean", "Init_Win_bytes_forward")})
    assert run("schema_fingerprint_check", many)["status"] == "warning" and run("schema_fingerprint_check", f)["status"] == "ok"
    assert len(run("known_issue_lookup", f, dataset={"name": "My BoT-IoT-official copy"})["details"]["matches"]) == 1 and run("known_issue_lookup", f)["status"] == "ok"


def grouped(n=1200, seed=1):
    """Labels belong to groups; columns tell the group, not the label."""
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 60, n)
    mark = rng.normal(size=(60, 3)) * 5
    label = rng.choice(["a", "b"], 60)
    return pd.DataFrame({**{f"x{k}": mark[g, k] + rng.normal(size=n) * 0.05 for k in range(3)}, "g": g, "y": label[g]})


def test_resplit(run):
    cfg = {"dataset": {"name": "t", "raw_files": ["x"], "group_columns": ["g"]}, "schema": {"label_column": "y", "drop_columns": ["g"]}}
    assert run("resplit_falsification", grouped(), **cfg)["status"] == "flag"
    assert run("resplit_falsification", grouped())["status"] == "not_applicable" and run("resplit_falsification", grouped(), raw=False, **cfg)["status"] == "not_applicable"
    got = run("repeated_seed_falsification_check", grouped(), audit={"repeated_seed_count": 3}, **cfg)
    assert got["details"]["n_seeds"] == 3 and got["details"]["mean_drop"] > 0.1
    assert run("repeated_seed_falsification_check", grouped(), audit={"repeated_seed_count": 2}, **cfg)["status"] == "not_applicable"
    assert run("result_robustness_check", grouped(), **cfg)["status"] == "flag" and run("result_robustness_check", base())["status"] == "not_applicable"


def test_scenarios(run):
    cfg = {"schema": {"label_column": "y", "scenario_column": "s"}}
    rng = np.random.default_rng(2)
    n = 900
    s = rng.choice(["p", "q", "r"], n, p=[0.4, 0.4, 0.2])
    y = rng.choice(["a", "b"], n)
    # what tells the classes apart is turned round in r
    sign = np.where(s == "r", -1, 1) * np.where(y == "a", 1, -1)
    f = pd.DataFrame({"x": sign + rng.normal(size=n) * 0.2, "s": s, "y": y})
    got = run("scenario_holdout_falsification", f, **cfg)
    assert got["status"] == "flag" and got["details"]["held_out_scenario"] == "r"
    m = run("cross_capture_matrix_check", f, **cfg)
    assert m["status"] == "flag" and len(m["details"]["matrix"]) == 6
    for name in ("scenario_holdout_falsification", "cross_capture_matrix_check"):
        assert run(name, f)["status"] == run(name, f.assign(s="p"), **cfg)["status"] == "not_applicable"


def test_reference(run):
    f, away = base(), base(seed=1)
    near = run("synthetic_realism_check", f, reference=away)
    assert near["status"] == "ok" and set(near["details"]["ks_by_feature"]) == {"x1", "x2"}
    assert run("synthetic_realism_check", f, reference=away.assign(x1=away.x1 + 9))["status"] == "flag"
    good, turned = base(leak=leak), base(seed=1, leak=lambda rng, n, d: (d["y"] == "b") * 10.0)
    assert run("cross_dataset_drift_check", good, reference=turned)["status"] == "flag" and run("cross_dataset_drift_check", good, reference=base(seed=3, leak=leak))["status"] == "ok"
    assert run("cross_dataset_drift_check", good, reference=turned.drop(columns="y"))["status"] == "warning"
    assert run("synthetic_realism_check", f, reference=pd.DataFrame({"q": [1.0]}))["status"] == "warning"


def test_ablation_and_artifacts(run):
    f = base(leak=leak, host=lambda rng, n, d: (d["y"] == "a") * 100.0 + rng.integers(0, 9, n))
    cfg = {"schema": {"label_column": "y", "feature_categories": {"leak": "l", "x1": "x"}, "drop_columns": ["host"]}}
    got = run("feature_category_ablation_check", f, **cfg)
    assert got["status"] == "flag" and got["details"]["drop_by_category"]["l"] > 0.3 and run("feature_category_ablation_check", f)["status"] == "not_applicable"
    art = run("artifact_sensitivity_check", f.drop(columns="leak"), schema={"label_column": "y", "id_like_columns": ["host"]})
    assert art["status"] == "flag" and run("artifact_sensitivity_check", f)["status"] == "not_applicable"


def test_seed_sensitivity(run):
    got = run("seed_sensitivity_check", base(leak=leak))
    assert got["status"] == "ok" and got["details"]["leakage_screen_statuses"] == ["flag"]


def test_values_not_seen_in_train(run):
    train = base(300, c=lambda rng, n, d: np.where(d["y"] == "a", "u", "v"))
    test = base(100, seed=5, c=lambda rng, n, d: np.full(n, "new"))
    got = run("leakage_screen", train, test)
    assert got["status"] == "flag" and "c" in got["details"]["top_features"]
