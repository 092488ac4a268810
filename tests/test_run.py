"""Whole runs through the command line, and what they leave."""

import json

import numpy as np
import pandas as pd
import pytest
import yaml

from plumbline.config import CHECKS
from plumbline.plans import advice, audit, report, run
from plumbline.plans.registry import checks


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(0)
    n = 400
    y = rng.choice(["normal", "attack"], n)
    f = pd.DataFrame({"dur": rng.exponential(size=n), "size": rng.integers(0, 1500, n), "leak": (y == "attack") * 5 + rng.normal(size=n) * 0.01, "host": rng.integers(0, 30, n), "cat": np.where(y == "normal", "none", rng.choice(["dos", "ddos", "scan"], n)), "y": y})
    f = pd.concat([f, f.iloc[:20]], ignore_index=True)
    f.to_csv(at / "d.csv", index=False)
    f.sample(frac=1, random_state=1).to_csv(at / "shuffled.csv", index=False)
    return at


FEW = {c: c in ("dedup_check", "class_distribution_report", "low_cardinality_warning", "known_issue_lookup") for c in CHECKS}


def write(files, name, **more):
    cfg = {
        "dataset": {"name": "Demo set", "raw_files": [str(files / "d.csv")], "group_columns": ["host"]}, "schema": {"label_column": "y", "attack_category_column": "cat", "id_like_columns": ["host"], "flow_id_columns": ["host"]},
        "label_grouping": {"attack_type_mapping": {"ddos": "dos"}}, "audit": {"forest_trees": 3, "forest_depth": 3, "checkpoint": True}, "classifiers": {"list": ["DecisionTree", "LDA"]}, "output": {"dir": str(files / f"out-{name}"), "write_scorecard_plot": True},
    }
    from plumbline.config import merge

    p = files / f"{name}.yaml"
    p.write_text(yaml.safe_dump(merge(cfg, more)))
    return p


@pytest.fixture(scope="module")
def done(spark, files):
    run.main(["--config", str(write(files, "a"))], spark)
    return next((files / "out-a" / "runs").iterdir())


def test_everything_is_left(done):
    names = {p.name for p in done.iterdir()}
    assert {"environment.json", "resolved_config.json", "dataset_fingerprint.json", "audit_report_before.json", "audit_report_after.json", "intervention_manifest.json", "scorecard.json", "SCORECARD.md", "SCORECARD.html", "scorecard.svg", "train.parquet", "test.parquet", "benchmark_results.csv", "per_class_metrics.csv", "benchmark_details.json", "run_status.json"} <= names
    assert json.loads((done / "run_status.json").read_text()) == {"status": "completed"}
    assert not (done.parent.parent / ".checkpoint" / "before.json").exists()


def test_scorecard(done):
    card = json.loads((done / "scorecard.json").read_text())
    assert card["overall_status"] == "review_required" and card["audit_stage"] == "after" and len(card["checks"]) == 19 and len(card["checks_not_run"]) == 9
    by = {r["check"]: r for r in card["checks"]}
    assert by["dedup_check"]["before"]["status"] == "flag" and by["dedup_check"]["after"]["status"] == "ok" and card["dedup_effect"]["train_duplicates_dropped"] > 0
    assert by["resplit_falsification"]["before"] == by["resplit_falsification"]["after"]
    rows = pd.read_csv(done / "benchmark_results.csv")
    assert len(rows) == 4 and set(rows.stage) == {"binary", "type"} and rows.accuracy.min() > 0.5
    prints = json.loads((done / "dataset_fingerprint.json").read_text())
    assert len(next(iter(prints["source_sha256"].values()))) == 64 and "ddos" not in str(json.loads((done / "benchmark_details.json").read_text())["class_distributions"])


def test_cite_and_recommend(done, capsys, files, spark):
    run.main(["cite", str(done)], spark)
    assert capsys.readouterr().out.startswith("@misc{plumbline_demo_set_")
    run.main(["recommend", str(done), "--apply", "--output", str(files / "new.yaml")], spark)
    out = capsys.readouterr().out
    assert "grouped_split" in out and yaml.safe_load((files / "new.yaml").read_text())["dataset"]["split_mode"] == "grouped"
    with pytest.raises(FileNotFoundError):
        report.load_scorecard(files)


def test_second_run_uses_the_cache_and_compares(done, files, spark):
    few = write(files, "a", audit=FEW)
    run.main(["run", "--config", str(few), "--skip-benchmark"], spark)
    last = sorted((files / "out-a" / "runs").iterdir())[-1]
    drift = json.loads((last / "scorecard.json").read_text())["previous_run_comparison"]
    assert drift["previous_run"] == done.name and drift["changed_checks"] == [] and not drift["fingerprint_changed"]


def test_compare(files, spark, capsys):
    a = write(files, "c1")
    b = write(files, "c2", dataset={"raw_files": [str(files / "shuffled.csv")], "split_ratio": 0.6})
    run.main(["compare-datasets", str(a), str(b)], spark)
    assert "FAIL" not in (out := capsys.readouterr().out) and "the same rows" in out
    c = report.compare_datasets(spark, str(a), str(write(files, "c3", dataset={"raw_files": [str(files / "d.csv"), str(files / "d.csv")]})))
    assert not c["row_count_match"] and not c["combined_content_match"] and c["schema_match"]


def test_failure_is_noted(files, spark):
    p = write(files, "bad", audit=FEW, output={"keep_runs": 1})
    old = checks()["class_distribution_report"]
    from plumbline.plans import registry

    registry._found["class_distribution_report"] = registry.Check(old.name, lambda s: 1 / 0, False, "statistical", "")
    try:
        with pytest.raises(ZeroDivisionError):
            run.main(["--config", str(p)], spark)
        at = next((files / "out-bad" / "runs").iterdir())
        assert json.loads((at / "run_status.json").read_text())["failed_stage"] == "audit_before"
        saved = audit.Progress(files / "out-bad" / ".checkpoint" / "before.json")
        assert saved.get("dedup_check") and not saved.get("class_distribution_report")
    finally:
        registry._found["class_distribution_report"] = old
    run.main(["--config", str(p), "--skip-benchmark"], spark)
    assert len(list((files / "out-bad" / "runs").iterdir())) == 1


def test_parallel_is_sequential(spark, files):
    from plumbline.config import load_config, merge
    from plumbline.plans import loading

    cfg = merge(load_config(str(write(files, "p"))), {"audit": {"checkpoint": False, **FEW}})
    train, test = loading.load_split(spark, cfg)
    a = audit.run_audit(spark, train, test, cfg)
    b = audit.run_audit(spark, train, test, merge(cfg, {"audit": {"parallel_checks": True}}))
    assert [(f["check"], f["status"]) for f in a] == [(f["check"], f["status"]) for f in b]
    assert [f["check"] for f in a] == [c for c in CHECKS if cfg["audit"][c]]


def test_every_bad_finding_has_advice():
    cfg = {"schema": {"drop_columns": ["z"], "id_like_columns": ["h", "k"], "timestamp_column": "t"}, "dataset": {}, "audit": {}}
    found = [{"check": c, "status": "flag", "summary": "", "details": {}} for c in CHECKS]
    covered = {c for r in advice.recommendations(found, cfg) for c in r["checks"]}
    assert covered == set(CHECKS)
    found = [{"check": "identity_column_flag", "status": "flag", "summary": "", "details": {"suggested_drop": ["h"]}}, {"check": "temporal_leakage_check", "status": "flag", "summary": "", "details": {"column": "t"}}, {"check": "data_integrity_check", "status": "flag", "summary": "", "details": {"missing_label_count": 2, "constant_features": ["q"]}}]
    recs = advice.recommendations(found, cfg)
    assert recs[0]["patch"]["schema"] == {"drop_columns": ["h", "q", "t", "z"], "id_like_columns": ["k"], "timestamp_column": None} and recs[1]["patch"] is None
    assert advice.apply({"schema": {"drop_columns": ["z"]}}, recs, ["drop_flagged_columns"])["schema"]["drop_columns"] == ["h", "q", "t", "z"]


def test_cards_escape_and_upgrade(tmp_path):
    f = [{"check": "dedup_check", "status": "flag", "summary": "<b>|", "details": {}}, {"check": "homogeneity_test", "status": "flag", "summary": "", "details": {}}, {"check": "resplit_falsification", "status": "flag", "summary": "", "details": {"drop": 1}}]
    card = report.build_scorecard(f, "before", {"dataset": {"name": "<i>"}}, {"train_content_hash": "0" * 64})
    assert "<b>|" not in report.page(card) and "<i>" not in report.page(card) and "\\|" in report.markdown(card) and "<svg" in report.chart(card)
    assert {r["check"]: r["before"]["evidence"] for r in card["checks"]}["homogeneity_test"] == "cross-corroborated"
    assert report.build_scorecard([], "before", {"dataset": {"name": "x"}}, {})["overall_status"] == "not_evaluated"
    assert report.upgrade({"overall_status": "failed", "findings": []})["overall_status"] == "review_required"
    assert [m["conclusion"]["status"] for m in report.manifest(f)] == ["material"]
    assert report.manifest([{"check": "repeated_seed_falsification_check", "status": "warning", "details": {"material": None}}])[0]["conclusion"]["status"] == "inconclusive"
    assert report.compare_runs(card, tmp_path) is None
