"""The command line: run, cite, validate-config, compare-datasets, recommend and dashboard."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from ..config import load_config
from ..session import session
from . import advice, audit, benchmark, dashboard, loading, report
from .dedup import dedup
from .registry import Subject  # noqa: F401  part of the interface

log = logging.getLogger("plumbline")
COMMANDS = ("run", "cite", "validate-config", "compare-datasets", "recommend", "dashboard")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description="Audits a labelled table and benchmarks classifiers on it.")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="audit and benchmark the data of a configuration")
    run.add_argument("--config", required=True)
    run.add_argument("--skip-audit", action="store_true")
    run.add_argument("--skip-benchmark", action="store_true")
    cite = sub.add_parser("cite", help="a citation of a finished run")
    cite.add_argument("run_dir")
    valid = sub.add_parser("validate-config", help="look for mistakes without loading data")
    valid.add_argument("--config", required=True)
    compare = sub.add_parser("compare-datasets", help="whether two configurations load the same rows")
    compare.add_argument("config_a")
    compare.add_argument("config_b")
    compare.add_argument("--json", action="store_true", help="the comparison as one line of JSON")
    dash = sub.add_parser("dashboard", help="a web page over finished runs, on this machine")
    dash.add_argument("--output", action="append", default=[], help="an output folder whose runs are shown; may be repeated")
    dash.add_argument("--config", help="what a new run starts from")
    dash.add_argument("--host", default="127.0.0.1")
    dash.add_argument("--port", type=int, default=8765)
    dash.add_argument("--no-browser", action="store_true")
    rec = sub.add_parser("recommend", help="changes to the configuration that a finished run suggests")
    rec.add_argument("run_dir")
    rec.add_argument("--config", help="apply to this file instead of the run's full configuration")
    rec.add_argument("--apply", action="store_true")
    rec.add_argument("--output")
    return p


def run(spark: SparkSession, cfg: dict, skip_audit: bool = False, skip_benchmark: bool = False) -> Path:
    """A whole run; returns its folder. An error is noted in run_status.json and goes up."""
    output = Path(cfg["output"]["dir"])
    output.mkdir(parents=True, exist_ok=True)
    train, test = loading.load_cached(spark, cfg)
    at = report.new_run(output)
    report.write_json(at / "environment.json", report.environment())
    report.write_json(at / "resolved_config.json", cfg)
    prints = loading.fingerprint(train, test, cfg) | {"source_sha256": loading.source_digests(spark, cfg)}
    report.write_json(at / "dataset_fingerprint.json", prints)
    keep = {k: audit.Progress(output / ".checkpoint" / f"{k}.json") if cfg["audit"]["checkpoint"] else None for k in ("before", "after")}
    stage = "audit_before"
    try:
        before = after = None
        if not skip_audit:
            before = audit.run_audit(spark, train, test, cfg, progress=keep["before"])
            report.write_json(at / "audit_report_before.json", before)
        if cfg["preprocessing"]["dedup"]:
            stage = "dedup"
            train, test, stats = dedup(train, test, cfg, loading.ROW_ID)
            log.info("duplicates: %s", stats)
            # what follows reads the result many times
            for name, df in (("train", train), ("test", test)):
                df.write.mode("overwrite").parquet(str(output / ".cache" / f"{name}-deduped.parquet"))
            train, test = (spark.read.parquet(str(output / ".cache" / f"{n}-deduped.parquet")) for n in ("train", "test"))
            if before is not None:
                stage = "audit_after"
                after = audit.again(before, audit.run_audit(spark, train, test, cfg, skip=audit.structural(), progress=keep["after"]))
                report.write_json(at / "audit_report_after.json", after)
        if before is not None:
            stage = "scorecard"
            final = after if after is not None else before
            if changed := report.manifest(final):
                report.write_json(at / "intervention_manifest.json", changed)
            card = report.build_scorecard(final, "after" if after is not None else "before", cfg, prints, before)
            last = report.previous(output, at)
            if last is not None and (drift := report.compare_runs(card, last)) is not None:
                card["previous_run_comparison"] = drift
            report.write_json(at / "scorecard.json", card)
            (at / "SCORECARD.md").write_text(report.markdown(card))
            (at / "SCORECARD.html").write_text(report.page(card))
            if cfg["output"]["write_scorecard_plot"]:
                (at / "scorecard.svg").write_text(report.chart(card))
            log.info("verdict: %s", card["overall_status"])
        if cfg["output"]["save_preprocessed"]:
            stage = "save_preprocessed"
            loading.write_tables(train, test, at, cfg["output"]["format"])
        if not skip_benchmark:
            stage = "benchmark"
            rows, extras = benchmark.run_benchmark(spark, train, test, cfg)
            benchmark.write(rows, extras, at)
        report.status(at, "completed")
        for p in keep.values():
            if p is not None:
                p.clear()
    except Exception as e:
        report.status(at, "failed", stage, str(e))
        raise
    finally:
        report.prune(output, cfg["output"]["keep_runs"])
    return at


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(name)s: %(message)s")
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] not in ([c] for c in (*COMMANDS, "-h", "--help")):
        argv = ["run", *argv]
    a = parser().parse_args(argv)
    if a.command == "cite":
        card = report.load_scorecard(a.run_dir)
        print(report.bibtex(card), report.citation(card), sep="\n\n")
    elif a.command == "validate-config":
        load_config(a.config)
        print(f"{a.config}: valid")
    elif a.command == "dashboard":
        dashboard.serve(a.output, a.config, a.host, a.port, not a.no_browser)
    elif a.command == "recommend":
        found, cfg = advice.for_run(a.run_dir)
        print(advice.text(found))
        if a.apply:
            base = yaml.safe_load(Path(a.config).read_text()) if a.config else cfg
            new = yaml.safe_dump(advice.apply(base, found, [r["id"] for r in found]), sort_keys=False)
            Path(a.output).write_text(new) if a.output else print(new)
    else:
        spark = spark or session()
        if a.command == "compare-datasets":
            found = report.compare_datasets(spark, a.config_a, a.config_b)
            print(json.dumps(found) if a.json else report.comparison_text(found))
        else:
            print(run(spark, load_config(a.config), a.skip_audit, a.skip_benchmark))
