"""Runs the enabled checks over a train and a test table: in order, several at once, or resumed from what an earlier run saved."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Collection
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from ..sources.reading import ROW_ID
from . import loading
from .registry import Check, Subject, checks


class Progress:
    """Findings, and the seeds that a repeated check is through with, in one small JSON file that is replaced as a whole."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)

    def read(self) -> dict:
        try:
            return json.loads(self.path.read_text())
        except (OSError, ValueError):
            return {}

    def _write(self, data: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_name(self.path.name + ".part")
        part.write_text(json.dumps(data, default=str))
        os.replace(part, self.path)

    def get(self, check: str) -> dict | None:
        return self.read().get("checks", {}).get(check)

    def save(self, check: str, finding: dict) -> None:
        data = self.read()
        data.setdefault("checks", {})[check] = finding
        self._write(data)

    def get_seeds(self, check: str) -> dict[int, float]:
        return {int(k): v for k, v in self.read().get("partial", {}).get(check, {}).get("drops_by_seed", {}).items()}

    def save_seed(self, check: str, seed: int, drop: float) -> None:
        data = self.read()
        data.setdefault("partial", {}).setdefault(check, {"drops_by_seed": {}})["drops_by_seed"][str(seed)] = drop
        self._write(data)

    def clear(self) -> None:
        self.path.unlink(missing_ok=True)


def enabled(cfg: dict, skip: Collection[str] = ()) -> list[Check]:
    return [c for name, c in checks().items() if cfg["audit"].get(name) is True and name not in skip]


def _raw_reader(spark: SparkSession, cfg: dict) -> tuple[Callable[[], DataFrame] | None, Callable[[], None]]:
    """The unsplit data, read and stored once for all the checks that split it anew."""
    if not cfg["dataset"]["raw_files"]:
        return None, lambda: None
    held: list[DataFrame] = []

    def read() -> DataFrame:
        if not held:
            held.append(loading.read_raw(spark, cfg).persist(StorageLevel.MEMORY_AND_DISK))
        return held[0]

    return read, lambda: [df.unpersist() for df in held] and None


def run_audit(spark: SparkSession, train: DataFrame, test: DataFrame, cfg: dict, skip: Collection[str] = (), progress: Progress | None = None, row_id: str = ROW_ID) -> list[dict]:
    """Findings of the enabled checks in their fixed order. The first error of a check goes up."""
    todo = enabled(cfg, skip)
    raw, release = _raw_reader(spark, cfg)
    reference = (lambda: loading.read_reference(spark, cfg)) if cfg["audit"]["reference_dataset"] else None
    subject = Subject(train, test, cfg, raw, reference, progress, row_id)

    def run(c: Check) -> dict:
        done = progress.get(c.name) if progress else None
        if done is None:
            done = c.run(subject)
            if progress:
                progress.save(c.name, done)
        return done

    for df in (train, test):
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if cfg["audit"]["parallel_checks"]:
            if raw:
                raw()  # before any two checks could both start to read it
            with ThreadPoolExecutor(min(cfg["audit"]["max_parallel_checks"], max(1, len(todo)))) as pool:
                return list(pool.map(run, todo))
        return [run(c) for c in todo]
    finally:
        for df in (train, test):
            df.unpersist()
        release()


def structural() -> set[str]:
    return {c.name for c in checks().values() if c.structural}


def again(before: list[dict], recomputed: list[dict]) -> list[dict]:
    """The findings after deduplication: structural ones as before, the others as recomputed, in the order they had."""
    new, keep = {f["check"]: f for f in recomputed}, structural()
    return [f if f["check"] in keep else new[f["check"]] for f in before]
