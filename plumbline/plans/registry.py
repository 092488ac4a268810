"""What a check is, and the table of all checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

from ..config import CHECKS
from ..functions.exprs import NESTED
from ..sources.reading import ROW_ID

OK, WARNING, FLAG, NOT_APPLICABLE = "ok", "warning", "flag", "not_applicable"


@dataclass
class Subject:
    """The data under audit and how its columns are to be read.

    raw is called for the unsplit data, by the checks that split it anew; it is None for
    data that came split. progress saves and gives back what a long check has done.
    """

    train: DataFrame
    test: DataFrame
    cfg: dict
    raw: Callable[[], DataFrame] | None = None
    reference: Callable[[], DataFrame] | None = None
    progress: Any = None
    row_id: str = ROW_ID
    _features: list[str] = field(default_factory=list)

    @property
    def label(self) -> str:
        return self.cfg["schema"]["label_column"]

    @property
    def cls(self) -> str:
        """The column that by-class results are grouped by."""
        c = self.cfg["schema"]["attack_category_column"]
        return c if c and c in self.train.columns else self.label

    @property
    def features(self) -> list[str]:
        return feature_columns(self.train, self.cfg)

    @property
    def numeric(self) -> list[str]:
        kinds = {f.name: f.dataType for f in self.train.schema}
        return [c for c in self.features if isinstance(kinds[c], NumericType)]

    @property
    def ids(self) -> list[str]:
        return [c for c in self.cfg["schema"]["id_like_columns"] if c in self.train.columns]

    @property
    def seed(self) -> int:
        return self.cfg["random_seed"]


def feature_columns(df: DataFrame, cfg: dict) -> list[str]:
    """All columns but the label, the category, those to drop, hidden ones and nested ones."""
    s = cfg["schema"]
    skip = {*s["drop_columns"], s["label_column"], s["attack_category_column"]}
    return [f.name for f in df.schema if f.name not in skip and not f.name.startswith("__") and not isinstance(f.dataType, NESTED)]


def finding(check: str, status: str, summary: str, **details: Any) -> dict:
    return {"check": check, "status": status, "summary": summary, "details": details}


@dataclass(frozen=True)
class Check:
    name: str
    run: Callable[[Subject], dict]
    #: Its answer cannot depend on whether duplicates were dropped.
    structural: bool
    #: What its verdict rests on: documented, direct-experiment or statistical.
    evidence: str
    #: One sentence on what is measured and when it flags.
    about: str
    #: Details of a flag or warning that name columns which had better be dropped.
    suspects: tuple[str, ...] = ()
    #: What it does to the data to see whether a result holds, if it is such an experiment.
    changes: str = ""


_found: dict[str, Check] = {}


def check(name: str, about: str, structural: bool = False, evidence: str = "statistical", **more: Any) -> Callable[[Callable[[Subject], dict]], Callable[[Subject], dict]]:
    def add(run: Callable[[Subject], dict]) -> Callable[[Subject], dict]:
        _found[name] = Check(name, run, structural, evidence, about, **more)
        return run

    return add


def suspected(found: dict) -> list[str]:
    """Columns that a flag or warning blames, in the order of the details that its check declares."""
    known = checks().get(found["check"])
    if known is None or found["status"] not in (FLAG, WARNING):
        return []
    named = [found["details"].get(k) or () for k in known.suspects]
    return [c for x in named for c in ((x,) if isinstance(x, str) else x)]


def outcome(found: dict) -> str:
    """What an experiment says of a result: its own word if it gives one, else what its status amounts to."""
    matters = found["details"].get("material", {FLAG: True, OK: False}.get(found["status"]))
    return "inconclusive" if matters is None else "material" if matters else "investigated_not_material"


def checks() -> dict[str, Check]:
    """All checks in their fixed order."""
    from . import lookup_checks, model_checks, table_checks  # noqa: F401  they register themselves

    return {c: _found[c] for c in CHECKS if c in _found} | {c: x for c, x in _found.items() if c not in CHECKS}
