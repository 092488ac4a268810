"""Run configuration: defaults, merging, loading and validation.

Validation gathers every problem and raises them together as one ValueError.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from typing import Any

import yaml

# Names and defaults that a configuration file may rely on.
CLASSIFIERS = ("RandomForest", "XGBoost", "DecisionTree", "NaiveBayes", "LogisticRegression", "KNN", "SVM", "LDA", "Stacking", "Voting", "ExtraTrees", "HistGradientBoosting", "AdaBoost", "MLP")
UNTUNED = ("NaiveBayes", "Stacking", "Voting")
SAMPLING = ("none", "smote", "smoteenn", "enn", "random_undersample")
SCALING = ("none", "standard", "minmax", "robust")
ON_CHECKS = (
    "dedup_check", "label_conflict_check", "near_duplicate_class_check", "leakage_screen", "one_rule_check", "feature_auc_ranking_check", "identity_column_flag", "port_protocol_shortcut_check",
    "temporal_leakage_check", "temporal_realism_check", "flow_group_leakage_check", "row_order_leakage_check", "homogeneity_test", "resplit_falsification", "scenario_holdout_falsification",
    "class_distribution_report", "low_cardinality_warning", "schema_fingerprint_check", "data_integrity_check",
)
OFF_CHECKS = (
    "synthetic_realism_check", "cross_dataset_drift_check", "cross_capture_matrix_check", "feature_category_ablation_check", "artifact_sensitivity_check", "result_robustness_check", "known_issue_lookup",
    "seed_sensitivity_check", "repeated_seed_falsification_check",
)
CHECKS = ON_CHECKS + OFF_CHECKS
ONE_THRESHOLD = ("resplit_falsification", "cross_dataset_drift_check", "repeated_seed_falsification_check", "homogeneity_test")
TWO_THRESHOLDS = ("result_robustness_check", "cross_capture_matrix_check", "scenario_holdout_falsification", "feature_category_ablation_check")

DEFAULTS: dict[str, Any] = {
    "random_seed": 0,
    "dataset": {"name": None, "raw_files": [], "train_file": None, "test_file": None, "column_names": [], "split_ratio": 0.8, "split_mode": "random", "group_columns": [], "chunk_size": None, "max_rows": None},
    "schema": {"label_column": None, "attack_category_column": None, "drop_columns": [], "id_like_columns": [], "timestamp_column": None, "flow_id_columns": [], "scenario_column": None, "feature_categories": {}},
    "label_grouping": {"attack_type_mapping": {}},
    "preprocessing": {"dedup": True, "scaling": "standard", "sampling": {"binary": "none", "type": "none"}},
    "audit": {
        **dict.fromkeys(ON_CHECKS, True), **dict.fromkeys(OFF_CHECKS, False),
        "repeated_seed_count": 10, "reference_dataset": None, "materiality_thresholds": {}, "parallel_checks": False, "max_parallel_checks": 4, "checkpoint": False,
        # how the forests behind the model-based checks are grown
        "forest_trees": 100, "forest_depth": 10, "fit_rows": 200_000,
    },
    "classifiers": {"list": "all", "tuning": False, "calibration": "none", "hyperparameters": {}, "search_space": {}},
    "output": {"dir": "./output", "format": "parquet", "save_preprocessed": True, "keep_runs": 10, "write_scorecard_plot": False},
}


def merge(base: dict, patch: dict) -> dict:
    """base with the patch laid over it: mappings are merged, anything else, lists too, is replaced."""
    out = copy.deepcopy(base)
    for k, v in patch.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def _get(cfg: dict, path: str) -> Any:
    for k in path.split("."):
        cfg = cfg.get(k) if isinstance(cfg, dict) else None
    return cfg


def _whole(x: Any, least: int | None = None) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and (least is None or x >= least)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _names(x: Any) -> bool:
    return isinstance(x, list) and all(isinstance(c, str) for c in x)


def _one_or_some(allowed: tuple[str, ...]) -> Callable[[Any], bool]:
    return lambda x: (isinstance(x, str) and x in allowed) or (isinstance(x, list) and bool(x) and all(isinstance(c, str) and c in allowed for c in x))


def _optional(test: Callable[[Any], bool]) -> Callable[[Any], bool]:
    return lambda x: x is None or test(x)


_flag = lambda x: isinstance(x, bool)
_text = lambda x: isinstance(x, str) and bool(x)
_map = lambda x: isinstance(x, dict)

#: What each field must be, one rule a field.
RULES: list[tuple[str, Callable[[Any], bool], str]] = [
    ("random_seed", _whole, "must be an integer"),
    ("dataset.name", _text, "is required"),
    ("dataset.raw_files", _names, "must be a list of paths"),
    ("dataset.train_file", _optional(_text), "must be a path"),
    ("dataset.test_file", _optional(_text), "must be a path"),
    ("dataset.split_ratio", lambda x: _number(x) and 0 < x < 1, "must be a number between 0 and 1, both excluded"),
    ("dataset.split_mode", lambda x: x in ("random", "grouped"), "must be random or grouped"),
    ("dataset.group_columns", _names, "must be a list of column names"),
    ("dataset.column_names", lambda x: _names(x) and len(set(x)) == len(x), "must be a list of column names without repeats"),
    ("dataset.chunk_size", _optional(lambda x: _whole(x, 1)), "must be a positive integer"),
    ("dataset.max_rows", _optional(lambda x: _whole(x, 1)), "must be a positive integer"),
    ("schema.label_column", _text, "is required"),
    ("schema.attack_category_column", _optional(_text), "must be a column name"),
    ("schema.drop_columns", _names, "must be a list of column names"),
    ("schema.id_like_columns", _names, "must be a list of column names"),
    ("schema.timestamp_column", _optional(_text), "must be a column name"),
    ("schema.flow_id_columns", _names, "must be a list of column names"),
    ("schema.scenario_column", _optional(_text), "must be a column name"),
    ("schema.feature_categories", _map, "must map columns to categories"),
    ("label_grouping.attack_type_mapping", _map, "must map labels to labels"),
    ("preprocessing.dedup", _flag, "must be true or false"),
    ("preprocessing.scaling", _one_or_some(SCALING), f"must be one or a list of {', '.join(SCALING)}"),
    ("preprocessing.sampling.binary", _one_or_some(SAMPLING), f"must be one or a list of {', '.join(SAMPLING)}"),
    ("preprocessing.sampling.type", _one_or_some(SAMPLING), f"must be one or a list of {', '.join(SAMPLING)}"),
    *[(f"audit.{c}", _flag, "must be true or false") for c in CHECKS],
    ("audit.repeated_seed_count", lambda x: _whole(x, 1), "must be an integer of at least 1"),
    ("audit.reference_dataset", _optional(_text), "must be a path"),
    ("audit.materiality_thresholds", _map, "must map checks to thresholds"),
    ("audit.parallel_checks", _flag, "must be true or false"),
    ("audit.max_parallel_checks", lambda x: _whole(x, 1), "must be an integer of at least 1"),
    ("audit.checkpoint", _flag, "must be true or false"),
    ("audit.forest_trees", lambda x: _whole(x, 1), "must be an integer of at least 1"),
    ("audit.forest_depth", lambda x: _whole(x, 1) and x <= 30, "must be an integer from 1 to 30"),
    ("audit.fit_rows", lambda x: _whole(x, 1), "must be an integer of at least 1"),
    ("classifiers.list", lambda x: x == "all" or (_names(x) and set(x) <= set(CLASSIFIERS)), f"must be all or a list of {', '.join(CLASSIFIERS)}"),
    ("classifiers.tuning", _flag, "must be true or false"),
    ("classifiers.calibration", lambda x: x in ("none", "platt", "isotonic"), "must be none, platt or isotonic"),
    ("classifiers.hyperparameters", lambda x: _map(x) and set(x) <= set(CLASSIFIERS), "must map known classifiers to parameters"),
    ("classifiers.search_space", lambda x: _map(x) and set(x) <= set(CLASSIFIERS) - set(UNTUNED), "must map classifiers that can be tuned to lists of values"),
    ("output.dir", _text, "must be a path"),
    ("output.format", lambda x: x in ("parquet", "csv"), "must be parquet or csv"),
    ("output.save_preprocessed", _flag, "must be true or false"),
    ("output.keep_runs", _optional(lambda x: _whole(x, 1)), "must be a positive integer"),
    ("output.write_scorecard_plot", _flag, "must be true or false"),
]


def _relations(cfg: dict) -> Iterator[str]:
    """Problems between fields."""
    data, audit = cfg["dataset"], cfg["audit"]
    pair = bool(data["train_file"]) and bool(data["test_file"])
    if bool(data["raw_files"]) == pair or (data["raw_files"] and (data["train_file"] or data["test_file"])):
        yield "dataset: give either raw_files, or train_file and test_file"
    if data["split_mode"] == "grouped" and not data["group_columns"]:
        yield "dataset.split_mode: grouped needs group_columns"
    if data["split_mode"] == "grouped" and _number(data["split_ratio"]) and 0 < data["split_ratio"] < 1 and round(1 / (1 - data["split_ratio"])) < 2:
        yield "dataset.split_ratio: a grouped split of this ratio has fewer than two folds"
    if data["max_rows"] is not None and data["chunk_size"] is None:
        yield "dataset.max_rows needs chunk_size"
    if cfg["label_grouping"]["attack_type_mapping"] and not cfg["schema"]["attack_category_column"]:
        yield "label_grouping.attack_type_mapping needs schema.attack_category_column"
    for c in ("synthetic_realism_check", "cross_dataset_drift_check"):
        if audit[c] is True and not audit["reference_dataset"]:
            yield f"audit.{c} needs audit.reference_dataset"
    if audit["repeated_seed_falsification_check"] is True and not (data["raw_files"] and data["group_columns"]):
        yield "audit.repeated_seed_falsification_check needs dataset.raw_files and dataset.group_columns"
    if audit["checkpoint"] is True and audit["parallel_checks"] is True:
        yield "audit.checkpoint and audit.parallel_checks exclude each other"
    for check, t in (audit["materiality_thresholds"] or {}).items() if isinstance(audit["materiality_thresholds"], dict) else ():
        if check in ONE_THRESHOLD:
            if not _number(t):
                yield f"audit.materiality_thresholds.{check} must be a number"
        elif check in TWO_THRESHOLDS:
            if not (isinstance(t, dict) and set(t) == {"warning", "flag"} and all(map(_number, t.values())) and t["warning"] < t["flag"]):
                yield f"audit.materiality_thresholds.{check} must be {{warning: x, flag: y}} with x below y"
        else:
            yield f"audit.materiality_thresholds.{check}: this check has no threshold to set"


def problems(cfg: dict) -> list[str]:
    out = [f"{k}: not a section" for k in cfg if k not in DEFAULTS]
    for section, default in DEFAULTS.items():
        if isinstance(default, dict) and not isinstance(cfg.get(section), dict):
            out.append(f"{section} must be a mapping")
    if out:
        return out
    out = [f"{path} {what}" for path, test, what in RULES if not test(_get(cfg, path))]
    return out + list(_relations(cfg))


def validate(cfg: dict) -> None:
    if found := problems(cfg):
        raise ValueError("invalid configuration:\n" + "\n".join(f"- {x}" for x in found))


def resolve(user: dict | None) -> dict:
    """A full, valid configuration from a partial one. The resplit check is on by default and steps aside by itself where it cannot run."""
    cfg = merge(DEFAULTS, user or {})
    validate(cfg)
    return cfg


def load_config(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return resolve(yaml.safe_load(f))
    except FileNotFoundError as e:
        raise ValueError(f"there is no configuration file at {path}") from e


def threshold(cfg: dict, check: str, default: Any) -> Any:
    return cfg["audit"]["materiality_thresholds"].get(check, default)
