import pytest
import yaml

from plumbline import config

GOOD = {"dataset": {"name": "x", "raw_files": ["a.csv"]}, "schema": {"label_column": "y"}}


def test_defaults_fill_in():
    cfg = config.resolve(GOOD)
    assert cfg["dataset"]["split_ratio"] == 0.8 and sum(cfg["audit"][c] for c in config.CHECKS) == 19


def test_all_problems_at_once():
    with pytest.raises(ValueError) as e:
        config.resolve({"dataset": {"split_ratio": 2, "raw_files": ["a"], "train_file": "b"}, "output": {"format": "xml"}})
    for part in ("dataset.name", "split_ratio", "label_column", "output.format", "raw_files"):
        assert part in str(e.value)


@pytest.mark.parametrize(
    ("patch", "what"),
    [
        ({"random_seed": True}, "random_seed"), ({"dataset": {"max_rows": 5}}, "max_rows"), ({"dataset": {"split_mode": "grouped"}}, "group_columns"), ({"preprocessing": {"scaling": []}}, "scaling"),
        ({"preprocessing": {"sampling": {"binary": ["smote", "x"]}}}, "sampling.binary"), ({"audit": {"synthetic_realism_check": True}}, "reference_dataset"), ({"audit": {"checkpoint": True, "parallel_checks": True}}, "exclude"),
        ({"audit": {"materiality_thresholds": {"dedup_check": 1}}}, "no threshold"), ({"audit": {"materiality_thresholds": {"homogeneity_test": "x"}}}, "a number"),
        ({"audit": {"materiality_thresholds": {"result_robustness_check": {"warning": 2, "flag": 1}}}}, "below"), ({"classifiers": {"list": ["Nope"]}}, "classifiers.list"), ({"label_grouping": {"attack_type_mapping": {"a": "b"}}}, "attack_category_column"),
        ({"extra": 1}, "not a section"), ({"audit": {"repeated_seed_falsification_check": True}}, "group_columns"), ({"dataset": {"column_names": ["a", "a"]}}, "column_names"), ({"audit": []}, "mapping"),
    ],
)
def test_each_rule(patch, what):
    with pytest.raises(ValueError, match=what):
        config.resolve(config.merge(GOOD, patch))


def test_lists_are_replaced():
    assert config.merge({"a": {"b": [1, 2], "c": 1}}, {"a": {"b": [3]}}) == {"a": {"b": [3], "c": 1}}


def test_files(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text(yaml.safe_dump(GOOD))
    assert config.load_config(str(p))["dataset"]["name"] == "x"
    with pytest.raises(ValueError, match="no configuration file"):
        config.load_config(str(tmp_path / "none.yaml"))
