"""Dropping repeated rows: those of train, then test rows that train has, then those that repeat within test."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import relational
from .registry import feature_columns


def deduplicated(train: DataFrame, test: DataFrame, keys: list[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """The first row of every key; labels are not compared."""
    if not keys:
        return train, test
    return relational.keep_first(train, keys, row_id), relational.keep_first(relational.without_matches(test, train, keys), keys, row_id)


def dedup(train: DataFrame, test: DataFrame, cfg: dict, row_id: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    keys = feature_columns(train, cfg)
    stats = {k: int(v) for k, v in relational.duplicate_stats(train, test, keys).first().asDict().items()}
    return (*deduplicated(train, test, keys, row_id), stats)
