"""Column expressions that the checks share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, NumericType, StringType, StructType, TimestampType, VariantType

NESTED = (ArrayType, MapType, StructType, VariantType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def row_hash(*columns: str) -> Column:
    """64-bit hash of a row that tells (NULL, 1) from (1, NULL): xxhash64 skips nulls, so each value is wrapped with its presence."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in on))


def finite_or_zero(c: Column) -> Column:
    x = c.try_cast("double")
    return F.coalesce(F.when(F.abs(x) < float("inf"), x), F.lit(0.0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number is missing, as an empty field is."""
    return df.withColumns({f.name: F.when(F.isnan(f.name), None).otherwise(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (FloatType, DoubleType))})


def epoch(df: DataFrame, name: str) -> Column:
    """Seconds since 1970 of a timestamp or text column; a number is taken as it is. What does not parse is null."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, TimestampType) or kind.simpleString() in ("date", "timestamp_ntz"):
        return c.cast("timestamp").cast("double")
    if isinstance(kind, StringType):
        formats = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss")]
        return F.coalesce(F.coalesce(*formats).cast("double"), c.try_cast("double"))
    return c.cast("double")


def is_infinite(c: Column) -> Column:
    return F.abs(c) == float("inf")
