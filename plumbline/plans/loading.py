"""From a configuration to a train and a test table, with a cache of what was loaded, and the tables written out again."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import VERSION
from ..operators import relational, splits
from ..sources.reading import ROW_ID, read_files
from .registry import feature_columns


def read_raw(spark: SparkSession, cfg: dict) -> DataFrame:
    """The unsplit data of dataset.raw_files, labels grouped."""
    d = cfg["dataset"]
    return group_labels(read_files(spark, d["raw_files"], d["column_names"], max_rows=d["max_rows"], seed=cfg["random_seed"]), cfg)


def read_reference(spark: SparkSession, cfg: dict) -> DataFrame:
    d = cfg["dataset"]
    return read_files(spark, [cfg["audit"]["reference_dataset"]], d["column_names"], max_rows=d["max_rows"], seed=cfg["random_seed"])


def group_labels(df: DataFrame, cfg: dict) -> DataFrame:
    column = cfg["schema"]["attack_category_column"]
    mapping = cfg["label_grouping"]["attack_type_mapping"]
    return relational.map_labels(df, column, mapping) if mapping and column in df.columns else df


def split(raw: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame]:
    d, label = cfg["dataset"], cfg["schema"]["label_column"]
    if label not in raw.columns:
        raise ValueError(f"the data has no label column {label}")
    if d["split_mode"] == "grouped":
        train, test = splits.grouped_split(raw, label, d["group_columns"], d["split_ratio"], cfg["random_seed"])
        if n := splits.shared_groups(train, test, d["group_columns"]):
            raise RuntimeError(f"{n} groups are on both sides of a grouped split")
        return train, test
    train, test = splits.stratified_split(raw, label, d["split_ratio"], cfg["random_seed"], ROW_ID)
    # the rows of a random split are in random order
    return tuple(df.withColumn(ROW_ID, splits.shuffled(cfg["random_seed"], ROW_ID)) for df in (train, test))  # type: ignore[return-value]


def load_split(spark: SparkSession, cfg: dict) -> tuple[DataFrame, DataFrame]:
    d = cfg["dataset"]
    if d["raw_files"]:
        return split(read_raw(spark, cfg), cfg)
    sides = [group_labels(read_files(spark, [d[k]], d["column_names"], max_rows=d["max_rows"], seed=cfg["random_seed"]), cfg) for k in ("train_file", "test_file")]
    return sides[0], sides[1]


def validate_loaded(train: DataFrame, test: DataFrame, cfg: dict) -> None:
    """Raises one ValueError with everything that makes an audit impossible."""
    s, bad = cfg["schema"], []
    for side, df in (("train", train), ("test", test)):
        if repeated := sorted(c for c, n in Counter(df.columns).items() if n > 1):
            bad.append(f"{side} has several columns named {', '.join(repeated)}")
        elif df.isEmpty():
            bad.append(f"{side} has no rows")
        bad += [f"{side} has no column {s[k]} (schema.{k})" for k in ("label_column", "attack_category_column") if s[k] and s[k] not in df.columns]
    if not bad and not set(feature_columns(train, cfg)) & set(feature_columns(test, cfg)):
        bad.append("train and test share no feature column")
    if bad:
        raise ValueError("the data cannot be audited:\n" + "\n".join(f"- {x}" for x in bad))


def _stamp(spark: SparkSession, path: str) -> list:
    """Size and time of each file behind a path, from its own file system."""
    archive = path.partition("::")[0]
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(archive)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p) or []
    return sorted([x.getPath().toString(), x.getLen(), x.getModificationTime()] for x in found) or [[path, 0, 0]]


def cache_key(spark: SparkSession, cfg: dict) -> str:
    d = cfg["dataset"]
    files = [*d["raw_files"], *[d[k] for k in ("train_file", "test_file") if d[k]]]
    what = [[_stamp(spark, f) for f in files], cfg["random_seed"], d, cfg["schema"]["label_column"], cfg["schema"]["attack_category_column"], cfg["label_grouping"], VERSION]
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


def load_cached(spark: SparkSession, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """load_split and validate_loaded, written under output.dir once and read from there as long as nothing it rests on changes."""
    folder = Path(cfg["output"]["dir"]) / ".cache"
    mark, key = folder / "manifest.json", cache_key(spark, cfg)
    try:
        fresh = json.loads(mark.read_text())["key"] == key
    except (OSError, ValueError, KeyError):
        fresh = False
    paths = [str(folder / f"{side}.parquet") for side in ("train", "test")]
    if not fresh:
        train, test = load_split(spark, cfg)
        validate_loaded(train, test, cfg)
        mark.unlink(missing_ok=True)
        for df, p in zip((train, test), paths, strict=True):
            df.write.mode("overwrite").parquet(p)
        mark.parent.mkdir(parents=True, exist_ok=True)
        mark.write_text(json.dumps({"key": key}))
    return spark.read.parquet(paths[0]), spark.read.parquet(paths[1])


def write_tables(train: DataFrame, test: DataFrame, folder: Path, kind: str) -> None:
    """Both sides without hidden columns, each a folder of part files."""
    for name, df in (("train", train), ("test", test)):
        out = df.select(*[c for c in df.columns if not c.startswith("__")]).write.mode("overwrite")
        path = str(folder / f"{name}.{kind}")
        out.parquet(path) if kind == "parquet" else out.option("header", True).csv(path)


def fingerprint(train: DataFrame, test: DataFrame, cfg: dict) -> dict:
    """Rows, columns, classes and content digests of both sides. The digests are of the rows as multisets."""
    label = cfg["schema"]["label_column"]
    columns = [c for c in train.columns if not c.startswith("__")]
    out: dict = {"columns": columns, "feature_count": len(feature_columns(train, cfg)), "numeric_columns": [f.name for f in train.schema if isinstance(f.dataType, NumericType) and f.name in columns]}
    for side, df in (("train", train), ("test", test)):
        own = [c for c in df.columns if not c.startswith("__")]
        out[f"{side}_rows"] = df.count()
        out[f"{side}_class_distribution"] = {str(r["cls"]): r["n"] for r in relational.class_counts(df, label).orderBy(F.desc("n"), "cls").collect()}
        out[f"{side}_content_hash"] = relational.content_hash(df, own)
    return out


def source_digests(spark: SparkSession, cfg: dict) -> dict[str, str]:
    """SHA-256 of each source file, computed where Spark reads it; folders are left out."""
    d, out = cfg["dataset"], {}
    for path in [*d["raw_files"], *[d[k] for k in ("train_file", "test_file") if d[k]]]:
        archive = path.partition("::")[0]
        if len(_stamp(spark, archive)) == 1 and _stamp(spark, archive)[0][1] < 1 << 31:
            row = spark.read.format("binaryFile").load(archive).where("length < 2147483647").select(F.sha2("content", 256).alias("h")).first()
            if row is not None:
                out[path] = row["h"]
    return out
