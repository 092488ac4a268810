"""Scans of CSV (plain, gz, bz2, xz, zip), Parquet and members of zip archives into one cleaned table.

The first file fixes the columns and which of them are numbers; later files are
aligned to it. Everything is read through Spark, so a path may be in any store Spark
reaches, a file or a folder of part files. Plain CSV and Parquet are split among tasks;
archives, xz, and a CSV whose quotes span lines cannot be split: each is one task's stream.

A CSV that is not valid UTF-8 is taken as Windows-1252; bytes that this leaves undefined
become U+FFFD.

ROW_ID numbers the rows from 0 in file order: by the file's place in the list, then by the
part file's path, then by the row's place in it. It is unique for any number of files and
partitions: rows are counted for each part file (for each split of a CSV), and a row's
number is the count before its split plus its place there.
"""

from __future__ import annotations

import csv
import io
import lzma
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType, StructType

from ..functions.exprs import nan_to_null
from ..functions.lineage import checkpoint
from ..operators.splits import sample_rows

ROW_ID = "__row_id"
#: Files and splits whose first row numbers are broadcast, 24 bytes each; more are joined by a shuffle.
MAX_BLOCKS = 1 << 20
#: Windows-1252 as the characters that ISO-8859-1 has for the bytes 0x80 to 0x9F (fixed values).
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def _parts(path: str) -> tuple[str, str | None]:
    archive, sep, member = path.partition("::")
    return archive, member if sep else None


def _is_parquet(name: str) -> bool:
    return name.lower().rstrip("/").endswith((".parquet", ".pq"))


def _bytes(archive: str, member: str | None, content: bytes) -> bytes:
    if archive.lower().endswith(".xz"):
        return lzma.decompress(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        if member is None and len(names) != 1:
            raise ValueError(f"{archive} holds {len(names)} files; name one as archive::member")
        return z.read(member or names[0])


def _blob(spark: SparkSession, archive: str) -> DataFrame:
    return spark.read.format("binaryFile").load(archive).select("path", "content")


def _packed_csv(spark: SparkSession, archive: str, member: str | None) -> DataFrame:
    """(fields, __file, __at) of the records of archived CSVs, quoted line breaks included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                raw = _bytes(archive, member, content)
                try:
                    raw.decode("utf-8")
                    encoding = "utf-8-sig"
                except UnicodeDecodeError:
                    encoding = "cp1252"
                rows: list[list[str | None]] = []
                at = 0
                for record in csv.reader(io.TextIOWrapper(io.BytesIO(raw), encoding=encoding, errors="replace", newline="")):
                    if record:
                        rows.append([x if x != "" else None for x in record])
                    if len(rows) == 4096:
                        yield _records(path, at, rows)
                        at, rows = at + len(rows), []
                if rows:
                    yield _records(path, at, rows)

    return _blob(spark, archive).mapInArrow(run, "fields array<string>, __file string, __at long")


def _records(path: str, at: int, rows: list[list[str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), pa.array([path] * len(rows)), pa.array(range(at, at + len(rows)), pa.int64())], names=["fields", "__file", "__at"])


def _packed_parquet(spark: SparkSession, archive: str, member: str | None) -> DataFrame:
    def schema(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"].to_pylist():
                s = pq.read_schema(io.BytesIO(_bytes(archive, member, content))).remove_metadata()
                yield pa.RecordBatch.from_arrays([pa.array([s.serialize().to_pybytes()], pa.binary())], names=["s"])

    from pyspark.sql.pandas.types import from_arrow_schema

    arrow = pa.ipc.read_schema(pa.py_buffer(_blob(spark, archive).mapInArrow(schema, "s binary").first()["s"]))
    kind = StructType([*from_arrow_schema(arrow).fields]).add("__file", "string").add("__at", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                at = 0
                for part in pq.ParquetFile(io.BytesIO(_bytes(archive, member, content))).iter_batches(8192):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([path] * n, pa.string()), pa.array(range(at, at + n), pa.int64())], names=[*part.schema.names, "__file", "__at"])
                    at += n

    return _blob(spark, archive).mapInArrow(run, kind)


def _named(path: str, columns: list[str], names: list[str]) -> list[str]:
    if names and len(names) != len(columns):
        raise ValueError(f"{path}: {len(columns)} columns, but column_names has {len(names)}")
    out = names or [c.strip() for c in columns]
    if twice := sorted({c for c in out if out.count(c) > 1}):
        raise ValueError(f"{path}: column names repeat: {twice}")
    return out


def _texts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """All columns of a CSV as text, with __file, __block and __at, which give a row's place."""
    archive, member = _parts(path)
    if member is not None or archive.lower().endswith((".zip", ".xz")):
        rows = _packed_csv(spark, archive, member)
        first = rows.where("__at = 0").orderBy("__file").select("fields").first()
        if first is None:
            raise ValueError(f"{path} is empty")
        given = _named(path, [str(x or f"_c{k}") for k, x in enumerate(first["fields"])], names)
        body = rows if names else rows.where("__at > 0")
        return body.select(*[F.get("fields", F.lit(k)).alias(f"c{k}") for k in range(len(given))], "__file", F.lit(0).cast("long"), "__at").toDF(*given, "__file", "__block", "__at")
    # raw lines, of which the bytes are as they are in the file
    lines = spark.read.text(path).agg(F.count_if(~F.is_valid_utf8("value")).alias("bad"), F.count_if((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1).alias("open")).first()
    reader = spark.read.option("header", not names).option("encoding", "iso-8859-1" if lines["bad"] else "utf-8").option("multiLine", lines["open"] > 0).option("escape", '"')
    df = reader.option("nullValue", "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    columns = [c.translate(str.maketrans(_C1, _CP1252)) if lines["bad"] else c for c in df.columns]
    given = _named(path, columns, names)
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        # the splits must be the same each time the file is read, also when executors come and go
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    texts = [F.translate(f"`{c}`", _C1, _CP1252) if lines["bad"] else F.col(f"`{c}`") for c in df.columns]
    return df.select(*texts, "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).toDF(*given, "__file", "__block", "__at")


def _numbered(df: DataFrame, start: int) -> tuple[DataFrame, int]:
    """The rows with ROW_ID from start on instead of their places, and the number after the last."""
    sizes = checkpoint(df.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__at").alias("low")))  # a row a split
    n_blocks, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    keep = [c for c in df.columns if c not in ("__file", "__block", "__at")]
    if n_blocks <= 1:
        low = sizes.first()["low"] if n_blocks else 0
        return df.select(*[F.col(f"`{c}`") for c in keep], (F.col("__at") - F.lit(low) + F.lit(start)).alias(ROW_ID)), start + total
    before = F.sum("n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("__file", "__block", (F.coalesce(before, F.lit(0)) - F.col("low") + F.lit(start)).alias("__base"))
    if n_blocks <= MAX_BLOCKS:
        bases = F.broadcast(bases)
    return df.join(bases, ["__file", "__block"]).select(*[F.col(f"`{c}`") for c in keep], (F.col("__at") + F.col("__base")).alias(ROW_ID)), start + total


def _read(spark: SparkSession, path: str, column_names: list[str] | None, start: int) -> tuple[DataFrame, int]:
    archive, member = _parts(path)
    if not _is_parquet(member or archive):
        return _numbered(_texts(spark, path, column_names or []), start)
    if member is not None:
        df = _packed_parquet(spark, archive, member).withColumn("__block", F.lit(0).cast("long"))
    else:
        df = spark.read.parquet(path)
        df = df.select(*df.columns, F.col("_metadata.file_path").alias("__file"), F.lit(0).cast("long").alias("__block"), F.col("_metadata.row_index").alias("__at"))
    out, end = _numbered(df, start)
    return nan_to_null(out), end


def read_file(spark: SparkSession, path: str, column_names: list[str] | None = None) -> DataFrame:
    """One file, or a folder of part files, with its row number in ROW_ID; the columns of a CSV are text."""
    return _read(spark, path, column_names, 0)[0]


def without_headers(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows that do not repeat the header: those in which some column does not hold its own name."""
    same = reduce(lambda a, b: a & b, [F.trim(F.col(f"`{c}`").cast("string")).eqNullSafe(F.lit(c)) for c in names])
    return df.where(~same)


def numeric_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of which every value present is a number, from one pass."""
    kinds = {f.name: f.dataType for f in df.schema}
    text = [c for c in names if isinstance(kinds[c], StringType)]
    out = {c for c in names if isinstance(kinds[c], NumericType)}
    if text:
        x = lambda c: F.trim(F.col(f"`{c}`"))
        row = df.agg(*[F.count_if(x(c).isNotNull() & as_number(x(c)).isNull()).alias(f"b{k}") for k, c in enumerate(text)], *[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(text)]).first()
        out |= {c for k, c in enumerate(text) if row[f"n{k}"] and not row[f"b{k}"]}
    return [c for c in names if c in out]


def as_number(c: Column) -> Column:
    """A double from text, infinities by any of their names; null where it is none, and where it is not a number."""
    low = F.lower(F.trim(c.cast("string")))
    plain = F.when(low.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?$"), low.try_cast("double"))
    return F.when(low.isin("inf", "+inf", "infinity", "+infinity"), float("inf")).when(low.isin("-inf", "-infinity"), float("-inf")).otherwise(plain)


def read_files(spark: SparkSession, paths: list[str], column_names: list[str] | None = None, downcast: bool = True, max_rows: int | None = None, seed: int = 0) -> DataFrame:
    """All files as one table in the first one's columns, cleaned, with ROW_ID.

    Rows that repeat the header or hold nothing are dropped. Numbers are doubles, then
    floats if downcast; other columns are text. With max_rows, exactly min(n, max_rows)
    rows are drawn, uniformly and the same for any partitioning.
    """
    if not paths:
        raise ValueError("no files to read")
    out: DataFrame | None = None
    names: list[str] = []
    numbers: set[str] = set()
    start = 0
    for path in paths:
        df, start = _read(spark, path, column_names, start)
        if out is None:
            names = [c for c in df.columns if c != ROW_ID]
        here = set(df.columns)
        df = df.select(*[F.col(f"`{c}`") if c in here else F.lit(None).cast("string").alias(c) for c in names], ROW_ID)
        df = without_headers(df, names)
        if out is None:
            numbers = set(numeric_columns(df, names))
        kind = FloatType() if downcast else DoubleType()
        typed = [(as_number(F.col(f"`{c}`")).cast(kind) if isinstance(df.schema[c].dataType, StringType) else F.col(f"`{c}`").try_cast("double").cast(kind)).alias(c) if c in numbers else F.col(f"`{c}`").cast("string").alias(c) for c in names]
        df = df.select(*typed, ROW_ID).na.drop(how="all", subset=names)
        out = df if out is None else out.unionByName(df)
    assert out is not None
    if max_rows is not None:
        out = sample_rows(out, max_rows, seed, ROW_ID)
    return nan_to_null(out)
