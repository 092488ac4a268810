"""A training-data pipeline over documents: each stage's result is written as Parquet and read again by the next.

toxicity drops documents that score 0.3 or more; line_dedup cuts passages that repeat
earlier ones, and near copies whole (a document cut empty stays, for the next stage to
gather); simhash keeps one document of each group of near copies; decontamination drops
documents that hold a whole window of a benchmark item; bpe encodes what is left and
decodes it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import shared_folder
from plumbline.llm import bpe, decontam, linededup, simhash, toxicity
from plumbline.llm.common import free_name, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = linededup.deduplicate(docs, whole=linededup.WHOLE)
    if "n_chars" in docs.columns:  # of what was cut, if the documents carry it
        n_chars = F.when(F.col(linededup.added(docs)[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", n_chars)
    return cut.select(*docs.columns)


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # an item of a few common words proves nothing; one of a whole window does
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), least=decontam.WINDOW)
    return out.where(F.col(free_name(docs, "n_hit")) == 0).select(*docs.columns)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [("toxicity", _toxicity), ("line_dedup", _line_dedup), ("simhash", _simhash), ("decontamination", _decontamination), ("bpe", _bpe)]

#: The first stage learns a classifier and the second cuts by hashes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Parquet between stages goes to the shared folder of spark.checkpoint.dir, and is deleted when the next one is written."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:  # nothing reads it any more
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = at
    return docs
