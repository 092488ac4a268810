"""Feature vectors and random forests for the checks that refit a model.

A fit reads at most `fit_rows` rows, drawn exactly and seeded; every row of the test
side is scored. Values that are not numbers become codes of a dictionary made on the
fit rows alone, so it has no more entries than those; a value it lacks takes the code
of the most frequent one, the branch that most training rows went down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.exprs import finite_or_zero, is_numeric
from .splits import sample_rows

#: Partitions of the rows of a fit.
FIT_PARTS = 16


@dataclass
class Encoder:
    """Turns the columns into a vector, and labels into class numbers in order of the labels."""

    columns: list[str]
    dictionaries: dict[str, DataFrame]
    classes: list[str]
    label: str
    unseen: str = "common"

    def __call__(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """label (text), y (class number, null for an unknown class), features, and the columns to keep."""
        out = df
        for k, (c, table) in enumerate(self.dictionaries.items()):
            out = out.join(F.broadcast(table.select(F.col("v").alias(f"__v{k}"), F.col("code").alias(f"__c{k}"))), F.col(c).cast("string") == F.col(f"__v{k}"), "left")  # at most fit_rows values
        names = list(self.dictionaries)
        default = F.lit(0.0 if self.unseen == "common" else -1.0)
        cols = [(F.coalesce(F.col(f"__c{names.index(c)}"), default) if c in names else finite_or_zero(F.col(c))).alias(f"__f{k}") for k, c in enumerate(self.columns)]
        number = F.create_map(*[F.lit(x) for k, c in enumerate(self.classes) for x in (c, float(k))]) if self.classes else F.create_map(F.lit(""), F.lit(0.0))
        label = F.col(self.label).cast("string")
        rows = out.select(*(keep or []), label.alias("__label"), F.try_element_at(number, label).alias("y"), *cols)
        made = VectorAssembler(inputCols=[f"__f{k}" for k in range(len(self.columns))], outputCol="features").transform(rows)
        return made.drop(*[f"__f{k}" for k in range(len(self.columns))])


def fit_encoder(fit_rows: DataFrame, columns: list[str], label: str, unseen: str = "common") -> Encoder:
    """Dictionaries number the values by falling frequency from 0. fit_rows must be a bounded sample."""
    spark = fit_rows.sparkSession
    tables = {}
    for c in columns:
        if not is_numeric(fit_rows, c):
            values = fit_rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").select("v").toPandas()["v"].tolist()
            tables[c] = spark.createDataFrame([(v, float(k)) for k, v in enumerate(values)], "v string, code double")
    classes = [r[0] for r in fit_rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("y")).distinct().orderBy("y").collect()]  # one row a class
    return Encoder(columns, tables, classes, label, unseen)


@dataclass
class Forest:
    encoder: Encoder
    model: Transformer | None  # None where only one class was there to learn

    def scored(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """(keep, __label, y, prediction, probability)"""
        rows = self.encoder(df, keep)
        if self.model is None:
            from pyspark.ml.functions import array_to_vector

            return rows.withColumns({"prediction": F.lit(0.0), "probability": array_to_vector(F.array(F.lit(1.0)))}).drop("features")
        return self.model.transform(rows).drop("rawPrediction", "features")

    def accuracy(self, df: DataFrame) -> float:
        """Share of df's rows whose label is predicted; a label that training lacked is never predicted."""
        hit = F.coalesce(F.col("y") == F.col("prediction"), F.lit(False)).cast("double")
        return float(self.scored(df).agg(F.avg(hit)).first()[0] or 0.0)

    @property
    def importances(self) -> list[float]:
        return [float(x) for x in self.model.featureImportances] if self.model is not None else [0.0] * len(self.encoder.columns)


def fit_forest(train: DataFrame, columns: list[str], label: str, cfg: dict, row_id: str, seed: int, trees: int | None = None, unseen: str = "common") -> Forest:
    a = cfg["audit"]
    known = train.where(F.col(label).isNotNull())
    drawn = sample_rows(known.select(*dict.fromkeys([*columns, label, row_id])), a["fit_rows"], seed, row_id)
    # bootstraps go by partition: the same few for any partitioning of the table, however many files it has
    rows = drawn.repartition(FIT_PARTS, row_id).sortWithinPartitions(row_id).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        encoder = fit_encoder(rows, columns, label, unseen)
        if len(encoder.classes) < 2 or not columns:
            return Forest(encoder, None)
        forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees or a["forest_trees"], maxDepth=a["forest_depth"], maxBins=64, minInstancesPerNode=1, seed=seed)
        return Forest(encoder, forest.fit(encoder(rows).where("y is not null")))
    finally:
        rows.unpersist()


def fit_and_score(train: DataFrame, test: DataFrame, columns: list[str], label: str, cfg: dict, row_id: str, seed: int) -> float:
    return fit_forest(train, columns, label, cfg, row_id, seed).accuracy(test)


def told(scored: DataFrame) -> DataFrame:
    """(__label, y, prediction, p, n): rows that were answered alike as one, with their number."""
    from pyspark.ml.functions import vector_to_array

    return scored.groupBy("__label", "y", "prediction", vector_to_array("probability").alias("p")).agg(F.count("*").alias("n"))


def class_scores(answers: DataFrame, classes: list[str]) -> DataFrame:
    """(cls, score, pos, neg) counts of each class's probability over answers as told() has them with a known label, renormalised over the classes present.

    Classes that the rows lack take no part; a row whose remaining probabilities add to 0 counts as undecided.
    """
    rows = answers.where(F.col("y").isNotNull())
    present = sorted(int(r[0]) for r in rows.select("y").distinct().collect())  # one row a class
    if len(present) < 2:
        return rows.limit(0).select(F.lit("").alias("cls"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    some = [F.get("p", F.lit(k)) for k in present]
    total = sum(some[1:], some[0])
    each = F.array(*[F.struct(F.lit(classes[k]).alias("cls"), F.round(F.when(total > 0, x / total).otherwise(1 / len(present)), 12).alias("score"), (F.col("y") == k).alias("hit")) for k, x in zip(present, some, strict=True)])
    count = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    return rows.select("n", F.inline(each)).groupBy("cls", "score").agg(count(F.col("hit")).alias("pos"), count(~F.col("hit")).alias("neg"))


def auc_of(answers: DataFrame, classes: list[str]) -> float | None:
    """AUC of the second class of two, or the support-weighted mean of one-against-the-rest; None if fewer than two are present."""
    from .ranks import score_auc

    rows = sorted(score_auc(class_scores(answers, classes)).collect(), key=lambda r: classes.index(r["cls"]))  # one row a class
    if len(rows) < 2:
        return None
    if len(rows) == 2:
        return float(rows[1]["auc"])
    return float(sum(r["auc"] * r["support"] for r in rows) / sum(r["support"] for r in rows))


def robust_auc(scored: DataFrame, classes: list[str]) -> float | None:
    """auc_of of rows that are scored once."""
    answers = told(scored).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return auc_of(answers, classes)
    finally:
        answers.unpersist()
