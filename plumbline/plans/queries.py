"""The audit's operators as registered queries over whole tables, each with the SQL it is held against where SQL can express it.

Splits are by arithmetic that SQL can repeat; the library itself splits by a seeded
hash. Forests are small here, so that every query ends soon; the defaults are larger.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import functions as MF
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.exprs import epoch
from ..functions.lineage import shared_folder
from ..operators import classifiers, forest, graph, neighbours, ranks, relational, splits
from ..sources import reading
from ..streaming import incremental
from . import benchmark, check_queries, lookup_checks, model_checks, studies, table_checks
from .dedup import deduplicated
from .registry import Subject, checks, feature_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def halves(df: DataFrame, key: str, rest: int = 5) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(key) % rest != 0), df.where(F.col(key) % rest == 0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- counts, duplicates, conflicts -----------------------------------------


@query("SELECT o_orderstatus AS cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.class_counts(table(spark, sf_dir, "orders"), "o_orderstatus"), "share")


@query("WITH c AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1) SELECT count(*) AS classes, round(max(n) / min(n), 6) AS imbalance, count(*) FILTER (WHERE n < 0.01 * (SELECT sum(n) FROM c)) AS rare FROM c")
def class_distribution_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relational.class_counts(table(spark, sf_dir, "labels"), "toxic")
    return rounded(c.agg(F.count("*").alias("classes"), (F.max("n") / F.min("n")).alias("imbalance"), F.count_if(F.col("share") < 0.01).alias("rare")), "imbalance")


def _dup_sql(keys: str, source: str) -> str:
    return f"""WITH g AS (SELECT {keys}, count(*) FILTER (WHERE NOT t) AS a, count(*) FILTER (WHERE t) AS b FROM ({source}) GROUP BY {keys}),
s AS (SELECT CAST(sum(a) AS BIGINT) AS tr, CAST(count(*) FILTER (WHERE a > 0) AS BIGINT) AS td, CAST(sum(b) AS BIGINT) AS te, CAST(coalesce(sum(b) FILTER (WHERE a > 0), 0) AS BIGINT) AS leak, CAST(coalesce(sum(b - 1) FILTER (WHERE a = 0 AND b > 0), 0) AS BIGINT) AS again FROM g)
SELECT tr AS train_rows_raw, td AS train_rows_deduped, tr - td AS train_duplicates_dropped, te AS test_rows_raw, te - leak - again AS test_rows_deduped, leak AS test_leakage_dropped, again AS test_duplicates_dropped FROM s"""


@query(_dup_sql("text, lang", "SELECT text, lang, doc_id % 5 = 0 AS t FROM documents"))
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicate_stats(*halves(table(spark, sf_dir, "documents"), "doc_id"), ["text", "lang"])


@query(_dup_sql("text", "SELECT text, doc_id % 5 = 0 AS t FROM documents"))
def dedup_stats_other_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicate_stats(*halves(table(spark, sf_dir, "documents"), "doc_id"), ["text"])


@query("WITH m AS (SELECT source, doc_id <> min(doc_id) OVER (PARTITION BY text, lang) AS dup FROM documents) SELECT source AS cls, count(*) AS n, round(avg(dup::INT), 6) AS rate FROM m WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) >= 20")
def dedup_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.duplicate_rates(table(spark, sf_dir, "documents"), ["text", "lang"], "source", "doc_id"), "rate")


@query("WITH k AS (SELECT DISTINCT l_quantity, l_discount, l_tax, l_partkey % 50 AS p FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT l_returnflag AS cls, count(*) AS n, round(avg((k.p IS NOT NULL)::INT), 6) AS rate FROM lineitem l LEFT JOIN k ON l.l_quantity = k.l_quantity AND l.l_discount = k.l_discount AND l.l_tax = k.l_tax AND l.l_partkey % 50 = k.p WHERE l_orderkey % 5 = 0 GROUP BY 1")
def leak_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_partkey") % 50)
    return rounded(relational.leak_rates(*halves(x, "l_orderkey"), ["l_quantity", "l_discount", "l_tax", "p"], "l_returnflag"), "rate")


@query("WITH tr AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 5 <> 0), te AS (SELECT doc_id, text, lang FROM documents d WHERE doc_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.text IS NOT DISTINCT FROM d.text AND tr.lang IS NOT DISTINCT FROM d.lang)) SELECT 'train' AS side, min(doc_id) AS doc_id FROM tr GROUP BY text, lang UNION ALL SELECT 'test', min(doc_id) FROM te GROUP BY text, lang")
def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = deduplicated(*halves(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id"), ["text", "lang"], "doc_id")
    return train.select(F.lit("train").alias("side"), "doc_id").unionByName(test.select(F.lit("test").alias("side"), "doc_id"))


@query("""WITH g AS (SELECT text, lang, count(*) AS n, count(DISTINCT source) > 1 AS bad, count(DISTINCT doc_id % 5 = 0) > 1 AS across FROM documents GROUP BY 1, 2)
SELECT CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS conflicting_groups, CAST(coalesce(sum(n) FILTER (WHERE bad), 0) AS BIGINT) AS conflicting_rows, CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE bad AND across) AS BIGINT) AS cross_split_conflicting_groups, round(100.0 * coalesce(sum(n) FILTER (WHERE bad), 0) / sum(n), 6) AS pct FROM g""")
def label_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.label_conflicts(*halves(table(spark, sf_dir, "documents"), "doc_id"), ["text", "lang"], "source"), "pct")


@query("WITH g AS (SELECT text, lang, count(DISTINCT source) > 1 AS bad FROM documents GROUP BY 1, 2) SELECT d.source AS cls, count(*) AS n, round(avg(g.bad::INT), 6) AS rate FROM documents d JOIN g ON d.text IS NOT DISTINCT FROM g.text AND d.lang IS NOT DISTINCT FROM g.lang WHERE d.source IS NOT NULL GROUP BY 1 HAVING count(*) >= 20")
def label_conflict_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.conflict_rates(*halves(table(spark, sf_dir, "documents"), "doc_id"), ["text", "lang"], "source", "source"), "rate")


@query("WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE NOT t) AS a, count(*) FILTER (WHERE t) AS b FROM (SELECT l_orderkey, (l_orderkey * 7 + l_linenumber) % 5 = 0 AS t FROM lineitem) GROUP BY 1) SELECT count(*) AS overlapping_identities, CAST(sum(a) AS BIGINT) AS train_rows_affected, CAST(sum(b) AS BIGINT) AS test_rows_affected FROM g WHERE a > 0 AND b > 0")
def flow_group_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").withColumn("__k", F.col("l_orderkey") * 7 + F.col("l_linenumber"))
    return relational.group_overlap(*halves(x, "__k"), ["l_orderkey"])


@query("SELECT 'quality' AS feature, CAST(count(*) FILTER (WHERE quality IS NULL) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS infinite, count(DISTINCT quality) <= 1 AS constant FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL), 0, count(DISTINCT n_chars) <= 1 FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL), 0, count(DISTINCT lang) <= 1 FROM documents UNION ALL SELECT 'ratio', count(*) FILTER (WHERE n_chars IS NULL), count(*) FILTER (WHERE n_chars % 7 = 0), false FROM documents")
def data_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("ratio", F.when(F.col("n_chars") % 7 == 0, float("inf")).otherwise(F.col("n_chars").cast("double")))
    return relational.integrity(d, ["n_chars", "lang", "ratio"], "quality")


@query("SELECT 'l_suppkey' AS feature, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem")
def low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_counts(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber"])


@query("SELECT event_type AS cls, count(*) AS n, round((epoch(max(ts)) - epoch(min(ts))) / (SELECT epoch(max(ts)) - epoch(min(ts)) FROM events), 6) AS ratio FROM events GROUP BY 1 HAVING count(*) >= 20")
def temporal_realism(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rounded(relational.class_spans(e, epoch(e, "ts"), "event_type"), "ratio")


@query("WITH x AS (SELECT event_type <> lag(event_type) OVER (ORDER BY event_id) AS c FROM events), p AS (SELECT 1 - sum(s * s) AS mixed FROM (SELECT count(*) / sum(count(*)) OVER () AS s FROM events GROUP BY event_type)) SELECT count(*) AS rows, CAST(count(*) FILTER (WHERE c) AS BIGINT) AS changes, round(count(*) FILTER (WHERE c) / (count(*) - 1) / any_value(mixed), 6) AS contiguity FROM x, p")
def row_order_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mixed = relational.class_counts(e, "event_type").agg((1 - F.sum(F.col("share") * F.col("share"))).alias("mixed"))  # one row
    t = ranks.transitions(e, "event_id", "event_type").crossJoin(F.broadcast(mixed))
    return t.select("rows", "changes", F.round(F.col("changes") / (F.col("rows") - 1) / F.col("mixed"), 6).alias("contiguity"))


# --- ranks -----------------------------------------------------------------

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _auc_sql(features: tuple[str, ...], source: str, label: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, {label} AS y FROM {source}" for f in features)
    return f"""WITH x AS ({long}), r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS k, count(*) OVER (PARTITION BY feature) AS n FROM x WHERE v IS NOT NULL AND y IS NOT NULL),
g AS (SELECT feature, y AS cls, any_value(n) AS n, count(*) AS n_class, sum(k) AS s FROM r GROUP BY 1, 2), a AS (SELECT *, (s - n_class * (n_class + 1) / 2) / (n_class * (n - n_class)) AS u FROM g WHERE n_class < n)
SELECT feature, cls, n, n_class, round(greatest(u, 1 - u), 6) AS auc FROM a"""


@query(_auc_sql(_NUMBERS, "lineitem", "l_returnflag"))
def feature_auc_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.feature_auc(table(spark, sf_dir, "lineitem"), list(_NUMBERS), "l_returnflag").withColumns({"n": F.col("n").cast("long"), "n_class": F.col("n_class").cast("long")}), "auc")


@query(_auc_sql(("value",), "events", "event_type"))
def feature_auc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.feature_auc(table(spark, sf_dir, "events"), ["value"], "event_type").withColumns({"n": F.col("n").cast("long"), "n_class": F.col("n_class").cast("long")}), "auc")


@query("SELECT v AS value, count(*) AS n, any_value(k) AS rank FROM (SELECT value AS v, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS k FROM events WHERE value IS NOT NULL) GROUP BY 1")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.average_rank(table(spark, sf_dir, "events"), "value").withColumn("n", F.col("n").cast("long"))


def _stump_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v, l_returnflag AS y FROM lineitem" for f in _NUMBERS)
    return f"""WITH x AS ({long}), k AS (SELECT DISTINCT y FROM x), fv AS (SELECT DISTINCT feature, v FROM x), c AS (SELECT feature, v, y, count(*) AS n FROM x GROUP BY 1, 2, 3),
p AS (SELECT feature, v, k.y, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY feature, k.y ORDER BY v) AS l, sum(coalesce(n, 0)) OVER (PARTITION BY feature, k.y) AS t FROM fv CROSS JOIN k LEFT JOIN c USING (feature, v, y)),
g AS (SELECT feature, v, sum(l) AS nl, sum(t - l) AS nr, sum(l * l) AS ql, sum((t - l) * (t - l)) AS qr, arg_max(y, l * 1000 - ascii(y)) AS left_cls, arg_max(y, (t - l) * 1000 - ascii(y)) AS right_cls FROM p GROUP BY 1, 2),
b AS (SELECT *, (nl - ql / nl + nr - qr / nr) / (nl + nr) AS gini FROM g WHERE nr > 0), best AS (SELECT * FROM b ORDER BY round(gini, 12), feature, v LIMIT 1)
SELECT feature, round((v + (SELECT min(fv.v) FROM fv WHERE fv.feature = best.feature AND fv.v > best.v)) / 2, 6) AS threshold, round(gini, 6) AS gini, left_cls, right_cls FROM best"""


@query(_stump_sql())
def one_rule_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.best_stump(table(spark, sf_dir, "lineitem"), list(_NUMBERS), "l_returnflag"), "threshold", "gini")


@query("WITH v AS (SELECT l_extendedprice AS v, (l_returnflag = 'A')::INT AS a FROM lineitem WHERE l_returnflag IN ('A', 'N')), c AS (SELECT v, sum(sum(a)) OVER (ORDER BY v) AS ca, sum(count(*) - sum(a)) OVER (ORDER BY v) AS cb FROM v GROUP BY v) SELECT 'l_extendedprice' AS feature, round(max(abs(ca / (SELECT sum(a) FROM v) - cb / (SELECT count(*) - sum(a) FROM v))), 6) AS ks FROM c")
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return rounded(ranks.two_sample_ks(x.where("l_returnflag = 'A'"), x.where("l_returnflag = 'N'"), ["l_extendedprice"]), "ks")


# --- lookups ---------------------------------------------------------------


def _lookup_ctes(keys: list[str], label: str, source: str) -> str:
    on = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)
    ks = ", ".join(keys)
    return f"""tr AS (SELECT {ks}, {label} AS y FROM {source} WHERE k % 5 <> 0), te AS (SELECT {ks}, {label} AS y FROM {source} WHERE k % 5 = 0),
prior AS (SELECT y AS cls, count(*) / sum(count(*)) OVER () AS prior FROM tr WHERE y IS NOT NULL GROUP BY 1),
kc AS (SELECT {ks}, y AS cls, count(*) AS n FROM tr WHERE y IS NOT NULL GROUP BY ALL), kn AS (SELECT {ks}, sum(n) AS n FROM kc GROUP BY ALL),
asked AS (SELECT {ks}, y, count(*) AS n FROM te WHERE y IN (SELECT cls FROM prior) GROUP BY ALL), akn AS (SELECT {ks}, sum(n) AS n FROM asked GROUP BY ALL),
scores AS (SELECT {", ".join(f"akn.{k}" for k in keys)}, prior.cls, CAST(akn.n AS BIGINT) AS n, CAST(coalesce(asked.n, 0) AS BIGINT) AS y_n, coalesce((coalesce(kc.n, 0) + prior) / (kn.n + 1), prior) AS p, kn.n IS NOT NULL AS seen
  FROM akn CROSS JOIN prior LEFT JOIN kn ON {on("akn", "kn")} LEFT JOIN kc ON {on("akn", "kc")} AND kc.cls = prior.cls LEFT JOIN asked ON {on("akn", "asked")} AND asked.y = prior.cls)"""


def _lookup_auc_sql(keys: list[str], label: str, source: str) -> str:
    return f"""WITH src AS ({source}), {_lookup_ctes(keys, label, "src")},
present AS (SELECT cls FROM scores GROUP BY 1 HAVING sum(y_n) > 0), z AS (SELECT *, round(p / sum(p) OVER (PARTITION BY {", ".join(keys)}), 12) AS s FROM scores WHERE cls IN (SELECT cls FROM present)),
v AS (SELECT cls, s, sum(y_n) AS pos, sum(n - y_n) AS neg FROM z GROUP BY 1, 2), w AS (SELECT *, sum(pos + neg) OVER (PARTITION BY cls ORDER BY s) - (pos + neg) + (pos + neg + 1) / 2 AS k FROM v)
SELECT cls, CAST(sum(pos) AS BIGINT) AS support, round((sum(k * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(neg)), 6) AS auc FROM w GROUP BY 1"""


@query(f"WITH src AS (SELECT *, event_id AS k FROM events), {_lookup_ctes(['user_id'], 'event_type', 'src')} SELECT user_id, cls, n, y_n, round(p + 1e-9, 6) AS p, seen FROM scores")
def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # off the exact halves, which the two sides round differently
    return rounded(relational.lookup_scores(*halves(table(spark, sf_dir, "events"), "event_id"), ["user_id"], "event_type").withColumn("p", F.col("p") + 1e-9), "p")


def _class_auc(scores: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    keys = [c for c in scores.columns if c.startswith("__k")]
    x = scores.withColumn("score", F.round(F.col("p") / F.sum("p").over(Window.partitionBy(*keys)), 12))
    return rounded(ranks.score_auc(x.select("cls", "score", F.col("y_n").alias("pos"), (F.col("n") - F.col("y_n")).alias("neg"))), "auc").select("cls", F.col("support").cast("long").alias("support"), "auc")


@query(_lookup_auc_sql(["user_id"], "event_type", "SELECT *, event_id AS k FROM events"))
def identity_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(table(spark, sf_dir, "events"), "event_id")
    s = Subject(train, test, config.merge(config.DEFAULTS, {"schema": {"label_column": "event_type"}}))
    return _class_auc(relational.lookup_scores(*lookup_checks.keyed(s, ["user_id"]), "__y"))


@query(_lookup_auc_sql(["l_suppkey", "l_linenumber"], "l_returnflag", "SELECT *, l_orderkey AS k FROM lineitem"))
def pair_lookup_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(table(spark, sf_dir, "lineitem"), "l_orderkey")
    s = Subject(train, test, config.merge(config.DEFAULTS, {"schema": {"label_column": "l_returnflag"}}))
    return _class_auc(relational.lookup_scores(*lookup_checks.keyed(s, ["l_suppkey", "l_linenumber"]), "__y"))


# --- splits, samples, mapping ------------------------------------------------


@query("SELECT 'test' AS side, o_orderstatus AS cls, CAST(least(count(*) - 1, greatest(1, round(count(*) * (1 - 0.8)))) AS BIGINT) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'train', o_orderstatus, count(*) - CAST(least(count(*) - 1, greatest(1, round(count(*) * (1 - 0.8)))) AS BIGINT) FROM orders GROUP BY 2")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each side and class, the two sides sharing no row and lacking none."""
    sides = dict(zip(("train", "test"), splits.stratified_split(table(spark, sf_dir, "orders"), "o_orderstatus", 0.8, 7, "o_orderkey"), strict=True))
    both = splits.union_all([df.select("o_orderkey", F.lit(s).alias("side")) for s, df in sides.items()])
    placed = both.groupBy("o_orderkey").agg(F.min("side").alias("side"), F.count("*").alias("times")).where("times = 1").drop("times")
    return table(spark, sf_dir, "orders").join(placed, "o_orderkey", "left").groupBy("side", F.col("o_orderstatus").alias("cls")).agg(F.count("*").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS shared_groups, count(*) AS rows, true AS near_a_fifth FROM lineitem")
def grouped_split_zero_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    train, test = splits.grouped_split(x, "l_returnflag", ["l_orderkey"], 0.8, 7)
    both = train.groupBy("l_orderkey").agg(F.count("*").alias("a")).join(test.groupBy("l_orderkey").agg(F.count("*").alias("b")), "l_orderkey", "full")
    s = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared_groups"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return s.select("shared_groups", (F.col("a") + F.col("b")).alias("rows"), (F.abs(F.col("b") / (F.col("a") + F.col("b")) - 0.2) < 0.02).alias("near_a_fifth"))


@query("SELECT k AS fold, o_orderstatus AS cls, CAST(round(n * (k + 1) / 5) - round(n * k / 5) AS BIGINT) AS n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), (SELECT CAST(unnest(range(5)) AS INT) AS k)")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_folds(table(spark, sf_dir, "orders"), "o_orderstatus", 5, 3, "o_orderkey").groupBy(F.col("__fold").alias("fold"), F.col("o_orderstatus").alias("cls")).agg(F.count("*").alias("n"))


def _drawn(draw: Callable[[DataFrame], DataFrame], of: DataFrame, key: str, cls: str | None = None) -> DataFrame:
    """Of a sample: its rows and ids (of each class), whether all are rows of the table, and whether the same are drawn again from other partitions."""
    mine, again = draw(of), draw(of.repartition(7, F.xxhash64(key) % 3)).select(F.col(key).alias("__again"))
    whole = of.select(F.col(key).alias("__of"))
    x = mine.join(again, mine[key] == again["__again"], "left").join(whole, mine[key] == whole["__of"], "left")
    groups = [F.col(cls).alias("cls")] if cls else []
    return x.groupBy(*groups).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids"), F.bool_and(F.col("__again").isNotNull()).alias("drawn_again"), F.bool_and(F.col("__of").isNotNull()).alias("of_the_table"))


@query("SELECT least(count(*), 1000) AS rows, least(count(*), 1000) AS ids, true AS drawn_again, true AS of_the_table FROM orders")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(lambda df: splits.sample_rows(df, 1000, 5, "o_orderkey"), table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT o_orderstatus AS cls, least(count(*), 500) AS rows, least(count(*), 500) AS ids, true AS drawn_again, true AS of_the_table FROM orders GROUP BY 1")
def sample_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(lambda df: splits.sample_by_class(df, "o_orderstatus", 500, 5, "o_orderkey"), table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus")


@query("WITH m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)) SELECT DISTINCT toxic AS cls, m.n AS rows, m.n AS ids, true AS drawn_again, true AS of_the_table FROM labels, m WHERE toxic IS NOT NULL")
def random_undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(lambda df: splits.undersample(df, "toxic", 3, "doc_id"), table(spark, sf_dir, "labels"), "doc_id", "toxic")


@query("SELECT least(count(*), 500) AS rows, least(count(*), 500) AS ids, true AS drawn_again, true AS of_the_table FROM orders")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(lambda df: relational.reservoir(df, 500, 9, "o_orderkey"), table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT c_mktsegment AS value, count(*) AS n, true AS dealt_out FROM customer GROUP BY 1")
def column_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    y = splits.permuted(x, "c_mktsegment", 11, "c_custkey")
    same = x.join(y.withColumnRenamed("c_mktsegment", "__v"), "c_custkey").agg((F.avg((F.col("c_mktsegment") == F.col("__v")).cast("int")) < 0.5).alias("dealt_out"))  # one row
    return y.groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(same))


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'soon' WHEN '2-HIGH' THEN 'soon' ELSE o_orderpriority END AS grouped, count(*) AS n FROM orders GROUP BY 1")
def label_grouping_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.map_labels(table(spark, sf_dir, "orders"), "o_orderpriority", {"1-URGENT": "soon", "2-HIGH": "soon"}).groupBy(F.col("o_orderpriority").alias("grouped")).agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY count(*), c_mktsegment) - 1 AS place, c_mktsegment AS scenario FROM customer GROUP BY 2 HAVING count(*) >= 20")
def scenario_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios of enough rows, the one to be held out first."""
    return spark.createDataFrame(list(enumerate(model_checks.scenarios(table(spark, sf_dir, "customer"), "c_mktsegment"))), "place long, scenario string")


# --- distances, graphs ------------------------------------------------------


@query("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), t AS (SELECT * FROM v UNION ALL SELECT vec_id + 1000000, label + 1, e FROM v WHERE vec_id % 7 = 0) SELECT a.vec_id, bool_or(coalesce(list_distance(a.e, b.e) < 1e-6, false)) AS near FROM t a LEFT JOIN t b ON a.vec_id <> b.vec_id AND a.e[1] = b.e[1] GROUP BY 1")
def near_zero_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _planted(spark, sf_dir)
    return neighbours.near_zero(v, v, 64, "vec_id").select("vec_id", "near")


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, and a copy of every seventh under another label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return v.unionByName(v.where("vec_id % 7 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), (F.col("label") + 1).cast("int").alias("label"), "v"))


@query("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, label, label + 1 AS other FROM v WHERE vec_id % 7 = 0 UNION ALL SELECT vec_id + 1000000, label + 1, label FROM v WHERE vec_id % 7 = 0")
def near_duplicate_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.confused_rows(_planted(spark, sf_dir), 64, "label", "vec_id")


@query("SELECT user_id, min(user_id) OVER () AS component FROM (SELECT DISTINCT user_id FROM events)")
def host_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return graph.bipartite_components(e, "user_id", "day")


@query("""WITH RECURSIVE k AS (SELECT doc_id, 't' || text AS r FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 's' || source || '|' || n_chars FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL),
h AS (SELECT r, min(doc_id) AS m FROM k GROUP BY 1), e AS (SELECT DISTINCT doc_id AS a, m AS b FROM k JOIN h USING (r) WHERE doc_id <> m), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.a, both_ways.b FROM c JOIN both_ways ON c.b = both_ways.a) SELECT a AS doc_id, min(b) AS component FROM c GROUP BY 1""")
def document_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by equal texts, or by source and length: chains of several links, in many components."""
    d = table(spark, sf_dir, "documents")
    keys = F.array(F.concat(F.lit("t"), "text"), F.concat(F.lit("s"), "source", F.lit("|"), F.col("n_chars").cast("string")))
    return graph.bipartite_components(d.select("doc_id", F.explode(keys).alias("shared")), "doc_id", "shared")


# --- analytics of splits ----------------------------------------------------


@query("WITH a AS (SELECT source AS c, count(*) / sum(count(*)) OVER () AS p FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1), b AS (SELECT source AS c, count(*) / sum(count(*)) OVER () AS q FROM documents WHERE doc_id % 5 = 0 GROUP BY 1), x AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM a FULL JOIN b USING (c)) SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 6) AS js, round(max(abs(p - q)), 6) AS max_diff FROM x")
def class_mix_js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.mix_divergence(*halves(table(spark, sf_dir, "documents"), "doc_id"), "source"), "js", "max_diff")


@query("WITH u AS (SELECT user_id, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS g FROM events GROUP BY 1) SELECT round(sum(n * pow(0.2, g)) / (0.2 * sum(n)), 6) AS expected_unseen, count(*) AS identities FROM u")
def expected_unseen_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return rounded(relational.expected_unseen(e, "user_id", "day"), "expected_unseen")


@query("""WITH v AS (SELECT text, source, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 AND source IS NOT NULL GROUP BY 1, 2), m AS (SELECT text, first(source ORDER BY n DESC, source) AS y FROM v GROUP BY 1)
SELECT m.y IS NOT NULL AS matched, count(*) AS n, round(avg((d.source = m.y)::INT), 6) AS agreement FROM documents d LEFT JOIN m ON d.text IS NOT DISTINCT FROM m.text WHERE doc_id % 5 = 0 GROUP BY 1""")
def matched_vs_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.matched_and_novel(*halves(table(spark, sf_dir, "documents"), "doc_id"), ["text"], "source"), "agreement")


@query("WITH x AS (SELECT l_linestatus AS s, l_suppkey % 3 = 0 AS r, (l_returnflag = 'N')::INT AS c FROM lineitem), g AS (SELECT s, count(*) FILTER (WHERE r) AS w, count(*) FILTER (WHERE NOT r) AS m, avg(c) FILTER (WHERE r) AS a, avg(c) FILTER (WHERE NOT r) AS b FROM x GROUP BY 1) SELECT count(*) AS strata, round(sum(w * a) / sum(w), 6) AS reused_accuracy, round(sum(w * b) / sum(w), 6) AS novel_accuracy, round(sum(w * a) / sum(w) - sum(w * b) / sum(w), 6) AS advantage FROM g WHERE m >= 20 AND w > 0")
def stratified_reuse_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return rounded(relational.reuse_advantage(x, "l_linestatus", F.col("l_suppkey") % 3 == 0, F.col("l_returnflag") == "N"), "reused_accuracy", "novel_accuracy", "advantage")


@query("SELECT o_orderstatus AS true_class, CASE WHEN o_custkey % 3 = 0 THEN 'F' ELSE 'O' END AS said, count(*) AS n FROM orders GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("true_class"), F.when(F.col("o_custkey") % 3 == 0, "F").otherwise("O").alias("said")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderstatus AS t, CASE WHEN o_custkey % 3 = 0 THEN 'F' ELSE 'O' END AS s FROM orders), k AS (SELECT DISTINCT t AS c FROM c UNION SELECT DISTINCT s FROM c),
m AS (SELECT k.c, (SELECT count(*) FROM c WHERE t = k.c AND s = k.c) AS h, (SELECT count(*) FROM c WHERE t = k.c) AS n, (SELECT count(*) FROM c WHERE s = k.c) AS p FROM k)
SELECT c AS class, round(CASE WHEN p > 0 THEN h / p ELSE 0 END, 6) AS precision, round(CASE WHEN n > 0 THEN h / n ELSE 0 END, 6) AS recall, round(CASE WHEN n + p > 0 THEN 2 * h / (n + p) ELSE 0 END, 6) AS f1, n AS support FROM m""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r[0], r[1], r[2]) for r in confusion_matrix(spark, sf_dir).collect()]  # a row a pair of classes
    per = benchmark.metrics(rows)["per_class"]
    out = spark.createDataFrame([(p["class"], p["precision"], p["recall"], p["f1"], p["support"]) for p in per], "class string, precision double, recall double, f1 double, support long")
    return rounded(out, "precision", "recall", "f1")


@query("SELECT c_mktsegment AS cls, round(avg((c_acctbal - m) / s), 6) AS standard, round(avg((c_acctbal - lo) / (hi - lo)), 6) AS minmax FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) GROUP BY 1")
def scalers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", MF.array_to_vector(F.array("c_acctbal")).alias("features"))
    done = [classifiers.scaling(k)(x)(x).select("c_custkey", "c_mktsegment", F.get(MF.vector_to_array("features"), F.lit(0)).alias(k)) for k in ("standard", "minmax")]
    y = done[0].join(done[1].drop("c_mktsegment"), "c_custkey")
    return rounded(y.groupBy(F.col("c_mktsegment").alias("cls")).agg(F.avg("standard").alias("standard"), F.avg("minmax").alias("minmax")), "standard", "minmax")


# --- sources, sinks, streams --------------------------------------------------


@query("SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and scanned by the library: typed by its values, aligned and cleaned."""
    at = f"{shared_folder(spark).rstrip('/')}/csv_round_trip"
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").write.mode("overwrite").option("header", True).csv(at)
    return reading.read_files(spark, [at], downcast=False).drop(reading.ROW_ID)


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name FROM supplier UNION ALL SELECT CAST(c_custkey AS DOUBLE), c_name FROM customer")
def union_with_schema_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second file is brought to the first one's columns."""
    at = f"{shared_folder(spark).rstrip('/')}/union_with_schema_lock"
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.mode("overwrite").parquet(f"{at}-1.parquet")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.lit(1).alias("more")).write.mode("overwrite").parquet(f"{at}-2.parquet")
    return reading.read_files(spark, [f"{at}-1.parquet", f"{at}-2.parquet"], downcast=False).drop(reading.ROW_ID)


@query("SELECT event_type AS cls, count(*) AS n FROM events GROUP BY 1")
def stream_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    sink = incremental.Running(spark, ["event_type"], {"n": F.count("*")}, {"n": lambda n: F.sum(n)})
    return incremental.drain(stream, sink).result().select(F.col("event_type").alias("cls"), F.col("n").cast("long").alias("n"))


# --- studies -----------------------------------------------------------------


@query(f"SELECT cls, first(feature ORDER BY auc DESC, feature) AS feature, max(auc) AS auc FROM ({_auc_sql(_NUMBERS, 'lineitem', 'l_returnflag')}) GROUP BY 1")
def best_feature_of_each_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.best_feature_of_each_class(table(spark, sf_dir, "lineitem"), list(_NUMBERS), "l_returnflag"), "auc")


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r = studies.cluster_bootstrap(e, "user_id", F.col("event_type") == "click", F.col("event_id") % 2 == 0)
    return spark.createDataFrame([tuple(r.values())], "value double, low double, high double")


@query()
def advantage_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(*[F.count_if(c).alias(n) for n, c in (("w", F.col("l_suppkey") % 3 == 0), ("a", (F.col("l_suppkey") % 3 == 0) & (F.col("l_returnflag") == "N")), ("m", F.col("l_suppkey") % 3 != 0), ("b", (F.col("l_suppkey") % 3 != 0) & (F.col("l_returnflag") == "N")))])
    r = studies.advantage_bootstrap([(q["w"], q["a"], q["m"], q["b"]) for q in x.orderBy("l_linestatus").collect()])  # a row a stratum
    return spark.createDataFrame([tuple(r.values())], "value double, low double, high double")


@query()
def cutoff_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _planted(spark, sf_dir)
    rows = studies.cutoff_grid(v.where("vec_id >= 1000000"), v.where("vec_id < 1000000"), v, 64, "vec_id")
    return spark.createDataFrame([tuple(r.values()) for r in rows], "cutoff double, margin double, low double, high double, verdict string")


@query(_auc_sql(("value",), "(SELECT coalesce(value, -2) AS value, event_type FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, event_type FROM events))", "event_type"))
def filled_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return rounded(studies.filled_auc(e, ["value"], "event_type").withColumns({"n": F.col("n").cast("long"), "n_class": F.col("n_class").cast("long")}), "auc")


@query()
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.interval_coverage(spark, 40)


@query()
def identifier_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = studies.identifier_ablation(_subject(spark, sf_dir), {"ports": ["port", "proto"], "keys": ["l_suppkey", "l_orderkey"]}, [0, 1])
    return spark.createDataFrame([(k, n, v["mean"], v["low"], v["high"]) for k, by in r.items() for n, v in by.items()], "features string, measure string, mean double, low double, high double")


# --- model-based checks: rows only --------------------------------------------


def _subject(spark: SparkSession, sf_dir: str) -> Subject:
    """Line items as the data under audit: the flag to be predicted, an id, a clock, scenarios and groups."""
    x = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_orderkey", "l_linestatus", "l_returnflag", F.col("l_shipdate").cast("timestamp").cast("double").alias("shipped"), F.concat(F.lit("s"), F.pmod("l_partkey", F.lit(3))).alias("scenario"),
        F.col("l_linenumber").cast("string").alias("proto"), F.col("l_suppkey").cast("string").alias("port"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("__h"),
    )
    x = x.withColumn(reading.ROW_ID, F.shiftrightunsigned("__h", 2)).drop("__h")
    cfg = config.merge(config.DEFAULTS, {
        "dataset": {"name": "lineitem", "raw_files": [f"{sf_dir}/lineitem.parquet"], "group_columns": ["l_orderkey"]},
        "schema": {"label_column": "l_returnflag", "id_like_columns": ["port", "l_suppkey"], "timestamp_column": "shipped", "flow_id_columns": ["l_orderkey"], "scenario_column": "scenario", "feature_categories": {"l_quantity": "amount", "l_extendedprice": "amount", "l_discount": "rate", "l_tax": "rate"}},
        "audit": {"forest_trees": 8, "forest_depth": 5, "repeated_seed_count": 3, "reference_dataset": "part"},
    })
    train, test = splits.stratified_split(x, "l_returnflag", 0.8, 0, reading.ROW_ID)
    ref = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("l_quantity"), F.col("p_retailprice").alias("l_extendedprice"), F.when(F.col("p_size") % 3 == 0, "A").when(F.col("p_size") % 3 == 1, "N").otherwise("R").alias("l_returnflag"), F.col("p_partkey").alias(reading.ROW_ID))
    return Subject(train, test, cfg, lambda: x, lambda: ref)


def _check(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = checks()[name].run(_subject(spark, sf_dir))
        return spark.createDataFrame([(f["check"], f["status"], f["summary"], json.dumps(f["details"], default=str))], "check string, status string, summary string, details string")

    return run


for _name in config.CHECKS:
    QUERIES[f"check_{_name}"] = _check(_name)
for _name, (_run, _sql) in check_queries.queries().items():
    QUERIES[_name], ORACLES[_name] = _run, _sql


_RICH = """x AS (SELECT c_custkey AS i, CAST(c_acctbal AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS b, (c_acctbal + 150 * c_nationkey > 5000)::INT AS y FROM customer), tr AS (SELECT * FROM x WHERE i % 5 <> 0), te AS (SELECT * FROM x WHERE i % 5 = 0),
g AS (SELECT y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb FROM tr GROUP BY 1), t AS (SELECT count(*) AS n, 1e-9 * greatest(var_pop(a), var_pop(b)) AS e FROM tr)"""


def _told(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truth, said, n) of a method that is fitted on two numbers of the customers, on all test rows."""
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("__id"), MF.array_to_vector(F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"))).alias("features"), (F.col("c_acctbal") + 150 * F.col("c_nationkey") > 5000).cast("double").alias("y"))
    train, test = halves(x, "__id")
    said = classifiers.build(name, 2, 2, train.count(), 0)(train)(test)
    return said.groupBy(F.col("y").cast("int").alias("truth"), F.col("prediction").cast("int").alias("said")).agg(F.count("*").alias("n"))


@query(f"WITH {_RICH}, s AS (SELECT i, te.y, g.y AS c, ln(g.n / t.n) - 0.5 * (ln(2 * pi() * (va + e)) + (a - ma) ** 2 / (va + e) + ln(2 * pi() * (vb + e)) + (b - mb) ** 2 / (vb + e)) AS z FROM te, g, t) SELECT truth, said, count(*) AS n FROM (SELECT any_value(y) AS truth, arg_max(c, z) AS said FROM s GROUP BY i) GROUP BY 1, 2")
def classifier_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told("NaiveBayes", spark, sf_dir)


@query(f"""WITH {_RICH}, p AS (SELECT sum((a - ma) ** 2) / (count(*) - 2) AS s, sum((a - ma) * (b - mb)) / (count(*) - 2) AS o, sum((b - mb) ** 2) / (count(*) - 2) AS v FROM tr JOIN g USING (y)),
w AS (SELECT y AS c, n, ma, mb, (v * ma - o * mb) / (s * v - o * o) AS wa, (s * mb - o * ma) / (s * v - o * o) AS wb FROM g, p),
z AS (SELECT i, te.y, c, wa * a + wb * b - 0.5 * (wa * ma + wb * mb) + ln(w.n / t.n) AS z FROM te, w, t) SELECT truth, said, count(*) AS n FROM (SELECT any_value(y) AS truth, arg_max(c, z) AS said FROM z GROUP BY i) GROUP BY 1, 2""")
def classifier_lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told("LDA", spark, sf_dir)


@query(f"""WITH {_RICH}, d AS (SELECT te.i, te.y, tr.y AS c, row_number() OVER (PARTITION BY te.i ORDER BY (te.a - tr.a) ** 2 + (te.b - tr.b) ** 2) AS k FROM te, tr)
SELECT truth, said, count(*) AS n FROM (SELECT any_value(y) AS truth, (sum(c) >= 3)::INT AS said FROM d WHERE k <= 5 GROUP BY i) GROUP BY 1, 2""")
def classifier_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told("KNN", spark, sf_dir)


@query()
def benchmark_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven quick methods on the customers, scored on all test rows."""
    x = table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment", F.col("c_custkey").alias(reading.ROW_ID))
    train, test = splits.stratified_split(x, "c_mktsegment", 0.8, 0, reading.ROW_ID)
    cfg = config.merge(config.DEFAULTS, {"schema": {"label_column": "c_mktsegment"}, "classifiers": {"list": ["RandomForest", "DecisionTree", "NaiveBayes", "LogisticRegression", "LDA", "KNN", "AdaBoost"], "hyperparameters": {"RandomForest": {"n_estimators": 8, "max_depth": 5}, "DecisionTree": {"max_depth": 5}, "LogisticRegression": {"max_iter": 30}, "AdaBoost": {"n_estimators": 10}}}})
    rows, extras = benchmark.run_benchmark(spark, train, test, cfg)
    if extras["failures"]:
        raise RuntimeError(str(extras["failures"]))
    return spark.createDataFrame([(r["classifier"], r["accuracy"], r["f1_macro"], r["auc"]) for r in rows], "classifier string, accuracy double, f1_macro double, auc double")


@query()
def content_hash_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders")
    return spark.createDataFrame([("orders", relational.content_hash(n, n.columns))], "name string, digest string")


@query("SELECT true AS same_in_other_partitions, true AS other_in_another_order")
def content_hash_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders")
    digest = lambda df, by: relational.ordered_content_hash(df, n.columns, by)
    one = digest(n, "o_orderkey")
    turned = n.withColumn("__turned", -F.col("o_orderkey"))
    return spark.createDataFrame([(one == digest(n.repartition(7, "o_custkey"), "o_orderkey"), one != digest(turned, "__turned"))], "same_in_other_partitions boolean, other_in_another_order boolean")


@query()
def forest_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subject(spark, sf_dir)
    f = forest.fit_forest(s.train, feature_columns(s.train, s.cfg), s.label, s.cfg, s.row_id, 0)
    return spark.createDataFrame([(f.accuracy(s.test), forest.robust_auc(f.scored(s.test), f.encoder.classes))], "accuracy double, auc double")


@query()
def forest_of_100_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of the library's default size, 100 trees of depth 10, on as many rows as a fit reads, scored on all test rows."""
    s = _subject(spark, sf_dir)
    cfg = config.merge(s.cfg, {"audit": {k: config.DEFAULTS["audit"][k] for k in ("forest_trees", "forest_depth")}})
    f = forest.fit_forest(s.train, feature_columns(s.train, cfg), s.label, cfg, s.row_id, 0)
    return spark.createDataFrame([(f.accuracy(s.test),)], "accuracy double")


assert table_checks  # its checks are among those registered above
