"""The checks that are aggregates and joins, run over whole tables as registered queries, each held against SQL.

A finding becomes rows (item, number, text): the path of each of its details, numbers to
six places, and its status. The sides are split by arithmetic that SQL can repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from .registry import Subject, checks

#: A piece of an answer in SQL: its item, number and text as expressions, and what they come from.
Piece = tuple[str, str, str, str]


def _leaves(x: Any, path: tuple[str, ...]) -> Iterator[tuple[str, float | None, str | None]]:
    if isinstance(x, dict):
        for k, v in x.items():
            yield from _leaves(v, (*path, str(k)))
    elif isinstance(x, (list, tuple)):
        for k, v in enumerate(x):
            yield from _leaves(v, (*path, str(k)))
    elif isinstance(x, (int, float)) and not isinstance(x, bool):
        yield ".".join(path), round(float(x), 6), None
    else:
        yield ".".join(path), None, None if x is None else str(x)


def flat(spark: SparkSession, found: dict, leave_out: tuple[str, ...] = ()) -> DataFrame:
    rows = [("status", None, found["status"]), *_leaves({k: v for k, v in found["details"].items() if k not in leave_out}, ())]
    return spark.createDataFrame(rows, "item string, number double, text string")


def _sql(ctes: str, *pieces: Piece) -> str:
    return f"WITH {ctes}\n" + "\nUNION ALL ".join(f"SELECT {i} AS item, round(CAST({n} AS DOUBLE), 6) AS number, CAST({t} AS VARCHAR) AS text FROM {f}" for i, n, t, f in pieces)


def _numbers(source: str, **columns: str) -> list[Piece]:
    return [(f"'{k}'", v, "NULL", source) for k, v in columns.items()]


def _status(case: str, source: str) -> Piece:
    return "'status'", "NULL", f"CASE {case} END", source


def _same(a: str, b: str, *keys: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


Make = Callable[[SparkSession, str], Subject]


def _of(name: str, key: str, schema: dict, row_id: str, columns: tuple[str, ...] | None = None, split: Callable[[DataFrame], Any] | None = None) -> Make:
    """A subject from a table: every fifth value of a key is in test."""
    def make(spark: SparkSession, sf_dir: str) -> Subject:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        at = (split(df) if split else F.col(key)) % 5 == 0
        df = df.withColumn("__t", at)
        keep = [*(columns or df.columns), *([row_id] if columns and row_id not in columns else [])]
        sides = [df.where(c).select(*[c for c in keep if c != "__t"]) for c in (~F.col("__t"), F.col("__t"))]
        return Subject(*sides, config.merge(config.DEFAULTS, {"dataset": {"name": name}, "schema": schema}), row_id=row_id)

    return make


_DOCUMENTS = _of("documents", "doc_id", {"label_column": "source", "drop_columns": ["doc_id"]}, "doc_id", ("text", "lang", "source"))
_SRC = "src AS (SELECT text, lang, source, doc_id, doc_id % 5 = 0 AS t FROM documents)"

DEDUP = _sql(
    f"""{_SRC}, g AS (SELECT text, lang, count(*) FILTER (WHERE NOT t) AS a, count(*) FILTER (WHERE t) AS b FROM src GROUP BY 1, 2),
s AS (SELECT sum(a) AS tr, count(*) FILTER (WHERE a > 0) AS td, sum(b) AS te, coalesce(sum(b) FILTER (WHERE a > 0), 0) AS leak, coalesce(sum(b - 1) FILTER (WHERE a = 0 AND b > 0), 0) AS again FROM g),
d AS (SELECT source, doc_id <> min(doc_id) OVER (PARTITION BY text, lang) AS dup FROM src WHERE NOT t),
r AS (SELECT source, avg(dup::INT) AS dup FROM d WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
l AS (SELECT src.source, avg((g.a > 0)::INT) AS leak FROM src JOIN g ON {_same("src", "g", "text", "lang")} WHERE src.t AND source IS NOT NULL GROUP BY 1)""",
    _status("WHEN leak > 0 THEN 'flag' WHEN tr > td OR again > 0 THEN 'warning' ELSE 'ok'", "s"),
    *_numbers("s", train_rows_raw="tr", train_rows_deduped="td", train_duplicates_dropped="tr - td", test_rows_raw="te", test_rows_deduped="te - leak - again", test_leakage_dropped="leak", test_duplicates_dropped="again"),
    ("'by_class.' || source || '.train_duplicate_rate'", "dup", "NULL", "r"),
    ("'by_class.' || source || '.test_leak_rate'", "leak", "NULL", "r LEFT JOIN l USING (source)"),
)

LABEL_CONFLICT = _sql(
    f"""{_SRC}, g AS (SELECT text, lang, count(*) AS n, count(DISTINCT source) > 1 AS bad, count(DISTINCT t) > 1 AS across FROM src GROUP BY 1, 2),
s AS (SELECT count(*) FILTER (WHERE bad) AS groups, coalesce(sum(n) FILTER (WHERE bad), 0) AS rows, count(*) FILTER (WHERE bad AND across) AS across FROM g),
r AS (SELECT src.source, avg(g.bad::INT) AS rate FROM src JOIN g ON {_same("src", "g", "text", "lang")} WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)""",
    _status("WHEN groups > 0 THEN 'flag' ELSE 'ok'", "s"),
    *_numbers("s WHERE groups > 0", conflicting_groups="groups", conflicting_rows="rows", cross_split_conflicting_groups="across"),
    ("'by_class.' || source || '.conflicting_rate'", "rate", "NULL", "r WHERE (SELECT groups FROM s) > 0"),
)

_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_ITEMS = _of("lineitem", "l_orderkey", {"label_column": "l_returnflag", "drop_columns": ["l_orderkey"]}, "l_orderkey", (*_FOUR, "l_returnflag"))
_TRAIN = "tr AS (SELECT * FROM lineitem WHERE l_orderkey % 5 <> 0), te AS (SELECT * FROM lineitem WHERE l_orderkey % 5 = 0)"
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, l_returnflag AS y FROM tr WHERE l_returnflag IS NOT NULL AND {f} IS NOT NULL" for f in _FOUR)
_VALUE = "CASE feature " + " ".join(f"WHEN '{f}' THEN CAST({f} AS DOUBLE)" for f in _FOUR) + " END"

ONE_RULE = _sql(
    f"""{_TRAIN}, x AS ({_LONG}), k AS (SELECT DISTINCT y FROM x), fv AS (SELECT DISTINCT feature, v FROM x), c AS (SELECT feature, v, y, count(*) AS n FROM x GROUP BY 1, 2, 3),
p AS (SELECT feature, v, k.y, sum(coalesce(n, 0)) OVER (PARTITION BY feature, k.y ORDER BY v) AS l, sum(coalesce(n, 0)) OVER (PARTITION BY feature, k.y) AS t FROM fv CROSS JOIN k LEFT JOIN c USING (feature, v, y)),
g AS (SELECT feature, v, sum(l) AS nl, sum(t - l) AS nr, sum(l * l) AS ql, sum((t - l) * (t - l)) AS qr, arg_max(y, l * 1000 - ascii(y)) AS lo, arg_max(y, (t - l) * 1000 - ascii(y)) AS hi FROM p GROUP BY 1, 2),
b AS (SELECT feature, v, lo, hi FROM g WHERE nr > 0 ORDER BY round((nl - ql / nl + nr - qr / nr) / (nl + nr), 12), feature, v LIMIT 1),
rule AS (SELECT feature, lo, hi, (v + (SELECT min(fv.v) FROM fv WHERE fv.feature = b.feature AND fv.v > b.v)) / 2 AS cut FROM b),
m AS (SELECT y FROM (SELECT l_returnflag AS y, count(*) AS n FROM tr WHERE l_returnflag IS NOT NULL GROUP BY 1) ORDER BY n DESC, y LIMIT 1),
said AS (SELECT t, l_returnflag AS y, CASE WHEN coalesce({_VALUE}, 0) <= cut THEN lo ELSE hi END AS s FROM (SELECT *, false AS t FROM tr UNION ALL SELECT *, true FROM te), rule),
s AS (SELECT avg((y = s)::INT) FILTER (WHERE NOT t) AS train, avg((y = s)::INT) FILTER (WHERE t) AS test, avg((y = (SELECT y FROM m))::INT) FILTER (WHERE t) AS base FROM said WHERE y IS NOT NULL)""",
    _status("WHEN test > 0.95 AND (test - base) / (1 - base) >= 0.5 THEN 'flag' ELSE 'ok'", "s"),
    *_numbers("s", train_accuracy="train", test_accuracy="test", majority_baseline_accuracy="base", error_reduction_vs_baseline="(test - base) / (1 - base)"),
)

FEATURE_AUC = _sql(
    f"""{_TRAIN}, x AS ({_LONG}), r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS k, count(*) OVER (PARTITION BY feature) AS n FROM x),
u AS (SELECT feature, y, (sum(k) - count(*) * (count(*) + 1) / 2) / (count(*) * (any_value(n) - count(*))) AS u FROM r GROUP BY 1, 2),
f AS (SELECT feature, max(round(greatest(u, 1 - u), 12)) AS auc, first(y ORDER BY round(greatest(u, 1 - u), 12) DESC, y) AS y FROM u GROUP BY 1),
b AS (SELECT * FROM f ORDER BY auc DESC, feature LIMIT 1)""",
    _status("WHEN auc > 0.95 THEN 'flag' WHEN auc > 0.90 THEN 'warning' ELSE 'ok'", "b"),
    ("'top_features.' || feature", "auc", "NULL", "f"), ("'best_feature'", "NULL", "feature", "b"), ("'best_class'", "NULL", "y", "b"),
)


def _lookup_ctes(prefix: str, keys: list[str], label: str, source: str) -> str:
    """CTEs that end in <prefix>auc (cls, support, auc) over all test rows, and <prefix>seen over those with a key that train has."""
    ks, p = ", ".join(keys), prefix
    ranked = lambda of, name: f"""{p}{name}c AS (SELECT cls FROM {p}s WHERE {of} GROUP BY 1 HAVING sum(y_n) > 0), {p}{name}z AS (SELECT *, round(p / sum(p) OVER (PARTITION BY {ks}), 12) AS v FROM {p}s WHERE {of} AND cls IN (SELECT cls FROM {p}{name}c)),
{p}{name}v AS (SELECT cls, v, sum(y_n) AS pos, sum(n - y_n) AS neg FROM {p}{name}z GROUP BY 1, 2), {p}{name}w AS (SELECT *, sum(pos + neg) OVER (PARTITION BY cls ORDER BY v) - (pos + neg) + (pos + neg + 1) / 2 AS k FROM {p}{name}v),
{p}{name} AS (SELECT cls, sum(pos) AS support, (sum(k * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(neg)) AS auc FROM {p}{name}w GROUP BY 1)"""  # noqa: E731
    return f"""{p}tr AS (SELECT {ks}, {label} AS y FROM {source} WHERE k % 5 <> 0), {p}te AS (SELECT {ks}, {label} AS y FROM {source} WHERE k % 5 = 0),
{p}prior AS (SELECT y AS cls, count(*) / sum(count(*)) OVER () AS prior FROM {p}tr WHERE y IS NOT NULL GROUP BY 1),
{p}kc AS (SELECT {ks}, y AS cls, count(*) AS n FROM {p}tr WHERE y IS NOT NULL GROUP BY ALL), {p}kn AS (SELECT {ks}, sum(n) AS n FROM {p}kc GROUP BY ALL),
{p}ky AS (SELECT {ks}, y, count(*) AS n FROM {p}te WHERE y IN (SELECT cls FROM {p}prior) GROUP BY ALL), {p}kt AS (SELECT {ks}, sum(n) AS n FROM {p}ky GROUP BY ALL),
{p}s AS (SELECT {", ".join(f"kt.{k}" for k in keys)}, prior.cls, kt.n AS n, coalesce(ky.n, 0) AS y_n, coalesce((coalesce(kc.n, 0) + prior) / (kn.n + 1), prior) AS p, kn.n IS NOT NULL AS known
  FROM {p}kt AS kt CROSS JOIN {p}prior AS prior LEFT JOIN {p}kn AS kn ON {_same("kt", "kn", *keys)} LEFT JOIN {p}kc AS kc ON {_same("kt", "kc", *keys)} AND kc.cls = prior.cls LEFT JOIN {p}ky AS ky ON {_same("kt", "ky", *keys)} AND ky.y = prior.cls),
{ranked("true", "auc")}, {ranked("known", "seen")}"""


#: The AUC of the second of two classes, or the mean weighted by their rows.
_MEAN = "(SELECT CASE WHEN count(*) = 2 THEN max_by(auc, cls) WHEN count(*) > 2 THEN sum(auc * support) / sum(support) END FROM {0})"
_EVENTS = _of("events", "event_id", {"label_column": "event_type", "id_like_columns": ["user_id"], "timestamp_column": "ts"}, "event_id")

IDENTITY = _sql(
    f"src AS (SELECT *, event_id AS k FROM events), {_lookup_ctes('u', ['user_id'], 'event_type', 'src')}, m AS (SELECT {_MEAN.format('uauc')} AS a, {_MEAN.format('useen')} AS s)",
    _status("WHEN a > 0.8 THEN 'flag' ELSE 'ok'", "m"),
    ("'standalone_auc.user_id'", "a", "NULL", "m"), ("'seen_only_auc.user_id'", "s", "NULL", "m"), ("'method'", "NULL", "'smoothed value table'", "m"),
    ("'seen_coverage.user_id'", "sum(n) FILTER (WHERE known) / sum(n)", "NULL", "(SELECT DISTINCT user_id, n, known FROM us)"),
    ("'suggested_drop.0'", "NULL", "'user_id'", "m WHERE a > 0.8"), ("'by_class.user_id.' || cls", "auc", "NULL", "uauc WHERE (SELECT a FROM m) > 0.8"),
)

_PORTS = _of("lineitem", "l_orderkey", {"label_column": "l_returnflag", "id_like_columns": ["port"]}, "l_orderkey")


def _with_ports(spark: SparkSession, sf_dir: str) -> Subject:
    s = _PORTS(spark, sf_dir)
    rename = lambda df: df.withColumns({"port": F.col("l_suppkey"), "proto": F.col("l_linenumber").cast("string")})
    return Subject(rename(s.train), rename(s.test), s.cfg, row_id=s.row_id)


PORT = _sql(
    f"src AS (SELECT *, l_suppkey AS port, l_linenumber AS proto, l_orderkey AS k FROM lineitem), {_lookup_ctes('u', ['port', 'proto'], 'l_returnflag', 'src')}, m AS (SELECT {_MEAN.format('uauc')} AS a)",
    _status("WHEN a > 0.8 THEN 'flag' ELSE 'ok'", "m"), ("'port_column'", "NULL", "'port'", "m"), ("'protocol_column'", "NULL", "'proto'", "m"), ("'standalone_auc'", "a", "NULL", "m"),
)

TEMPORAL = _sql(
    """tr AS (SELECT event_type AS c, epoch(ts) AS s FROM events WHERE event_id % 5 <> 0 AND ts IS NOT NULL),
r AS (SELECT c, (max(s) - min(s)) / (SELECT max(s) - min(s) FROM tr) AS r FROM tr WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)""",
    _status("WHEN min(r) < 0.05 THEN 'flag' WHEN min(r) < 0.15 THEN 'warning' ELSE 'ok'", "r"), ("'span_ratio_by_class.' || c", "r", "NULL", "r"),
)

_FLOWS = _of("lineitem", "", {"label_column": "l_returnflag", "flow_id_columns": ["l_orderkey"]}, "l_orderkey", split=lambda df: F.col("l_orderkey") * 7 + F.col("l_linenumber"))
FLOWS = _sql(
    """g AS (SELECT l_orderkey, count(*) FILTER (WHERE (l_orderkey * 7 + l_linenumber) % 5 <> 0) AS a, count(*) FILTER (WHERE (l_orderkey * 7 + l_linenumber) % 5 = 0) AS b FROM lineitem GROUP BY 1),
s AS (SELECT count(*) AS n, coalesce(sum(a), 0) AS a, coalesce(sum(b), 0) AS b FROM g WHERE a > 0 AND b > 0)""",
    _status("WHEN n > 0 THEN 'flag' ELSE 'ok'", "s"), ("'flow_id_columns.0'", "NULL", "'l_orderkey'", "s"), *_numbers("s", overlapping_identities="n", train_rows_affected="a", test_rows_affected="b"),
)

ORDER = _sql(
    """x AS (SELECT event_id % 5 = 0 AS t, event_type AS y, lag(event_type) OVER (PARTITION BY event_id % 5 = 0 ORDER BY event_id) AS b, row_number() OVER (PARTITION BY event_id % 5 = 0 ORDER BY event_id) AS k FROM events),
p AS (SELECT t, 1 - sum(s * s) AS mixed FROM (SELECT t, count(*) / sum(count(*)) OVER (PARTITION BY t) AS s FROM x WHERE y IS NOT NULL GROUP BY t, y) GROUP BY 1),
c AS (SELECT t, count(*) FILTER (WHERE k > 1 AND (y IS DISTINCT FROM b OR y IS NULL)) / (count(*) - 1) / any_value(mixed) AS r FROM x JOIN p USING (t) GROUP BY 1)""",
    _status("WHEN min(r) < 0.3 THEN 'flag' WHEN min(r) < 0.6 THEN 'warning' ELSE 'ok'", "c"), ("'contiguity_ratio.' || CASE WHEN t THEN 'test' ELSE 'train' END", "r", "NULL", "c"),
)

CLASSES = _sql(
    """c AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS side, o_orderstatus AS y, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY o_orderkey % 5 = 0) AS s FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderkey % 5 = 0, 1, 2),
m AS (SELECT max(n) / min(n) AS r, count(*) FILTER (WHERE s < 0.01) AS rare FROM c WHERE side = 'train')""",
    _status("WHEN r > 100 OR rare > 0 THEN 'warning' ELSE 'ok'", "m"), ("side || '.counts.' || y", "n", "NULL", "c"), ("side || '.shares.' || y", "s", "NULL", "c"), ("'imbalance_ratio'", "r", "NULL", "m"),
    ("'rare_classes.' || (row_number() OVER (ORDER BY y) - 1)", "NULL", "y", "c WHERE side = 'train' AND s < 0.01"),
)

_ID_COLUMNS = ("l_suppkey", "l_linenumber")
CARDINALITY = _sql(
    "c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS f, count(DISTINCT {c}) AS n FROM lineitem WHERE l_orderkey % 5 <> 0" for c in _ID_COLUMNS) + ")",
    _status("WHEN min(n) < 50 THEN 'warning' ELSE 'ok'", "c"), ("'cardinalities.' || f", "n", "NULL", "c"), ("'flagged.' || (row_number() OVER (ORDER BY f) - 1)", "NULL", "f", "c WHERE n < 50"),
)

_NAMED = {"l_quantity": "Flow Duration", "l_extendedprice": "Fwd IAT Mean", "l_discount": "Bwd IAT Mean", "l_tax": "Flow Bytes/s", "l_suppkey": "Flow Packets/s", "l_partkey": "Init_Win_bytes_forward"}


def _named(spark: SparkSession, sf_dir: str) -> Subject:
    s = _ITEMS(spark, sf_dir)
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnsRenamed(_NAMED)
    return Subject(df, df, s.cfg, row_id="l_orderkey")


FINGERPRINT = _sql(
    "c AS (SELECT count(*) / 9 AS s FROM (DESCRIBE lineitem) WHERE column_name IN (" + ", ".join(f"'{c}'" for c in _NAMED) + "))",
    _status("WHEN s >= 0.6 THEN 'warning' ELSE 'ok'", "c"), ("'CICFlowMeter.match_share'", "s", "NULL", "c WHERE s >= 0.6"),
)


def _joined(spark: SparkSession, sf_dir: str) -> Subject:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    d = read("documents").join(read("labels"), "doc_id", "left").select("doc_id", "lang", "n_chars", "quality", F.lit(1).alias("one"), F.when(F.col("n_chars") % 7 == 0, float("inf")).otherwise(F.col("n_chars").cast("double")).alias("ratio"))
    cfg = config.merge(config.DEFAULTS, {"schema": {"label_column": "quality", "drop_columns": ["doc_id"]}})
    return Subject(d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0"), cfg, row_id="doc_id")


INTEGRITY = _sql(
    """d AS (SELECT d.lang, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE doc_id % 5 <> 0),
m AS (SELECT 'lang' AS f, count(*) FILTER (WHERE lang IS NULL) AS n, count(DISTINCT lang) <= 1 AS one FROM d UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL), count(DISTINCT n_chars) <= 1 FROM d UNION ALL SELECT 'one', 0, true UNION ALL SELECT 'ratio', count(*) FILTER (WHERE n_chars IS NULL), false FROM d),
i AS (SELECT count(*) FILTER (WHERE n_chars % 7 = 0) AS n FROM d), s AS (SELECT count(*) FILTER (WHERE quality IS NULL) AS lost FROM d)""",
    _status("WHEN lost > 0 THEN 'flag' ELSE 'warning'", "s"), ("'missing_label_count'", "lost", "NULL", "s"), ("'missing_by_feature.' || f", "n", "NULL", "m WHERE n > 0"), ("'inf_by_feature.ratio'", "n", "NULL", "i WHERE n > 0"),
    ("'constant_features.' || (row_number() OVER (ORDER BY array_position(['lang', 'n_chars', 'one', 'ratio'], f)) - 1)", "NULL", "f", "m WHERE one"),
)

_CUSTOMERS = {"label_column": "c_mktsegment", "drop_columns": ["c_custkey"]}


def _copied(spark: SparkSession, sf_dir: str, other_label: bool) -> Subject:
    """Customers by two numbers, of which every third of train is also in test, or every seventh is there again under the next segment."""
    x = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    train, test = x.where("c_custkey % 5 <> 0"), x.where("c_custkey % 5 = 0")
    more = train.where(f"c_custkey % {7 if other_label else 3} = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    if other_label:
        train = train.unionByName(more.withColumn("c_mktsegment", F.concat("c_mktsegment", F.lit("+"))))
    else:
        test = test.unionByName(more)
    return Subject(train, test, config.merge(config.DEFAULTS, {"schema": _CUSTOMERS}), row_id="c_custkey")


# the checks look at all rows
NEAR_DUPLICATE = _sql(
    """x AS (SELECT c_custkey AS i, c_acctbal AS a, c_nationkey AS b, c_mktsegment AS y FROM customer WHERE c_custkey % 5 <> 0),
t AS (SELECT * FROM x UNION ALL SELECT i + 10000000, a, b, y || '+' FROM x WHERE i % 7 = 0),
c AS (SELECT y FROM t GROUP BY 1 HAVING count(*) >= 20), k AS (SELECT t.* FROM t SEMI JOIN c USING (y)),
n AS (SELECT p.i, any_value(p.y) AS y, min(q.y) FILTER (WHERE q.y <> p.y) AS o FROM k p JOIN k q ON p.a = q.a AND p.b = q.b AND p.i <> q.i GROUP BY p.i HAVING count(*) FILTER (WHERE q.y <> p.y) > 0),
pairs AS (SELECT least(y, o) || ' / ' || greatest(y, o) AS pair, count(*) AS m FROM n GROUP BY 1 ORDER BY m DESC, pair LIMIT 5), s AS (SELECT (SELECT count(*) FROM c) AS classes, (SELECT count(*) FROM n) AS rows)""",
    _status("WHEN classes < 2 THEN 'not_applicable' WHEN rows > 0 THEN 'flag' ELSE 'ok'", "s"), *_numbers("s WHERE classes >= 2", classes_tested="classes", affected_rows="rows"), ("'top_pairs.' || pair", "m", "NULL", "pairs"),
)

_Z = 1.959964
_wilson = lambda k, n, sign: f"(({k} / {n} + {_Z * _Z} / (2 * {n})) {sign} {_Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {_Z * _Z} / (4 * {n} * {n}))) / (1 + {_Z * _Z} / {n})"
HOMOGENEITY = _sql(
    f"""tr AS (SELECT c_custkey AS i, c_acctbal AS a, c_nationkey AS b, c_mktsegment AS y FROM customer WHERE c_custkey % 5 <> 0),
te AS (SELECT c_custkey AS i, c_acctbal AS a, c_nationkey AS b, c_mktsegment AS y FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT * FROM tr WHERE i % 3 = 0),
v AS (SELECT a, b, count(*) AS m FROM tr GROUP BY 1, 2), big AS (SELECT y FROM (SELECT y FROM tr GROUP BY 1 HAVING count(*) >= 20) SEMI JOIN (SELECT y FROM te GROUP BY 1 HAVING count(*) >= 20) USING (y)),
p AS (SELECT y, count(*) AS n1, count(m) AS k1 FROM te LEFT JOIN v USING (a, b) GROUP BY 1), q AS (SELECT y, count(*) AS n2, count(*) FILTER (WHERE m > 1) AS k2 FROM tr JOIN v USING (a, b) GROUP BY 1),
r AS (SELECT y, k1 / n1 AS x, k2 / n2 AS z, {_wilson('k1', 'n1', '-')} AS l1, {_wilson('k1', 'n1', '+')} AS u1, {_wilson('k2', 'n2', '-')} AS l2, {_wilson('k2', 'n2', '+')} AS u2 FROM p JOIN q USING (y) SEMI JOIN big USING (y)),
c AS (SELECT *, x - z - sqrt((x - l1) ** 2 + (u2 - z) ** 2) AS lo, x - z + sqrt((u1 - x) ** 2 + (z - l2) ** 2) AS hi FROM r),
d AS (SELECT *, CASE WHEN lo > 0.05 THEN 'leakage' WHEN hi < -0.05 THEN 'below_control' WHEN hi < 0.05 THEN 'equivalent' ELSE 'inconclusive' END AS kind FROM c)""",
    ("'status'", "NULL", "CASE WHEN count(*) = 0 THEN 'not_applicable' WHEN bool_or(kind = 'leakage') THEN 'flag' WHEN bool_or(kind = 'inconclusive') THEN 'warning' ELSE 'ok' END", "d"),
    *[(f"'per_class.' || y || '.{k}'", v, "NULL", "d") for k, v in (("test_near_zero_rate", "x"), ("control_near_zero_rate", "z"), ("rate_diff_ci_95.0", "lo"), ("rate_diff_ci_95.1", "hi"), ("equivalence_margin", "0.05"))],
    ("'per_class.' || y || '.classification'", "NULL", "kind", "d"), ("'equivalence_margin'", "0.05", "NULL", "(SELECT 1 FROM d LIMIT 1)"),
)

#: Of each check its subject, what of its details is left out here, and its SQL.
HELD: dict[str, tuple[Make, tuple[str, ...], str]] = {
    "dedup_check": (_DOCUMENTS, (), DEDUP),
    "label_conflict_check": (_DOCUMENTS, (), LABEL_CONFLICT),
    "one_rule_check": (_ITEMS, ("rule",), ONE_RULE),
    "feature_auc_ranking_check": (_ITEMS, (), FEATURE_AUC),
    "identity_column_flag": (_EVENTS, (), IDENTITY),
    "port_protocol_shortcut_check": (_with_ports, (), PORT),
    "temporal_realism_check": (_EVENTS, (), TEMPORAL),
    "near_duplicate_class_check": (lambda spark, sf_dir: _copied(spark, sf_dir, True), (), NEAR_DUPLICATE),
    "homogeneity_test": (lambda spark, sf_dir: _copied(spark, sf_dir, False), (), HOMOGENEITY),
    "flow_group_leakage_check": (_FLOWS, (), FLOWS),
    "row_order_leakage_check": (_EVENTS, (), ORDER),
    "class_distribution_report": (_of("orders", "o_orderkey", {"label_column": "o_orderstatus"}, "o_orderkey"), (), CLASSES),
    "low_cardinality_warning": (_of("lineitem", "l_orderkey", {"label_column": "l_returnflag", "id_like_columns": list(_ID_COLUMNS)}, "l_orderkey"), (), CARDINALITY),
    "schema_fingerprint_check": (_named, (), FINGERPRINT),
    "data_integrity_check": (_joined, (), INTEGRITY),
}


def queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """For each check of HELD the query and its SQL, under check_ and its name."""
    def make(name: str, subject: Make, leave_out: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = checks()[name].run(subject(spark, sf_dir))
            for of_tool in found["details"].values():
                if isinstance(of_tool, dict):
                    of_tool.pop("warning", None)  # prose
            return flat(spark, found, leave_out)

        return run

    return {f"check_{n}": (make(n, s, out), sql) for n, (s, out, sql) in HELD.items()}
