"""Group-by, join and set operators behind the checks. Each answers with a small DataFrame and one shuffle of partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_infinite, null_safe
from .splits import sample_rows


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(cls, n, share) of the labels that are present."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("cls")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # one row a class


def both(train: DataFrame, test: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The rows of both sides with __test telling them apart."""
    names = [*columns, *more]
    return train.select(*names, F.lit(False).alias("__test")).unionByName(test.select(*names, F.lit(True).alias("__test")))


def duplicate_stats(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct rows and rows dropped on either side, train first, then test rows that match train, then the rest's repeats.

    One aggregate by key answers all three steps: grouping treats nulls as equal, and hot keys combine before the shuffle.
    """
    by = both(train, test, keys).groupBy(*keys).agg(F.count_if(~F.col("__test")).alias("a"), F.count_if(F.col("__test")).alias("b"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    leak = F.when(F.col("a") > 0, F.col("b")).otherwise(0)
    again = F.when((F.col("a") == 0) & (F.col("b") > 0), F.col("b") - 1).otherwise(0)
    s = by.agg(total("a").alias("train_rows_raw"), F.count_if(F.col("a") > 0).alias("train_rows_deduped"), total("b").alias("test_rows_raw"), total(leak).alias("test_leakage_dropped"), total(again).alias("test_duplicates_dropped"))
    return s.select("train_rows_raw", "train_rows_deduped", (F.col("train_rows_raw") - F.col("train_rows_deduped")).alias("train_duplicates_dropped"), "test_rows_raw", (F.col("test_rows_raw") - F.col("test_leakage_dropped") - F.col("test_duplicates_dropped")).alias("test_rows_deduped"), "test_leakage_dropped", "test_duplicates_dropped")


def duplicate_rates(df: DataFrame, keys: list[str], cls: str, row_id: str, least: int = 20) -> DataFrame:
    """(cls, n, rate): share of a class's rows that repeat an earlier row (by row_id) of any class."""
    by = df.groupBy(*keys, F.col(cls).alias("cls")).agg(F.count("*").alias("n"), F.min(row_id).alias("first"))
    lowest = F.min("first").over(Window.partitionBy(*keys))  # at most one row a class
    marked = by.withColumn("dup", F.col("n") - F.when(F.col("first") == lowest, 1).otherwise(0))
    out = marked.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.sum("n").alias("n"), F.sum("dup").alias("dup"))
    return out.where(F.col("n") >= least).select("cls", "n", (F.col("dup") / F.col("n")).alias("rate"))


def leak_rates(train: DataFrame, test: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """(cls, n, rate): share of each class's test rows whose key occurs in train."""
    by = both(train, test, keys, cls).groupBy(*keys, F.col(cls).alias("cls")).agg(F.count_if(~F.col("__test")).alias("a"), F.count_if(F.col("__test")).alias("b"))
    seen = F.sum("a").over(Window.partitionBy(*keys)) > 0
    return by.withColumn("leak", F.when(seen, F.col("b")).otherwise(0)).where("cls is not null and b > 0").groupBy("cls").agg(F.sum("b").alias("n"), (F.sum("leak") / F.sum("b")).alias("rate"))


def keep_first(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """The row with the least row_id of every key, by one aggregate that combines before the shuffle."""
    rest = [row_id, *[c for c in df.columns if c != row_id]]
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*rest), row_id).alias("r")).select("r.*").select(*df.columns)


def without_matches(test: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Test rows whose key is nowhere in train, nulls matching nulls."""
    known = train.select(*keys).distinct()
    return test.join(known, null_safe(test, known, keys), "left_anti")


def matches(test: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    known = train.select(*keys).distinct()
    return test.join(known, null_safe(test, known, keys), "left_semi")


def label_conflicts(train: DataFrame, test: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row: keys that carry more than one label, their rows and share, and those found on both sides."""
    by = both(train, test, keys, label).groupBy(*keys).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("bad"), (F.min("__test") != F.max("__test")).alias("cross"))
    bad = F.coalesce(F.col("bad"), F.lit(False))
    s = by.agg(F.count_if(bad).alias("conflicting_groups"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("conflicting_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(bad & F.col("cross")).alias("cross_split_conflicting_groups"))
    return s.withColumn("pct", F.coalesce(100 * F.try_divide("conflicting_rows", "rows"), F.lit(0.0)))


def conflict_rates(train: DataFrame, test: DataFrame, keys: list[str], label: str, cls: str, least: int = 20) -> DataFrame:
    """(cls, n, rate): share of each class's rows whose key carries more than one label."""
    more = [cls] if cls != label else []
    by = both(train, test, keys, label, *more).groupBy(*keys, F.col(cls).alias("cls")).agg(F.count("*").alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    w = Window.partitionBy(*keys)
    x = by.withColumn("bad", F.coalesce(F.min("lo").over(w) != F.max("hi").over(w), F.lit(False))).where("cls is not null")
    return x.groupBy("cls").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rate")).where(F.col("n") >= least)


def group_overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """One row: identities on both sides and the rows they touch on each."""
    by = both(train, test, keys).groupBy(*keys).agg(F.count_if(~F.col("__test")).alias("a"), F.count_if(F.col("__test")).alias("b")).where("a > 0 and b > 0")
    return by.agg(F.count("*").alias("overlapping_identities"), F.coalesce(F.sum("a"), F.lit(0)).alias("train_rows_affected"), F.coalesce(F.sum("b"), F.lit(0)).alias("test_rows_affected"))


def integrity(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """(feature, missing, infinite, constant), the label under its own name first, from one pass."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*([label] if label else []), *features]
    parts: list[Column] = []
    for c in names:
        x, floating = F.col(c), kinds[c] in ("float", "double")
        gone = x.isNull() | F.isnan(x) if floating else x.isNull()
        parts.append(F.struct(F.lit(c).alias("feature"), F.count_if(gone).alias("missing"), (F.count_if(F.coalesce(is_infinite(x), F.lit(False))) if floating else F.lit(0)).cast("long").alias("infinite"), F.coalesce((F.min(F.when(~gone, x)).eqNullSafe(F.max(F.when(~gone, x)))), F.lit(True)).alias("constant")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_distinct) of each column without nulls."""
    one = [df.agg(F.countDistinct(c).alias("n_distinct")).select(F.lit(c).alias("feature"), "n_distinct") for c in columns]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


def class_spans(df: DataFrame, seconds: Column, cls: str, least: int = 20) -> DataFrame:
    """(cls, n, ratio): time span of each class over that of all rows."""
    x = df.select(seconds.alias("s"), F.col(cls).alias("cls")).where("s is not null")
    by = x.groupBy("cls").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row a class
    whole = F.max("hi").over(w) - F.min("lo").over(w)
    return by.withColumn("ratio", F.try_divide(F.col("hi") - F.col("lo"), whole)).where(F.col("cls").isNotNull() & (F.col("n") >= least)).select("cls", "n", "ratio")


def lookup_scores(train: DataFrame, test: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(*keys, cls, n, y_n, p, seen): smoothed probability of each class for each key of test, with its rows there.

    p = (n_key,cls + prior) / (n_key + 1); a key that train lacks has the prior. y_n is how many of the key's test rows are of the class.
    The result has a row for each key of test and class of train, so it is as large as test's distinct keys.
    """
    prior = class_counts(train, label).select("cls", F.col("share").alias("prior"))
    known = train.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("cls")).agg(F.count("*").alias("n_kc"))
    table = known.groupBy(*keys).agg(F.sum("n_kc").alias("n_k"), F.map_from_entries(F.collect_list(F.struct(F.col("cls").cast("string"), "n_kc"))).alias("by"))
    asked = test.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("y")).agg(F.count("*").alias("n_ky"))
    asked = asked.join(prior.select(F.col("cls").alias("y")), "y", "left_semi")
    asked = asked.groupBy(*keys).agg(F.sum("n_ky").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("string"), "n_ky"))).alias("ys"))
    joined = asked.join(table, null_safe(asked, table, keys), "left").select(*[asked[k] for k in keys], "n", "ys", "n_k", "by")
    classes = prior.agg(F.collect_list(F.struct(F.col("cls").cast("string").alias("cls"), "prior")).alias("classes"))  # one row
    x = joined.crossJoin(F.broadcast(classes)).select("*", F.inline("classes")).drop("classes")
    p = F.coalesce((F.coalesce(F.try_element_at("by", F.col("cls")), F.lit(0)) + F.col("prior")) / (F.col("n_k") + 1), F.col("prior"))
    return x.select(*keys, "cls", "n", F.coalesce(F.try_element_at("ys", F.col("cls")), F.lit(0)).alias("y_n"), p.alias("p"), F.col("n_k").isNotNull().alias("seen"))


def map_labels(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """df with the values of a column replaced where the mapping has them."""
    if not mapping:
        return df
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(m, F.col(column).cast("string")), F.col(column).cast("string")))


def mix_divergence(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """One row (js, max_diff): squared Jensen-Shannon distance in bits and the largest difference of the class shares."""
    a, b = class_counts(train, label).selectExpr("cls", "share as p"), class_counts(test, label).selectExpr("cls", "share as q")
    x = a.join(b, "cls", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("m"))).otherwise(0.0)
    return x.agg((F.sum(part("p")) / 2 + F.sum(part("q")) / 2).alias("js"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_diff"))


def expected_unseen(df: DataFrame, identity: str, group: str, q: float = 0.2) -> DataFrame:
    """One row: share of a held-out fifth of groups' rows whose identity train would lack, in expectation."""
    by = df.groupBy(identity).agg(F.count("*").alias("n"), F.countDistinct(group).alias("g"))
    return by.agg((F.sum(F.col("n") * F.pow(F.lit(q), F.col("g"))) / (q * F.sum("n"))).alias("expected_unseen"), F.count("*").alias("identities"))


def matched_and_novel(train: DataFrame, test: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(matched, n, agreement): test rows by whether train has their key, and how often its most common label there (ties: the lowest) is theirs."""
    votes = train.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    major = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("y"))).alias("v")).select(*keys, F.col("v.y").alias("__y"), F.lit(True).alias("__seen"))
    x = test.join(major, null_safe(test, major, keys), "left").select(test[label].alias("y"), "__y", F.coalesce("__seen", F.lit(False)).alias("matched"))
    return x.groupBy("matched").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("__y")).cast("double")).alias("agreement"))


def reuse_advantage(df: DataFrame, stratum: str, reused: Column, correct: Column, least_novel: int = 20) -> DataFrame:
    """One row: accuracy on reused rows less that on novel rows, standardised to the strata of the reused rows."""
    x = df.select(F.col(stratum).alias("s"), reused.alias("r"), correct.cast("double").alias("c")).groupBy("s").agg(F.count_if("r").alias("w"), F.count_if(~F.col("r")).alias("m"), F.avg(F.when(F.col("r"), F.col("c"))).alias("a"), F.avg(F.when(~F.col("r"), F.col("c"))).alias("b"))
    x = x.where((F.col("m") >= least_novel) & (F.col("w") > 0))
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    return x.agg(F.count("*").alias("strata"), mean("a").alias("reused_accuracy"), mean("b").alias("novel_accuracy"), (mean("a") - mean("b")).alias("advantage"))


def reservoir(df: DataFrame, k: int, seed: int, row_id: str) -> DataFrame:
    """Exactly min(n, k) rows, uniform, the same for any partitioning: the least by a hash of the row's id."""
    return sample_rows(df, k, seed, row_id)


def ordered_content_hash(df: DataFrame, columns: list[str], row_id: str) -> str:
    """Digest of the rows in the order of row_id: each row's hash is taken with its place, which is counted in ranges of the order."""
    from hashlib import sha256

    from ..functions.exprs import row_hash
    from .ranks import cumulative

    rows = df.select(row_hash(*columns).alias("h"), F.col(row_id).alias("at"), F.lit(0).alias("g"), F.lit(1).alias("one"))
    placed = cumulative(rows, ["g"], "at", {"one": "place"})
    total = placed.agg(F.sum(F.xxhash64("place", "h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return sha256(f"{int(total['s'] or 0) % 2**64}:{total['n']}:{','.join(columns)}".encode()).hexdigest()


def content_hash(df: DataFrame, columns: list[str]) -> str:
    """Digest of the rows as a multiset: equal for any order or split, different if a row's count differs."""
    from hashlib import sha256

    from ..functions.exprs import row_hash

    total = df.select(row_hash(*sorted(columns)).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return sha256(f"{int(total['s'] or 0) % 2**64}:{total['n']}:{','.join(sorted(columns))}".encode()).hexdigest()
