import pytest

from compare import same, view
from plumbline import config
from plumbline.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), view(small), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {f"check_{c}" for c in config.CHECKS}))
def test_query_answers(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_partitioning_does_not_matter(spark, small):
    names = ["dedup_stats", "feature_auc_ranking", "row_order_contiguity", "reservoir_sample"]
    first = {n: sorted(map(tuple, queries.QUERIES[n](spark, small).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        for n in names:
            assert sorted(map(tuple, queries.QUERIES[n](spark, small).collect())) == first[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
