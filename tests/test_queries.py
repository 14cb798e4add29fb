import pytest
from oracle import assert_matches
from pyspark.sql import functions as F

from trellium.plans import oracles, queries

SQL = oracles.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(queries.REGISTRY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    assert_matches(spark, sf, queries.REGISTRY[name], SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_workers_crash_more_than_once(spark):
    """Of ten workers, each with the balances of many suppliers, every line is an episode."""
    sf = "/root/testdata/sf0.01"
    rows = queries.REGISTRY["worker_crashes"](spark, sf).cache()
    assert rows.count() == spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").distinct().count()
    crashed = rows.where("crashed_at is not null").groupBy("worker").agg(F.countDistinct("crashed_at").alias("c")).collect()
    assert len(crashed) == 10 and all(r["c"] > 1 for r in crashed)


def test_events_are_spread_before_conditions_are_judged(spark, sf):
    """A small file is one task's, and judging is what takes the time."""
    assert queries.REGISTRY["state_conditions"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
