"""What the plans must look like: pushed filters, split hot keys, one scan, few exchanges."""

import re

import pytest

from surgewatch.operators import classify, search
from surgewatch.plans import catalog
from surgewatch.sources import fixtures
from surgewatch.sources.fixtures import Tables
from tests.conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return len(re.findall(r"[+:]- Exchange (?!SinglePartition)", plan))


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_match_any_reaches_the_scan(spark, tmp_dir):
    flat = fixtures.sales(Tables(spark, SF_SMALL))
    flat.write.mode("overwrite").parquet(f"{tmp_dir}/flat")
    plan = plan_of(search.match_any(spark.read.parquet(f"{tmp_dir}/flat"), {"client_id": 89, "country": "NATION_7"}, "sale_id"))
    assert re.search(r"PushedFilters: \[Or\(EqualTo\(client_id,89\),EqualTo\(country,NATION_7\)\)\]", plan)


@pytest.mark.parametrize("key", ["sales_hourly_flat", "spike_label_flat", "spike_label_nested", "monthly_counts_sql"])
def test_hot_keys_are_split_in_row_level_joins(spark, no_broadcast, key):
    plan = plan_of(catalog.QUERIES[key](spark, SF_SMALL))
    joins = [x for x in re.findall(r"(?:SortMergeJoin|ShuffledHashJoin) \[([^\]]*)\]", plan) if "_salt" in x]
    assert joins and re.search(r"hashpartitioning\((?:client_id|agent_code)#\d+L?, _salt#\d+", plan)


def test_copies_of_a_large_dimension_are_not_broadcast(spark):
    """Copies count at their full size: a dimension below the broadcast limit, its copies above it."""
    dimension = spark.range(5000).selectExpr("id as client_id", "cast(id % 7 as int) as nationkey")
    facts = spark.range(200_000).selectExpr("id as sale_id", "if(id % 3 = 0, 1, id % 6000) as client_id", "id % 13 as amount", "id as more")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(5000 * 16 * 4))
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(facts.join(dimension, "client_id"))
        salted = fixtures._salted_join(facts, dimension, "client_id", "sale_id")
        assert "BroadcastHashJoin" not in plan_of(salted)
        assert salted.exceptAll(facts.join(dimension, "client_id").select(salted.columns)).count() == 0
        assert salted.count() == facts.join(dimension, "client_id").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_a_third_of_all_rows_on_one_client(spark, no_broadcast, tmp_dir):
    """The hot client's rows are dealt over many tasks, and the sums stay right."""
    base = Tables(spark, SF_SMALL)
    events = base["events"]
    n = events.count()
    hot = events.limit(n // 2).selectExpr("event_id + 1000000 as event_id", "ts", "cast(1 as bigint) as user_id", "event_type", "value", "props")
    events.unionByName(hot).write.mode("overwrite").parquet(f"{tmp_dir}/events.parquet")
    for name in ("customer", "nation"):
        base[name].write.mode("overwrite").parquet(f"{tmp_dir}/{name}.parquet")
    t = Tables(spark, tmp_dir)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    salted = fixtures._salted_join(t["events"].selectExpr("user_id as client_id", "event_id"), fixtures._client_nations(t), "client_id", "event_id")
    dealt = salted.filter("client_id = 1").selectExpr("spark_partition_id() as p").distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt > 1
    a = {tuple(r) for r in catalog.QUERIES["sales_hourly_flat"](spark, tmp_dir).collect()}
    b = {tuple(r) for r in catalog.QUERIES["sales_hourly"](spark, tmp_dir).collect()}
    assert a == b and any(r[0] == 1 for r in a)


def test_client_buckets_read_the_events_once(spark):
    frames = []
    original = fixtures.Tables.__getitem__

    def counted(self, name):
        frames.append(name)
        return original(self, name)

    fixtures.Tables.__getitem__ = counted
    try:
        plan = plan_of(catalog.QUERIES["client_buckets"](spark, SF_SMALL))
    finally:
        fixtures.Tables.__getitem__ = original
    assert frames.count("events") == 1 and "events.parquet" not in plan   # what is left reads the written buckets


def test_alerts_take_one_exchange_and_push_the_country(spark):
    t = Tables(spark, SF_SMALL)
    assert exchanges(plan_of(fixtures.alerts(t))) == 1
    assert exchanges(plan_of(catalog.QUERIES["alerts_by_country"](spark, SF_SMALL))) == 2
    plan = plan_of(catalog.QUERIES["filter_country"](spark, SF_SMALL))
    assert exchanges(plan) == 1 and "EqualTo(n_name,NATION_7)" in plan


def test_latest_history_ranks_in_one_scan(spark):
    plan = plan_of(catalog.QUERIES["latest_history"](spark, SF_SMALL))
    assert exchanges(plan) == 2 and plan.count("o_custkey") and len(re.findall(r"FileScan parquet \[o_", plan)) == 1


def test_no_single_task_size_check(spark):
    for key in ("spike_label", "client_buckets", "monthly_counts"):
        plan = plan_of(catalog.QUERIES[key](spark, SF_SMALL))
        assert not re.search(r"GlobalLimit[^\n]*\n[^\n]*Exchange SinglePartition", plan)


def test_random_split_is_disjoint_and_complete(spark):
    rows = spark.range(5000).selectExpr("id", "rand() as noise")   # not repeatable unless written
    train, test = classify.split_random(rows, 0.3, seed=5)
    a, b = ({r.id for r in x.collect()} for x in (train, test))
    assert not a & b and len(a | b) == 5000 and 1200 < len(a) < 1800
    assert train.join(test, "noise").count() == 0
