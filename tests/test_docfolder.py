from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from surgewatch.sources import docfolder, tables

SCHEMA = "id bigint, at timestamp_ntz, seen timestamp, name string, details struct<client_id: bigint, amount: double>, tags array<string>"
PUSH = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture()
def pushing(spark):
    before = spark.conf.get(PUSH, None)
    spark.conf.set(PUSH, "true")
    yield
    spark.conf.unset(PUSH) if before is None else spark.conf.set(PUSH, before)


@pytest.fixture()
def folder(spark, tmp_dir):
    start = datetime(2024, 1, 1, 0, 0, 0, 125)
    rows = [(i, start + timedelta(hours=i), start + timedelta(hours=i), f"n{i % 3}" if i % 5 else None, (i % 7, i / 8) if i % 11 else None, ["x"] * (i % 3))
            for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    frames = {"sales-1": df.filter("id < 120").repartitionByRange(6, "at"), "sales-2": df.filter("id >= 120").repartitionByRange(4, "at"),
              "other": spark.range(3).toDF("k")}
    tables.export_tables(spark, frames, tmp_dir)
    docfolder.write_stats(spark, tmp_dir, {n: f.schema for n, f in frames.items()}, ["at", "id", "details.client_id"])
    return tmp_dir, df


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_wildcard_reads_all_rows(spark, folder):
    root, df = folder
    got = docfolder.read_document_folder(spark, root, "sales-*")
    assert got.schema == df.schema and same(got, df)
    assert same(docfolder.read_document_folder(spark, root, "sales-2"), df.filter("id >= 120"))
    with pytest.raises(Exception, match="another schema"):
        docfolder.read_document_folder(spark, root)
    with pytest.raises(Exception, match="no table"):
        docfolder.read_document_folder(spark, root, "none-*")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


TESTS = ["at >= timestamp_ntz '2024-01-03 00:00:00' and at < timestamp_ntz '2024-01-04 12:00:00'", "id = 150", "id > 190 and name = 'n1'", "details.client_id <= 2",
         "name is not null and id < 7", "id >= 1000", "name like 'n%' and id <= 30", "seen > timestamp '2024-01-08 00:00:00'", "id = 3 or id = 170"]


@pytest.mark.parametrize("where", TESTS)
def test_filters_give_the_same_rows(spark, folder, pushing, where):
    root, df = folder
    got = docfolder.read_document_folder(spark, root, "sales-*").filter(where)
    assert same(got, df.filter(where))
    assert got.agg(F.count("id")).first()[0] == df.filter(where).count()


def test_a_pushed_range_is_in_the_plan_and_files_are_skipped(spark, folder, pushing):
    root, _ = folder
    all_files = docfolder.read_document_folder(spark, root, "sales-*")
    some = all_files.filter(TESTS[0])
    assert all_files.rdd.getNumPartitions() == 10 and some.rdd.getNumPartitions() <= 4
    # nothing is left for Spark to test above the scan
    assert "+- Filter" not in plan_of(some) and ") Filter" not in plan_of(some)
    spark.conf.set(PUSH, "false")
    late = docfolder.read_document_folder(spark, root, "sales-*").filter(TESTS[0])
    assert ") Filter (" in plan_of(late) and late.rdd.getNumPartitions() == 10 and same(late, some)
    spark.conf.set(PUSH, "true")
    assert all_files.filter("id >= 1000").rdd.getNumPartitions() == 1   # an empty read
