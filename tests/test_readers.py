import pytest

from surgewatch.sources import readers
from surgewatch.sources.fixtures import Tables, tickets
from tests.conftest import SF_SMALL


def test_require_columns_nested(spark):
    tk = tickets(Tables(spark, SF_SMALL))
    readers.require_columns(tk, ["ticket.issueDate", "ticket.cashAmount"])
    with pytest.raises(ValueError, match="ticket.nope"):
        readers.require_columns(tk, ["ticket.nope"])


def test_read_files_glob_and_list(spark, tmp_dir):
    t = Tables(spark, SF_SMALL)
    t["nation"].write.parquet(f"{tmp_dir}/sales-1")
    t["nation"].write.parquet(f"{tmp_dir}/sales-2")
    assert readers.read_files(spark, f"{tmp_dir}/sales-*").count() == 50
    assert readers.read_files(spark, [f"{tmp_dir}/sales-1"], columns=["n_name"]).count() == 25
    t["nation"].write.json(f"{tmp_dir}/j")
    assert readers.read_files(spark, f"{tmp_dir}/j", "json", schema="n_name string").columns == ["n_name"]


def test_jdbc_options():
    o = readers.jdbc_options("jdbc:x://h/db", "s.t", user="u", password="p", partition_column="id",
                             lower_bound=0, upper_bound=100, num_partitions=4, fetch_size=1000, batch_size=5000)
    assert o == {"url": "jdbc:x://h/db", "dbtable": "s.t", "user": "u", "password": "p", "partitionColumn": "id",
                 "lowerBound": "0", "upperBound": "100", "numPartitions": "4", "fetchsize": "1000",
                 "batchsize": "5000"}
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x://h/db", "t", partition_column="id")


def test_document_store_needs_connector(spark):
    with pytest.raises(Exception):
        readers.read_document_store(spark, "sales-*", "no.such.connector", {"host": "h"}, query='{"match_all":{}}')


def test_broadcast_if_small(spark, tmp_dir):
    from surgewatch.session import broadcast_if_small

    small = spark.range(10)
    plan = small.join(broadcast_if_small(small, 10), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    assert broadcast_if_small(small, 9) is small                 # one row over the bound: no hint
    spark.range(3).write.parquet(f"{tmp_dir}/s")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_dir}/s")
    assert broadcast_if_small(stream, 10) is stream


def test_document_store_options_per_read():
    base = {"es.nodes": "h", "es.port": "9200"}
    a = readers.document_store_options("sales-*", base, '{"match_all":{}}')
    b = readers.document_store_options("sales-*", base)
    assert a == {"es.nodes": "h", "es.port": "9200", "es.resource": "sales-*", "es.query": '{"match_all":{}}'}
    assert "es.query" not in b and base == {"es.nodes": "h", "es.port": "9200"}   # caller's dict untouched


def covered(predicates, keys):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT)")
    con.executemany("INSERT INTO t VALUES (?)", [(k,) for k in keys])
    return [con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in predicates]


def test_equi_depth_ranges_cover_skewed_keys_once(spark):
    import random

    rnd = random.Random(2)
    skewed = [7] * 900 + [rnd.randrange(1000) for _ in range(500)] + [10**9 + rnd.randrange(50) for _ in range(600)] + [-(10**12)] + [None] * 40
    df = spark.createDataFrame([(k,) for k in skewed], "k bigint")
    steps = readers.key_histogram(df, "k", bins=1 << 20)
    assert sum(n for *_, n in steps) == 2001
    for parts in (1, 2, 5, 8, 64):
        counts = covered(readers.range_predicates("k", readers.equi_depth_bounds(steps, parts)), skewed)
        assert sum(counts) == len(skewed) and len(counts) <= parts
    even = [(i, i, 10) for i in range(100)]
    assert covered(readers.range_predicates("k", readers.equi_depth_bounds(even, 4)), [i for i in range(100) for _ in range(10)]) == [250] * 4
    assert readers.equi_depth_bounds([], 8) == [] and readers.range_predicates("k", []) == ["1 = 1"]
    assert readers.equi_depth_bounds([(5, 5, 100)], 4) == []
    with pytest.raises(ValueError):
        readers.range_predicates("k", [3, 3])
