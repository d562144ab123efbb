"""Every query against its DuckDB oracle on the smallest scale factor."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from surgewatch.plans import catalog, oracle
from surgewatch.sources.fixtures import TABLES
from tests.conftest import SF_SMALL



def _norm(v):
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "item"):
        v = v.item()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)),
                        key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_key_has_an_oracle():
    # trained networks, a random split and file sizes have no SQL
    without = {"classify_spikes", "training_error", "eval_network", "spike_job", "split_random", "table_sizes"}
    assert set(oracle.oracle_sql()) == set(catalog.queries()) - without


def test_trained_keys_return_their_results(spark):
    scored = entry.queries()["classify_spikes"](spark, SF_SMALL).cache()
    rows, right = scored.count(), scored.filter("label = predicted_label").count()
    most = scored.groupBy("label").count().agg({"count": "max"}).first()[0]
    assert right > most and scored.filter("predicted_label is null or size(probabilities) <> 3").isEmpty()
    report = entry.queries()["spike_job"](spark, SF_SMALL).collect()
    assert sum(r["count"] for r in report) == rows and {"recall_pct", "accuracy_pct"} <= set(report[0].asDict())
    assert report[0].accuracy_pct > 100 * most / rows
    split = {r.part: r["count"] for r in entry.queries()["split_random"](spark, SF_SMALL).groupBy("part").count().collect()}
    assert set(split) == {"train", "test"} and 0.1 < split["train"] / sum(split.values()) < 0.3


@pytest.mark.parametrize("key", sorted(oracle.oracle_sql()))
def test_query_equals_oracle(spark, duck, key):
    got = _rows(entry.queries()[key](spark, SF_SMALL).toPandas())
    want = _rows(duck.execute(entry.oracle_sql()[key]).fetchdf())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert {"client_id", "country", "hour", "label", "pct"} <= set(df.columns)
    labels = {r.label for r in df.select("label").distinct().collect()}
    assert labels <= {"NO_SPIKE", "SPIKE", "BIG_SPIKE"} and df.count() == 951
