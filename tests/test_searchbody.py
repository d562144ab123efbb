import json
from datetime import datetime

import pytest

from surgewatch.plans import catalog
from surgewatch.sources import searchbody
from surgewatch.sources.fixtures import Tables, sales_documents
from tests.conftest import SF_SMALL

SCHEMA = "id bigint, at timestamp_ntz, day string, n int, name string, details struct<client_id: bigint, amount: double>"


@pytest.fixture(scope="module")
def docs(spark):
    d = lambda day, hour: datetime(2024, 1, day, hour)
    rows = [(1, d(1, 0), "2024-01-01T00:00:00", 5, "a", (10, 1.5)), (2, d(2, 0), "2024-01-02T00:00:00", 7, "b", (10, 2.25)),
            (3, d(2, 12), "2024-01-02T12:00:00", None, "a", (20, 0.1)), (4, d(3, 0), "2024-01-03T00:00:00", 5, None, (None, 4.0)),
            (5, None, None, 9, "c", None)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(docs, query, now=None):
    return sorted(r.id for r in searchbody.matching(docs, {"query": query}, now).collect())


def test_clauses(docs):
    assert ids(docs, {"match_all": {}}) == [1, 2, 3, 4, 5]
    assert ids(docs, {"term": {"details.client_id": "10"}}) == [1, 2] == ids(docs, {"term": {"details.client_id": {"value": 10}}})
    assert ids(docs, {"terms": {"name": ["a", "c", "z"]}}) == [1, 3, 5] and ids(docs, {"terms": {"name": []}}) == []
    assert ids(docs, {"exists": {"field": "details.client_id"}}) == [1, 2, 3]
    assert ids(docs, {"range": {"n": {"gte": 5, "lt": 9}}}) == [1, 2, 4]
    assert ids(docs, {"bool": {"must": [{"term": {"n": 5}}], "must_not": {"term": {"name": "a"}}}}) == [4]
    assert ids(docs, {"bool": {"must_not": [{"term": {"n": 5}}]}}) == [2, 3, 5]   # a missing field is not 5
    assert ids(docs, {"bool": {}}) == [1, 2, 3, 4, 5]
    should = [{"term": {"name": "a"}}, {"term": {"n": 5}}, {"range": {"at": {"lt": "2024-01-02"}}}]
    assert ids(docs, {"bool": {"should": should}}) == [1, 3, 4]
    assert ids(docs, {"bool": {"should": should, "minimum_should_match": 2}}) == [1]
    assert ids(docs, {"bool": {"should": should, "minimum_should_match": 4}}) == []
    assert ids(docs, {"bool": {"filter": [{"match_all": {}}], "should": should}}) == [1, 2, 3, 4, 5]


def test_date_maths(docs):
    now = "2024-01-03T00:00:00"
    for field in ("at", "day"):
        at = lambda **bounds: ids(docs, {"range": {field: bounds}}, now)  # noqa: E731, B023
        assert at(gt="now-1d", lte="now") == [3, 4] and at(gte="now-1d", lt="now") == [2, 3]
        assert at(gte="2024-01-02T13:00:00||/d", lte="2024-01-02||/d") == [2, 3]
        assert at(gt="2024-01-02||/d") == [4] and at(lt="2024-01-02T13:00:00||/d") == [1]
        assert at(gt="2024-02-02T00:00:00||-1M") == [3, 4] and at(lte="2023-12-25||+1w/w") == [1, 2, 3, 4]
    maths = lambda text: searchbody.date_maths(text, datetime(2024, 3, 31, 10, 20, 30))
    assert maths("now-1M") == (datetime(2024, 2, 29, 10, 20, 30), None) and maths("now/h") == (datetime(2024, 3, 31, 10), "h")
    assert maths("now-1y/M") == (datetime(2023, 3, 1), "M") and maths("now+90m-30s") == (datetime(2024, 3, 31, 11, 50), None)
    assert maths("now/w")[0] == datetime(2024, 3, 25) and maths("now/y")[0] == datetime(2024, 1, 1)


@pytest.mark.parametrize("body", [
    {"query": {"fuzzy": {"name": "a"}}}, {"query": {"term": {"none": 1}}}, {"query": {"term": {"details.none": 1}}},
    {"query": {"range": {"n": {"from": 1}}}}, {"query": {"range": {"n": {}}}}, {"query": {"range": {"at": {"gt": "now-1q"}}}},
    {"query": {"range": {"at": {"gt": "now"}}}}, {"query": {"bool": {"might": []}}}, {"query": {"match_all": {"boost": 2}}},
    {"query": {"term": {"n": 1}, "exists": {"field": "n"}}}, {"highlight": {}}, {"size": "all"}, {"sort": {"n": "up"}}, {"sort": "_score"},
    {"sort": ["none"]}, {"query": {"bool": {"should": [], "minimum_should_match": "75%"}}}])
def test_unknown_parts_raise(docs, body):
    with pytest.raises(ValueError):
        searchbody.hits(docs, json.dumps(body), "id")


def test_hits_order_and_page(docs):
    page = lambda body: [(r.id, r.asDict().get("score")) for r in searchbody.hits(docs, body, "id").collect()]
    assert page('{"query": {"bool": {"should": [{"term": {"name": "a"}}, {"term": {"n": 5}}]}}}') == [(1, 2), (3, 1), (4, 1)]
    assert page('{"size": 2, "from": 1, "sort": [{"n": {"order": "desc"}}]}') == [(2, None), (1, None)]
    assert page('{"sort": "n"}') == [(1, None), (4, None), (2, None), (5, None), (3, None)]
    assert page('{"size": 0}') == [] and page('{"term": {"n": 5}}') == [(1, 1), (4, 1)]


def test_aggregations(docs):
    body = """{"size": 0, "query": {"exists": {"field": "at"}}, "aggs": {
        "clients": {"terms": {"field": "details.client_id", "size": 5}, "aggs": {"total": {"sum": {"field": "details.amount"}}, "most": {"max": {"field": "n"}}}},
        "all": {"sum": {"field": "details.amount"}}, "dated": {"value_count": {"field": "n"}}}}"""
    out = searchbody.aggregations(docs, body, scales={"details.amount": 2})
    assert [tuple(r) for r in out["clients"].collect()] == [(10, 2, 3.75, 7), (20, 1, 0.1, None)]
    assert tuple(out["metrics"].first()) == (7.85, 3)
    with pytest.raises(ValueError, match="median"):
        searchbody.aggregations(docs, {"aggs": {"m": {"median": {"field": "n"}}}})
    with pytest.raises(ValueError, match="include"):
        searchbody.aggregations(docs, {"aggs": {"m": {"terms": {"field": "n", "include": "a"}}}})


def test_a_nested_body_over_documents_equals_the_flat_one(spark):
    t = Tables(spark, SF_SMALL)
    body = catalog.BODIES["buckets"].replace('"client_id"', '"details.client_id"').replace('"amount"}', '"details.amount"}')
    nested = searchbody.aggregations(sales_documents(t), body, scales={"details.amount": 2})["clients"]
    flat = catalog.QUERIES["body_client_buckets"](spark, SF_SMALL)
    assert sorted(tuple(r) for r in nested.collect()) == sorted(tuple(r) for r in flat.collect())


def test_a_range_reaches_the_scan(spark):
    plan = catalog.QUERIES["body_lookback"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2023-10-22T08:50:01)" in plan and "LessThan(ts,2024-01-20T08:50:01)" in plan
