"""Search bodies of a document store, given as JSON text, as DataFrame plans.

A body such as ``{"size": 20, "query": {"bool": {"should": [...]}}}`` becomes a filter, an order
and a limit on a frame of documents; its ``aggs`` become grouped aggregations. The filter is an
ordinary column condition, so a range on a time field reaches the scan like any other filter.

| clause | plan |
| --- | --- |
| ``match_all`` | every row |
| ``range`` with ``gt``, ``gte``, ``lt``, ``lte`` | comparisons; on time fields with date maths |
| ``term``, ``terms``, ``exists`` | equality, membership, not null |
| ``bool`` with ``must``, ``filter``, ``should``, ``must_not``, ``minimum_should_match`` | and, or, not, a count of matches |
| ``size``, ``from``, ``sort`` | limit, offset, order (ties by the caller's key) |
| ``aggs``: ``terms`` (``size``, nested metrics) | rows per key, most rows first, ties by key |
| ``aggs``: ``sum``, ``min``, ``max``, ``avg``, ``value_count`` | one row, or a column of the buckets around it |

Anything else raises ``ValueError`` and names what it does not know; nothing is skipped. A null
field matches no clause, so it passes a ``must_not``, as an absent field does in a store. The
score is the number of scoring clauses (``term`` and ``terms`` outside ``filter`` and
``must_not``) that match. Date maths: ``now`` (given by the caller, never read from a clock) or a
date followed by ``||``, then steps such as ``-90d``, ``+1M`` and a rounding such as ``/d``, which
``gt`` and ``lte`` take to the end of the unit and ``gte`` and ``lt`` to its start.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgewatch.functions import money
from surgewatch.functions.timewin import add_months, as_time, time_literal
from surgewatch.operators import rollup

DEFAULT_HITS, DEFAULT_BUCKETS = 10, 10
# The units of date maths, as seconds or as months.
SECONDS = {"w": 7 * 86400, "d": 86400, "h": 3600, "H": 3600, "m": 60, "s": 1}
MONTHS = {"y": 12, "M": 1}
METRICS = ("sum", "min", "max", "avg", "value_count")


def field_type(df: DataFrame, path: str) -> T.DataType:
    """Type of a (dotted) field; raises where there is none."""
    dtype: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(dtype, T.StructType) or part not in dtype.fieldNames():
            raise ValueError(f"no field {path!r}")
        dtype = dtype[part].dataType
    return dtype


def _one(value: object, what: str) -> tuple[str, object]:
    if not isinstance(value, Mapping) or len(value) != 1:
        raise ValueError(f"{what} needs exactly one name, got {value!r}")
    return next(iter(value.items()))


def _known(value: object, names: set[str], what: str) -> Mapping:
    if not isinstance(value, Mapping):
        raise ValueError(f"{what} must be an object, got {value!r}")
    if extra := set(value) - names:
        raise ValueError(f"{what} does not know {sorted(extra)}")
    return value


# ---- date maths ----------------------------------------------------------------------------

def unit_start(when: datetime, unit: str) -> datetime:
    if unit in MONTHS:
        return datetime(when.year, when.month if unit == "M" else 1, 1)
    if unit == "w":
        when -= timedelta(days=when.weekday())
    day = datetime(when.year, when.month, when.day)
    if unit in "wd":
        return day
    return day + timedelta(seconds=(when - day) // timedelta(seconds=SECONDS[unit]) * SECONDS[unit])


def moved(when: datetime, n: int, unit: str) -> datetime:
    return add_months(when, n * MONTHS[unit]) if unit in MONTHS else when + timedelta(seconds=n * SECONDS[unit])


def date_maths(text: str, now: datetime | None) -> tuple[datetime, str | None]:
    """The moment that a date expression names, and the unit that it rounds to (the start of it is returned)."""
    if text.startswith("now"):
        if now is None:
            raise ValueError(f"{text!r} needs a value for now")
        when, steps = now, text[3:]
    else:
        date, _, steps = text.partition("||")
        when = datetime.fromisoformat(date)
    parts = re.findall(r"([+-]\d+|/)([yMwdhHms])", steps)
    if "".join(a + b for a, b in parts) != steps:
        raise ValueError(f"unknown date expression {text!r}")
    unit = None
    for sign, unit_of in parts:
        unit = unit_of if sign == "/" else None
        when = unit_start(when, unit_of) if sign == "/" else moved(when, int(sign), unit_of)
    return when, unit


def _range(df: DataFrame, field: str, bounds: object, now: datetime | None) -> Column:
    dtype = field_type(df, field)
    is_time = isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType))
    bounds = _known(bounds, {"gt", "gte", "lt", "lte"}, f"range of {field!r}")
    if not bounds:
        raise ValueError(f"range of {field!r} has no bound")
    out = None
    for name, value in bounds.items():
        if is_time and isinstance(value, str):
            col = as_time(F.col(field), dtype)
            kind = T.TimestampNTZType() if isinstance(dtype, T.TimestampNTZType) else T.TimestampType()
            when, unit = date_maths(value, now)
            if unit and name in ("gt", "lte"):   # to the end of the unit
                when, name = moved(when, 1, unit), {"gt": "gte", "lte": "lt"}[name]
            limit = time_literal(when, kind)
        else:
            col, limit = F.col(field), F.lit(value).cast(dtype)
        test = {"gt": col > limit, "gte": col >= limit, "lt": col < limit, "lte": col <= limit}[name]
        out = test if out is None else out & test
    return out


# ---- queries -------------------------------------------------------------------------------

def condition(df: DataFrame, query: object, now: datetime | None = None) -> tuple[Column, list[Column]]:
    """``(filter, scoring clauses)`` of a query clause."""
    kind, body = _one(query, "a query")
    if kind == "match_all":
        _known(body, set(), "match_all")
        return F.lit(True), []
    if kind == "range":
        field, bounds = _one(body, "range")
        return _range(df, field, bounds, now), []
    if kind == "term":
        field, value = _one(body, "term")
        if isinstance(value, Mapping):
            value = _known(value, {"value"}, "term")["value"]
        test = F.col(field) == F.lit(value).cast(field_type(df, field))
        return test, [test]
    if kind == "terms":
        field, values = _one(body, "terms")
        if not isinstance(values, list):
            raise ValueError(f"terms of {field!r} must be a list")
        dtype = field_type(df, field)
        test = F.col(field).isin(*[F.lit(v).cast(dtype) for v in values]) if values else F.lit(False)
        return test, [test]
    if kind == "exists":
        field = str(_known(body, {"field"}, "exists")["field"])
        field_type(df, field)
        return F.col(field).isNotNull(), []
    if kind == "bool":
        return _bool(df, body, now)
    raise ValueError(f"unknown query {kind!r}")


def _bool(df: DataFrame, body: object, now: datetime | None) -> tuple[Column, list[Column]]:
    body = _known(body, {"must", "filter", "should", "must_not", "minimum_should_match"}, "bool")
    clauses = {name: [condition(df, c, now) for c in (body.get(name, []) if isinstance(body.get(name, []), list) else [body[name]])]
               for name in ("must", "filter", "should", "must_not")}
    tests = [c for name in ("must", "filter") for c, _ in clauses[name]]
    # a store wants one of the should clauses, unless others already choose the documents
    least = body.get("minimum_should_match", 0 if tests or not clauses["should"] else 1)
    if not isinstance(least, int) or least < 0:
        raise ValueError(f"minimum_should_match must be a number of clauses, got {least!r}")
    should = [c for c, _ in clauses["should"]]
    if least > len(should):
        tests.append(F.lit(False))
    elif least == 1:
        tests.append(reduce(lambda a, b: a | b, should))   # plain predicates: the scan can take them
    elif least > 1:
        tests.append(_matches(should) >= least)
    tests += [~F.coalesce(c, F.lit(False)) for c, _ in clauses["must_not"]]
    return reduce(lambda a, b: a & b, tests, F.lit(True)) if tests else F.lit(True), [s for name in ("must", "should") for _, found in clauses[name] for s in found]


def _matches(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(t.cast("int"), F.lit(0)) for t in tests])


def parsed(body: str | Mapping) -> Mapping:
    """The body as an object. A bare query clause, as connectors take it, is the query of an unlimited body."""
    body = json.loads(body) if isinstance(body, str) else body
    if isinstance(body, Mapping) and len(body) == 1 and next(iter(body)) in ("range", "term", "terms", "bool", "match_all", "exists"):
        return {"query": body, "size": None}
    return _known(body, {"query", "size", "from", "sort", "aggs", "aggregations"}, "a search body")


def _now(now: str | datetime | None) -> datetime | None:
    return datetime.fromisoformat(now) if isinstance(now, str) else now


def matching(df: DataFrame, body: str | Mapping, now: str | datetime | None = None) -> DataFrame:
    """The documents that the body's query matches, unordered and unlimited."""
    query = parsed(body).get("query", {"match_all": {}})
    return df.filter(condition(df, query, _now(now))[0])


def hits(df: DataFrame, body: str | Mapping, order_key: str, now: str | datetime | None = None) -> DataFrame:
    """The page of documents that the body asks for, with ``score`` (bigint) where a clause scores.

    Ordered by the body's ``sort``, else by descending score, and then by ``order_key``. The
    default page is 10; a bare query clause has no limit.
    """
    body = parsed(body)
    size, start = body.get("size", DEFAULT_HITS), body.get("from", 0)
    test, scoring = condition(df, body.get("query", {"match_all": {}}), _now(now))
    out = df.filter(test)
    if scoring:
        out = out.withColumn("score", _matches(scoring).cast("bigint"))
    if size is None:
        return out
    if not all(isinstance(n, int) and n >= 0 for n in (size, start)):
        raise ValueError(f"size and from must be numbers of documents, got {size!r} and {start!r}")
    order = [_sort(df, s, bool(scoring)) for s in ([body["sort"]] if isinstance(body.get("sort"), (str, Mapping)) else body.get("sort", []))]
    if not order and scoring:
        order = [F.col("score").desc()]
    return out.orderBy(*order, F.col(order_key).asc()).offset(start).limit(size)


def _sort(df: DataFrame, entry: object, scored: bool) -> Column:
    field, how = (entry, "desc" if entry == "_score" else "asc") if isinstance(entry, str) else _one(entry, "sort")
    if isinstance(how, Mapping):
        how = _known(how, {"order"}, "sort").get("order", "asc")
    if how not in ("asc", "desc"):
        raise ValueError(f"unknown sort order {how!r}")
    if field == "_score":
        if not scored:
            raise ValueError("sort by _score without a scoring clause")
        field = "score"
    else:
        field_type(df, field)
    # documents without the field come last in both orders
    return F.col(field).asc_nulls_last() if how == "asc" else F.col(field).desc_nulls_last()


# ---- aggregations --------------------------------------------------------------------------

def _metric(df: DataFrame, name: str, agg: Mapping, scales: Mapping[str, int]) -> Column:
    kind, body = _one(agg, f"aggregation {name!r}")
    if kind not in METRICS:
        raise ValueError(f"unknown aggregation {kind!r}")
    field = str(_known(body, {"field"}, kind)["field"])
    field_type(df, field)
    col = F.col(field)
    made = {"sum": lambda: money.amount_sum(col, scales.get(field)), "min": lambda: F.min(col), "max": lambda: F.max(col),
            "avg": lambda: F.avg(col), "value_count": lambda: F.count(col)}[kind]()
    return made.alias(name)


def aggregations(df: DataFrame, body: str | Mapping, now: str | datetime | None = None, scales: Mapping[str, int] | None = None) -> dict[str, DataFrame]:
    """One frame for each named aggregation of the body, over the documents that its query matches.

    A ``terms`` aggregation gives ``key, doc_count`` and its nested metrics; documents without the
    field are in no bucket. Metrics side by side at the top level share one frame named ``metrics``.
    ``scales`` states the decimals of amount fields, which makes their sums exact.
    """
    body, scales = parsed(body), scales or {}
    named = body.get("aggs", body.get("aggregations", {}))
    found = matching(df, body, now)
    out, top = {}, []
    for name, agg in named.items():
        if not isinstance(agg, Mapping) or "terms" not in agg:
            top.append(_metric(df, name, agg, scales))
            continue
        agg = _known(agg, {"terms", "aggs", "aggregations"}, f"aggregation {name!r}")
        terms = _known(agg["terms"], {"field", "size"}, "terms")
        field, size = str(terms["field"]), terms.get("size", DEFAULT_BUCKETS)
        field_type(df, field)
        inner = [_metric(df, n, a, scales) for n, a in agg.get("aggs", agg.get("aggregations", {})).items()]
        grouped = found.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("key")).agg(F.count(F.lit(1)).alias("doc_count"), *inner)
        out[name] = rollup.top_buckets(grouped, size, "key")
    if top:
        out["metrics"] = found.agg(*top)
    return out
