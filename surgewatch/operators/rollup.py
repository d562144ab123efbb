"""Rollups: hourly sums, the trailing 24 h total, client buckets, grouped counts, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgewatch.functions import money
from surgewatch.functions.timewin import column_type, epoch_seconds, hour_bucket
from surgewatch.session import checkpointed


def with_hour(df: DataFrame, ts: str = "sold_at", out: str = "hour") -> DataFrame:
    """Add the hour bucket of ``ts`` (same time type as the input)."""
    return df.withColumn(out, hour_bucket(F.col(ts), column_type(df, ts)))


def hourly_sales(sales: DataFrame, client: str = "client_id", country: str = "country",
                 ts: str = "sold_at", amount: str = "amount", co_partition: bool = False,
                 scale: int | None = None) -> DataFrame:
    """Sum of ``amount`` per client, country and hour -> client_id, country, hour, amount.

    Partial sums are built before the shuffle, so a hot client ships at most
    one row per hour per task. The sum has the amount's own type; with ``scale``
    it is exact for that many decimals and double (see ``functions.money``).

    ``co_partition=True`` shuffles the raw rows by (client, country) first, so
    the sums and the trailing window share one exchange instead of two. It
    ships every row and puts a hot client's rows into one task: off by default.
    """
    if co_partition:
        sales = sales.repartition(F.col(client), F.col(country))
    hour = hour_bucket(F.col(ts), column_type(sales, ts))
    return (sales.groupBy(F.col(client).alias("client_id"), F.col(country).alias("country"), hour.alias("hour"))
            .agg(money.amount_sum(amount, scale).alias("amount")))


def trailing_sum(hourly: DataFrame, seconds: int = 24 * 3600, keys: Sequence[str] = ("client_id", "country"),
                 hour: str = "hour", amount: str = "amount", out: str = "last24h_amount",
                 scale: int | None = None, span_seconds: int | None = None) -> DataFrame:
    """Total of the buckets whose start lies in ``[hour - seconds, hour]`` per key.

    Value-based range with both ends included: with hourly buckets the default
    covers 25 buckets. Run it on hourly sums, never on raw rows: a key's window
    partition then holds at most one row per hour of the data's span, however
    hot the key is.

    ``span_seconds`` cuts each key's time into spans of that length, so one long
    history is in many tasks. The rows that reach into a later span are copied
    there (its halo), count in its windows, and are dropped again; the totals
    are the same. Rows without an hour form a span of their own.
    """
    epoch = epoch_seconds(F.col(hour), column_type(hourly, hour))
    total = F.sum(amount) if scale is None else money.money_sum(amount, scale)
    if span_seconds is None:
        added = total.over(Window.partitionBy(*keys).orderBy(epoch).rangeBetween(-seconds, 0))
        return hourly.withColumn(out, added if scale is None else money.to_double(added, scale))
    if span_seconds < 1 or seconds < 0:
        raise ValueError("span_seconds must be positive and seconds not negative")
    first, last = F.floor(epoch / F.lit(span_seconds)), F.floor((epoch + F.lit(seconds)) / F.lit(span_seconds))
    spans = F.coalesce(F.sequence(first, last), F.array(F.lit(None).cast("bigint")))
    rows = hourly.select("*", F.posexplode(spans).alias("_halo", "_span"))
    added = total.over(Window.partitionBy(*keys, "_span").orderBy(epoch).rangeBetween(-seconds, 0))
    rows = rows.withColumn(out, added if scale is None else money.to_double(added, scale))
    return rows.filter(F.col("_halo") == 0).drop("_halo", "_span")


def top_by_count(buckets: DataFrame, size: int, key: str, count: str = "doc_count") -> DataFrame:
    """The ``size`` buckets with the most rows (ties by key), exactly.

    A plain ``orderBy().limit()`` merges every partition's own top ``size`` in
    one task (partitions x size rows). Here a histogram of the counts first
    gives the smallest count still inside the top ``size`` (a scalar subquery
    over one row per distinct count); only buckets at or above it go to the
    top-k, so the final merge is bounded by the candidates, not the partitions.
    """
    hist = buckets.groupBy(count).agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.col(count).desc()))
    cut = (hist.withColumn("_cum", above).filter(F.col("_cum") >= F.lit(size))
           .agg(F.max(count).alias("_cut")).scalar())
    candidates = buckets.filter(F.col(count) >= F.coalesce(cut, F.lit(0)))
    return candidates.orderBy(F.col(count).desc(), F.col(key).asc()).limit(size)


def client_buckets(sales: DataFrame, key: str = "client_id", amount: str = "amount",
                   size: int = 100_000, where: Column | None = None, scale: int | None = None) -> DataFrame:
    """Terms buckets: rows and summed amount per key, most rows first, at most ``size``.

    Ties are broken by the key, so the top ``size`` is deterministic. The limit
    is the feature (the bucket count asked for); see :func:`top_by_count`.
    """
    if where is not None:
        sales = sales.filter(where)
    return top_buckets(sales.groupBy(key).agg(F.count(F.lit(1)).alias("doc_count"),
                                              money.amount_sum(amount, scale).alias("amount")), size, key)


def top_buckets(buckets: DataFrame, size: int, key: str, count: str = "doc_count") -> DataFrame:
    """The top of buckets that are written once (to the shared checkpoint folder), not computed twice."""
    return top_by_count(checkpointed(buckets), size, key, count)


def grouped_count(df: DataFrame, keys: Sequence[str], keep: Sequence[str] | None = None,
                  weight: str | None = None) -> DataFrame:
    """``groupBy(keys).count()``; ``keep`` narrows the output afterwards (repeated rows stay).

    ``weight`` names a column of row counts when ``df`` is already collapsed.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")
    out = df.groupBy(*keys).agg(n.alias("count"))
    return out.select(*keep, "count") if keep is not None else out


def two_sums(df: DataFrame, key: str, first: str, second: str, names: tuple[str, str],
             key_name: str | None = None, scales: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Two sums per key over (possibly nested) amount fields (exact where a scale is given).

    Equal to ``groupBy(key).sum(first, second)``, whose automatic column names
    (``sum(ticket.cashAmount)``-like) are replaced by ``names``.
    """
    return df.groupBy(F.col(key).alias(key_name or key.split(".")[-1])).agg(
        money.amount_sum(first, scales[0]).alias(names[0]), money.amount_sum(second, scales[1]).alias(names[1]))


def summary(df: DataFrame, fields: Sequence[str], digits: int | None = 4) -> DataFrame:
    """count, mean, stddev (sample), min, max per numeric field, one row per field.

    Unlike ``DataFrame.describe`` the values stay numeric. All fields are
    summarised in one pass; ``stack`` turns the single result row into rows.
    """
    aggs = []
    for i, name in enumerate(fields):
        c = F.col(name)
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"sd{i}"),
                 F.min(c).cast("double").alias(f"min{i}"), F.max(c).cast("double").alias(f"max{i}")]
    wide = df.agg(*aggs)

    def rnd(c: str) -> str:
        return f"round({c}, {digits})" if digits is not None else c

    parts = ", ".join(f"'{name.split('.')[-1]}', n{i}, {rnd(f'mean{i}')}, {rnd(f'sd{i}')}, min{i}, max{i}"
                      for i, name in enumerate(fields))
    return wide.selectExpr(f"stack({len(fields)}, {parts}) AS (field, count, mean, stddev, min, max)")


def token_buckets(df: DataFrame, field: str, amount: str, size: int | None = None, scale: int | None = None,
                  separators: str = r"[^\p{L}\p{N}]+") -> DataFrame:
    """Buckets of the tokens of an analysed text field: ``key, doc_count, amount``.

    The analyser folds case and splits at everything but letters and digits. A document is in the
    bucket of each of its distinct tokens once, as in a store's text field with field data. Rows
    are counted and summed per distinct value of the field first, within each task, so a value
    that most documents hold is analysed a few times only, and tokens are shuffled as partial
    counts. Null fields have no tokens. ``size`` keeps the buckets with the most rows, ties by key.
    """
    part = F.sum(amount) if scale is None else money.money_sum(amount, scale)
    values = df.groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"), part.alias("part"))
    tokens = F.array_distinct(F.filter(F.split(F.lower("value"), separators), lambda t: t != F.lit("")))
    each = values.select(F.explode(tokens).alias("key"), "rows", "part").groupBy("key").agg(
        F.sum("rows").alias("doc_count"), F.sum("part").alias("part"))
    out = each.select("key", "doc_count", (F.col("part") if scale is None else money.to_double("part", scale)).alias("amount"))
    return out if size is None else top_buckets(out, size, "key")


#: A frequent-items sketch of m counters misses no key of more than 3.5 / m of the rows (its documented error bound).
SKETCH_ERROR = 3.5


def heavy_buckets(df: DataFrame, key: str = "client_id", amount: str = "amount", size: int = 20, tracked: int = 1 << 16,
                  scale: int | None = None) -> DataFrame:
    """:func:`client_buckets` without counting every key: a frequent-items sketch first, then its keys exactly.

    Each task keeps ``tracked`` counters, merged into one row. Only the keys in it are counted and summed
    exactly (they are sent to every task: at most ``tracked`` of them). The result stands if it is
    proven: the last bucket has more rows than a missed key can have, or no row is outside the
    tracked keys. Else all keys are counted, as :func:`client_buckets` does. Null keys are a bucket.
    """
    if not 0 < size <= tracked:
        raise ValueError("size must be positive and at most tracked")
    total = F.count(F.lit(1))
    found = checkpointed(df.agg(F.call_function("approx_top_k", F.col(key), F.lit(tracked), F.lit(tracked)).alias("items"), total.alias("rows")))
    rows = found.select("rows").first()[0]   # the items stay with the executors
    keys = found.select(F.explode("items.item").alias(key)).unionByName(df.sparkSession.createDataFrame([(None,)], df.select(key).schema))
    exact = df.join(F.broadcast(keys), df[key].eqNullSafe(keys[key]), "left_semi").groupBy(key).agg(total.alias("doc_count"), money.amount_sum(amount, scale).alias("amount"))
    exact = checkpointed(exact)   # at most one row for each tracked key
    out = top_by_count(exact, size, key)
    last, held, top = exact.agg(F.sum("doc_count")).first()[0] or 0, exact.count(), out.agg(F.min("doc_count")).first()[0] or 0
    if last == rows or held >= size and top > SKETCH_ERROR * rows / tracked:
        return out
    return client_buckets(df, key, amount, size, scale=scale)
