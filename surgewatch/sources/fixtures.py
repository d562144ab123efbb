"""The reference's input tables, derived from the driver's TPC-H-like tables.

| view          | columns                                           | from                          |
| ------------- | ------------------------------------------------- | ----------------------------- |
| sales         | sale_id, client_id, country, sold_at, amount      | events x customer x nation    |
| history       | client_id, country, month, amount                 | orders x customer x nation    |
| thresholds    | country, spike_amount, big_spike_amount, ...      | nation                        |
| alerts        | country_code, month, accumulated_sales            | orders x customer x nation    |
| monthly_sales | agent_code, country_code, month                   | lineitem x supplier x nation  |
| tickets       | ticket struct<issueDate, agentNumericCode, ...>   | lineitem                      |
| chi           | label, features (vector)                          | lineitem                      |

Dimension tables are joined *after* the fact tables are pre-aggregated
wherever the view is an aggregate (hourly sales, history, alerts): a hot
client then reaches the join as at most one row per hour or month, and the
joins carry aggregates, not raw rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surgewatch.functions import money
from surgewatch.functions.timewin import column_type, hour_bucket
from surgewatch.session import broadcast_if_small
from surgewatch.sources.readers import read_files

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy access to ``<sf_dir>/<name>.parquet``; each table is read once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str, format: str = "parquet"):
        self.spark, self.sf_dir, self.format = spark, sf_dir.rstrip("/"), format
        self._frames: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.{self.format}"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = read_files(self.spark, self.path(name), self.format)
        return self._frames[name]

    def prefetch(self, *names: str) -> Tables:
        """Read several tables' schemas at once (each read is a small Spark job)."""
        todo = [n for n in names if n not in self._frames]
        for name, df in zip(todo, _in_parallel([lambda n=n: read_files(self.spark, self.path(n), self.format)
                                                for n in todo])):
            self._frames[name] = df
        return self

    def memo(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Build a derived frame once per instance (plans are reused, not cached)."""
        if key not in self._frames:
            self._frames[key] = build()
        return self._frames[key]


def _in_parallel(jobs: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """Run plan-building callables from threads, so their Spark jobs overlap."""
    if len(jobs) <= 1:
        return [job() for job in jobs]
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return list(pool.map(lambda job: job(), jobs))


def month_index(col: Column) -> Column:
    """``year * 100 + month`` of a timestamp: a cheap, hashable grouping key."""
    return F.year(col) * F.lit(100) + F.month(col)


def month_text(index: Column) -> Column:
    """``yyyy-MM`` from a month index (equal to the first 7 characters of the timestamp text)."""
    year = F.floor(index / F.lit(100)).cast("int")
    month = (index % F.lit(100)).cast("int")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def month_of(col: Column) -> Column:
    """``yyyy-MM`` text of a timestamp (from its fields, so time-zone free)."""
    return month_text(month_index(col))


NATION_BROADCAST_ROWS = 10_000
SCALE = 2      # decimals of the driver's amounts
SALTS = 16     # parts of a hot key in a row-level join that feeds an aggregate


def _countries(t: Tables) -> DataFrame:
    """nation key -> name, broadcast behind a count (one check per query build).

    Explicit, so that a cluster with automatic broadcasts switched off does not
    shuffle fact rows by a 25-value key.
    """
    def build() -> DataFrame:
        nation = t["nation"].select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("country"))
        return broadcast_if_small(nation, NATION_BROADCAST_ROWS)

    return t.memo("countries", build)


def _salted_join(facts: DataFrame, dimension: DataFrame, key: str, salt: str) -> DataFrame:
    """Join rows on ``key`` with every key dealt over ``SALTS`` partitions.

    An aggregate above a plain join on ``key`` reuses its partitioning, so AQE may
    not split a hot key and all its rows meet in one task. With a salt (a hash of
    ``salt``, a column that tells rows apart) in the join key they do not; the
    aggregate then shuffles partial sums.

    The copies come from a join with the salts, whose size Spark estimates from both
    sides. An exploded array counts as one row, so all copies of a large dimension
    would be collected in the driver and broadcast.
    """
    salts = dimension.sparkSession.range(0, SALTS, 1, 1).select(F.col("id").cast("int").alias("_salt"))
    facts = facts.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    copies = dimension.crossJoin(F.broadcast(salts))
    return facts.join(copies, [key, "_salt"]).drop("_salt")


def _client_nations(t: Tables) -> DataFrame:
    """client_id -> nation key (customer), without a hint.

    Where Spark's size threshold or AQE broadcasts it, the pre-summed fact side's
    partitioning stays in place; else the join is a shuffle join on client_id,
    which the later groupings and windows reuse.
    """
    return t["customer"].select(F.col("c_custkey").alias("client_id"), F.col("c_nationkey").alias("nationkey"))


def _with_client_country(facts: DataFrame, t: Tables, salt: str | None = None) -> DataFrame:
    """Attach ``country`` to rows keyed by client_id: customer, then nation (broadcast)."""
    clients = _client_nations(t)
    joined = facts.join(clients, "client_id") if salt is None else _salted_join(facts, clients, "client_id", salt)
    return joined.join(_countries(t), "nationkey").drop("nationkey")


def sales(t: Tables, where: Callable[[DataFrame], Column] | None = None,
          events: DataFrame | None = None, salted: bool = False) -> DataFrame:
    """Row-level sales: one row per event with its client's country.

    ``where`` filters the raw events before the join (it receives the renamed
    frame), so a time range reaches the parquet scan. ``events`` replaces the
    events table. ``salted`` splits hot clients in the join: for callers that
    aggregate the rows.
    """
    t.prefetch("events", "customer", "nation")
    events = (t["events"] if events is None else events).select(F.col("event_id").alias("sale_id"), F.col("user_id").alias("client_id"),
                                F.col("ts").alias("sold_at"), F.col("value").alias("amount"))
    if where is not None:
        events = events.filter(where(events))
    return (_with_client_country(events, t, "sale_id" if salted else None)
            .select("sale_id", "client_id", "country", "sold_at", "amount"))


def sales_documents(t: Tables) -> DataFrame:
    """The sales as documents: ``sold_at`` plus a nested ``details`` struct.

    details = struct<client_id, country, amount>, the one-level nesting of a
    document index; read it with dotted paths (``details.client_id``).
    """
    flat = sales(t, salted=True)
    return flat.select("sale_id", "sold_at",
                       F.struct("client_id", "country", "amount").alias("details"))


def hourly_sales(t: Tables, where: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Hourly sales per client and country, equal to grouping :func:`sales`.

    Events are summed per (user, hour) first (exact decimals), then the country
    is attached and the sums are re-added, which keeps duplicate customer rows
    multiplying exactly as the row-level join would.
    """
    t.prefetch("events", "customer", "nation")
    events = t["events"].select(F.col("user_id").alias("client_id"), F.col("ts").alias("sold_at"),
                                F.col("value").alias("amount"))
    if where is not None:
        events = events.filter(where(events))
    hour = hour_bucket(F.col("sold_at"), column_type(events, "sold_at"))
    per_user = events.groupBy("client_id", hour.alias("hour")).agg(money.money_sum("amount").alias("part"))
    return (_with_client_country(per_user, t)
            .groupBy("client_id", "country", "hour")
            .agg(money.to_double(money.resum("part")).alias("amount")))


def client_totals(t: Tables, where: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """``client_id, doc_count, amount`` of the sales, equal to grouping :func:`sales`.

    Events are counted and summed per user before the joins, so a hot client
    reaches them as one row for each task; repeated customer or nation rows multiply as the
    row-level join would.
    """
    t.prefetch("events", "customer", "nation")
    events = t["events"].select(F.col("user_id").alias("client_id"), F.col("ts").alias("sold_at"), F.col("value").alias("amount"))
    if where is not None:
        events = events.filter(where(events))
    per_user = events.groupBy("client_id").agg(F.count(F.lit(1)).alias("rows"), money.money_sum("amount", SCALE).alias("part"))
    return (_with_client_country(per_user, t).groupBy("client_id")
            .agg(F.sum("rows").alias("doc_count"), money.to_double(money.resum("part"), SCALE).alias("amount")))


def history(t: Tables) -> DataFrame:
    """Monthly totals per client and country; ``amount`` is the month's sum / 100."""
    t.prefetch("orders", "customer", "nation")
    orders = t["orders"].select(F.col("o_custkey").alias("client_id"), month_index(F.col("o_orderdate")).alias("m"),
                                F.col("o_totalprice").alias("price"))
    per_client = orders.groupBy("client_id", "m").agg(money.money_sum("price").alias("part"))
    return (_with_client_country(per_client, t)
            .groupBy("client_id", "country", "m")
            .agg((money.to_double(money.resum("part")) / F.lit(100)).alias("amount"))
            .select("client_id", "country", month_text(F.col("m")).alias("month"), "amount"))


def thresholds(t: Tables, null_big_amount_region: int | None = None) -> DataFrame:
    """Per-country thresholds: 50 + key and 200 + key (amounts), 25 and 100 (percent).

    ``null_big_amount_region`` leaves the big-spike amount NULL for the
    nations of that region, to exercise three-valued flags.
    """
    nation = t["nation"]
    key = F.col("n_nationkey").cast("double")
    big = key + F.lit(200.0)
    if null_big_amount_region is not None:
        big = F.when(F.col("n_regionkey") == F.lit(null_big_amount_region), F.lit(None).cast("double")).otherwise(big)
    return nation.select(F.col("n_name").alias("country"), (key + F.lit(50.0)).alias("spike_amount"),
                         big.alias("big_spike_amount"), F.lit(25.0).alias("spike_pct"),
                         F.lit(100.0).alias("big_spike_pct"))


def alerts(t: Tables) -> DataFrame:
    """Accumulated sales per country and month.

    The dimensions are joined first and the sums are partial before the one
    shuffle by (country, month): a filter on the country reaches the nation scan.
    """
    t.prefetch("orders", "customer", "nation")
    orders = t["orders"].select(F.col("o_custkey").alias("client_id"), month_index(F.col("o_orderdate")).alias("m"),
                                F.col("o_totalprice").alias("price"))
    return (_with_client_country(orders, t)
            .groupBy(F.col("country").alias("country_code"), "m")
            .agg(money.to_double(money.money_sum("price", SCALE), SCALE).alias("accumulated_sales"))
            .select("country_code", month_text(F.col("m")).alias("month"), "accumulated_sales"))


def _agent_nations(t: Tables) -> DataFrame:
    """agent_code -> nation key (supplier), without a hint."""
    return t["supplier"].select(F.col("s_suppkey").alias("agent_code"), F.col("s_nationkey").alias("nationkey"))


def _with_agent_country(facts: DataFrame, t: Tables, salt: str | None = None) -> DataFrame:
    countries = _countries(t).withColumnRenamed("country", "country_code")
    agents = _agent_nations(t)
    joined = facts.join(agents, "agent_code") if salt is None else _salted_join(facts, agents, "agent_code", salt)
    return joined.join(countries, "nationkey").drop("nationkey")


def monthly_sales(t: Tables) -> DataFrame:
    """One row per line item: the supplier as agent (hot ones split), its country, the ship month."""
    t.prefetch("lineitem", "supplier", "nation")
    items = t["lineitem"].select(F.col("l_suppkey").alias("agent_code"), month_of(F.col("l_shipdate")).alias("month"), "l_orderkey")
    return _with_agent_country(items, t, "l_orderkey").select("agent_code", "country_code", "month")


def monthly_sales_counted(t: Tables) -> DataFrame:
    """``monthly_sales`` collapsed to (agent_code, country_code, month, rows).

    Line items are counted per (agent, month) before the dimension join, so
    the join and the shuffle carry counts, not line items.
    """
    t.prefetch("lineitem", "supplier", "nation")
    items = t["lineitem"].select(F.col("l_suppkey").alias("agent_code"), month_index(F.col("l_shipdate")).alias("m"))
    per_agent = items.groupBy("agent_code", "m").agg(F.count(F.lit(1)).alias("rows"))
    return (_with_agent_country(per_agent, t)
            .select("agent_code", "country_code", month_text(F.col("m")).alias("month"), "rows"))


def tickets(t: Tables) -> DataFrame:
    """Sale tickets as a nested struct, the older document layout.

    ``ticketAmount`` has up to 4 decimals: sum it with ``scale=4``.
    """
    li = t["lineitem"]
    ticket = F.struct(
        F.col("l_shipdate").alias("issueDate"),
        F.col("l_suppkey").alias("agentNumericCode"),
        F.col("l_returnflag").alias("operationCode"),
        F.col("l_extendedprice").alias("cashAmount"),
        # price with tax, exact to 4 decimals, kept as a double like the other amounts
        money.to_double(money.minor_units("l_extendedprice") * (F.lit(100) + money.minor_units("l_tax")), 4)
        .alias("ticketAmount"),
    )
    return li.select(ticket.alias("ticket"))


def chi_rows(t: Tables) -> DataFrame:
    """label = 1 for a closed line (status F); features = quantity, discount, tax."""
    from pyspark.ml.feature import VectorAssembler

    li = t["lineitem"].select((F.col("l_linestatus") == F.lit("F")).cast("double").alias("label"),
                              "l_quantity", "l_discount", "l_tax")
    assembler = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features")
    return assembler.transform(li).select("label", "features")
