"""The query catalog: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Every query reads the driver's tables (through ``fixtures``) in full; the only
limits are the ones that are the feature (top-n hits and buckets). Parameters
below are fixed so that the DuckDB oracle in ``plans.oracle`` sees the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgewatch.functions.timewin import column_type, day_range, relative_month
from surgewatch.operators import baseline, classify, evaluate, forward, labels, rollup, search, stats
from surgewatch.plans import flagship
from surgewatch.session import shared_dir
from surgewatch.sources import docfolder, fixtures, searchbody, tables
from surgewatch.sources.fixtures import Tables
from surgewatch.sources.sqlview import sql_with

# Query parameters shared with the oracle SQL.
FULL_ANCHOR = "2024-01-31T00:00:00"      # 90 days back from here keeps every event
TEST_ANCHOR = "2024-01-20T08:50:01"      # an anchor inside the data, so windows drop rows
LOOKBACK_DAYS = 90
SHORT_LOOKBACK_DAYS = 7
NULL_BIG_SPIKE_REGION = 4                # nations of this region get a NULL big-spike amount
TICKETS_NOW = "2000-04-01T12:00:00"      # injected "now" for the ticket month queries
LARGE_ALERT = 2_000_000
ALERT_COUNTRY = "NATION_7"
MATCH_CLIENT = 89
MATCH_COUNTRY = "NATION_7"
HITS = 20
SPAN_SECONDS = 3 * 86400
PAGE = 10
BUCKETS = 100_000
AGENT = 58
OPERATION = "R"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir, _fn=fn: _fn(Tables(spark, sf_dir))
    return fn


def flat_tickets(df: DataFrame) -> DataFrame:
    return df.select(F.col("ticket.issueDate").alias("issue_date"),
                     F.col("ticket.agentNumericCode").alias("agent_code"),
                     F.col("ticket.operationCode").alias("operation_code"),
                     F.col("ticket.cashAmount").alias("cash_amount"),
                     F.col("ticket.ticketAmount").alias("ticket_amount"))


def sales_between(t: Tables, anchor: str, days: int, bounds: str) -> DataFrame:
    return fixtures.sales(t, flagship.sales_window(anchor, days, bounds))


# ---- sources -------------------------------------------------------------

@query
def scan_sales(t: Tables) -> DataFrame:
    """Full scan of the sales through a wildcard, as of an index set (``sales-*``)."""
    from surgewatch.sources.readers import read_files

    return fixtures.sales(t, events=read_files(t.spark, f"{t.sf_dir}/events*.{t.format}", t.format))


@query
def sales_lookback(t: Tables) -> DataFrame:
    return sales_between(t, TEST_ANCHOR, LOOKBACK_DAYS, "[)")


@query
def sales_lookback_open(t: Tables) -> DataFrame:
    return sales_between(t, TEST_ANCHOR, LOOKBACK_DAYS, "(]")


# ---- projections, hour bucket, hourly sums, trailing window ------------------

@query
def hour_bucket(t: Tables) -> DataFrame:
    return rollup.with_hour(fixtures.sales(t)).select("sale_id", "client_id", "country", "sold_at", "hour")


@query
def sales_hourly(t: Tables) -> DataFrame:
    return fixtures.hourly_sales(t)


@query
def sales_hourly_flat(t: Tables) -> DataFrame:
    """The same sums computed on the row-level sales view (no pre-summing; hot clients split by a salt)."""
    return rollup.hourly_sales(fixtures.sales(t, salted=True), scale=fixtures.SCALE)


@query
def sales_last24h(t: Tables) -> DataFrame:
    return rollup.trailing_sum(fixtures.hourly_sales(t), scale=fixtures.SCALE)


@query
def sales_last24h_split(t: Tables) -> DataFrame:
    """The trailing totals with each client's time cut into spans of three days, with a halo."""
    return rollup.trailing_sum(fixtures.hourly_sales(t), scale=fixtures.SCALE, span_seconds=SPAN_SECONDS)


# ---- baseline -----------------------------------------------------------

@query
def latest_month(t: Tables) -> DataFrame:
    return baseline.latest_month(fixtures.history(t))


@query
def latest_history(t: Tables) -> DataFrame:
    return baseline.latest_rows(fixtures.history(t), method="window")


@query
def latest_history_join(t: Tables) -> DataFrame:
    """The self-join form: two scans, kept for histories whose hot key exceeds a window's partition."""
    return baseline.latest_rows(fixtures.history(t), method="join")


@query
def latest_history_rank(t: Tables) -> DataFrame:
    return baseline.latest_rows(fixtures.history(t), method="window")


@query
def daily_baseline(t: Tables) -> DataFrame:
    return baseline.daily_rate(baseline.latest_rows(fixtures.history(t), method="window"))


@query
def baseline_thresholds(t: Tables) -> DataFrame:
    return flagship.baseline_thresholds(fixtures.history(t), fixtures.thresholds(t), latest_method="window")


# ---- spike labelling -------------------------------------------------------

def _metrics(t: Tables) -> DataFrame:
    hourly = fixtures.hourly_sales(t, flagship.sales_window(FULL_ANCHOR, LOOKBACK_DAYS))
    base = flagship.baseline_thresholds(fixtures.history(t), fixtures.thresholds(t), latest_method="window")
    return labels.spike_metrics(rollup.trailing_sum(hourly, scale=fixtures.SCALE), base)


@query
def spike_metrics(t: Tables) -> DataFrame:
    return _metrics(t)


@query
def spike_flags(t: Tables) -> DataFrame:
    return labels.spike_flags(_metrics(t))


@query
def spike_label(t: Tables) -> DataFrame:
    return flagship.label_spikes_from_tables(t, FULL_ANCHOR, LOOKBACK_DAYS)


@query
def spike_label_window(t: Tables) -> DataFrame:
    """7-day lookback inside the data, NULL big-spike amounts for one region."""
    return flagship.label_spikes_from_tables(t, TEST_ANCHOR, SHORT_LOOKBACK_DAYS,
                                             null_big_amount_region=NULL_BIG_SPIKE_REGION)


@query
def spike_label_flat(t: Tables) -> DataFrame:
    """The job as written for flat sales rows (lookback filter, then hourly sums)."""
    return flagship.label_spikes(fixtures.sales(t, salted=True), fixtures.history(t), fixtures.thresholds(t),
                                 anchor=FULL_ANCHOR, lookback_days=LOOKBACK_DAYS, scale=fixtures.SCALE)


@query
def spike_label_nested(t: Tables) -> DataFrame:
    """The job over document-shaped sales, reading the nested ``details`` fields."""
    return flagship.label_spikes(fixtures.sales_documents(t), fixtures.history(t), fixtures.thresholds(t),
                                 anchor=FULL_ANCHOR, lookback_days=LOOKBACK_DAYS, client="details.client_id",
                                 country="details.country", amount="details.amount", scale=fixtures.SCALE)


# ---- alerts examples -------------------------------------------------------

@query
def project_country(t: Tables) -> DataFrame:
    return fixtures.alerts(t).select("country_code")


@query
def project_plus(t: Tables) -> DataFrame:
    return fixtures.alerts(t).select("country_code", (F.col("accumulated_sales") + F.lit(10)).alias("sales_plus_10"))


@query
def filter_large_alerts(t: Tables) -> DataFrame:
    return search.where_greater(fixtures.alerts(t), "accumulated_sales", LARGE_ALERT)


@query
def filter_country(t: Tables) -> DataFrame:
    return search.where_equal(fixtures.alerts(t), {"country_code": ALERT_COUNTRY})


@query
def alerts_by_country(t: Tables) -> DataFrame:
    return rollup.grouped_count(fixtures.alerts(t), ["country_code"])


@query
def sql_on_view(t: Tables) -> DataFrame:
    return sql_with(t.spark, "select country_code, count(*) as count from {alerts} group by country_code",
                    alerts=fixtures.alerts(t))


@query
def sql_select_all(t: Tables) -> DataFrame:
    return sql_with(t.spark, "SELECT * FROM {alerts}", alerts=fixtures.alerts(t))


# ---- monthly sales examples -------------------------------------------------

@query
def monthly_counts(t: Tables) -> DataFrame:
    return rollup.grouped_count(fixtures.monthly_sales_counted(t), ["agent_code", "country_code", "month"],
                                keep=["agent_code"], weight="rows")


@query
def monthly_counts_sql(t: Tables) -> DataFrame:
    """The SQL form: ``"month"`` is a string literal in Spark SQL, so it groups by two keys."""
    return sql_with(t.spark, 'select agent_code, count(*) as count from {historical_sales} '
                             'group by agent_code, country_code, "month"',
                    historical_sales=fixtures.monthly_sales(t))


# ---- tickets examples --------------------------------------------------------

@query
def tickets_sum(t: Tables) -> DataFrame:
    return rollup.two_sums(fixtures.tickets(t), "ticket.agentNumericCode", "ticket.cashAmount",
                           "ticket.ticketAmount", ("cash_amount", "ticket_amount"), "agent_code", (2, 4))


@query
def tickets_last_month(t: Tables) -> DataFrame:
    tk = fixtures.tickets(t)
    when = relative_month(F.col("ticket.issueDate"), tk.schema["ticket"].dataType["issueDate"].dataType,
                          TICKETS_NOW, 1, "[)")
    return flat_tickets(tk.filter(when))


@query
def tickets_month_sum(t: Tables) -> DataFrame:
    tk = fixtures.tickets(t)
    when = day_range(F.col("ticket.issueDate"), tk.schema["ticket"].dataType["issueDate"].dataType, TICKETS_NOW, 1)
    return rollup.two_sums(tk.filter(when), "ticket.agentNumericCode", "ticket.cashAmount",
                           "ticket.ticketAmount", ("cash_amount", "ticket_amount"), "agent_code", (2, 4))


@query
def filter_agent_operation(t: Tables) -> DataFrame:
    return flat_tickets(search.where_equal(fixtures.tickets(t), {"ticket.agentNumericCode": AGENT,
                                                                 "ticket.operationCode": OPERATION}))


@query
def describe_amount(t: Tables) -> DataFrame:
    return rollup.summary(fixtures.tickets(t), ["ticket.cashAmount", "ticket.ticketAmount"])


# ---- search and buckets ------------------------------------------------------

@query
def match_any(t: Tables) -> DataFrame:
    return search.match_any(fixtures.sales(t), {"client_id": MATCH_CLIENT, "country": MATCH_COUNTRY},
                            "sale_id", HITS)


@query
def sales_lookback_page(t: Tables) -> DataFrame:
    """The 90-day query as a plain fetch: the default page of 10 hits (in sale order)."""
    return search.first_n(sales_between(t, TEST_ANCHOR, LOOKBACK_DAYS, "(]"), "sale_id", PAGE)


@query
def first_n(t: Tables) -> DataFrame:
    return search.first_n(fixtures.sales(t), "sale_id", HITS)


@query
def client_buckets(t: Tables) -> DataFrame:
    totals = fixtures.client_totals(t, flagship.sales_window(TEST_ANCHOR, LOOKBACK_DAYS, "(]"))
    return rollup.top_buckets(totals, BUCKETS, "client_id")


@query
def client_buckets_heavy(t: Tables) -> DataFrame:
    """The client buckets with a frequent-items sketch before the exact pass."""
    rows = fixtures.sales(t, flagship.sales_window(TEST_ANCHOR, LOOKBACK_DAYS, "(]"), salted=True)
    return rollup.heavy_buckets(rows, "client_id", "amount", BUCKETS, 1 << 17, fixtures.SCALE)


@query
def client_buckets_month(t: Tables) -> DataFrame:
    def month(df):
        return relative_month(df["sold_at"], column_type(df, "sold_at"), TEST_ANCHOR, 1, "(]")

    return rollup.top_buckets(fixtures.client_totals(t, month), BUCKETS, "client_id")


@query
def country_token_buckets(t: Tables) -> DataFrame:
    """Sales per token of the analysed country name: rows and summed amount."""
    return rollup.token_buckets(fixtures.sales(t, salted=True), "country", "amount", scale=fixtures.SCALE)


# ---- search bodies as JSON text --------------------------------------------------

#: The store's request bodies, over the sales and the tickets of the tables.
BODIES = {
    "first_n": '{"size": 20, "query": {"match_all": {}}}',
    "match_any": '{"size": 20, "query": {"bool": {"should": [{"term": {"client_id": "89"}}, {"term": {"country": "NATION_7"}}]}}}',
    "lookback": '{"range": {"sold_at": {"gte": "2024-01-20T08:50:01||-90d", "lt": "2024-01-20T08:50:01"}}}',
    "page": '{"query": {"range": {"sold_at": {"gt": "2024-01-20T08:50:01||-90d", "lte": "2024-01-20T08:50:01"}}}}',
    "buckets": """{"size": 0, "query": {"range": {"sold_at": {"gt": "2024-01-20T08:50:01||-90d", "lte": "2024-01-20T08:50:01"}}},
                   "aggs": {"clients": {"terms": {"field": "client_id", "size": 100000}, "aggs": {"amount": {"sum": {"field": "amount"}}}}}}""",
    "buckets_month": """{"size": 0, "query": {"range": {"sold_at": {"gt": "now-1M", "lte": "now"}}},
                         "aggs": {"clients": {"terms": {"field": "client_id", "size": 100000}, "aggs": {"amount": {"sum": {"field": "amount"}}}}}}""",
    "tickets": '{"range": {"ticket.issueDate": {"gte": "now-1M", "lt": "now"}}}',
}


@query
def body_first_n(t: Tables) -> DataFrame:
    return searchbody.hits(fixtures.sales(t), BODIES["first_n"], "sale_id")


@query
def body_match_any(t: Tables) -> DataFrame:
    return searchbody.hits(fixtures.sales(t), BODIES["match_any"], "sale_id")


@query
def body_lookback(t: Tables) -> DataFrame:
    return searchbody.hits(fixtures.sales(t), BODIES["lookback"], "sale_id")


@query
def body_lookback_page(t: Tables) -> DataFrame:
    return searchbody.hits(fixtures.sales(t), BODIES["page"], "sale_id")


def _body_buckets(t: Tables, body: str) -> DataFrame:
    found = searchbody.aggregations(fixtures.sales(t, salted=True), body, TEST_ANCHOR, {"amount": fixtures.SCALE})
    return found["clients"].withColumnRenamed("key", "client_id")


@query
def body_client_buckets(t: Tables) -> DataFrame:
    return _body_buckets(t, BODIES["buckets"])


@query
def body_client_buckets_month(t: Tables) -> DataFrame:
    return _body_buckets(t, BODIES["buckets_month"])


@query
def body_tickets_month(t: Tables) -> DataFrame:
    return flat_tickets(searchbody.matching(fixtures.tickets(t), BODIES["tickets"], TICKETS_NOW))


@query
def document_folder_lookback(t: Tables) -> DataFrame:
    """The lookback over a folder of documents: exported by ranges of time with statistics, read back through the data source."""
    root = shared_dir(t.spark, "documents")
    rows = fixtures.sales(t).repartitionByRange(F.col("sold_at"))
    tables.export_tables(t.spark, {"sales-all": rows}, root)
    docfolder.write_stats(t.spark, root, {"sales-all": rows.schema}, ["sold_at"])
    return searchbody.matching(docfolder.read_document_folder(t.spark, root, "sales-*"), BODIES["lookback"])


# ---- splits, features, evaluation, classifier ---------------------------------

SPLIT_SEED = 42


def _split_keys() -> list:
    return ["client_id", "country", F.unix_timestamp("hour")]


def _labelled(t: Tables) -> DataFrame:
    return t.memo("labelled", lambda: flagship.label_spikes_from_tables(t, FULL_ANCHOR, LOOKBACK_DAYS))


def _rule_predicted(t: Tables) -> DataFrame:
    """A percent-only rule as the 'prediction', so the evaluation has an exact oracle."""
    pred = (F.when(F.col("pct") > F.col("big_spike_pct"), F.lit("BIG_SPIKE"))
            .when(F.col("pct") > F.col("spike_pct"), F.lit("SPIKE")).otherwise(F.lit("NO_SPIKE")))
    return _labelled(t).withColumn("predicted_label", pred)


@query
def split_by_key(t: Tables) -> DataFrame:
    return classify.split_by_key(_labelled(t), _split_keys(), 20.0).select("client_id", "country", "hour", "label", "part")


@query
def split_random(t: Tables) -> DataFrame:
    """Both parts of the random split together: every labelled row once, with its part (up to the seed and the layout)."""
    train, test = classify.split_random(_labelled(t), classify.JOB_TRAIN_SHARE, SPLIT_SEED)
    cols = ["client_id", "country", "hour", "label"]
    return train.select(*cols, F.lit("train").alias("part")).unionByName(test.select(*cols, F.lit("test").alias("part")))


@query
def split_exact(t: Tables) -> DataFrame:
    """A fifth of each class, rounded down, drawn by seeded hashes: the same rows in any engine."""
    parts = classify.split_exact(_labelled(t), _split_keys(), classify.JOB_TRAIN_SHARE, "label", SPLIT_SEED)
    return parts.select("client_id", "country", "hour", "label", "part")


@query
def feature_matrix(t: Tables) -> DataFrame:
    return _labelled(t).select(*classify.SPIKE_FEATURES, "label")


@query
def label_index(t: Tables) -> DataFrame:
    return evaluate.label_index(_labelled(t))


@query
def eval_accuracy(t: Tables) -> DataFrame:
    return evaluate.accuracy(_rule_predicted(t))


@query
def eval_class_share(t: Tables) -> DataFrame:
    return evaluate.class_share(_rule_predicted(t))


@query
def eval_recall(t: Tables) -> DataFrame:
    return evaluate.recall(_rule_predicted(t))


def _network(t: Tables, seed: int = SPLIT_SEED):
    """The job's training step: label, split 20 / 80 by key, train on the 20 %, keep the 80 %."""
    return classify.train_on_split(_labelled(t), "label", classify.SPIKE_FEATURES,
                                   classify.NetworkSettings(inputs=len(classify.SPIKE_FEATURES),
                                                            outputs=classify.JOB_OUTPUTS,
                                                            hidden=classify.JOB_HIDDEN, seed=seed),
                                   classify.JOB_TRAIN_SHARE, _split_keys())


@query
def classify_spikes(t: Tables) -> DataFrame:
    """The scored rows with the trained network's label and probabilities."""
    net, test = _network(t)
    return net.as_columns().classify(test).select("client_id", "country", "hour", "label", "predicted_label", "probabilities")


#: Shape of the network with stated weights, and the rule of its weights and biases by layer, output and input.
STATED_LAYERS = (8, 20, 3)
STATED_LABELS = ("NO_SPIKE", "SPIKE", "BIG_SPIKE")


def stated_network() -> forward.Network:
    flat = []
    for layer, (n_in, n_out) in enumerate(zip(STATED_LAYERS, STATED_LAYERS[1:], strict=False)):
        flat += [((7 * i + 3 * o + 5 * layer) % 11 - 5) / (1000 if layer == 0 else 1) for i in range(n_in) for o in range(n_out)]
        flat += [((5 * o + 2 * layer) % 7 - 3) / 10 for o in range(n_out)]
    return forward.Network.from_flat(classify.SPIKE_FEATURES, STATED_LAYERS, flat, STATED_LABELS)


@query
def network_scores(t: Tables) -> DataFrame:
    """Every labelled row scored by a network of stated weights: its label and the label's probability."""
    scored = stated_network().classify(_labelled(t))
    return scored.select("client_id", "country", "hour", "label", "predicted_label", F.round(F.array_max("probabilities"), 6).alias("probability"))


@query
def training_error(t: Tables) -> DataFrame:
    """The training rows' labels by frequency, and the network's error and accuracy on its held-out rows."""
    net, _ = _network(t)
    return t.spark.createDataFrame([(",".join(net.labels), net.error_pct, net.accuracy)], "labels string, error_pct double, accuracy double")


@query
def eval_network(t: Tables) -> DataFrame:
    """Recall per class of the trained network on the rows it did not see."""
    net, test = _network(t)
    return evaluate.recall(net.classify(test))


@query
def spike_job(t: Tables) -> DataFrame:
    """The main job end to end: labels, network, scoring, and its report per class."""
    _, _, scored = flagship.run_job(t, FULL_ANCHOR, LOOKBACK_DAYS, seed=SPLIT_SEED, keys=_split_keys())
    return evaluate.report(scored)


@query
def eval_report(t: Tables) -> DataFrame:
    """The job's report on the rule prediction (exact oracle)."""
    return evaluate.report(_rule_predicted(t))


# ---- statistics -------------------------------------------------------------

@query
def chi_square(t: Tables) -> DataFrame:
    return stats.chi_square(fixtures.chi_rows(t), digits=6)


# ---- table jobs ---------------------------------------------------------------

@query
def table_profile(t: Tables) -> DataFrame:
    t.prefetch(*fixtures.TABLES)
    return tables.table_profile({name: t[name] for name in fixtures.TABLES})


@query
def table_sizes(t: Tables) -> DataFrame:
    """Files and bytes of every table, from the files' own listing: no row is read."""
    return tables.table_sizes(t.spark, {name: t.path(name) for name in fixtures.TABLES})


@query
def export_restore(t: Tables) -> DataFrame:
    """All tables exported and restored: name, rows and content sum of each restored table."""
    dest = shared_dir(t.spark, "export")
    t.prefetch(*fixtures.TABLES)
    tables.export_tables(t.spark, {name: t[name] for name in fixtures.TABLES}, dest)
    return tables.table_sums(tables.restore_tables(t.spark, dest))


@query
def export_projected(t: Tables) -> DataFrame:
    dest = shared_dir(t.spark, "export")
    fields = ["ticket.issueDate", "ticket.cashAmount", "ticket.operationCode", "ticket.agentNumericCode"]
    tables.export_tables(t.spark, {"tickets": fixtures.tickets(t)}, dest, columns=fields)
    return tables.restore_tables(t.spark, dest)["tickets"]


@query
def copy_tables(t: Tables) -> DataFrame:
    """All tables copied: name, rows and content sum of each copy."""
    dest = shared_dir(t.spark, "copy")
    t.prefetch(*fixtures.TABLES)

    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{dest}/{name}")

    names = tables.copy_tables(lambda name: t[name], write, fixtures.TABLES)
    return tables.table_sums({name: t.spark.read.parquet(f"{dest}/{name}") for name in names})


def queries() -> dict[str, Query]:
    return dict(QUERIES)
