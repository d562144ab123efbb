"""DuckDB SQL for every comparable query key.

Written by hand from the fixture definitions, not generated from the Spark
code. Each entry stands alone: the derived views are CTEs over the driver's
base tables. Money is summed as DECIMAL(18,2) and turned into DOUBLE after
the sum, as on the Spark side, so the results agree bit for bit.
"""

from __future__ import annotations

SALES = """sales AS (
  SELECT e.event_id AS sale_id, e.user_id AS client_id, n.n_name AS country, e.ts AS sold_at, e.value AS amount
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

HISTORY = """history AS (
  SELECT o.o_custkey AS client_id, n.n_name AS country, substring(CAST(o.o_orderdate AS VARCHAR), 1, 7) AS month,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 100 AS amount
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2, 3)"""


def thresholds(null_region: int | None = None) -> str:
    big = "CAST(n_nationkey AS DOUBLE) + 200.0"
    if null_region is not None:
        big = f"CASE WHEN n_regionkey = {null_region} THEN CAST(NULL AS DOUBLE) ELSE {big} END"
    return f"""thresholds AS (
  SELECT n_name AS country, CAST(n_nationkey AS DOUBLE) + 50.0 AS spike_amount, {big} AS big_spike_amount,
         CAST(25.0 AS DOUBLE) AS spike_pct, CAST(100.0 AS DOUBLE) AS big_spike_pct
  FROM nation)"""


ALERTS_SELECT = """SELECT n.n_name AS country_code, substring(CAST(o.o_orderdate AS VARCHAR), 1, 7) AS month,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS accumulated_sales
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2"""

ALERTS = f"""alerts AS (
  {ALERTS_SELECT})"""

MONTHLY_SALES = """monthly_sales AS (
  SELECT l.l_suppkey AS agent_code, n.n_name AS country_code, substring(CAST(l.l_shipdate AS VARCHAR), 1, 7) AS month
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

TICKETS = """tickets AS (
  SELECT l_shipdate AS issue_date, l_suppkey AS agent_code, l_returnflag AS operation_code,
         l_extendedprice AS cash_amount,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS ticket_amount
  FROM lineitem)"""


def hourly(where: str = "") -> str:
    return f"""hourly AS (
  SELECT client_id, country, date_trunc('hour', sold_at) AS hour,
         CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM sales {where}
  GROUP BY 1, 2, 3)"""


LAST24 = """last24 AS (
  SELECT client_id, country, hour, amount,
         CAST(SUM(CAST(amount AS DECIMAL(38,2))) OVER (
           PARTITION BY client_id, country ORDER BY hour
           RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS DOUBLE) AS last24h_amount
  FROM hourly)"""

LATEST = """latest AS (
  SELECT h.client_id, h.country, h.month, h.amount
  FROM history h
  JOIN (SELECT client_id, country, max(month) AS month FROM history GROUP BY 1, 2) m
    ON h.client_id = m.client_id AND h.country = m.country AND h.month = m.month)"""

BASELINE = """baseline AS (SELECT client_id, country, month, amount / 30 AS daily_amount FROM latest)"""

BT = """bt AS (
  SELECT b.client_id, b.country, b.daily_amount, t.spike_amount, t.big_spike_amount, t.spike_pct, t.big_spike_pct
  FROM baseline b JOIN thresholds t ON b.country = t.country)"""

METRICS = """metrics AS (
  SELECT l.client_id, l.country, l.hour, l.amount, l.last24h_amount, bt.daily_amount,
         bt.spike_amount, bt.big_spike_amount, bt.spike_pct, bt.big_spike_pct,
         l.last24h_amount - bt.daily_amount AS diff,
         (l.last24h_amount - bt.daily_amount) / NULLIF(bt.daily_amount, 0) * 100 AS pct
  FROM last24 l JOIN bt ON l.client_id = bt.client_id AND l.country = bt.country)"""

FLAGS = """flags AS (
  SELECT *, (spike_amount < diff AND spike_pct < pct) AS spike,
            (big_spike_amount < diff AND big_spike_pct < pct) AS big_spike
  FROM metrics)"""

LABELLED = """labelled AS (
  SELECT *, CASE WHEN big_spike THEN 'BIG_SPIKE' WHEN spike THEN 'SPIKE' ELSE 'NO_SPIKE' END AS label
  FROM flags WHERE pct IS NOT NULL)"""


def window(anchor: str, days: int, bounds: str = "[)") -> str:
    lo = ">=" if bounds[0] == "[" else ">"
    hi = "<=" if bounds[1] == "]" else "<"
    return (f"WHERE sold_at {lo} TIMESTAMP '{anchor}' - INTERVAL {days} DAYS "
            f"AND sold_at {hi} TIMESTAMP '{anchor}'")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def labelled_ctes(anchor: str, days: int, null_region: int | None = None) -> list[str]:
    return [SALES, hourly(window(anchor, days)), LAST24, HISTORY, LATEST, BASELINE, thresholds(null_region),
            BT, METRICS, FLAGS, LABELLED]


def labelled(anchor: str, days: int, null_region: int | None = None) -> str:
    return with_(*labelled_ctes(anchor, days, null_region))


FULL = ("2024-01-31 00:00:00", 90)
TEST = "2024-01-20 08:50:01"

ORACLE: dict[str, str] = {
    "scan_sales": with_(SALES) + "SELECT * FROM sales",
    "sales_lookback": with_(SALES) + "SELECT * FROM sales " + window(TEST, 90, "[)"),
    "sales_lookback_open": with_(SALES) + "SELECT * FROM sales " + window(TEST, 90, "(]"),
    "hour_bucket": with_(SALES) + "SELECT sale_id, client_id, country, sold_at, date_trunc('hour', sold_at) AS hour FROM sales",
    "sales_hourly": with_(SALES, hourly()) + "SELECT * FROM hourly",
    "sales_hourly_flat": with_(SALES, hourly()) + "SELECT * FROM hourly",
    "sales_last24h": with_(SALES, hourly(), LAST24) + "SELECT * FROM last24",
    "latest_month": with_(HISTORY) + "SELECT client_id, country, max(month) AS month FROM history GROUP BY 1, 2",
    "latest_history": with_(HISTORY, LATEST) + "SELECT * FROM latest",
    "latest_history_rank": with_(HISTORY, LATEST) + "SELECT * FROM latest",
    "latest_history_join": with_(HISTORY, LATEST) + "SELECT * FROM latest",
    "daily_baseline": with_(HISTORY, LATEST, BASELINE) + "SELECT * FROM baseline",
    "baseline_thresholds": with_(HISTORY, LATEST, BASELINE, thresholds(), BT) + "SELECT * FROM bt",
    "spike_metrics": with_(SALES, hourly(window(*FULL)), LAST24, HISTORY, LATEST, BASELINE,
                           thresholds(), BT, METRICS) + "SELECT * FROM metrics",
    "spike_flags": with_(SALES, hourly(window(*FULL)), LAST24, HISTORY, LATEST, BASELINE,
                         thresholds(), BT, METRICS, FLAGS) + "SELECT * FROM flags",
    "spike_label": labelled(*FULL) + "SELECT * FROM labelled",
    "spike_label_window": labelled(TEST, 7, 4) + "SELECT * FROM labelled",
    "spike_label_flat": labelled(*FULL) + "SELECT * FROM labelled",
    "spike_label_nested": labelled(*FULL) + "SELECT * FROM labelled",
    "sales_lookback_page": with_(SALES) + "SELECT * FROM sales " + window(TEST, 90, "(]") + " ORDER BY sale_id LIMIT 10",
    "project_country": with_(ALERTS) + "SELECT country_code FROM alerts",
    "project_plus": with_(ALERTS) + "SELECT country_code, accumulated_sales + 10 AS sales_plus_10 FROM alerts",
    "filter_large_alerts": with_(ALERTS) + "SELECT * FROM alerts WHERE accumulated_sales > 2000000",
    "filter_country": with_(ALERTS) + "SELECT * FROM alerts WHERE country_code = 'NATION_7'",
    "alerts_by_country": with_(ALERTS) + "SELECT country_code, count(*) AS count FROM alerts GROUP BY country_code",
    "sql_on_view": with_(ALERTS) + "SELECT country_code, count(*) AS count FROM alerts GROUP BY country_code",
    "sql_select_all": with_(ALERTS) + "SELECT * FROM alerts",
    "monthly_counts": with_(MONTHLY_SALES) + (
        "SELECT agent_code, count(*) AS count FROM monthly_sales GROUP BY agent_code, country_code, month"),
    "monthly_counts_sql": with_(MONTHLY_SALES) + (
        "SELECT agent_code, count(*) AS count FROM monthly_sales GROUP BY agent_code, country_code"),
    "tickets_sum": with_(TICKETS) + (
        "SELECT agent_code, CAST(SUM(CAST(cash_amount AS DECIMAL(18,2))) AS DOUBLE) AS cash_amount, "
        "CAST(SUM(CAST(ticket_amount AS DECIMAL(18,4))) AS DOUBLE) AS ticket_amount FROM tickets GROUP BY agent_code"),
    "tickets_last_month": with_(TICKETS) + (
        "SELECT * FROM tickets WHERE issue_date >= TIMESTAMP '2000-03-01 12:00:00' "
        "AND issue_date < TIMESTAMP '2000-04-01 12:00:00'"),
    "tickets_month_sum": with_(TICKETS) + (
        "SELECT agent_code, CAST(SUM(CAST(cash_amount AS DECIMAL(18,2))) AS DOUBLE) AS cash_amount, "
        "CAST(SUM(CAST(ticket_amount AS DECIMAL(18,4))) AS DOUBLE) AS ticket_amount FROM tickets "
        "WHERE issue_date < DATE '2000-04-01' AND issue_date >= DATE '2000-03-01' GROUP BY agent_code"),
    "filter_agent_operation": with_(TICKETS) + (
        "SELECT * FROM tickets WHERE agent_code = 58 AND operation_code = 'R'"),
    "describe_amount": with_(TICKETS) + """SELECT 'cashAmount' AS field, count(cash_amount) AS count,
  round(avg(cash_amount), 4) AS mean, round(stddev_samp(cash_amount), 4) AS stddev,
  min(cash_amount) AS min, max(cash_amount) AS max FROM tickets
UNION ALL
SELECT 'ticketAmount', count(ticket_amount), round(avg(ticket_amount), 4), round(stddev_samp(ticket_amount), 4),
  min(ticket_amount), max(ticket_amount) FROM tickets""",
    "match_any": with_(SALES) + """SELECT *, CAST(COALESCE(CAST(client_id = 89 AS INTEGER), 0)
  + COALESCE(CAST(country = 'NATION_7' AS INTEGER), 0) AS BIGINT) AS score
FROM sales WHERE client_id = 89 OR country = 'NATION_7'
ORDER BY score DESC, sale_id LIMIT 20""",
    "first_n": with_(SALES) + "SELECT * FROM sales ORDER BY sale_id LIMIT 20",
    "client_buckets": with_(SALES) + f"""SELECT client_id, count(*) AS doc_count,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM sales {window(TEST, 90, "(]")} GROUP BY client_id ORDER BY doc_count DESC, client_id LIMIT 100000""",
    "client_buckets_month": with_(SALES) + """SELECT client_id, count(*) AS doc_count,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM sales WHERE sold_at > TIMESTAMP '2023-12-20 08:50:01' AND sold_at <= TIMESTAMP '2024-01-20 08:50:01'
GROUP BY client_id ORDER BY doc_count DESC, client_id LIMIT 100000""",
}


RULE = """ruled AS (
  SELECT *, CASE WHEN pct > big_spike_pct THEN 'BIG_SPIKE' WHEN pct > spike_pct THEN 'SPIKE'
                 ELSE 'NO_SPIKE' END AS predicted_label
  FROM labelled)"""

CHI = """chi AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS label, l_quantity AS f0, l_discount AS f1, l_tax AS f2
  FROM lineitem),
cells AS (
  SELECT 0 AS feature_index, f0 AS value, label, count(*) AS o FROM chi GROUP BY 1, 2, 3
  UNION ALL SELECT 1, f1, label, count(*) FROM chi GROUP BY 1, 2, 3
  UNION ALL SELECT 2, f2, label, count(*) FROM chi GROUP BY 1, 2, 3),
value_totals AS (SELECT feature_index, value, sum(o) AS r FROM cells GROUP BY 1, 2),
label_totals AS (SELECT feature_index, label, sum(o) AS c FROM cells GROUP BY 1, 2),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM chi)"""

# Column counts of the driver's tables.
TABLE_COLUMNS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
                 "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3,
                 "benchmark": 2, "labels": 3, "conversations": 4}

LABELLED_FULL = labelled(*FULL)

ORACLE.update({
    "split_by_key": LABELLED_FULL + """SELECT client_id, country, hour, label,
  CASE WHEN substring(md5(concat_ws('|', CAST(client_id AS VARCHAR), country,
                                   CAST(CAST(epoch(hour) AS BIGINT) AS VARCHAR))), 1, 2) < '33'
       THEN 'train' ELSE 'test' END AS part
FROM labelled""",
    "feature_matrix": LABELLED_FULL + """SELECT last24h_amount, daily_amount, spike_amount, big_spike_amount,
  spike_pct, big_spike_pct, diff, pct, label FROM labelled""",
    "label_index": LABELLED_FULL + """SELECT label, count(*) AS count,
  CAST(row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS DOUBLE) AS label_index
FROM labelled GROUP BY label""",
    "eval_accuracy": with_(*labelled_ctes(*FULL), RULE) + """SELECT
  CAST(count_if(label = predicted_label) AS BIGINT) AS correct, count(*) AS total,
  CAST(count_if(label = predicted_label) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100 AS accuracy_pct
FROM ruled""",
    "eval_class_share": with_(*labelled_ctes(*FULL), RULE) + """SELECT label, count(*) AS count,
  CAST(sum(count(*)) OVER () AS BIGINT) AS total,
  CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100 AS share_pct
FROM ruled GROUP BY label""",
    "eval_recall": with_(*labelled_ctes(*FULL), RULE) + """SELECT label, count(*) AS total,
  CAST(count_if(label = predicted_label) AS BIGINT) AS correct,
  CAST(count_if(label = predicted_label) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100 AS recall_pct
FROM ruled GROUP BY label""",
    "eval_report": with_(*labelled_ctes(*FULL), RULE, """per AS (
  SELECT label, count(*) AS count, CAST(count_if(label = predicted_label) AS BIGINT) AS correct
  FROM ruled GROUP BY label)""") + """SELECT label, count, correct,
  CAST(sum(count) OVER () AS BIGINT) AS total,
  CAST(count AS DOUBLE) / CAST(sum(count) OVER () AS DOUBLE) * 100 AS share_pct,
  CAST(correct AS DOUBLE) / CAST(count AS DOUBLE) * 100 AS recall_pct,
  CAST(sum(correct) OVER () AS DOUBLE) / CAST(sum(count) OVER () AS DOUBLE) * 100 AS accuracy_pct
FROM per""",
    # the p-value is the upper tail of the chi-square distribution: one minus the series of the lower incomplete gamma function
    "chi_square": "WITH RECURSIVE " + CHI + """,
tests AS (SELECT c.feature_index,
  CAST((count(DISTINCT c.value) - 1) * (count(DISTINCT c.label) - 1) AS BIGINT) AS degrees_of_freedom,
  sum(CAST(c.o AS DOUBLE) * CAST(c.o AS DOUBLE) / (CAST(v.r AS DOUBLE) * CAST(l.c AS DOUBLE)))
        * (SELECT n FROM total) - (SELECT n FROM total) AS x
FROM cells c
JOIN value_totals v ON c.feature_index = v.feature_index AND c.value = v.value
JOIN label_totals l ON c.feature_index = l.feature_index AND c.label = l.label
GROUP BY c.feature_index),
series AS (SELECT feature_index, 0 AS k, degrees_of_freedom / 2.0::DOUBLE AS a, x / 2 AS y, 1.0::DOUBLE AS term, 1.0::DOUBLE AS total FROM tests
  UNION ALL SELECT feature_index, k + 1, a, y, term * y / (a + k + 1), total + term * y / (a + k + 1) FROM series WHERE k < 2000 AND term > 1e-17 * total),
tails AS (SELECT feature_index, 1 - arg_max(total, k) * exp(a * ln(y) - y - lgamma(a + 1)) AS p FROM series GROUP BY feature_index, a, y)
SELECT t.feature_index, round(greatest(p, 0), 6) AS p_value, degrees_of_freedom, round(x, 6) AS statistic FROM tests t JOIN tails USING (feature_index)""",
    "table_profile": "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, CAST({n} AS BIGINT) AS column_count FROM {name}"
        for name, n in TABLE_COLUMNS.items()),
    "export_projected": """SELECT l_shipdate AS ticket_issueDate, l_extendedprice AS ticket_cashAmount,
  l_returnflag AS ticket_operationCode, l_suppkey AS ticket_agentNumericCode FROM lineitem""",
})


def stated_network_sql() -> str:
    """The forward pass of the stated 8-20-3 network, neuron by neuron: weights and biases by their rule."""
    names = ["last24h_amount", "daily_amount", "spike_amount", "big_spike_amount", "spike_pct", "big_spike_pct", "diff", "pct"]

    def neuron(layer: int, o: int, inputs: list[str]) -> str:
        weight = [((7 * i + 3 * o + 5 * layer) % 11 - 5) / (1000 if layer == 0 else 1) for i in range(len(inputs))]
        bias = ((5 * o + 2 * layer) % 7 - 3) / 10
        return " + ".join([f"({bias!r}::DOUBLE)", *[f"({w!r}::DOUBLE) * {x}" for w, x in zip(weight, inputs, strict=True)]])

    hidden = ", ".join(f"1 / (1 + exp(-({neuron(0, o, names)}))) AS h{o}" for o in range(20))
    outputs = ", ".join(f"{neuron(1, o, [f'h{i}' for i in range(20)])} AS z{o}" for o in range(3))
    return LABELLED_FULL.rstrip() + f""",
hidden AS (SELECT client_id, country, hour, label, {hidden} FROM labelled),
outputs AS (SELECT client_id, country, hour, label, {outputs} FROM hidden),
shifted AS (SELECT *, greatest(z0, z1, z2) AS top FROM outputs),
exps AS (SELECT *, exp(z0 - top) AS e0, exp(z1 - top) AS e1, exp(z2 - top) AS e2 FROM shifted)
SELECT client_id, country, hour, label,
  CASE WHEN z0 = top THEN 'NO_SPIKE' WHEN z1 = top THEN 'SPIKE' ELSE 'BIG_SPIKE' END AS predicted_label,
  round(greatest(e0, e1, e2) / (e0 + e1 + e2), 6) AS probability FROM exps"""


# Keys that train a network have no SQL: their labels and rates depend on fitted weights.
ORACLE.update({
    "split_exact": LABELLED_FULL + """SELECT client_id, country, hour, label,
  CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', CAST(client_id AS VARCHAR), country,
      CAST(CAST(epoch(hour) AS BIGINT) AS VARCHAR)))) <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS part
FROM labelled""",
    "network_scores": stated_network_sql(),
    "country_token_buckets": with_(SALES) + """SELECT key, count(*) AS doc_count, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM (SELECT sale_id, amount, unnest(list_distinct(list_filter(regexp_split_to_array(lower(country), '[^a-z0-9]+'), lambda x: x <> ''))) AS key FROM sales)
GROUP BY key""",
    # the store's bodies say the same as the hand-written queries
    "body_first_n": ORACLE["first_n"],
    "body_match_any": ORACLE["match_any"],
    "body_lookback": ORACLE["sales_lookback"],
    "document_folder_lookback": ORACLE["sales_lookback"],
    "body_lookback_page": ORACLE["sales_lookback_page"],
    "body_client_buckets": ORACLE["client_buckets"],
    "body_client_buckets_month": ORACLE["client_buckets_month"],
    "body_tickets_month": ORACLE["tickets_last_month"],
    "sales_last24h_split": ORACLE["sales_last24h"],
    "client_buckets_heavy": ORACLE["client_buckets"],
})


# The driver's tables, each column as kind:name (i whole, f fraction, s text, t time, a array of fractions).
TABLE_FIELDS = {
    "region": "i:r_regionkey s:r_name",
    "nation": "i:n_nationkey s:n_name i:n_regionkey",
    "customer": "i:c_custkey s:c_name i:c_nationkey f:c_acctbal s:c_mktsegment",
    "supplier": "i:s_suppkey s:s_name i:s_nationkey f:s_acctbal",
    "part": "i:p_partkey s:p_name s:p_brand s:p_type i:p_size f:p_retailprice",
    "orders": "i:o_orderkey i:o_custkey s:o_orderstatus f:o_totalprice t:o_orderdate s:o_orderpriority",
    "lineitem": "i:l_orderkey i:l_partkey i:l_suppkey i:l_linenumber f:l_quantity f:l_extendedprice f:l_discount f:l_tax "
                "s:l_returnflag s:l_linestatus t:l_shipdate",
    "events": "i:event_id t:ts i:user_id s:event_type f:value s:props",
    "documents": "i:doc_id s:text s:lang s:source i:n_chars",
    "embeddings": "i:vec_id a:embedding i:label",
    "pages": "i:page_id s:url s:html",
    "benchmark": "i:item_id s:text",
    "labels": "i:doc_id i:quality i:toxic",
    "conversations": "i:conv_id i:turn s:role s:text",
}
# a fraction as whole millionths and the nine digits after them
FRACTION = ("concat(CAST(CAST(floor({0} * 1000000.0::DOUBLE) AS BIGINT) AS VARCHAR), '.', CAST(CAST(floor(({0} * 1000000.0::DOUBLE "
            "- floor({0} * 1000000.0::DOUBLE)) * 1000000000.0::DOUBLE) AS BIGINT) AS VARCHAR))")
VALUE_TEXT = {
    "i": "CAST({0} AS VARCHAR)", "s": "{0}", "f": "CASE WHEN {0} IS NOT NULL THEN " + FRACTION + " END",
    "t": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')",
    "a": "concat(CAST(len({0}) AS VARCHAR), ':', array_to_string([" + FRACTION.replace("{0}", "CAST(e AS DOUBLE)") + " for e in {0}], ','))",
}


def sums(table: str, fields: str) -> str:
    texts = ", ".join(f"coalesce({VALUE_TEXT[kind].format(name)}, '~')" for kind, name in (f.split(":") for f in fields.split()))
    return (f"SELECT '{table}' AS table_name, count(*) AS row_count, "
            f"CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws('|', {texts})), 1, 8) AS BIGINT)), 0) AS BIGINT) AS content_sum FROM {table}")


ORACLE["copy_tables"] = ORACLE["export_restore"] = "\nUNION ALL\n".join(sums(t, f) for t, f in TABLE_FIELDS.items())


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
