"""The labelling chain with one client holding a third of all rows, against brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from surgewatch.plans import flagship
from tests.helpers import HISTORY_SCHEMA, THRESHOLD_SCHEMA

SALES_SCHEMA = "client_id bigint, country string, sold_at timestamp_ntz, amount double"


def brute_force(sales, history, thresholds):
    cents = defaultdict(int)
    for c, k, ts, a in sales:
        cents[(c, k, ts.replace(minute=0, second=0, microsecond=0))] += round(a * 100)
    latest = {}
    for c, k, m, a in history:
        latest[(c, k)] = max(latest.get((c, k), m), m)
    base = defaultdict(list)
    for c, k, m, a in history:
        if m == latest[(c, k)]:
            base[(c, k)].append(a / 30)
    thr = defaultdict(list)
    for row in thresholds:
        thr[row[0]].append(row[1:])
    out = []
    for (c, k, h), v in cents.items():
        last = sum(x for (c2, k2, h2), x in cents.items()
                   if (c2, k2) == (c, k) and h - timedelta(hours=24) <= h2 <= h) / 100
        for daily in base.get((c, k), []):
            for sa, ba, sp, bp in thr.get(k, []):
                diff = last - daily
                if daily == 0:
                    continue
                pct = diff / daily * 100
                label = "BIG_SPIKE" if (ba < diff and bp < pct) else "SPIKE" if (sa < diff and sp < pct) else "NO_SPIKE"
                out.append((c, k, h, v / 100, last, diff, pct, label))
    return sorted(out)


def test_hot_client_equals_brute_force(spark):
    rnd = random.Random(11)
    start = datetime(2024, 1, 1)
    sales = [(rnd.randint(2, 40), rnd.choice("AB"), start + timedelta(minutes=rnd.randint(0, 3 * 24 * 60)),
              rnd.randint(1, 9999) / 100) for _ in range(1200)]
    # one client and country holds a third of all rows, crowded into few hours
    sales += [(1, "A", start + timedelta(hours=rnd.choice([5, 6, 30, 31]), minutes=rnd.randint(0, 59)),
               rnd.randint(1, 9999) / 100) for _ in range(600)]
    history = [(c, k, "2023-12", float(rnd.randint(0, 3000))) for c in range(1, 41) for k in "AB"]
    history += [(c, k, "2023-11", 5.0) for c in range(1, 41) for k in "AB"]
    thresholds = [("A", 10.0, 60.0, 20.0, 150.0), ("B", 5.0, 40.0, 10.0, 100.0)]
    got = flagship.label_spikes(spark.createDataFrame(sales, SALES_SCHEMA).repartition(6),
                                spark.createDataFrame(history, HISTORY_SCHEMA),
                                spark.createDataFrame(thresholds, THRESHOLD_SCHEMA), anchor=None)
    got = sorted((r.client_id, r.country, r.hour, r.amount, r.last24h_amount, r.diff, r.pct, r.label)
                 for r in got.collect())
    want = brute_force(sales, history, thresholds)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[7] == w[7]
        assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(g[3:7], w[3:7]))
    hot = [g for g in got if g[0] == 1 and g[1] == "A"]
    assert len(hot) <= 4          # the hot client reaches the window as one row per hour
