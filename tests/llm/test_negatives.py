import math
import random

import duckdb
import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from surgewatch.llm import negatives, queries

SCHEMA = "id bigint, vector array<float>, label int"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def brute(rows, is_anchor, k=5, n=3):
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in v], y) for i, v, y in rows
          if i is not None and v is not None and y is not None and all(c is not None and math.isfinite(c) for c in v)]
    anchors, out = [], []
    for a in ok:
        if is_anchor(a[0]) and a not in anchors:
            anchors.append(a)
    for i, v, y in anchors:
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, z) for j, w, z in ok if j != i and len(w) == len(v))
        for s, j, _ in [r for r in scored if r[2] == y][:k]:
            near = [r for r in scored if r[2] != y and -50 * s <= -100 * r[0] <= -95 * s]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m, _) in enumerate(near[:n], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_whole_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_SMALL}/embeddings.parquet'")
    want = sorted(con.execute(negatives.ORACLE_SQL).fetchall())
    assert rows_of(queries.op13_hard_negatives(spark, SF_SMALL)) == want and want


def test_larger_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert rows_of(queries.op13_hard_negatives(spark, "/root/testdata/sf0.01")) == sorted(con.execute(negatives.ORACLE_SQL).fetchall())


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(2)
    for d in (1, 3, 8, 13, 64):
        x = np.floor(rng.normal(0, 60, (40, d)) + rng.normal(0, 90, (40, 1)) * rng.random((1, d)))
        m, s = negatives.summaries(x)
        exact, before = x @ x.T, None
        for level in negatives.levels(d):
            mid, off = m[:, level] @ m[:, level].T, s[:, level] @ s[:, level].T
            assert (exact <= mid + off + 1e-6).all() and (exact >= mid - off - 1e-6).all()
            assert before is None or (off <= before + 1e-6).all()
            before = off


def test_few_pairs_are_scored_exactly():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 200, (20, 1)) * np.ones((1, 64)) + rng.normal(0, 120, (20, 8)).repeat(8, axis=1)
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 10, (4000, 64))).astype(np.int64)
    means, devs = negatives.summaries(x.astype(float))
    rows = negatives.Vectors(np.arange(4000), np.zeros(4000, int), x, means, devs)
    a = rows.take(slice(0, 4000, 100))
    need = np.sort(a.x @ x.T, axis=1)[:, -6].astype(float)
    sparse = []
    real = negatives._sparse
    try:
        negatives._sparse = lambda *args: ((sparse.append(len(x[0])), x)[1] for x in real(*args))
        got = sum(len(i) for i, _, _ in negatives.pairs_left(a, rows, np.ones((40, 4000), bool), need, None))
    finally:
        negatives._sparse = real
    assert got >= 6 * 40 and 0 < sum(sparse) < 0.02 * 40 * 4000


def test_both_ways_of_filtering_agree(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(-90, 90, (300, 16))
    means, devs = negatives.summaries(x.astype(float))
    rows = negatives.Vectors(np.arange(300), np.zeros(300, int), x, means, devs)
    scores, wanted = x @ x.T, ~np.eye(300, dtype=bool)
    least, most = np.quantile(scores, 0.8, axis=1), np.quantile(scores, 0.97, axis=1)
    want = {(i, j, int(scores[i, j])) for i, j in zip(*np.nonzero(wanted & (scores >= least[:, None]) & (scores <= most[:, None])), strict=True)}
    for share in (0.0, 0.5, 1.0):
        monkeypatch.setattr(negatives, "DENSE", share)
        got = {(int(i), int(j), int(v)) for ii, jj, vv in negatives.pairs_left(rows, rows, wanted, least, most) for i, j, v in zip(ii, jj, vv, strict=True)}
        assert want == {(i, j, v) for i, j, v in got if least[i] <= v <= most[i]}


def test_best_keeps_the_first_of_each_list():
    rng = random.Random(8)
    best, want = negatives.Best(4, 3), {i: [] for i in range(4)}
    for _ in range(30):
        some = [(rng.randrange(4), rng.randint(-5, 5), rng.randint(0, 99)) for _ in range(rng.randint(0, 6))]
        best.add(*(np.array([s[c] for s in some], np.int64) for c in range(3)))
        for i, score, at in some:
            want[i] = sorted([*want[i], (-score, at)])[:3]
    at, ids, scores = best.rows()
    assert sorted(zip(at.tolist(), (-scores).tolist(), ids.tolist(), strict=True)) == sorted((i, s, x) for i, v in want.items() for s, x in v)


def test_nulls_ties_repeats_lengths_and_names(spark):
    rng = random.Random(9)
    vec = lambda d=6: [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(d)]
    rows = [(i, vec(), rng.randint(0, 2)) for i in range(120)]
    rows += [(7, rows[7][1], rows[7][2])] * 3 + [(10, rows[10][1], rows[10][2])] * 2 + [(10, vec(), 1)]
    rows += [(None, vec(), 1), (200, None, 1), (201, vec(), None), (202, [None] * 6, 1), (203, [float("nan")] * 6, 1), (210, [float("inf")] * 6, 1)]
    rows += [(300 + i, vec(3), i % 2) for i in range(20)] + [(400, [], 0), (401, [], 0), (402, [], 1)]
    df = table(spark, rows)
    want = brute(rows, lambda i: i % 10 == 0)
    assert rows_of(negatives.mine(df, "id % 10 = 0")) == want and want
    # slices of one anchor, and other columns with the names used inside
    for name in ("x", "means", "devs", "anchor", "slot", "score", "rank"):
        df = df.withColumn(name, F.lit("x"))
    assert rows_of(negatives.mine(df, "id % 10 = 0", slice_bytes=4000)) == want


def test_empty_table_large_group_and_large_component(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none, "id % 10 = 0").collect() == []
    rows = [(i, [1.0, 0.5, 0.25], i % 2) for i in range(600)] + [(1000 + i, [0.75, 0.5, i / 64], 2) for i in range(30)]
    assert rows_of(negatives.mine(table(spark, rows), "id % 100 = 0")) == brute(rows, lambda i: i % 100 == 0)
    with pytest.raises(Exception, match="too large"):
        negatives.mine(table(spark, [(10, [1e18], 0), (11, [1.0], 0)]), "id % 10 = 0").collect()
