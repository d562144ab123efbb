import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
from conftest import SF_SMALL
from llm.helpers import DOCS, docs
from pyspark.sql import functions as F

from surgewatch.llm import importance, queries, radix, words

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, numerator=5, denominator=100, min_words=20, buckets=10_000, seed="42"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    corpus = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    wanted = Counter(bucket(f) for t in target for f in features(t)[1])
    s_all, t_all = sum(corpus.values()) + buckets, sum(wanted.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((corpus[b] + 1) * t_all)))
    out = []
    for k, (i, t) in enumerate(rows):
        n, f = features(t)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([k, n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[5], r[2] is None, r[2] or 0))
    for rank, r in enumerate(long[:len(long) * numerator // denominator], 1):
        r[6] = rank
    return sorted((tuple(r[2:]) for r in out), key=repr)


def test_whole_table_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({importance.oracle_sql(**queries.DRAW)})").fetchall(), key=repr)
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    target = [r[0] for r in con.execute("SELECT text FROM benchmark").fetchall()]
    assert rows_of(queries.op12_importance_resample(spark, SF_SMALL)) == want == brute(rows, target)
    assert any(r[4] for r in want)


def test_run_buckets_are_crcs_of_joined_words():
    rng = random.Random(3)
    alphabet = "abcXYZ0189 .,\né中\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(60)] + ["", "a" * 70 + " b " + "c" * 300 + " d"]
    data, offsets = words.buffers(pa.array(texts))
    runs, bounds = importance.run_buckets(data, offsets, (1 << 32) - 1)
    got = [sorted(int(b) for first, found in runs for b in found[(first >= bounds[i]) & (first < bounds[i + 1])]) for i in range(len(texts))]
    assert got == [sorted(zlib.crc32(f.encode()) % ((1 << 32) - 1) for f in features(t)[1]) for t in texts]
    assert [int(n) for n in np.diff(bounds)] == [features(t)[0] for t in texts]


def test_nulls_ties_repeats_long_and_clashing_names(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["Sun", "moon", "sea", "x1", "Über"]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 5, 19, 20, 21, 40]))) for i in range(300)]
    rows += [(None, text(30)), (None, text(30)), (7, None), (8, ""), (9, rows[0][1]), (9, rows[0][1]), (400, text(30_000)), (-(1 << 63), text(25)), ((1 << 63) - 1, text(25))]
    target = [text(30) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(5)
    for name in ("weight", "score", "rank", "n_words", "bucket", "down", "radix_pos"):
        df = df.withColumn(name, F.lit("x"))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    assert rows_of(importance.resample(df, bench, numerator=1, denominator=2)) == brute(rows, target, 1, 2)


def test_empty_tables(spark):
    none = docs(spark, ["a"]).filter("doc_id < 0")
    bench = spark.createDataFrame([(1, "sea")], "item_id bigint, text string")
    assert importance.resample(none, bench).collect() == []
    rows = [(i, f"sea sun {i} " * 10) for i in range(50)]
    assert rows_of(importance.resample(docs(spark, [t for _, t in rows]), bench.filter("item_id > 1"))) == brute(rows, [])


def test_cut_of_equal_scores(spark):
    scores = spark.range(1000).selectExpr("cast(case when id < 900 then 5 else id * 1000003 end as bigint) as score")
    for n in (1, 50, 100, 101, 500, 1000):
        cut = importance.lowest_drawn(scores, n)
        assert scores.filter(F.col("score") >= cut).count() >= n
        assert cut == 5 or n <= 100
    assert importance.lowest_drawn(scores, 0) is None


def test_radix_ranks(spark):
    rng = random.Random(1)
    big = 1 << 63
    for values in ([rng.choice([-3, 0, 1, 7]) for _ in range(500)], [rng.randint(-big, big - 1) for _ in range(300)] + [-big, big - 1], [0] * 40):
        rows = [(v if rng.random() > 0.1 else None, rng.randint(0, 5000), k) for k, v in enumerate(values)]
        df = spark.createDataFrame(rows, "a bigint, b bigint, row int").repartition(4)
        got = sorted(radix.ranked(df, ["a", "b"], block_rows=37).collect(), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, len(rows) + 1))
        key = lambda a, b: (a is None, a or 0, b)
        assert [key(r.a, r.b) for r in got] == sorted(key(a, b) for a, b, _ in rows)
        assert sorted(r.row for r in got) == list(range(len(rows)))
    assert radix.ranked(spark.createDataFrame([], "a bigint"), ["a"]).collect() == []
