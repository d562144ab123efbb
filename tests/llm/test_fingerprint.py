import math
import random
import re
from collections import Counter
from hashlib import sha256

import duckdb
from conftest import SF_SMALL
from llm.helpers import DOCS, docs
from pyspark.sql import functions as F

from surgewatch.llm import fingerprint, queries

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def oracle(frame):
    con = duckdb.connect()
    con.register("documents", frame)
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({fingerprint.oracle_sql()})").fetchall(), key=repr)


def weighted_jaccard(a, b):
    x, y = Counter(re.findall(fingerprint.TOKEN, a)), Counter(re.findall(fingerprint.TOKEN, b))
    top = sum(max(x[w], y[w]) for w in x | y)
    return sum(min(x[w], y[w]) for w in x | y) / top if top else 1.0


def test_whole_table_equals_sql(spark):
    got = rows_of(queries.op11_fingerprint(spark, SF_SMALL))
    assert got == oracle(duckdb.sql(f"SELECT * FROM '{SF_SMALL}/documents.parquet'").df()) and got


def test_collision_rate_is_weighted_jaccard(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    bags = [" ".join(w for w in rng.sample(vocabulary, 30) for _ in range(rng.choice([1, 1, 2, 5, 40]))) for _ in range(12)]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in bags for b in bags if a < b)]
    df = spark.createDataFrame(pairs, "id long, a string, b string").repartition(4, "id")
    sigs = fingerprint.signatures(df, ["id"], ["a", "b"], samples=512)
    near = {r.id: r.near for r in sigs.select("id", fingerprint.likeness(F.col("sig_a"), F.col("sig_b")).alias("near")).collect()}
    errors = []
    for i, a, b in pairs:
        want = weighted_jaccard(a, b)
        assert abs(near[i] - want) < 5 * math.sqrt(0.25 / 512)
        errors.append(near[i] - want)
    assert abs(sum(errors) / len(errors)) < 0.02   # no bias


def edited_of(rows):
    """doc_id -> text with its last third replaced by the start of the next one in descending order."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        out[i] = t[:len(t) - k] + nxt[:k]
    return out


def test_edited_texts_and_estimates(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["alpha", "b\u00e9ta", "\u03b3", "\U0001f600", "d" * 9]) for _ in range(rng.randint(0, 60))) for _ in range(70)]
    got = fingerprint.digests(docs(spark, texts)).collect()
    want = edited_of(list(enumerate(texts)))
    assert len(got) == len(texts)
    for r in got:
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == sha256(want[r.doc_id].encode()).hexdigest()
        assert abs(r.near_edited - weighted_jaccard(texts[r.doc_id], want[r.doc_id])) < 0.5


def test_equal_texts_have_equal_fingerprints(spark):
    got = fingerprint.digests(docs(spark, ["x y z", "q", "x y z", "x  y\tz"])).collect()
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[2].fingerprint == by[3].fingerprint != by[1].fingerprint
    alone = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs(spark, ["x y z", "q"])).collect()}
    assert alone == {0: by[0].fingerprint, 1: by[1].fingerprint}


def test_nulls_empty_repeated_and_long(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n "), (None, "n a"), (None, "n b"), (5, "same"), (5, "same"), (5, "other words"), (7, long), (8, "tail")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = fingerprint.digests(df)
    import pandas as pd

    frame = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], dtype="Int64"), "text": [t for _, t in rows]})
    assert rows_of(got) == oracle(frame)
    by = {(r.doc_id, r.n_chars): r for r in got.collect()}
    assert by[(1, 0)].fingerprint == "" == by[(2, 0)].fingerprint and by[(1, 0)].near_edited == 1.0
    assert len(got.collect()) == len(rows)


def test_single_row_and_empty_table(spark):
    one = fingerprint.digests(docs(spark, ["abcdef"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert one[0].edited_sha256 == sha256(b"abcdab").hexdigest()
    assert fingerprint.digests(docs(spark, ["a"]).filter("doc_id < 0")).collect() == []


def test_clashing_column_names(spark):
    df = docs(spark, ["a b c", "d e f"])
    for name in ("id", "key", "range", "no", "halo", "place", "at", "bounds", "edited", "fingerprint"):
        df = df.withColumn(name, F.lit("x"))
    assert rows_of(fingerprint.digests(df)) == rows_of(fingerprint.digests(docs(spark, ["a b c", "d e f"])))


def test_no_python_and_one_text_shuffle(spark):
    plan = queries.op11_fingerprint(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
