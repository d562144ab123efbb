import random
import re

import numpy as np
import pyarrow.dataset as ds
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import docs

from surgewatch.llm import decontaminate, queries


def tokens(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())


def tiled(a, b, n):
    """Greedy string tiling on words, by trying every pair of places in every round."""
    ua, ub, out = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for x in range(len(a)):
            for y in range(len(b)):
                k = 0
                while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k] and not ua[x + k] and not ub[y + k]:
                    k += 1
                if k >= n and (best is None or k > best[2]):
                    best = (x, y, k)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            ua[best[0] + k] = ub[best[1] + k] = True


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), max_size=18), st.integers(1, 4))
def test_tiles_equal_plain_greedy_tiling(a, b, n):
    pairs = [(x, y) for x in range(len(a) - n + 1) for y in range(len(b) - n + 1) if a[x:x + n] == b[y:y + n]]
    d, i = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    got = decontaminate.tiles(d, i, len(b), n)
    want = tiled(a, b, n)
    assert sum(t[2] for t in got) == sum(t[2] for t in want) and got == want[:len(got)]


def brute(rows, bench, n, coverage):
    out = {}
    for i, t in rows:
        a = tokens(t)
        grams = {tuple(a[k:k + n]) for k in range(len(a) - n + 1)}
        for j, u in bench:
            b = tokens(u)
            if len(b) < n or not any(tuple(b[k:k + n]) in grams for k in range(len(b) - n + 1)):
                continue
            # words without a seed cannot be in a tile
            keep = [k for k in range(len(a)) if any(tuple(a[s:s + n]) in {tuple(b[q:q + n]) for q in range(len(b) - n + 1)} for s in range(max(0, k - n + 1), k + 1))]
            part = [a[k] if k in set(keep) else None for k in range(min(keep), max(keep) + 1)] if keep else []
            c = sum(x[2] for x in tiled(part, b, n))
            if c >= coverage * len(b):
                out[i, j] = c
    return out


def got(df):
    return {(r.doc_id, r.item_id): r.n_words for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    t = ds.dataset(f"{SF_SMALL}/documents.parquet").to_table()
    b = ds.dataset(f"{SF_SMALL}/benchmark.parquet").to_table()
    want = brute(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True), list(zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True)), 5, 0.5)
    assert got(queries.op1_decontaminate(spark, SF_SMALL)) == want and want


def fixture(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(40)] for _ in range(8)]
    noise = lambda n: [word() for _ in range(n)]
    texts = [None, "", " ".join(noise(100))]
    for w in items:
        texts.append(" ".join(noise(30) + w + noise(20)).upper())
        texts.append(" ".join(w[28:] + noise(10) + w[:14] + noise(3) + w[14:28]))      # reordered
        texts.append(" ".join(noise(10) + w[:15] + noise(10)))                        # too little
        texts.append(" ".join(w[:8] * 10))                                          # a part, repeated
    texts.append(" ".join(noise(60_000) + items[0]))
    texts.append("ha " * 500)
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(90, "too short"), (91, None), (92, ""), (93, "ha " * 30), (None, "un named item of six words")]
    return texts, bench, docs(spark, texts).selectExpr("*", "1 as item_id", "'t' as id"), spark.createDataFrame(bench, "item_id bigint, text string")


def test_reordered_short_repeated_and_long(spark):
    texts, bench, df, b = fixture(spark)
    want = brute(enumerate(texts), bench, 5, 0.5)
    assert got(decontaminate.matches(df, b)) == want
    assert {k[0] for k in want} >= set(range(3, 35, 4)) | set(range(4, 35, 4)) and not {k[0] for k in want} & set(range(5, 35, 4))
    assert got(decontaminate.matches(df, b, slice_bytes=300)) == want
    left = decontaminate.clean(df, b, slice_bytes=300)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {k[0] for k in want}


def test_empty_tables_and_null_ids(spark):
    _, _, df, b = fixture(spark)
    assert decontaminate.matches(df, b.limit(0)).count() == 0 and decontaminate.clean(df, b.limit(0)).count() == df.count()
    assert decontaminate.matches(df.limit(0), b).count() == 0
    nulls = df.filter("doc_id = 3").selectExpr("cast(null as bigint) as doc_id", "text")
    assert got(decontaminate.matches(nulls, b)) == {(None, 0): 40} and decontaminate.clean(nulls, b).count() == 0


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def test_copies_in_capitals_of_any_alphabet(spark):
    items = ["ΟΔΥΣΣΕΥΣ ΗΡΘΕ ΣΤΟΝ ΤΟΠΟ ΤΟΥ ΠΑΛΙ ΧΩΡΙΣ ΤΟΥΣ ΑΛΛΟΥΣ", "İSTANBUL İLE İZMİR ARASI İKİ SAAT SÜRÜYOR DİYE DUYDUM", "GROSSE STRASSE MIT ÄPFELN UND ÖL IM ÜBERFLUSS"]
    df = docs(spark, [*items, "nothing of the kind here"])
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.matches(df, bench(spark, items)).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0}
    assert [r.doc_id for r in decontaminate.clean(df, bench(spark, items), slice_bytes=60).collect()] == [3]


def test_repeated_rows_are_each_reported(spark):
    df = docs(spark, ["one two three four five six seven"])
    assert decontaminate.matches(df.union(df), bench(spark, ["one two three four five six"])).count() == 2
    assert decontaminate.clean(df.union(df), bench(spark, ["one two three four five six"])).count() == 0


def test_many_items_that_begin_alike_are_ruled_out_at_once():
    import time

    import pyarrow as pa

    start = "this is how each of the items begins"
    items = [start + " " + " ".join(f"w{k}x{i}" for k in range(20)) for i in range(2000)]
    seeds = decontaminate.Seeds(list(range(2000)), items, 5)
    texts = pa.array([start + " and goes on " + " ".join(f"v{i}k{j}" for j in range(100)) for i in range(20)] + [items[7]])
    began = time.perf_counter()
    found = [(row, it) for row, it, _ in decontaminate.found(seeds, texts, 0.5)]
    assert found == [(20, 7)] and time.perf_counter() - began < 1.0
