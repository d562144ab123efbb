import math
import random
import re
from collections import Counter

import pyarrow.dataset as ds
from conftest import SF_SMALL
from llm.helpers import docs

from surgewatch.llm import linking, neardup, queries


def bag(t):
    low = t.lower()
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", low)
    if not w:
        return Counter([("raw", low)])
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows, threshold=0.8):
    """doc_id -> class id from all pairs."""
    bags = {i: bag(t) for i, t in rows if t}
    n = len(rows)
    df = Counter(s for b in bags.values() for s in b)
    weight = {i: {s: c * (1 + math.log((1 + n) / (1 + df[s])) / math.log(1 + n)) for s, c in b.items()} for i, b in bags.items()}
    holders = {}
    for i, b in bags.items():
        for s in b:
            holders.setdefault(s, []).append(i)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        wa, wb = weight[a], weight[b]
        both = sum(min(wa[s], wb[s]) for s in wa if s in wb)
        if both / (sum(wa.values()) + sum(wb.values()) - both) >= threshold - 1e-6:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def got(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    t = ds.dataset(f"{SF_SMALL}/documents.parquet").to_table()
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    want = brute(rows)
    assert got(queries.op8_minhash_neardup(spark, SF_SMALL)) == want
    assert len(set(want.values())) < len(want)


def test_copies_near_copies_and_chains(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = [" ".join(base).upper(), " ".join(base), ", ".join(base)]
    for _ in range(25):
        w = list(base)
        for k in rnd.sample(range(150), rnd.randint(1, 5)):
            w[k] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(40)) for _ in range(30)]
    texts += ["two words", "Two  words!", "###", "###", "", "", None, "x"]
    texts.append(" ".join(word() for _ in range(50_000)))
    texts.append(texts[-1] + " end")
    assert got(neardup.classes(docs(spark, texts))) == brute(list(enumerate(texts)))


def test_empty_table_null_ids_and_extra_columns(spark):
    df = docs(spark, ["a b c d e f g", "a b c d e f g"]).selectExpr("*", "1 as sig", "2 as node", "3 as bucket")
    assert got(neardup.classes(df)) == {0: 0, 1: 0}
    assert neardup.classes(df.limit(0)).count() == 0
    nulls = df.selectExpr("cast(null as bigint) as doc_id", "text")
    assert got(neardup.classes(nulls)) == {None: None} and neardup.classes(nulls).count() == 2
    kept = neardup.first_of_each(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [0]
    assert neardup.first_of_each(nulls).count() == 2


def test_rows_that_repeat_an_id(spark):
    df = docs(spark, ["a b c d e f g", "p q r s t u v"])
    out = neardup.classes(df.union(df))
    assert out.count() == 4 and got(out) == {0: 0, 1: 1}


def test_samples_agree_as_often_as_similar(spark):
    import numpy as np

    from surgewatch.llm import words
    h = words.mix(np.arange(1, 1401, dtype=np.uint64))
    w = 1 + (np.arange(1400) % 3)
    a, b = h[:1000], h[400:]
    wa, wb = w[:1000].astype(float), w[400:].astype(float)
    k = 1024
    same = (neardup.samples(a, wa, np.array([0]), k) == neardup.samples(b, wb, np.array([0]), k)).mean()
    both = w[400:1000].sum()
    assert abs(same - both / (wa.sum() + wb.sum() - both)) < 0.05


def test_components_and_cross_pairs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (105, 101), (7, 7)], "a long, b long")
    comp = {r.node: r.comp for r in linking.components(edges).collect()}
    assert comp == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}
    # the leader 1 is far from all; 2..6 are linked to each other only
    members = spark.createDataFrame([(9, n, 0) for n in (1, 2, 3, 4, 5, 6)] + [(8, 1, 0), (8, 7, 0)], "bucket long, node long, info int")
    comps, links = linking.link(members, lambda x, y: x == y, lambda pairs: pairs.filter("a <> 1 and b <> 1").selectExpr("a", "b", "1.0 as sim"), 1.0)
    assert {r.node: r.comp for r in comps.collect()} == {n: 2 for n in (2, 3, 4, 5, 6)}
    assert links.count() == 10


def test_heavy_nodes_that_were_not_compared_with_a_light_leader(spark):
    # the leader 1 has the most company and too little weight to be compared with 2 and 3, which are alike
    members = spark.createDataFrame([(9, 1, (10.0, 10.0)), (9, 2, (20.0, 20.0)), (9, 3, (20.0, 20.0)), (8, 1, (10.0, 10.0)), (8, 4, (10.0, 10.0))],
                                    "bucket long, node long, info struct<weight:double,shared:double>")
    comps, links = linking.link(members, neardup.bounds(0.8)[0], lambda pairs: pairs.selectExpr("a", "b", "if(a = 2 and b = 3, 0.9D, 0.0D) as sim"), 0.8, neardup.bounds(0.8)[1])
    assert {r.node: r.comp for r in comps.collect()} == {2: 2, 3: 2}
    assert [tuple(r) for r in links.collect()] == [(2, 3)]


def test_links_are_named_as_spanning_links(spark):
    out = neardup.classes(docs(spark, [" ".join(f"w{i}" for i in range(200)) + f" end{k}" for k in range(12)]))
    rows = out.collect()
    assert out.columns == ["doc_id", "class_id", "n_spanning_links"] and {r.class_id for r in rows} == {0}
    assert sum(r.n_spanning_links for r in rows) >= 2 * 11 and all(r.n_spanning_links >= 1 for r in rows)
