import random

import numpy as np
import pyarrow.dataset as ds
from llm.helpers import docs, held_out

from surgewatch.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    for s in np.unique(scores):
        ranks[scores == s] = (np.flatnonzero(scores[order] == s) + 1).mean()
    pos = labels > 0
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    t = ds.dataset(f"{SF}/documents.parquet").to_table()
    label = {r["doc_id"]: r["toxic"] for r in ds.dataset(f"{SF}/labels.parquet").to_table().to_pylist()}
    rows = queries.op9_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(t["doc_id"].to_pylist())
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    unseen = [(r.score, r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    s, p, y = (np.array(x) for x in zip(*unseen, strict=True))
    assert auc(s, y) > 0.9 and p[y == 0].mean() < 0.03 and p[y == 1].mean() > 0.6


def biased(spark, n=400):
    """Labelled texts in which one group is named far more often in the toxic ones."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    texts, labels = [], []
    for i in range(n):
        bad = i % 2
        words = [word() for _ in range(20)]
        group = rnd.random()
        if bad and group < 0.8 or not bad and group < 0.05:
            words.append("muslims")
        elif group > 0.9:
            words.append("christians")
        if bad and rnd.random() < 0.7:
            words.append(rnd.choice(["idiot", "scum", "moron"]))
        rnd.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, bad))
    neutral = ["the muslims of the town met", "the christians of the town met", "what scum and what a moron", "the town met"]
    df = docs(spark, texts + neutral)
    return df, spark.createDataFrame(labels, "doc_id bigint, toxic int"), n


def test_identity_terms_do_not_move_the_score(spark):
    df, labels, n = biased(spark)
    sample = toxicity.sampled(df, labels, 400, "doc_id", "text", "toxic")
    wanted = ["the muslims of the town met", "the christians of the town met", "what scum and what a moron"]
    import pyarrow as pa
    free = toxicity.fit(sample, 500, 4, swap_penalty=0.0)
    fair = toxicity.fit(sample, 500, 4)
    a, b, c = free.score(pa.array(wanted), toxicity.sieve_of(free.keys))
    x, y, z = fair.score(pa.array(wanted), toxicity.sieve_of(fair.keys))
    assert a - b > 0.3 and abs(x - y) < 0.1 and x < 0.7 and z > 0.7


def test_edge_cases(spark):
    df, labels, n = biased(spark, 400)
    odd = docs(spark, [None, "", "scum " * 90_000, "ünï çödé"], first=9000).selectExpr("*")
    both = df.union(odd).selectExpr("*", "1 as id", "2 as held", "'t' as score")
    rows = {r.doc_id: r for r in toxicity.scored(both, labels.selectExpr("*", "doc_id as id")).collect()}
    assert rows[9000].score == rows[9001].score and rows[9002].score > rows[9001].score and len(rows) == both.count()
    none = toxicity.scored(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    one = toxicity.scored(df, labels.filter("toxic = 0")).collect()
    assert max(r.score for r in one) < 0.1
    nulls = df.selectExpr("cast(null as bigint) as doc_id", "text")
    assert {r.held_out for r in toxicity.scored(nulls, labels).collect()} == {False}
    assert toxicity.scored(df.limit(0), labels).count() == 0
    odd_labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (0, 1)], "doc_id bigint, toxic int"))
    assert toxicity.scored(df, odd_labels).count() == df.count()


def test_letters_that_only_look_like_ascii_are_swapped(spark):
    term = next(t for t in toxicity.PLACE if "s" in t)
    new = toxicity.swapped(f"the {term.replace('s', chr(0x17F))} met", 3)
    assert new and new != f"the {term} met" and new.split()[1] in toxicity.PLACE
    for odd in (chr(0x130), chr(0x131), chr(0x212A)):
        toxicity.swapped(" ".join(t.replace("i", odd).replace("k", odd) for t in toxicity.PLACE), 1)
    df, labels, _ = biased(spark, 60)
    odd = df.selectExpr("doc_id", f"concat(text, ' {term.replace('s', chr(0x17F))}') as text")
    assert toxicity.scored(odd, labels).count() == df.count()


def test_the_fit_does_not_depend_on_the_layout(spark):
    df, labels, _ = biased(spark)
    scores = [{r.doc_id: round(r.score, 9) for r in toxicity.scored(d, labels).collect()} for d in (df.repartition(1), df.repartition(7))]
    assert scores[0] == scores[1]


def test_the_sample_stays_bounded_when_rows_share_an_id(spark):
    df, labels, n = biased(spark)
    many = df.union(df.filter("doc_id = 1").selectExpr("explode(sequence(1, 500)) as k", "*").drop("k"))
    assert toxicity.sampled(many, labels, 100, "doc_id", "text", "toxic").count() <= 100
