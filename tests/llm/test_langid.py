import random

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from llm.helpers import docs, held_out

from surgewatch.llm import langid, queries, words

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    t = ds.dataset(f"{SF}/documents.parquet").to_table()
    lang = dict(zip(t["doc_id"].to_pylist(), t["lang"].to_pylist(), strict=True))
    rows = queries.op10_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and {r.doc_id: r.held_out for r in rows} == {i: held_out(i) for i in lang}
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in unseen]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_features_equal_a_plain_count():
    texts = ["ab cd", "", "é1 x", "a", "..", "abc" * 3]
    data, offsets = langid.lowered(pa.array(texts))
    f, starts = langid.features(data, offsets)
    for t, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        raw = bytes(c if words.NORMAL[c] else 32 for c in t.encode())
        tri = [raw[i:i + 3] for i in range(len(raw) - 2) if raw[i:i + 3] != b"   "]
        assert b - a == len(tri) + len(raw.split()) and (f[a:b] < 1 << langid.BITS).sum() == len(tri)


def test_families_and_pairs(spark):
    rnd = random.Random(1)
    make = lambda parts, n: " ".join("".join(rnd.choice(parts) for _ in range(3)) for _ in range(n))
    parts = {"es": ["ci", "on", "mos"], "pt": ["ca", "ao", "mos"], "it": ["zi", "one", "mo"], "de": ["sch", "ung", "ein"], "xx": ["qo", "wu", "kh"]}
    texts, langs = [], []
    for lang, p in parts.items():
        for n in [3, 5, 10, 20, 40] * 8:
            texts.append(make(p, n))
            langs.append(lang)
    df = docs(spark, texts, langs)
    rows = langid.identify(df, max_rows=150).collect()
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.97
    assert {r.family for r in rows if r.lang_pred == "pt"} == {"romance"} and {r.family for r in rows if r.lang_pred == "xx"} == {"xx"}


def test_edge_cases(spark):
    texts = [None, "", "123 !? — €", "a", "中文", "ein " * 80_000, "das ist ein haus", "the house is here"]
    langs = [None, "en", "en", "en", None, "de", "de", "en"]
    df = docs(spark, texts, langs).selectExpr("*", "lang as lang_pred", "1 as id", "false as held")
    train = docs(spark, ["das ist ein haus und ein baum", "the house is here and there"] * 6, ["de", "en"] * 6, first=100)
    got = {r.doc_id: r for r in langid.identify(df, train).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].score == 0 for i in range(3))
    assert got[3].lang_pred in ("de", "en") and got[4].lang_pred in ("de", "en") and got[5].lang_pred == "de" and got[7].lang_pred == "en"
    kept = langid.accepted(df, train)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7}
    assert {r.lang_pred for r in langid.identify(df, train.limit(0)).collect()} == {"und"}
    one = train.filter("lang = 'de'")
    assert {r.lang_pred for r in langid.identify(df, one).collect()} == {"und", "de"}
    assert langid.identify(df.limit(0), train).count() == 0
    nulls = df.selectExpr("cast(null as bigint) as doc_id", "text", "lang")
    assert {r.held_out for r in langid.identify(nulls, train).collect()} == {False}


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    texts = [f"das ist text {i}" for i in range(300)] + [f"this is text {i}" for i in range(40)] + ["lang " * 5000]
    langs = ["de"] * 300 + ["en"] * 41
    df = docs(spark, texts, langs)
    many = df.union(df.filter("doc_id = 3").selectExpr("explode(sequence(1, 400)) as k", "*").drop("k"))
    got = langid.sampled(many, 60, "doc_id", "text", "lang").collect()
    assert len(got) == len({r.id for r in got}) <= 60 and sum(r.lang == "de" for r in got) == 30
    small = langid.sampled(df, 200, "doc_id", "text", "lang", max_bytes=600).collect()
    assert sum(len(r.text) for r in small) <= 600 and {r.lang for r in small} == {"de", "en"} and 340 not in {r.id for r in small}


def test_repeated_rows_are_judged_alike(spark):
    train = docs(spark, ["das ist ein haus und ein baum", "the house is here and there"] * 6, ["de", "en"] * 6, first=100)
    df = docs(spark, ["das haus", "the house"])
    rows = langid.identify(df.union(df), train).collect()
    assert len(rows) == 4 and len({(r.doc_id, r.lang_pred, r.score) for r in rows}) == 2
