import hashlib
import random
import re

import pyarrow.dataset as ds
from conftest import SF_SMALL
from llm.helpers import docs

from surgewatch.llm import queries, substring


def brute(rows, n):
    """doc_id -> (words, removed, sha) by a plain scan in the order of ids."""
    first, out = {}, {}
    parts = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t in rows}
    for i in sorted(parts):
        for k in range(len(parts[i]) - n + 1):
            first.setdefault(tuple(parts[i][k:k + n]), (i, k))
    for i, w in parts.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < (i, k):
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    rows = ds.dataset(f"{SF_SMALL}/documents.parquet").to_table()
    want = brute(list(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True)), 20)
    got = result(queries.op3_substring_dedup(spark, SF_SMALL))
    assert got == want
    assert any(v[1] for v in want.values())


def test_small_windows_ties_nulls_and_long_texts(spark):
    rnd = random.Random(5)
    texts = [None, "", "  \t\n ", "a b c", "x " * 50, "a b c d e f g h", "a b c d e f g h", "q r s t u v w x y"]
    texts += [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    texts.append(" ".join(rnd.choice("abcdefgh") for _ in range(60_000)))
    df = docs(spark, texts)
    got = result(substring.dedup(df, length=8, start=2))
    assert got == brute(list(enumerate(texts)), 8)
    spans = {r.doc_id: (r.spans, r.kept_text) for r in substring.dedup(df, length=8, start=2).collect()}
    assert spans[6][1] == "" and [(s.start, s.words) for s in spans[6][0]] == [(0, 8)]
    assert spans[5][1] == "a b c d e f g h" and spans[0][1] == ""


def test_no_candidates_empty_table_extra_columns_and_one_level(spark):
    df = docs(spark, ["one two three four five six"]).selectExpr("*", "1 as chunk", "'x' as ids")
    assert result(substring.dedup(df, length=4, start=2))[0][:2] == (6, 0)
    assert result(substring.dedup(df.limit(0), length=4, start=2)) == {}
    twice = docs(spark, ["a b c d e", "z a b c d y"])
    assert result(substring.dedup(twice, length=4, start=4))[1][:2] == (6, 4)


def test_repeated_rows_keep_their_window(spark):
    df = docs(spark, ["a b c d e f"])
    got = substring.dedup(df.union(df), length=4, start=2).collect()
    assert [r.n_removed for r in got] == [0, 0]
