import random
from collections import Counter

import pyarrow.dataset as ds
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import docs

from surgewatch.llm import lines, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 5))
def test_banded_distance_equals_the_full_table(a, b, k):
    assert lines.within(a, b, k) == (distance(a, b) <= k)


def brute(rows, max_edits, per):
    """doc_id -> (lines, removed line numbers): components of all line pairs."""
    places, texts = {}, {}
    for i, t in sorted((i, t) for i, t in rows if t):
        for k, line in enumerate(t.split("\n")):
            s = line.strip(" \t\n\r\x0b\x0c")
            if s:
                places.setdefault(s, []).append((i, k))
    seen = sorted(places, key=len)
    root = {s: s for s in seen}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    bags = {s: Counter(s) for s in seen}
    for x, a in enumerate(seen):
        k = min(max_edits, len(a) // per)
        for b in seen[x + 1:]:
            if len(b) - len(a) > k:
                break
            if k and sum(((bags[a] - bags[b]) + (bags[b] - bags[a])).values()) <= 2 * k and distance(a, b) <= k:
                root[find(a)] = find(b)
    keep = {}
    for s in seen:
        keep[find(s)] = min(keep.get(find(s), (1 << 60, 0)), places[s][0])
    gone = {}
    for s in seen:
        for i, k in places[s]:
            if (i, k) != keep[find(s)]:
                gone.setdefault(i, []).append(k)
    return {i: (len(t.split("\n")) if t else 0, sorted(gone.get(i, []))) for i, t in rows}


def got(df):
    return {r.doc_id: (r.n_lines, list(r.removed)) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    t = ds.dataset(f"{SF_SMALL}/documents.parquet").to_table()
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    want = brute(rows, 2, 20)
    assert got(queries.op4_line_dedup(spark, SF_SMALL)) == want
    assert any(v[1] for v in want.values())


def test_edits_chains_short_lines_and_blanks(spark):
    rnd = random.Random(11)

    def edited(s, n):
        for _ in range(n):
            p, kind = rnd.randrange(len(s)), rnd.random()
            s = s[:p] + (rnd.choice("xyzé") if kind < 0.7 else "") + s[p + (kind > 0.3):]
        return s

    base = ["".join(rnd.choice("abcdeö ") for _ in range(rnd.randint(15, 90))) for _ in range(12)]
    texts = []
    for _ in range(40):
        texts.append("\n".join(edited(rnd.choice(base), rnd.randint(0, 3)) for _ in range(rnd.randint(0, 6))))
    texts += [None, "", "\n\n", "  padded line of text  \n\npadded line of text", "short\nshort\nshart", "y" * 900, "y" * 899]
    df = docs(spark, texts)
    for edits, per in ((2, 20), (3, 10)):
        assert got(lines.dedup(df, edits, per)) == brute(list(enumerate(texts)), edits, per)


def test_kept_text_and_carried_columns(spark):
    text = "the same long line of words here\n\nonly in one"
    df = docs(spark, [text, "the same long line of wordz here\nnew", "the same long line of words here", None]).selectExpr("*", "'c' as chunk", "doc_id as rest_0")
    rows = {r.doc_id: r for r in lines.dedup(df, rest=["lang", "chunk", "rest_0", "source"]).collect()}
    assert rows[0].text == text and rows[1].text == "new" and rows[2].text == "" and rows[3].text == ""
    assert all(r.rest_0 == r.doc_id and r.chunk == "c" and r.lang == "en" for r in rows.values())
    assert lines.dedup(df.limit(0), rest=["lang"]).count() == 0


def test_null_ids_and_repeated_rows(spark):
    df = docs(spark, ["a line that is here twice over\nother line of the text"])
    assert [list(r.removed) for r in lines.dedup(df.union(df)).collect()] == [[], []]
    nulls = df.selectExpr("cast(null as bigint) as doc_id", "text")
    both = lines.dedup(df.select("doc_id", "text").union(nulls)).collect()
    assert {r.doc_id: r.n_removed for r in both} == {None: 0, 0: 2}


def test_very_long_lines(spark):
    df = docs(spark, ["y" * 70_000, "y" * 69_999, "z" * 70_000])
    assert [len(r.removed) for r in sorted(lines.dedup(df).collect())] == [0, 1, 0]
