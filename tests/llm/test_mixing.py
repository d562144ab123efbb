import random
import re
from hashlib import md5

import duckdb
from conftest import SF_SMALL
from llm.helpers import docs

from surgewatch.llm import mixing, queries


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "domain", "language", "origin", "epoch", "tokens", "take_tokens").collect())


def oracle(path, **kw):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return sorted(con.execute("SELECT doc_id, domain, language, origin, epoch, tokens, take_tokens FROM (" + mixing.oracle_sql(**kw) + ")").fetchall())


def test_whole_table_equals_sql(spark):
    got = rows_of(queries.op2_mix_sources(spark, SF_SMALL))
    assert got == oracle(f"{SF_SMALL}/documents.parquet", **queries.MIX) and got


def fill(budget, children):
    """Exact shares by raising a level until every child is used up or the budget is spent: {name: tokens}."""
    open_, out, left = dict(children), {}, budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c * total <= left * w]
        if not full:
            break
        for n in full:
            out[n] = open_.pop(n)[1]
        left = budget - sum(out.values())
    total = sum(w for w, _ in open_.values())
    rest = left
    for n, (w, _) in open_.items():
        out[n] = left * w // total
        rest -= out[n]
    for n in sorted(open_)[:rest]:
        out[n] += 1
    return out


def brute(rows, domains, weights, numerator, denominator, max_epochs, seed):
    leaf = {}
    for i, text, lang, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        if n:
            leaf.setdefault((domains.get(source or "", "other"), lang or "", source or ""), []).append((i, text, n))
    tokens = {k: sum(d[2] for d in v) for k, v in leaf.items()}
    cap = {k: n * max_epochs for k, n in tokens.items()}
    budgets = {(): min(sum(tokens.values()) * numerator // denominator, sum(cap.values()))}
    for depth, level in enumerate(mixing.LEAF):
        nxt = {}
        for node, b in budgets.items():
            names = {k[depth] for k in leaf if k[:depth] == node}
            kids = {x: (weights.get(level, {}).get(x, 1), sum(c for k, c in cap.items() if k[:depth + 1] == (*node, x))) for x in names}
            nxt |= {(*node, x): v for x, v in fill(b, kids).items()}
        budgets = nxt
    out = []
    for k, members in leaf.items():
        epochs, partial = divmod(budgets[k], tokens[k])
        out += [(i, *k, e + 1, n, n) for i, _, n in members for e in range(epochs)]
        key = lambda d: md5(f"{seed}:{epochs + 1}:{'' if d[0] is None else d[0]}:{md5((d[1] or '').encode()).hexdigest()}".encode()).hexdigest()  # noqa: E731, B023
        for d in sorted(members, key=key):
            if partial > 0:
                out.append((d[0], *k, epochs + 1, d[2], min(d[2], partial)))
            partial -= d[2]
    return sorted(out)


def test_shortages_go_to_siblings_then_ancestors(spark):
    rnd = random.Random(4)
    rows = [(f"w{i} " * rnd.randint(0, 30), rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(150)]
    df = docs(spark, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]).selectExpr("*", "1 as id", "'x' as domain", "2 as epoch")
    full = [(i, *r) for i, r in enumerate(rows)]
    for weights, num, den, epochs in (({"domain": {"x": 9, "y": 1}}, 1, 2, 3), ({"origin": {"a": 1, "b": 50}, "language": {"de": 7}}, 2, 1, 3), ({}, 9, 1, 2)):
        kw = {"domains": {"a": "x", "b": "x", "c": "y"}, "weights": weights, "numerator": num, "denominator": den, "max_epochs": epochs, "seed": "s"}
        want = brute(full, **kw)
        assert rows_of(mixing.mix(df, **kw)) == want
        total = sum(len(r[0].split()) for r in rows)
        assert sum(r[6] for r in want) == min(total * num // den, total * epochs)


def test_ranges_do_not_change_the_prefix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 2)
    assert rows_of(queries.op2_mix_sources(spark, SF_SMALL)) == oracle(f"{SF_SMALL}/documents.parquet", **queries.MIX)


def test_edge_cases(spark):
    kw = {"domains": {}, "weights": {"origin": {"zero": 0}}, "numerator": 1, "denominator": 2, "max_epochs": 2, "seed": "s"}
    df = docs(spark, [None, "", " \n", "a b c d", "long " * 50_000, "q r"], [None] * 6, ["s", "s", "s", "s", None, "zero"])
    got = rows_of(mixing.mix(df, **kw))
    assert {r[0] for r in got} <= {3, 4} and sum(r[6] for r in got) == (4 + 50_000 + 2) // 2
    assert mixing.mix(df.limit(0), **kw).count() == 0
    nulls = df.selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source")
    assert sum(r.take_tokens for r in mixing.mix(nulls, **kw).collect()) == 25_003
    twice = docs(spark, ["a b c d"]).union(docs(spark, ["a b c d"]))
    assert [r.take_tokens for r in mixing.mix(twice, **kw).collect()] == [4, 4]
    texts = mixing.mix(df, **kw, carry=["text", "source"])
    assert texts.columns[-2:] == ["text", "source"] and {len(r.text.split()) == r.tokens for r in texts.collect()} == {True}
