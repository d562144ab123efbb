import importlib.util

from conftest import SF_SMALL
from llm.helpers import docs
from llm.test_decontaminate import brute as leaks
from llm.test_lines import brute as removed_lines
from llm.test_mixing import brute as mixed
from llm.test_neardup import brute as classes

import corpus_pipeline
from surgewatch.llm import queries

BENCH = [(0, "one two three four five six seven eight nine ten"), (1, "alpha beta gamma delta epsilon zeta eta theta")]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_whole_pipeline_stage_by_stage(spark):
    """Each stage on all that the one before kept, against brute force (the language stage: against its rule)."""
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    now = rows(df)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{queries.__name__}-{k}"
        out = corpus_pipeline.saved(stage(spark, df, SF_SMALL), path)
        if k < 4:
            assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
        got = rows(out)
        if name == "language":
            assert set(got) == {i for i, r in now.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "lines":
            want = removed_lines([(i, r.text) for i, r in now.items()], 2, 20)
            texts = {}
            for i, r in now.items():
                left = [x for n, x in enumerate(r.text.split("\n")) if n not in want[i][1]]
                if not want[i][1] or any(x.strip() for x in left):
                    texts[i] = "\n".join(left)
            assert {i: r.text for i, r in got.items()} == texts
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_duplicates":
            own = classes([(i, r.text) for i, r in now.items()])
            assert set(got) == {i for i, c in own.items() if i == c}
        elif name == "decontaminate":
            assert set(got) == set(now) - {d for d, _ in leaks(((i, r.text) for i, r in now.items()), bench, 5, 0.5)}
        else:
            want = mixed([(i, r.text, r.lang, r.source) for i, r in now.items()], **queries.MIX)
            cols = ["doc_id", "domain", "language", "origin", "epoch", "tokens", "take_tokens"]
            assert sorted(tuple(r) for r in out.select(*cols).collect()) == want
            assert all(r.text == now[r.doc_id].text for r in out.collect())
        df, now = out, got


def test_edge_cases(spark, tmp_path):
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    line = "this is one long line that stands in several documents of the set"
    texts = [None, "", "12 34", line, line + "\nand a line of its own in this document", "copy of some words here to see it go away",
             "Copy of some words, here to see it go away.", BENCH[0][1] + " and then some more", "word " * 30_000]
    langs = [None, "en", "en", "en", "en", "en", "de", "en", "en"]
    df = docs(spark, texts, langs, [None, "a", "b", "c", "src1", "src1", "src1", "src1", "src9"]).selectExpr("*", "1 as chunk", "'k' as sig", "2 as id")
    train = df
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.saved(stage(spark, df, str(tmp_path)), "edge")
        assert k == 4 or out.columns == train.columns
        df = out
    assert {r.doc_id for r in df.collect()} <= {3, 4, 5, 8}
    empty = train.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_entry_registers_the_pipeline():
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
