import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from llm.helpers import docs
from pyspark.sql import functions as F

from surgewatch.llm import exchange, lines, queries, words


def counted(spark, df, n):
    """Words of each chunk with the number of their occurrences in all chunks, through the exchange."""
    def keys_of(table):
        texts = exchange.unpacked(table)
        words = [w for i in range(len(texts.ids)) for w in texts.text(i).decode().split()]
        return np.array([int(w) * 0x9E3779B97F4A7C15 % 2**64 for w in words], np.uint64)

    def ask(chunk, table):
        keys, counts = np.unique(keys_of(table), return_counts=True)
        return exchange.request_rows(chunk, keys, counts.astype(np.uint32), n, 8)

    def reply(table):
        keys, at = exchange.bucket_keys(table, 8)
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["note"].to_pylist()])
        seen, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, counts, len(seen))[place].astype(np.uint32)
        return [total[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def tell(chunk, table, answers):
        keys = np.unique(keys_of(table))
        got = exchange.answered(answers, len(keys), keys, n, np.uint32)
        return [(chunk, str(k), int(c)) for k, c in zip(keys, got, strict=True)]

    return exchange.asked(exchange.chunked(df, n), n, ask, reply, tell, "chunk int, key string, total int")


def test_hops_give_the_same_answers(spark, monkeypatch):
    texts = [" ".join(str((i * k) % 97) for k in range(i % 40)) for i in range(400)] + [None, ""]
    df = docs(spark, texts)
    direct = sorted(tuple(r) for r in counted(spark, df, 23).collect())
    monkeypatch.setattr(exchange, "HOP_CHUNKS", 4)
    hopped = counted(spark, df, 23)
    assert sorted(tuple(r) for r in hopped.collect()) == direct and direct
    want = {}
    for t in texts:
        for w in (t or "").split():
            want[str(int(w) * 0x9E3779B97F4A7C15 % 2**64)] = want.get(str(int(w) * 0x9E3779B97F4A7C15 % 2**64), 0) + 1
    assert {k: c for _, k, c in direct} == want


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op4_line_dedup", "op8_minhash_neardup"])
def test_operators_over_hops_equal_the_direct_way(spark, monkeypatch, name):
    want = sorted(map(repr, queries.QUERIES[name](spark, SF_SMALL).collect()))
    monkeypatch.setattr(exchange, "HOP_CHUNKS", 2)
    assert sorted(map(repr, queries.QUERIES[name](spark, SF_SMALL).collect())) == want


def test_chunks_grow_and_rows_stay_few(spark, monkeypatch):
    gb = 1 << 30
    assert [exchange.chunk_count(spark, s) for s in (0, gb // 2, gb)] == [8, 128, 256]
    assert exchange.chunk_count(spark, 30 * gb) == 30 * gb // exchange.MAX_CHUNK_BYTES
    # rows of the first hop: of the order of n ** 1.5, against n ** 2 without hops
    schema = exchange.arrow_schema(exchange.REQUEST_SCHEMA)
    for n in (1_000, 4_000):
        width = int(n ** 0.5) + 1
        keys = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows = exchange.request_rows(0, np.sort(keys), None, n, 4)
        assert len(rows) == n and len(exchange._split(exchange.table_of(rows, schema), np.array([r[0] for r in rows]) // width)) <= width


def test_rows_without_an_id_are_dealt_by_their_text(spark):
    df = spark.range(300).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sizes = exchange.chunked(df, 16).select("chunk", F.octet_length("lens").alias("n")).groupBy("chunk").agg(F.sum("n")).collect()
    assert len(sizes) == 16 and max(r[1] for r in sizes) < 8 * 60


def test_smallest_hashes_of_a_hot_label(spark):
    rows = [(0 if i % 50 else 1, i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "label int, id bigint").select("label", F.xxhash64("id").alias("h"), "id").repartition(4)
    got = {(r.label, r.id) for r in exchange.lowest_hashes(df, "label", 30).collect()}
    by = {y: sorted((r.h, r.id) for r in df.filter(F.col("label") == y).collect())[:30] for y in (0, 1)}
    assert got == {(y, i) for y, best in by.items() for _, i in best}
    assert isinstance(exchange._unpacked(pa.chunked_array([], pa.binary()), exchange.arrow_schema("a int")), pa.Table)


def test_saved_tables_have_few_files(spark):
    """Many small partitions are written as few files, with all rows."""
    out = exchange.saved(spark.range(0, 2110, numPartitions=211).withColumn("half", F.col("id") / 2), "few")
    assert len(out.inputFiles()) <= exchange.file_count(spark) < 211
    assert sorted(map(tuple, out.collect())) == [(i, i / 2) for i in range(2110)]


def test_tables_kept_by_a_worker_are_bounded():
    """The tables of powers that stay in a worker follow the blocks, not the chunk."""
    data = np.frombuffer(b"some words of a line\n" * 150_000, np.uint8)
    texts = exchange.Texts(np.arange(1500), data, np.arange(1501) * (len(data) // 1500))
    words._powers.clear()
    assert len(lines.Lines(texts).sig) == 150_000 + 1500
    assert sum(x.nbytes for pair in words._powers.values() for x in pair) <= 10 << 20
