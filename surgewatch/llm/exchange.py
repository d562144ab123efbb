"""Chunks of documents, and counting of keys over the whole corpus.

Several operators ask the same thing: which of a document's many keys (word
windows, shingles, line segments) occur elsewhere, and how often. A row per key
would shuffle many times the input. Here documents are dealt into *chunks* by
a hash of their id, and each chunk sends every distinct key once, as packed
bytes, to the key's *bucket*. The bucket answers with a few packed bits per key
in the same order, and the chunk (a reused exchange, not a second shuffle)
reads the answers next to its documents.

Pre-aggregation inside a chunk makes hot keys harmless: a key of a third of all
documents costs a bucket one entry per chunk. Chunks and buckets are sized from
the input, so a task holds a bounded number of bytes at every size.

A row for each chunk and bucket would grow with the square of the input. Chunks
therefore grow with its square root, from ``CHUNK_BYTES`` up to ``MAX_CHUNK_BYTES``,
and beyond ``HOP_CHUNKS`` chunks keys and answers travel in two hops: a chunk packs
what goes to a group of buckets into one row, and a relay for each group of chunks
and group of buckets, which holds about a chunk's bytes, packs anew for each bucket.
So ``n`` chunks make about ``n ** 1.5`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from surgewatch.llm import words
from surgewatch.session import shared_dir

CHUNK_BYTES, MAX_CHUNK_BYTES = 4 << 20, 16 << 20
HOP_CHUNKS = 1024
FILES_PER_CORE, PARTITIONS_PER_FILE = 4, 8
PACK_BYTES = 8 << 20
NO_ID = -(1 << 63)
CHUNK_SCHEMA = "chunk int, ids binary, lens binary, text binary, rest binary"


def file_count(spark: SparkSession) -> int:
    """Files of a saved table at most: some for each core, so that all cores write.

    Cores may still be coming (dynamic allocation): no task takes over more than
    ``PARTITIONS_PER_FILE`` partitions of a shuffle.
    """
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, -(-shuffled // PARTITIONS_PER_FILE))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    Partitions are put together without a shuffle, to ``file_count`` at most: a file for each of many
    small ones costs an executor several file operations, and on some file systems (Hadoop's local one
    without its native library) a process beside the executor for each of them.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.coalesce(file_count(spark)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lowest_hashes(rows: DataFrame, label: str, limit: int) -> DataFrame:
    """The ``limit`` rows of each label with the smallest ``h`` (a 64-bit hash), ties by the other columns.

    Counts come first: of a label with many rows only those under a hash that leaves about twice
    ``limit`` are ranked, so a hot label is no hot task.
    """
    rows = saved(rows, "hashes")
    mean = 2 * limit + 100
    cuts = {r[label]: -(1 << 63) + (1 << 64) * mean // r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] > 2 * mean}
    under = F.lit(True)
    for value, cut in cuts.items():
        under = under & ((F.col(label) != F.lit(value)) | (F.col("h") < F.lit(cut)))
    order = Window.partitionBy(label).orderBy("h", *[c for c in rows.columns if c not in (label, "h")])
    return rows.filter(under).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def chunk_count(spark: SparkSession, size: int) -> int:
    per_chunk = min(MAX_CHUNK_BYTES, max(CHUNK_BYTES, int(CHUNK_BYTES * (size / (1 << 30)) ** 0.5)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_chunk))


def chunked(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", rest: list[str] | None = None) -> DataFrame:
    """Documents packed into rows of many texts each, dealt by a hash of the id and, without an id, of the text.

    A null text counts as empty. Rows without an id have ``NO_ID``, below every real id. ``rest`` names columns that travel along as they are.
    """
    place = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string"))).otherwise(F.xxhash64(F.col(id_col).cast("long")))
    rows = docs.select(F.pmod(place, F.lit(n)).cast("int").alias("chunk"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *[F.col(c).alias(f"rest_{i}") for i, c in enumerate(rest or [])])
    schema = arrow_schema(CHUNK_SCHEMA)
    names = [f"rest_{i}" for i in range(len(rest or []))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)

        def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            order = np.argsort(table["chunk"].to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            data, offsets = words.buffers(table["text"])
            ids, chunk = table["id"].to_numpy(), table["chunk"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            out = []
            for lo, hi in zip(cuts.tolist(), np.r_[cuts[1:], len(chunk)].tolist(), strict=True):
                raw = data[offsets[lo]:offsets[hi]].tobytes()
                out.append((int(chunk[lo]), ids[lo:hi].tobytes(), np.diff(offsets[lo:hi + 1]).tobytes(),
                            codec.compress(raw, asbytes=True) if raw else b"",
                            _to_ipc(table.select(names).slice(lo, hi - lo)) if names else None))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    return rows.mapInArrow(pack, CHUNK_SCHEMA)


def _to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


@dataclass
class Texts:
    """The documents of one chunk, in the order of their ids."""

    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    rest: pa.Table | None = None

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def pick(self, rows: np.ndarray) -> tuple[bytes, bytes, bytes]:
        raw = b"".join(self.text(i) for i in rows)
        lens = np.diff(self.offsets)[rows]
        return self.ids[rows].tobytes(), lens.tobytes(), pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b""


def unpacked(table: pa.Table) -> Texts:
    """The texts of a chunk's rows. Rows of one id keep a fixed order: by length, then by content."""
    ids, lens, parts = [], [], []
    codec = pa.Codec("zstd", 1)
    for i, n, t in zip(table["ids"].to_pylist(), table["lens"].to_pylist(), table["text"].to_pylist(), strict=True):
        ids.append(np.frombuffer(i, np.int64))
        lens.append(np.frombuffer(n, np.int64))
        size = int(lens[-1].sum())
        parts.append(codec.decompress(t, decompressed_size=size, asbytes=True) if size else b"")
    if not ids:
        return Texts(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64))
    all_ids, all_lens, raw = np.concatenate(ids), np.concatenate(lens), b"".join(parts)
    ends = np.cumsum(all_lens)
    order = np.lexsort((all_lens, all_ids))
    same = np.flatnonzero((all_ids[order][1:] == all_ids[order][:-1]) & (all_lens[order][1:] == all_lens[order][:-1]))
    if len(same):  # equal id and length: content decides, so that every run sees one order
        order = np.array(sorted(order.tolist(), key=lambda k: (all_ids[k], all_lens[k], raw[ends[k] - all_lens[k]:ends[k]])))
    data = np.frombuffer(b"".join(raw[ends[k] - all_lens[k]:ends[k]] for k in order.tolist()), np.uint8)
    rest = [pa.ipc.open_stream(x).read_all() for x in table["rest"].to_pylist() if x] if "rest" in table.column_names else []
    return Texts(all_ids[order], data, np.concatenate([[0], np.cumsum(all_lens[order])]).astype(np.int64),
                 pa.concat_tables(rest).take(pa.array(order)) if rest else None)


# ---- keys: from chunks to buckets and back -------------------------------------------

REQUEST_SCHEMA = "bucket int, chunk int, n int, keys binary, note binary"
ANSWER_SCHEMA = "chunk int, bucket int, answer binary"


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a 64-bit key: from its high 32 bits."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def request_rows(chunk: int, keys: np.ndarray, note: np.ndarray | None, n: int, width: int) -> list[tuple]:
    """Rows for the buckets. ``keys``: sorted and distinct; a bucket gets the low ``width`` bytes of each.

    As keys are sorted, a bucket's keys are one slice, in an order that the chunk can repeat.
    """
    cuts = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    low = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)
    out = []
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        # byte planes: all first bytes, then all second bytes; the order of keys keeps high planes alike
        out.append((int(b), chunk, int(hi - lo), np.ascontiguousarray(low[lo:hi, :width].T).tobytes(),
                    None if note is None else note[lo:hi].tobytes()))
    return out


def answered(table: pa.Table, n_keys: int, keys: np.ndarray, n: int, kind: type) -> np.ndarray:
    """The buckets' answers in the order of the chunk's sorted keys."""
    out = np.zeros(n_keys, kind)
    cuts = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    for b, a in zip(table["bucket"].to_pylist(), table["answer"].to_pylist(), strict=True):
        part = np.frombuffer(a, kind)
        out[cuts[b]:cuts[b] + len(part)] = part
    return out


def bucket_keys(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a bucket's requests, one after the other, and where each request begins (n + 1)."""
    parts = []
    for n, k in zip(table["n"].to_pylist(), table["keys"].to_pylist(), strict=True):
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(k, np.uint8).reshape(width, n).T
        parts.append(full.reshape(-1).view("<u8"))
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), at


def distinct_pairs(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, then owner, and the places in that order where a new (key, owner) begins."""
    order = np.lexsort((owners, keys))
    k, o = keys[order], owners[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return order, np.flatnonzero(new)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    pa.default_memory_pool().release_unused()   # what the last group took is not kept beside the next
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blobs: pa.ChunkedArray, schema: pa.Schema) -> pa.Table:
    parts = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs]
    return pa.concat_tables(parts).combine_chunks() if parts else schema.empty_table()


def _split(table: pa.Table, place: np.ndarray) -> list[tuple[int, bytes]]:
    """``(place, packed rows)`` of each place."""
    order = np.argsort(place, kind="stable")
    table, place = table.take(pa.array(order)), place[order]
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    return [(int(place[lo]), _packed(table.slice(lo, hi - lo).combine_chunks())) for lo, hi in zip(cuts.tolist(), np.r_[cuts[1:], len(place)].tolist(), strict=True)]


def asked(chunks: DataFrame, n: int, ask: Callable, reply: Callable, tell: Callable, out_ddl: str) -> DataFrame:
    """Chunks ask, buckets reply, chunks tell; ``n`` is the number of chunks and of buckets.

    ``ask(chunk, table) -> request rows``, ``reply(requests table) -> list of answers, one for
    each request``, ``tell(chunk, table, answers table) -> rows of out_ddl``. The chunks are
    shuffled once: both uses share the exchange.
    """
    request, answer, out = arrow_schema(REQUEST_SCHEMA), arrow_schema(ANSWER_SCHEMA), arrow_schema(out_ddl)

    def requests_of(key, table):
        return table_of(ask(key[0].as_py(), table), request)

    def answers_of(table):
        return table_of([(c, b, a) for c, b, a in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), reply(table), strict=True)], answer)

    def told(key, left, answers):
        return table_of(tell(key[0].as_py(), left, answers) if left.num_rows else [], out)

    if n <= HOP_CHUNKS:
        requests = chunks.groupBy("chunk").applyInArrow(requests_of, REQUEST_SCHEMA)
        answers = requests.groupBy("bucket").applyInArrow(lambda key, table: answers_of(table), ANSWER_SCHEMA)
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(told, out_ddl)

    width = math.isqrt(n - 1) + 1   # chunks in a group, and buckets in a group
    relay_ddl, bucket_ddl, chunk_ddl = "chunks int, buckets int, packed binary", "bucket int, chunks int, packed binary", "chunk int, packed binary"
    relay, to_bucket, to_chunk = arrow_schema(relay_ddl), arrow_schema(bucket_ddl), arrow_schema(chunk_ddl)

    def first_hop(key, table):
        rows = requests_of(key, table)
        own = key[0].as_py() // width
        return table_of([(own, b, p) for b, p in _split(rows, rows["bucket"].to_numpy() // width)], relay)

    def second_hop(key, table):
        rows = _unpacked(table["packed"], request)
        return table_of([(b, key[0].as_py(), p) for b, p in _split(rows, rows["bucket"].to_numpy())], to_bucket)

    def in_bucket(key, table):
        rows = answers_of(_unpacked(table["packed"], request))
        return table_of([(c, key[0].as_py() // width, p) for c, p in _split(rows, rows["chunk"].to_numpy() // width)], relay)

    def back(key, table):
        rows = _unpacked(table["packed"], answer)
        return table_of(_split(rows, rows["chunk"].to_numpy()), to_chunk)

    def at_chunk(key, left, right):
        return told(key, left, _unpacked(right["packed"], answer))

    requests = chunks.groupBy("chunk").applyInArrow(first_hop, relay_ddl).groupBy("chunks", "buckets").applyInArrow(second_hop, bucket_ddl)
    answers = requests.groupBy("bucket").applyInArrow(in_bucket, relay_ddl).groupBy("chunks", "buckets").applyInArrow(back, chunk_ddl)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(at_chunk, out_ddl)


def lowered(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case."""
    array = pa.Array.from_buffers(pa.large_string(), len(texts.ids), [None, pa.py_buffer(np.ascontiguousarray(texts.offsets)), pa.py_buffer(texts.data)])
    try:
        return words.buffers(pc.utf8_lower(array))
    except pa.ArrowInvalid:  # bytes that are not UTF-8
        return words.buffers(pa.array([texts.text(i).decode("utf-8", "replace").lower() for i in range(len(texts.ids))], pa.large_string()))
