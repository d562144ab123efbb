"""Nearest neighbours by inner product: several shifted Hilbert orderings.

Vectors are scaled by the largest norm and get one more coordinate that makes
them unit length, so the largest inner product is the nearest neighbour. Each
ordering projects them on a few random directions, shifts the result at random,
and orders the cells by their place on a Hilbert curve. Spark range-partitions
every ordering into blocks. A query stands in an ordering at its own key; the
blocks within ``reach`` of its block are its window, and the windows of all
orderings are merged and reranked by the exact inner product.

``reach`` is fitted: a bounded sample of at most ``sample_queries`` queries is
compared with every row, and the smallest reach is taken at which the windows
hold ``target`` of their true neighbours. So the reach follows the data: narrow
where vectors are clustered, wide where they are nearly isotropic (there the
curve tells little, and a recall of 0.9 needs windows of a good part of the
rows).

Equal vectors are indexed once, with the ids that a result can need (the
smallest ``k + 1``), so a vector that a third of the rows share is one entry.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id, nor vectors whose length is
not the most frequent one; of rows that share an id the smallest vector counts;
ties go to the smaller id; fewer candidates than ``k``: all; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgewatch.llm.exchange import arrow_schema, saved

BLOCK_ROWS = 512
SHARD_BLOCKS = 16
DIRECTIONS, BITS = 6, 8
SEED = 41
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of small whole numbers) on the Hilbert curve through all cells."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # undo the rotations and reflections of each level, from the coarsest on
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    # Gray code across the axes
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    rows = rows.filter(F.size("vec") == (sizes.n if sizes else 0))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, 0.0).otherwise(x)))   # -0.0 is 0.0
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def contents(rows: DataFrame, k: int) -> DataFrame:
    """``vid, ids, vec``: every distinct vector, with its smallest id and its ``k + 1`` smallest ids.

    The rank limit is applied in every task before the shuffle.
    """
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= k + 1)
    return ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "ids", "vec")


def keyed(vectors: DataFrame, top: float, orderings: int, size: int, low: np.ndarray, high: np.ndarray, query: bool) -> DataFrame:
    """``ordering, key`` of each vector. A query is scaled to unit length, a row by the largest norm."""
    turn = np.random.default_rng(SEED).normal(size=(orderings, size + 1, DIRECTIONS))
    shift = np.random.default_rng(SEED + 1).random((orderings, DIRECTIONS))
    schema = arrow_schema("ordering int, key bigint, vid bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = projected(_matrix(batch["vec"]), top, turn, query)
            for o in range(orderings):
                # the grid covers the sample's range and, shifted, half a range more on either side
                place = (p[o] - low[o]) / np.maximum(high[o] - low[o], 1e-12) * 0.5 + 0.5 * shift[o]
                cells = np.clip((place * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, o, np.int32)), pa.array(hilbert(cells, BITS)), batch["vid"]], schema=schema)

    return vectors.select("vid", "vec").mapInArrow(read, "ordering int, key bigint, vid bigint")


def projected(x: np.ndarray, top: float, turn: np.ndarray, query: bool) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.hstack([x / norm, np.zeros_like(norm)]) if query else np.hstack([x / top, np.sqrt(np.maximum(0.0, 1.0 - (norm / top) ** 2))])
    return np.einsum("nd,ode->one", unit, turn)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores the places of the ``k`` largest; ties to the smaller id. -inf is no candidate."""
    if score.shape[1] > k:
        bar = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
    else:
        bar = np.full(len(score), -np.inf)
    out = []
    for row, b in zip(score, bar, strict=True):
        at = np.flatnonzero((row >= b) & (row > -np.inf))
        out.append(at[np.lexsort((ids[at], -row[at]))][:k])
    return out


def exact(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``query_vid, vid`` of the ``k`` nearest contents of few queries (bounded by the caller), over all rows."""
    picked = queries.select("vid", "vec").orderBy("vid").collect()
    ids, x = np.array([q.vid for q in picked], np.int64), np.array([q.vec for q in picked], float)
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for batch in batches:
            if not batch.num_rows or not len(own):
                continue
            vid = batch["vid"].to_numpy()
            score = q @ _matrix(batch["vec"]).T
            score[own[:, None] == vid[None, :]] = -np.inf
            for i, at in enumerate(_top(score, vid, k)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), own[i])), pa.array(vid[at]), pa.array(score[i, at])], names=["query_vid", "vid", "score"])

    found = rows.select("vid", "vec").mapInArrow(scan, "query_vid bigint, vid bigint, score double")
    best = Window.partitionBy("query_vid").orderBy(F.desc("score"), "vid")
    return found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("query_vid", "vid")


def search(df: DataFrame, is_query, k: int = 20, orderings: int = 4, target: float = 0.95, sample_rows: int = 10_000,
           sample_queries: int = 100, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of every row whose id satisfies ``is_query`` (a condition on the column ``id``).

    ``query_id, rank, vec_id, score``; the query's own row is no candidate.
    """
    spark = df.sparkSession
    rows = saved(valid(df, id_col, vec_col), "vectors")
    index = saved(contents(rows, k), "contents")
    stats = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("top"), F.first(F.size("vec")).alias("size")).first()
    if not stats.n:
        return spark.createDataFrame([], RESULT)
    top, size = float(np.sqrt(stats.top)), stats.size
    # each query by the content that has its vector
    asked = rows.filter(is_query).select("id", "vec").join(index.select("vec", "vid"), "vec").select("id", "vid")
    asked = saved(asked, "queries")
    query_rows = index.join(asked.select("vid").distinct(), "vid", "left_semi").select("vid", "vec")

    sample = index.orderBy(F.xxhash64("vid"), "vid").limit(sample_rows).select("vec").collect()
    turn = np.random.default_rng(SEED).normal(size=(orderings, size + 1, DIRECTIONS))
    p = projected(np.array([r.vec for r in sample], float), top, turn, False)
    low, high = p.min(axis=1), p.max(axis=1)

    blocks = max(1, -(-stats.n // block_rows))
    both = (keyed(index, top, orderings, size, low, high, False).withColumn("query", F.lit(False))
            .union(keyed(query_rows, top, orderings, size, low, high, True).withColumn("query", F.lit(True))))
    dealt = both.repartitionByRange(orderings * blocks, "ordering", "key", F.xxhash64("vid"))
    placed = saved(dealt.withColumn("block", F.spark_partition_id()), "blocks")

    # block numbers within each ordering: its first block holds its smallest keys
    spans = {r.ordering: (r.lo, r.hi) for r in placed.groupBy("ordering").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).collect()}
    widest = max(hi - lo for lo, hi in spans.values())
    mine = placed.filter("query").select("ordering", F.col("vid").alias("query_vid"), F.col("block").alias("at"))
    theirs = placed.filter("not query").select("ordering", "vid", "block")

    few = query_rows.orderBy(F.xxhash64("vid"), "vid").limit(sample_queries)
    true = saved(exact(few, index, k), "true-neighbours")
    gap = (true.join(theirs, "vid").join(mine, ["query_vid", "ordering"]).groupBy("query_vid", "vid").agg(F.min(F.abs(F.col("block") - F.col("at"))).alias("gap")))
    gaps = gap.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).orderBy("gap").collect()
    total, have, reach = sum(g.n for g in gaps), 0, widest
    for g in gaps:
        have += g.n
        if have >= target * total:
            reach = g.gap
            break

    # a shard is a run of blocks; a query goes to the shards that its window meets, once for each ordering
    shard = lambda c: F.floor(c / SHARD_BLOCKS).cast("int")
    held = theirs.join(index.select("vid", "vec"), "vid").withColumn("shard", shard(F.col("block"))).select(F.col("ordering").alias("o"), F.col("shard").alias("s"), "block", "vid", "vec")
    sent = (mine.join(query_rows.toDF("query_vid", "vec"), "query_vid")
            .select(F.col("ordering").alias("q_ordering"), "at", "query_vid", "vec", F.explode(F.sequence(shard(F.greatest(F.col("at") - reach, F.lit(0))), shard(F.col("at") + reach))).alias("q_shard")))
    schema = arrow_schema("query_vid bigint, vids array<bigint>, scores array<double>")

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            vid, block = right["vid"].to_numpy(), right["block"].to_numpy()
            x = _matrix(right["vec"].combine_chunks())
            for lo in range(0, left.num_rows, 256):
                part = left.slice(lo, 256)
                own, at = part["query_vid"].to_numpy(), part["at"].to_numpy()
                score = _matrix(part["vec"].combine_chunks()) @ x.T
                score[np.abs(at[:, None] - block[None, :]) > reach] = -np.inf
                for i, best in enumerate(_top(score, vid, k + 1)):
                    out.append((int(own[i]), vid[best].tolist(), score[i, best].tolist()))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    found = sent.groupBy("q_ordering", "q_shard").cogroup(held.groupBy("o", "s")).applyInArrow(compare, "query_vid bigint, vids array<bigint>, scores array<double>")
    return _merged(found, asked, index, k)


def _merged(found: DataFrame, asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Merge the windows' finds, rerank by the exact product, and expand contents to ids."""
    schema = arrow_schema("query_vid bigint, vid bigint")

    def merge(table: pa.Table) -> pa.Table:
        vid = table["vids"].combine_chunks().flatten().to_numpy()
        score = table["scores"].combine_chunks().flatten().to_numpy()
        first = np.unique(vid, return_index=True)[1]   # a pair that several windows found
        vid, score = vid[first], score[first]
        order = np.lexsort((vid, -score))
        # a few more than needed: equal products may differ in their last bits until they are computed alike
        best = vid[order][:k + 9]
        return pa.Table.from_arrays([pa.array(np.full(len(best), table["query_vid"][0].as_py())), pa.array(best)], schema=schema)

    pairs = found.groupBy("query_vid").applyInArrow(merge, "query_vid bigint, vid bigint")
    pairs = (pairs.join(index.select(F.col("vid"), "ids", F.col("vec").alias("v")), "vid")
             .join(index.select(F.col("vid").alias("query_vid"), F.col("vec").alias("q")), "query_vid"))
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.select("query_vid", "ids", score.alias("score"))
    rows = (asked.select(F.col("id").alias("query_id"), F.col("vid").alias("query_vid")).join(pairs, "query_vid")
            .select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
