"""Importance resampling towards a target distribution over hashed n-grams.

Every run of one to three words is hashed into a bucket. The logarithm of the ratio of a bucket's
smoothed share in the target texts to its share in the corpus is the bucket's gain, held in one
array. A document's weight is the sum of the gains of its runs. With a Gumbel number of the seed
and the id added, the highest scores are a weighted draw without replacement. The drawn rows are
ranked by a distributed radix sort (``llm/radix.py``) of (score, id); a histogram of the scores
first leaves only rows that can be drawn, ties included.

Words are hashed by CRC-32. Runs are hashed from their words: the CRC of a joined text follows
from the CRCs of its parts, so no run is ever built.

Defined cases: a null text has no words; a text without words has no features and a weight of 0;
a null id is drawn as the empty name and stands after all others in ties; rows that share an id
are rows of their own, with the same random number; an empty target gives every bucket the target
share of nothing (all counts 0); an empty corpus gives an empty result; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgewatch.llm import radix, words
from surgewatch.llm.exchange import saved

BUCKETS, RUN, BINS = 10_000, 3, 4096
U32 = np.uint32
SPACE = U32(zlib.crc32(b" "))
LONG_WORD = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@cache
def byte_table() -> np.ndarray:
    """CRC register of each single byte."""
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = np.where(t & U32(1), (t >> U32(1)) ^ U32(0xEDB88320), t >> U32(1))
    return t


@cache
def zeros(power: int) -> np.ndarray:
    """What ``2 ** power`` zero bytes do to a register, for each value of each of its four bytes."""
    each = (np.arange(256, dtype=U32)[None, :] << (U32(8) * np.arange(4, dtype=U32))[:, None])
    if power == 0:
        return (each >> U32(8)) ^ byte_table()[each & U32(255)]
    half = zeros(power - 1)
    return moved(half, moved(half, each))


def moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & U32(255)] ^ table[1][(crc >> U32(8)) & U32(255)] ^ table[2][(crc >> U32(16)) & U32(255)] ^ table[3][crc >> U32(24)]


def followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that ``crc`` has in the CRC of its text followed by ``n`` more bytes."""
    out = crc.copy()
    for power in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero((n >> power) & 1)
        out[at] = moved(zeros(power), out[at])
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: all words at once, byte by byte; long words one by one."""
    n = ends - starts
    order = np.argsort(-n, kind="stable")
    long = int(np.searchsorted(-n[order], -LONG_WORD, side="left"))
    out = np.empty(len(n), U32)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes())
    rest = order[long:]
    state, lengths, table = np.full(len(rest), 0xFFFFFFFF, U32), -n[rest], byte_table()
    for at in range(int(-lengths[0]) if len(rest) else 0):
        live = int(np.searchsorted(lengths, -at, side="left"))
        head = state[:live]
        state[:live] = (head >> U32(8)) ^ table[(head ^ data[starts[rest[:live]] + at]) & U32(255)]
    out[rest] = state ^ U32(0xFFFFFFFF)
    return out


def run_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """``(first words, buckets)`` of the runs of one, two and three words, and the first word of each text (n + 1)."""
    data = LOWER[data]
    starts, ends, bounds = words.split(data, offsets, words.NORMAL)
    crc, n = word_crcs(data, starts, ends), ends - starts
    after = followed(np.full(len(n), SPACE), n) ^ crc   # of a space and the word
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(n))   # words from here to the end of the text
    out = [(np.arange(len(n)), (crc % U32(buckets)).astype(np.int64))]
    at, run = np.arange(len(n)), crc
    for k in range(1, RUN):
        keep = left[at] > k
        at, run = at[keep], run[keep]
        run = followed(run, n[at + k] + 1) ^ after[at + k]
        out.append((at, (run % U32(buckets)).astype(np.int64)))
    return out, bounds


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> dict[int, int]:
    """Runs in each bucket over all texts: at most ``buckets`` rows a task and on the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in words.blocks(*words.buffers(batch.column(0))):
                for _, found in run_buckets(data, offsets, buckets)[0]:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n bigint")
    return {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(target: dict[int, int], corpus: dict[int, int], buckets: int) -> np.ndarray:
    """``floor(1000 ln(share in the target / share in the corpus))`` of each bucket, shares smoothed by one."""
    t_all, s_all = float(sum(target.values()) + buckets), float(sum(corpus.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document: sums of array entries."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_runs, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, data, offsets in words.blocks(*words.buffers(batch.column(1))):
                runs, bounds = run_buckets(data, offsets, buckets)
                at_word, runs_at = np.zeros(bounds[-1] + 1, np.int64), np.zeros(bounds[-1] + 1, np.int64)
                for first, found in runs:   # a first word occurs once for each length
                    at_word[first + 1] += gain[found]
                    runs_at[first + 1] += 1
                n_words[lo:hi] = np.diff(bounds)
                weight[lo:hi], n_runs[lo:hi] = np.diff(np.cumsum(at_word)[bounds]), np.diff(np.cumsum(runs_at)[bounds])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_runs), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(seed: str, id_col: str) -> Column:
    """``floor(1000 g)`` of a Gumbel number ``g`` that depends on the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def lowest_drawn(scores: DataFrame, n: int) -> int | None:
    """A score that at least ``n`` of the rows reach, with few more rows in reach: by histograms of ``BINS`` equal steps, finer each time."""
    ends = scores.agg(F.min("score"), F.max("score")).first()
    if n < 1 or ends[0] is None:
        return None
    lo, hi = ends
    above = 0   # rows over the range that is looked at
    while True:
        step = max(1, -(-(hi - lo + 1) // BINS))
        bins = scores.filter(F.col("score").between(lo, hi)).groupBy(F.expr(f"(score - {lo}L) div {step}L").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        for b, rows in sorted(((r.bin, r.n) for r in bins), reverse=True):
            if above + rows >= n:
                lo, hi = lo + b * step, min(hi, lo + (b + 1) * step - 1)
                break
            above += rows
        if step == 1 or rows <= max(1000, n // 100):
            return lo


def resample(docs: DataFrame, target: DataFrame, numerator: int = 5, denominator: int = 100, min_words: int = 20, buckets: int = BUCKETS,
             seed: str = "42", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every document: ``doc_id, n_features, weight, score, rank``; ``rank`` is null where it is not drawn.

    ``floor(numerator N / denominator)`` of the N documents of at least ``min_words`` words are drawn.
    """
    gain = gains(bucket_counts(target, target_col, buckets), bucket_counts(docs, text_col, buckets), buckets)
    scored = weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel(seed, "doc_id"))
    scored = saved(scored, "importance-scores")
    long = scored.filter(F.col("n_words") >= min_words)
    n = long.count() * numerator // denominator
    cut = lowest_drawn(long, n)
    out = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    drawn = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    top = radix.ranked(scored.filter(drawn).select(*out, F.bitwise_not("score").alias("down")), ["down", "doc_id"])
    top = top.select(*out, F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
    return scored.filter(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank")).unionByName(top)


def oracle_sql(numerator: int, denominator: int, min_words: int, buckets: int, seed: str) -> str:
    """``resample`` of ``documents`` towards ``benchmark`` as DuckDB SQL: CRC-32 as the sum of what each byte adds at its distance from the end."""
    return f"""
WITH RECURSIVE bytes(b, s, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT b, CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, i + 1 FROM bytes WHERE i < 8),
tab AS (SELECT b, s FROM bytes WHERE i = 8),
texts AS (SELECT 0 AS kind, row_number() OVER () AS no, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
lists AS (SELECT kind, no, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM texts),
spots AS (SELECT kind, no, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
runs AS (SELECT kind, no, w[i] AS f FROM spots UNION ALL SELECT kind, no, w[i] || ' ' || w[i + 1] FROM spots WHERE i + 1 <= len(w)
  UNION ALL SELECT kind, no, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM spots WHERE i + 2 <= len(w)),
named AS (SELECT f, hex(encode(f)) AS h FROM runs GROUP BY f),
adds(d, b, v) AS (SELECT 0, b, s FROM tab UNION ALL SELECT 0, 256, 4294967295 UNION ALL
  SELECT d + 1, adds.b, xor(v >> 8, tab.s) FROM adds JOIN tab ON tab.b = v & 255 WHERE d < (SELECT max(length(h) // 2) FROM named)),
parts AS (SELECT f, h, unnest(range(length(h) // 2)) AS i FROM named),
sums AS (SELECT f, any_value(length(h) // 2) AS n, bit_xor(a.v) AS x FROM parts p JOIN adds a ON a.d = length(h) // 2 - 1 - i AND a.b = ('0x' || substring(h, 2 * i + 1, 2))::BIGINT GROUP BY f),
crc AS (SELECT f, (xor(xor(x, a.v), 4294967295) % {buckets})::BIGINT AS bucket FROM sums JOIN adds a ON a.d = n AND a.b = 256),
found AS (SELECT kind, no, bucket FROM runs JOIN crc USING (f)),
counts AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM found GROUP BY bucket),
whole AS (SELECT (coalesce(sum(s), 0) + {buckets})::DOUBLE AS s_all, (coalesce(sum(t), 0) + {buckets})::DOUBLE AS t_all FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * s_all / ((s + 1)::DOUBLE * t_all)))::BIGINT AS g FROM counts, whole),
weights AS (SELECT no, count(*) AS n, sum(g) AS w FROM found JOIN gain USING (bucket) WHERE kind = 0 GROUP BY no),
scored AS (SELECT l.doc_id, len(l.w) AS words, coalesce(x.n, 0)::BIGINT AS n_features, coalesce(x.w, 0)::BIGINT AS weight, coalesce(x.w, 0)::BIGINT
  + floor(-1000 * ln(-ln((('0x' || substring(sha256('{seed}:' || coalesce(l.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM lists l LEFT JOIN weights x USING (no) WHERE l.kind = 0),
ranks AS (SELECT *, words >= {min_words} AS long, row_number() OVER (PARTITION BY words >= {min_words} ORDER BY score DESC, doc_id NULLS LAST) AS r,
  count(*) FILTER (words >= {min_words}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND r <= {numerator} * n // {denominator} THEN r END::BIGINT AS rank FROM ranks"""
