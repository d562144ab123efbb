"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words (lower case, letters and digits only) of
one document; its weight is its count in the document times
``1 + ln((1 + N) / (1 + df)) / ln(1 + N)``, with ``df`` the documents that hold
it and ``N`` all documents, both counted over the whole corpus. Two documents
are linked if the weighted Jaccard similarity of their shingles is at least
0.8; classes are the connected components.

Document frequencies come from the chunk and bucket exchange. A document of
which less than 0.8 of the weight lies on shingles of other documents cannot
have a partner, so only the rest is sampled: for each of ``bands * rows``
samples the consistent weighted sample (shingle, level) with gamma variates
drawn from the shingle's hash; a band's samples are its bucket. Pairs in a
bucket are verified by their exact weighted Jaccard similarity.

Defined cases: null or empty text: a class of its own; text without a word: one
shingle of the whole text; fewer than five words: one shingle of all of them;
a null id takes no part and has a null class; rows that share an id are one
document; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgewatch.llm import exchange, linking, words
from surgewatch.llm.exchange import saved

WIDTH = 5           # bytes of a shingle's hash that a bucket compares, besides the bucket itself
TABLE = 1 << 16     # entries in the tables of random variates
SEED = 20_17
OUT = "doc_id bigint, sig string, bands array<bigint>, vector binary, weight double, shared double"


def shingles(texts: exchange.Texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and count of each distinct shingle of each document, sorted by hash, then document."""
    data, offsets = exchange.lowered(texts)
    hashes, docs = [], []
    for lo, _, part, offs in words.blocks(data, offsets):
        s, e, bounds = words.split(part, offs, words.NORMAL)
        h = words.hash_spans(part, s, e)
        first, w = words.windows(h, bounds, n)
        hashes.append(w)
        docs.append(np.searchsorted(bounds, first, side="right") - 1 + lo)
        counts = np.diff(bounds)
        for i in np.flatnonzero((counts < n) & (np.diff(offs) > 0)):
            c = int(counts[i])
            whole = words.hash_windows(h, bounds[i:i + 1], c) if c else words.hash_spans(part, offs[i:i + 1], offs[i + 1:i + 2])
            hashes.append(words.mix(whole + np.uint64(c + 1)))
            docs.append(np.array([i + lo]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order, at = exchange.distinct_pairs(h, d)
    return h[order][at], d[order][at], np.diff(np.r_[at, len(h)])


def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(SEED)
    u = 1.0 - rnd.random((5, TABLE))
    return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]


def samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """(documents, k) hashes of the consistent weighted samples; entries are grouped by document at ``starts``."""
    r_of, log_c_of, beta_of = _variates()
    log_w = np.log(weight)
    counts = np.diff(np.r_[starts, len(h)])
    out = np.empty((len(starts), k), np.uint64)
    low = np.uint64(TABLE - 1)
    for j in range(k):
        x = words.mix(h + np.uint64(((2 * j + 1) * words.WORD_BASE_2) & (2**64 - 1)))
        r, log_c, beta = r_of[(x & low).astype(np.int64)], log_c_of[((x >> np.uint64(16)) & low).astype(np.int64)], beta_of[((x >> np.uint64(32)) & low).astype(np.int64)]
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta) - r
        at = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, starts), counts))
        best = at[np.searchsorted(at, starts)]
        out[:, j] = words.mix(x[best] ^ (t[best].astype(np.int64).view(np.uint64) * words.MIX_1))
    return out


def _vector(h: np.ndarray, weight: np.ndarray) -> bytes:
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    keys, place = np.unique(low, return_inverse=True)
    return keys.tobytes() + np.bincount(place, weight, len(keys)).astype(np.float32).tobytes()


def weighted_jaccard(a: bytes, b: bytes) -> float:
    na, nb = len(a) // 8, len(b) // 8
    ka, wa = np.frombuffer(a, np.uint32, na), np.frombuffer(a, np.float32, na, 4 * na).astype(np.float64)
    kb, wb = np.frombuffer(b, np.uint32, nb), np.frombuffer(b, np.float32, nb, 4 * nb).astype(np.float64)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[ia], wb[ib]).sum()
    return both / (wa.sum() + wb.sum() - both)


def sketched(docs: DataFrame, shingle: int, threshold: float, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document with an id; ``sig``, ``bands`` and ``vector`` only where a partner is possible."""
    spark = docs.sparkSession
    docs = docs.filter(F.col(id_col).isNotNull())
    size, n_docs = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    n = exchange.chunk_count(spark, size or 0)
    scale = float(np.log1p(max(1, n_docs)))

    def ask(chunk, table):
        h, _, _ = shingles(exchange.unpacked(table), shingle)
        keys, counts = np.unique(h, return_counts=True)
        return exchange.request_rows(chunk, keys, counts.astype(np.uint32), n, WIDTH)

    def reply(table):
        keys, at = exchange.bucket_keys(table, WIDTH)
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["note"].to_pylist()])
        seen, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, counts, len(seen))[place].astype(np.uint32)
        return [total[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def tell(chunk, table, answers):
        texts = exchange.unpacked(table)
        h, d, tf = shingles(texts, shingle)
        keys, place = np.unique(h, return_inverse=True)
        df = exchange.answered(answers, len(keys), keys, n, np.uint32)[place].astype(np.float64)
        weight = tf * (1.0 + (scale - np.log1p(df)) / scale)
        total = len(texts.ids)
        shared, whole = np.bincount(d, weight * (df > 1), total), np.bincount(d, weight, total)
        alive = (shared >= (threshold - 1e-9) * whole) & (shared > 0)
        out = [(int(texts.ids[i]), None, None, None, None, None) for i in np.flatnonzero(~alive)]
        on = alive[d]
        h, d, tf, weight = h[on], d[on], tf[on], weight[on]
        order = np.argsort(d, kind="stable")
        h, d, tf, weight = h[order], d[order], tf[order], weight[order]
        if len(h):
            starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            ends = np.r_[starts[1:], len(h)]
            picks = samples(h, weight, starts, bands * rows)
            up, _ = words.powers(words.WORD_BASE, rows)
            band_no = np.arange(bands, dtype=np.uint64) * np.uint64(words.BYTE_BASE)
            keys = words.mix((picks.reshape(-1, bands, rows) * up[:rows]).sum(axis=2, dtype=np.uint64) + band_no).view(np.int64)
            once = words.mix(h + tf.astype(np.uint64) * words.MIX_1)
            sigs = np.add.reduceat(once, starts), np.add.reduceat(words.mix(once + words.MIX_2), starts)
            for i, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                out.append((int(texts.ids[d[lo]]), f"{int(sigs[0][i]):016x}{int(sigs[1][i]):016x}", keys[i].tolist(), _vector(h[lo:hi], weight[lo:hi]),
                            float(whole[d[lo]]), float(shared[d[lo]])))
        return out

    chunks = exchange.chunked(docs, n, id_col, text_col)
    return saved(exchange.asked(chunks, n, ask, reply, tell, OUT), "sketches")


def bounds(threshold: float) -> tuple[Callable[[Column, Column], Column], Callable[..., Column]]:
    """``possible`` and ``bound`` of ``linking.link`` for nodes whose ``info`` is ``weight, shared``."""
    def possible(x: Column, y: Column) -> Column:
        # a similarity of t takes a common weight of t / (1 + t) of both; no more than the shared weight can be common
        need = (threshold / (1 + threshold) - 1e-7) * (x["weight"] + y["weight"])
        return (x["shared"] >= need) & (y["shared"] >= need)

    def bound(x: Column, x_sim: Column, y: Column, y_sim: Column, leader: Column) -> Column:
        # x and y have in common at most what both have in common with the leader, and what both share beyond it
        def parts(info: Column, sim: Column) -> tuple[Column, Column]:
            known = sim / (1 + sim) * (info["weight"] + leader["weight"])
            # greatest() skips nulls: a node that was not compared may share all its weight beyond the leader
            return (F.coalesce(known, F.least(info["shared"], leader["shared"])),
                    F.when(sim.isNull(), info["shared"]).otherwise(F.greatest(info["shared"] - known, F.lit(0.0))))

        (x_in, x_out), (y_in, y_out) = parts(x, x_sim), parts(y, y_sim)
        need = (threshold / (1 + threshold) - 1e-4) * (x["weight"] + y["weight"])   # weights are kept as 32-bit floats
        return F.least(x_in, y_in) + F.least(x_out, y_out) >= need

    return possible, bound


def classes(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = 16, rows: int = 4,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_spanning_links`` of every document.

    ``class_id`` is the smallest id of the class; ``n_spanning_links`` counts the verified links
    of the document's content (each stands for all its exact copies) by which its class was
    found: to the leaders of its buckets and across components. Pairs that were already in one
    component are not verified, so it is no count of all similar documents.
    """
    rows_ = sketched(docs, shingle, threshold, bands, rows, id_col, text_col)
    live = rows_.filter(F.col("sig").isNotNull())
    contents = saved(live.groupBy("sig").agg(F.min("doc_id").alias("node")), "signatures")
    # one vector for each content, and for each id if rows repeat it; joined on both columns, so that a
    # content of many copies is no hot key
    firsts = live.join(contents.withColumnRenamed("node", "doc_id"), ["sig", "doc_id"])
    firsts = saved(firsts.groupBy(F.col("doc_id").alias("node")).agg(F.min(F.struct("sig", "bands", "vector", "weight", "shared")).alias("v"))
                            .select("node", "v.bands", "v.vector", "v.weight", "v.shared"), "contents")
    vectors = firsts.select("node", "vector")

    def verify(pairs: DataFrame) -> DataFrame:
        joined = (pairs.join(vectors.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b")
                  .join(vectors.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a").select("a", "b", "va", "vb"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sim = [weighted_jaccard(x.as_py(), y.as_py()) for x, y in zip(batch["va"], batch["vb"], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(sim, pa.float64())], names=["a", "b", "sim"])

        return joined.mapInArrow(check, "a bigint, b bigint, sim double")

    members = firsts.select(F.explode("bands").alias("bucket"), "node", F.struct("weight", "shared").alias("info"))
    possible, bound = bounds(threshold)
    comps, links = linking.link(members, possible, verify, threshold - 1e-6, bound)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    found = (live.select("doc_id", "sig").join(contents, "sig").join(comps, "node", "left").join(degree, "node", "left")
             .select("doc_id", F.coalesce("comp", "node").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_spanning_links")))
    alone = rows_.filter(F.col("sig").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_spanning_links"))
    none = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_spanning_links"))
    return found.union(alone).union(none)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that are the first of their class, unchanged. Rows without an id stay."""
    gone = classes(docs, id_col=id_col, text_col=text_col, **kw).filter("doc_id <> class_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
