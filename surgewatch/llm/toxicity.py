"""Toxicity: a linear classifier that swapping identity terms must not move.

Features are a text's distinct words (lower case) and their beginnings of four,
five and six bytes, so that inflected forms share evidence. The score is the
logistic function of a bias plus one weight for each feature present, however
long the text.

The loss is the mean logistic loss, an L2 term, and a counterfactual term: in
every training text that names a group, identity terms are swapped for other
terms of the same kind, and the squared change of the score's logit is
penalised. So a term such as a religion or an orientation cannot carry weight of
its own, and neutral mentions of a group do not raise the score.

Fitting uses a bounded sample of labelled rows: at most ``max_rows``, half of
each label where there are enough (those whose hashed ids are the smallest),
each with its whole text, and the ``max_features`` features that tell the labels
apart best by chi-square. Scoring covers every row.

Defined cases: null or empty text scores the bias; with labels of one kind or
none every score is the smoothed share of label 1; a row without an id is
scored and never used for fitting; labels that are null are ignored, and of
contradicting labels of one id the higher counts; repeated rows are each
scored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgewatch.llm import exchange, words
from surgewatch.llm.langid import held_out

#: Identity terms by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = {
    "religion": ["atheist", "buddhist", "catholic", "christian", "hindu", "jew", "jewish", "muslim", "protestant", "sikh"],
    "religions": ["atheists", "buddhists", "catholics", "christians", "hindus", "jews", "muslims", "protestants", "sikhs"],
    "orientation": ["bisexual", "gay", "heterosexual", "homosexual", "lesbian", "queer", "straight"],
    "gender": ["female", "male", "nonbinary", "trans", "transgender"],
    "people": ["boys", "girls", "men", "women"],
    "origin": ["african", "american", "arab", "asian", "black", "chinese", "european", "indian", "latino", "mexican", "white"],
    "ability": ["blind", "deaf", "disabled", "autistic"],
    "de": ["christen", "juden", "muslime", "frauen", "männer", "schwule", "lesben", "ausländer", "behinderte"],
    "fr": ["chrétiens", "juifs", "musulmans", "femmes", "hommes", "homosexuels", "lesbiennes", "étrangers", "handicapés"],
    "es": ["cristianos", "judíos", "musulmanes", "mujeres", "hombres", "gays", "lesbianas", "extranjeros", "discapacitados"],
}
STEMS = (4, 5, 6)
FILTER_BITS = 22
COUNT_BYTES = 1 << 20   # of text whose features are counted before they are shuffled
OUT = "doc_id bigint, held_out boolean, score double, predicted int"


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return exchange.lowered(exchange.Texts(np.zeros(len(texts), np.int64), *words.buffers(texts)))


def word_features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of the words (whole, then each stem of longer words) and the word of each."""
    at = np.arange(len(s))
    keys, owner = [words.hash_spans(data, s, e)], [at]
    for n in STEMS:
        long = np.flatnonzero(e - s > n)
        keys.append(words.mix(words.hash_spans(data, s[long], s[long] + n) + words.U64(n)))
        owner.append(long)
    return np.concatenate(keys), np.concatenate(owner)


def text_features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None, sieve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, text) pairs, sorted by feature; only ``wanted`` features if given (then as places in it)."""
    s, e, bounds = words.split(data, offsets, words.NORMAL)
    keys, owner = word_features(data, s, e)
    if wanted is not None:
        maybe = np.flatnonzero(sieve[(keys & words.U64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(wanted, keys[maybe]), max(0, len(wanted) - 1))
        hit = wanted[place] == keys[maybe] if len(wanted) else np.zeros(0, bool)
        keys, owner = place[hit], owner[maybe[hit]]
    doc = np.searchsorted(bounds, owner, side="right") - 1
    order, at = exchange.distinct_pairs(keys, doc)
    return keys[order][at], doc[order][at]


def sieve_of(wanted: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(wanted & words.U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return out


def features_of(text: str) -> set[int]:
    """The features of one text (for tests and identity terms)."""
    data, offsets = _bytes_of(pa.array([text]))
    s, e, _ = words.split(data, offsets, words.NORMAL)
    return set(word_features(data, s, e)[0].tolist())


def swapped(text: str, salt: int) -> str | None:
    """The text with every identity term swapped for another of its kind; None if it names none."""
    import re

    def other(m):
        kind, k = PLACE[m[0].lower().translate(FOLDED)]
        terms = IDENTITY_TERMS[kind]
        return terms[(k + 1 + salt % (len(terms) - 1)) % len(terms)]

    out, n = re.subn(PATTERN, other, text, flags=re.IGNORECASE)
    return out if n else None


#: Letters that case-blind patterns take for ASCII letters (lower case gives i and a dot for the first).
FOLDED = {0x130: "i", 0x307: None, 0x131: "i", 0x17F: "s", 0x212A: "k"}
PLACE = {t: (kind, k) for kind, terms in IDENTITY_TERMS.items() for k, t in enumerate(terms)}
PATTERN = r"\b(?:" + "|".join(sorted(PLACE, key=lambda t: (-len(t), t))) + r")\b"


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array, sieve: np.ndarray) -> np.ndarray:
        data, offsets = _bytes_of(texts)
        logit = np.full(len(texts), self.bias)
        for lo, hi, part, offs in words.blocks(data, offsets):
            f, d = text_features(part, offs, self.keys, sieve)
            logit[lo:hi] += np.bincount(d, self.weights[f], hi - lo)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))


def optimise(rows: list[np.ndarray], labels: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], n: int,
             l2: float, swap_penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps.

    ``rows``: features of each text; ``changes``: features that a swap adds and takes away.
    """
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight_of = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels <= 0).sum()))
    c_flat = np.concatenate([np.r_[a, b] for a, b in changes]) if changes else np.zeros(0, np.int64)
    c_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in changes]) if changes else np.zeros(0)
    c_owner = np.repeat(np.arange(len(changes)), [len(a) + len(b) for a, b in changes])
    w, bias = np.zeros(n), 0.0
    seen_w, seen_b, momentum = w.copy(), 0.0, 1.0
    # step size: bounds of the curvature of the three terms
    row_norm = max([1.0, *(len(r) + 1.0 for r in rows)])
    change_norm = max([0.0, *(float(len(a) + len(b)) for a, b in changes)])
    rate = 1.0 / (0.25 * row_norm + l2 + 2.0 * swap_penalty * change_norm)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(owner, seen_w[flat], len(rows)) + seen_b, -40, 40)))
        error = weight_of * (p - labels)
        grad = np.bincount(flat, error[owner], n) + l2 * seen_w
        if changes:
            moved = np.bincount(c_owner, c_sign * seen_w[c_flat], len(changes))
            grad += np.bincount(c_flat, c_sign * moved[c_owner], n) * (2.0 * swap_penalty / len(changes))
        new_w, new_b = seen_w - rate * grad, seen_b - rate * error.sum()
        nxt = (1.0 + np.sqrt(1.0 + 4.0 * momentum * momentum)) / 2.0
        seen_w, seen_b = new_w + (momentum - 1.0) / nxt * (new_w - w), new_b + (momentum - 1.0) / nxt * (new_b - bias)
        w, bias, momentum = new_w, new_b, nxt
    return w, float(bias)


def fit(sample: DataFrame, max_features: int, n_buckets: int, l2: float = 1e-4, swap_penalty: float = 10.0, steps: int = 400) -> Model:
    """Fit on ``sample`` (``id, text, toxic``; bounded by the caller)."""
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((pos + 1.0) / (neg + 1.0))))

    schema = exchange.arrow_schema("bucket int, keys binary, pos binary, neg binary")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(batch["text"])
            toxic = batch["toxic"].to_numpy(zero_copy_only=False) > 0
            for lo, _, part, offs in words.blocks(data, offsets, COUNT_BYTES):
                f, d = text_features(part, offs)
                keys, place = np.unique(f, return_inverse=True)
                up = np.bincount(place, toxic[lo + d], len(keys)).astype(np.uint32)
                down = np.bincount(place, ~toxic[lo + d], len(keys)).astype(np.uint32)
                cuts = np.searchsorted(exchange.bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
                rows = [(int(b), keys[x:y].tobytes(), up[x:y].tobytes(), down[x:y].tobytes())
                        for b, x, y in zip(range(n_buckets), cuts[:-1], cuts[1:], strict=True) if y > x]
                yield from exchange.table_of(rows, schema).to_batches()

    def chosen(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
        seen, place = np.unique(keys, return_inverse=True)
        a = np.bincount(place, np.concatenate([np.frombuffer(x, np.uint32) for x in table["pos"].to_pylist()]), len(seen))
        b = np.bincount(place, np.concatenate([np.frombuffer(x, np.uint32) for x in table["neg"].to_pylist()]), len(seen))
        n, chi = pos + neg, np.zeros(len(seen))
        c, d = pos - a, neg - b
        den = (a + b) * (c + d) * pos * neg
        np.divide(n * (a * d - b * c) ** 2, den, out=chi, where=den > 0)
        ok = (chi > 10.0) & (a + b >= 3)
        return pa.table({"key": seen[ok].view(np.int64), "chi": chi[ok]})

    packed = sample.select("text", "toxic").mapInArrow(counted, "bucket int, keys binary, pos binary, neg binary")
    scored = packed.groupBy("bucket").applyInArrow(chosen, "key bigint, chi double")
    keys = {r.key for r in scored.orderBy(F.desc("chi"), "key").limit(max_features).collect()}
    # identity terms always have a feature, so that the swap can act on it
    terms = set().union(*(features_of(t) for t in PLACE))
    wanted = np.array(sorted({k & (2**64 - 1) for k in keys} | terms), np.uint64)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sieve_of(wanted)

        def of(texts: list[str]) -> list[bytes]:
            data, offsets = _bytes_of(pa.array(texts, pa.large_string()))
            out = []
            for lo, hi, part, offs in words.blocks(data, offsets):
                f, d = text_features(part, offs, wanted, sieve)
                order = np.lexsort((f, d))
                cuts = np.searchsorted(d[order], np.arange(hi - lo + 1))
                out += [f[order][x:y].astype(np.int32).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            return out

        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            swaps = [swapped(t, i) for i, t in zip(batch["id"].to_pylist(), texts, strict=True)]   # the same swap in any partitioning
            alike = of([s if s is not None else "" for s in swaps])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["toxic"], pa.array(of(texts), pa.binary()),
                                              pa.array([a if s is not None else None for a, s in zip(alike, swaps, strict=True)], pa.binary())], names=["id", "toxic", "f", "swap"])

    got = sorted((r.id, r.toxic, bytes(r.f), None if r.swap is None else bytes(r.swap)) for r in
                 sample.select("id", "text", "toxic").mapInArrow(reduced, "id bigint, toxic int, f binary, swap binary").collect())
    rows = [np.frombuffer(g[2], np.int32).astype(np.int64) for g in got]
    changes = []
    for own, g in zip(rows, got, strict=True):
        if g[3] is not None:
            new = np.frombuffer(g[3], np.int32).astype(np.int64)
            changes.append((np.setdiff1d(new, own), np.setdiff1d(own, new)))
    w, bias = optimise(rows, np.array([g[1] for g in got], float), changes, len(wanted), l2, swap_penalty, steps)
    return Model(wanted, w, bias)


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """The bounded sample of labelled rows outside the held-out third: ``id, text, toxic``."""
    marks = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("toxic")))
    ranked = marks.select("toxic", F.xxhash64("id").alias("h"), "id")
    chosen = exchange.lowest_hashes(ranked, "toxic", max(1, max_rows // 2)).select("id", "toxic")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most max_rows rows of two numbers: bounded, so sent to every task instead of moving all texts
    rows = rows.join(F.broadcast(chosen), "id").select("id", "text", F.col("toxic").cast("int").alias("toxic"))
    # of rows that share an id the smallest text is learned from, so the sample stays bounded
    return rows.groupBy("id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("id", "text", "toxic")


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_features: int = 20_000, threshold: float = 0.7,
           id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    spark = docs.sparkSession
    sample = exchange.saved(sampled(docs, labels, max_rows, id_col, text_col, label_col), "labelled")
    model = fit(sample, max_features, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(model)
    schema = exchange.arrow_schema(OUT)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sieve_of(shared.value.keys)
        for batch in batches:
            p = shared.value.score(batch["text"], sieve)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held"], pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, OUT)
