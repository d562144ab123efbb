"""Language identification in two steps: family, then pairwise linear support vector machines.

A document is the relative frequency of its hashed byte trigrams (lower case,
everything but letters and digits is a space) and hashed words. One-versus-rest
linear SVMs choose a language family; inside it, one-versus-one linear SVMs
between its languages vote. Whole texts are read, block by block; a model's
score is a sum over the text's features, so nothing is kept per document.

The models are fitted on a bounded sample of labelled rows: at most ``max_rows``
documents, the same number for each language (those whose hashed ids are the
smallest), each with its whole text. Scoring covers every row.

Defined cases: null text or text without a letter: ``und`` with score 0; no
labelled rows: ``und`` for all; one language alone: that language; a language
code outside ``FAMILIES`` is a family of its own; a null id is scored and never
used for fitting; repeated rows are each scored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgewatch.llm import exchange, words

#: Language codes by family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "ug", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "austronesian": ["id", "jv", "ms", "tl"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BITS = 15                 # hashed trigrams; as many words follow
SIZE = 2 << BITS
SCALE = 30.0              # relative frequencies are small; this brings them near one
OUT = "doc_id bigint, held_out boolean, lang_pred string, family string, score double"

_letters = np.zeros(256, bool)
_letters[[*range(65, 91), *range(97, 123)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in order, and where each text's begin (n + 1)."""
    n = len(offsets) - 1
    flat = np.where(words.NORMAL[data], data, np.uint8(32)).astype(np.uint32)
    tri = np.zeros(0, np.int64)
    at = np.zeros(0, np.int64)
    if len(flat) > 2:
        code = flat[:-2] | (flat[1:-1] << np.uint32(8)) | (flat[2:] << np.uint32(16))
        owner_end = np.repeat(offsets[1:], np.diff(offsets))[:-2]
        at = np.flatnonzero((np.arange(len(code)) + 2 < owner_end) & (code != 0x202020))
        tri = ((code[at] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    s, e, bounds = words.split(data, offsets, words.NORMAL)
    word = (words.hash_spans(data, s, e) >> words.U64(64 - BITS)).astype(np.int64) + (1 << BITS)
    first = np.searchsorted(at, offsets)
    out = np.empty(len(tri) + len(word), np.int64)
    starts = first + bounds
    # each text: its trigrams, then its words
    n_tri, n_word = np.diff(first), np.diff(bounds)
    out[np.arange(len(tri)) + np.repeat(bounds[:-1], n_tri)] = tri
    out[np.arange(len(word)) + np.repeat(first[1:], n_word)] = word
    return out, starts if n else np.zeros(1, np.int64)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_letters[data])])
    out = np.diff(seen[offsets]) > 0
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    for i in np.flatnonzero(~out & (np.diff(wide[offsets]) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    plain = exchange.Texts(np.zeros(len(texts), np.int64), *words.buffers(texts))
    return exchange.lowered(plain)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear SVM by dual coordinate descent: (weights, bias). Classes weigh the same."""
    w, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    share = np.where(labels > 0, (labels < 0).sum(), (labels > 0).sum()) * 2.0 / max(1, len(labels))
    rnd = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rnd.permutation(len(rows)):
            idx, val = rows[i]
            y = labels[i]
            gradient = y * (w[idx] @ val + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost * share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[idx] += step * val
                bias += step
                alpha[i] = new
    return w, bias


@dataclass
class Model:
    """Languages by family, and the weights of all classifiers, one row each."""

    families: dict[str, list[str]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))
    names: list[tuple] = field(default_factory=list)

    def predict(self, texts: pa.Array) -> tuple[list[str], list[str | None], np.ndarray]:
        data, offsets = lowered(texts)
        n = len(offsets) - 1
        letters = np.zeros(n, bool)
        margins = np.zeros((len(self.names), n))
        for lo, hi, part, offs in words.blocks(data, offsets):
            if self.families:
                letters[lo:hi] = has_letter(part, offs)
            f, starts = features(part, offs)
            count = np.maximum(1, np.diff(starts))
            full = np.flatnonzero(np.diff(starts) > 0)
            for m in range(len(self.names)):
                if len(full):
                    margins[m, lo + full] = np.add.reduceat(self.weights[m][f].astype(np.float64), starts[full])
                margins[m, lo:hi] = margins[m, lo:hi] * SCALE / count + self.biases[m]
        return self._decide(margins, letters)

    def _decide(self, margins: np.ndarray, letters: np.ndarray) -> tuple[list[str], list[str | None], np.ndarray]:
        n = len(letters)
        sure = lambda m: 1.0 / (1.0 + np.exp(-2.0 * np.clip(m, -30, 30)))
        row = {name: k for k, name in enumerate(self.names)}
        family_names = sorted(self.families)
        if len(family_names) > 1:
            of = np.stack([sure(margins[row["family", f]]) for f in family_names])
            best = of.argmax(axis=0)
            score = of.max(axis=0) / np.maximum(of.sum(axis=0), 1e-12)
        else:
            best, score = np.zeros(n, np.int64), np.ones(n)
        langs = np.full(n, "und", dtype=object)
        for k, fam in enumerate(family_names):
            own = np.flatnonzero(best == k)
            inside = self.families[fam]
            if len(inside) == 1:
                langs[own] = inside[0]
                continue
            votes, belief = np.zeros((len(inside), len(own))), np.zeros((len(inside), len(own)))
            for a in range(len(inside)):
                for b in range(a + 1, len(inside)):
                    p = sure(margins[row["pair", inside[a], inside[b]]][own])
                    votes[a] += p >= 0.5
                    votes[b] += p < 0.5
                    belief[a] += p
                    belief[b] += 1 - p
            pick = (votes + belief / (10.0 * len(inside))).argmax(axis=0)
            langs[own] = np.array(inside, dtype=object)[pick]
            score[own] *= belief[pick, np.arange(len(own))] / (len(inside) - 1)
        langs[~letters] = "und"
        score = np.where(letters, np.clip(score, 0.0, 1.0), 0.0)
        families = [family_names[b] if ok else None for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return langs.tolist(), families, score


def fit(sample: DataFrame) -> Model:
    """Fit on ``sample`` (``text, lang``; bounded by the caller). Features are made on the executors."""
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lowered(batch["text"])
            idx, val = [], []
            for _, _, part, offs in words.blocks(data, offsets):
                f, starts = features(part, offs)
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    k, c = np.unique(f[a:b], return_counts=True)
                    idx.append(k.astype(np.uint32).tobytes())
                    val.append((c * (SCALE / max(1, b - a))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["lang", "idx", "val"])

    got = sorted(((r.lang, bytes(r.idx), bytes(r.val)) for r in sample.select("text", "lang").mapInArrow(rows_of, "lang string, idx binary, val binary").collect()))
    rows = [(np.frombuffer(i, np.uint32), np.frombuffer(v, np.float32).astype(np.float64)) for _, i, v in got]
    langs = np.array([g[0] for g in got], dtype=object)
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    model = Model(families)
    fitted = []
    if len(families) > 1:
        family = np.array([FAMILY_OF.get(x, x) for x in langs], dtype=object)
        for name in sorted(families):
            fitted.append((("family", name), *svm(rows, np.where(family == name, 1.0, -1.0))))
    for inside in families.values():
        for a in range(len(inside)):
            for b in range(a + 1, len(inside)):
                own = np.flatnonzero((langs == inside[a]) | (langs == inside[b]))
                fitted.append((("pair", inside[a], inside[b]), *svm([rows[i] for i in own], np.where(langs[own] == inside[a], 1.0, -1.0))))
    model.names = [f[0] for f in fitted]
    if fitted:
        model.weights = np.stack([f[1] for f in fitted]).astype(np.float32)
        model.biases = np.array([f[2] for f in fitted])
    return model


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, max_rows: int, id_col: str, text_col: str, lang_col: str, max_bytes: int = 16 << 20) -> DataFrame:
    """The bounded sample of labelled rows: as many of each language as share ``max_rows`` evenly.

    Equal rows count once. The texts of a language have its share of ``max_bytes`` at most: rows are
    taken in the order of their hashes while they fit, so a text longer than the share is not learned from.
    """
    rows = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    n = max(1, rows.select(lang_col).distinct().count())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).withColumn("content", F.xxhash64("text"))
    share = max_bytes // n
    short = rows.filter(F.octet_length("text") <= share).select("lang", F.xxhash64("id").alias("h"), "id", "content", F.octet_length("text").cast("long").alias("size")).distinct()
    chosen = exchange.lowest_hashes(short, "lang", max(2, max_rows // n))
    upto = Window.partitionBy("lang").orderBy("place")
    chosen = chosen.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") <= share).select("lang", "id", "content")
    # at most max_rows rows of two numbers and a name: bounded, so sent to every task instead of moving all texts
    return rows.join(F.broadcast(chosen), ["lang", "id", "content"]).groupBy("id", "lang", "content").agg(F.min("text").alias("text")).select("id", "text", "lang")


def identify(docs: DataFrame, train: DataFrame | None = None, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, family, score`` of every document; fitted on ``train`` (or ``docs``) outside the held-out third."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(sampled(train if train is not None else docs, max_rows, id_col, text_col, lang_col)))
    schema = exchange.arrow_schema(OUT)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, families, scores = shared.value.predict(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held"], pa.array(langs, pa.string()), pa.array(families, pa.string()), pa.array(scores)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, OUT)


def accepted(docs: DataFrame, train: DataFrame | None = None, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, unchanged, that have a language (not ``und``)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(sampled(train if train is not None else docs, max_rows, id_col, text_col, lang_col)))
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, _ = shared.value.predict(batch.column(place))
            yield batch.filter(pc.not_equal(pa.array(langs, pa.string()), "und"))

    return docs.mapInArrow(keep, docs.schema)
