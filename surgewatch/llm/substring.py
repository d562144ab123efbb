"""Substring dedup: repeated word windows, found by level-wise doubling.

A window is ``n`` consecutive words of one document. Windows of ``start`` words
that occur once in the corpus are out; where two neighbouring windows of a
length both repeat, the window of twice that length is a candidate, and so on
up to ``length``, or until no candidates survive. Only the first level looks at
every window; each later level reads only the documents that still have candidates.

A window of ``length`` words is removed where the same words also start
earlier: in a document with a smaller id, or earlier in the same document.
Levels below the last use 32 bits of a window's hash in each bucket (a false
candidate costs work, not correctness); the last level decides on 128 bits.

Defined cases: null or empty text has no words and keeps an empty text; fewer
than ``length`` words: nothing is removed; rows with a null id count as one document below all others; of rows that
share an id and start, none is earlier than the other, so repeated rows keep
their first window; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgewatch.llm import exchange, words

STATE = "ids binary, lens binary, text binary, marks binary"
DONE = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,words:int>>, kept_sha256 string, kept_text string"


class _Windows:
    """Windows of one length in a chunk that are candidates, with their keys and places."""

    def __init__(self, texts: exchange.Texts, length: int, marks: np.ndarray | None, half: int, wide: bool):
        keys, keys2, docs, starts, places = [], [], [], [], []
        self.n_words = np.zeros(len(texts.ids), np.int64)
        base = 0
        for lo, hi, data, offsets in words.blocks(texts.data, texts.offsets):
            s, e, bounds = words.split(data, offsets, words.RAW)
            self.n_words[lo:hi] = np.diff(bounds)
            h = words.hash_spans(data, s, e)
            counts = np.diff(bounds)
            at = np.arange(len(h))
            first = at[np.repeat(bounds[1:], counts) - at >= length]
            if marks is not None:
                m = marks[base:base + len(h)]
                first = first[m[first] & m[first + half]]
            if len(first):
                keys.append(words.hash_windows(h, first, length))
                if wide:
                    keys2.append(words.hash_windows(h, first, length, words.WORD_BASE_2))
                doc = np.searchsorted(bounds, first, side="right") - 1
                docs.append(doc + lo)
                starts.append(first - bounds[doc])
                places.append(first + base)
            base += len(h)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.keys, self.keys2 = cat(keys, np.uint64), cat(keys2, np.uint64)
        self.docs, self.starts, self.places = cat(docs, np.int64), cat(starts, np.int64), cat(places, np.int64)
        self.total = base


def _marks(table: pa.Table) -> np.ndarray | None:
    """Word positions whose window of the last level repeats; None at the first level."""
    if "marks" not in table.column_names:
        return None
    packed = table["marks"].to_pylist()
    if not packed:
        return np.zeros(0, bool)
    return np.unpackbits(np.frombuffer(packed[0], np.uint8)).astype(bool)


def _level(chunks: DataFrame, n_buckets: int, length: int, half: int, keep_text: bool) -> DataFrame:
    """Chunks of the documents with windows of ``length`` that repeat; other documents are done."""
    first_level = "marks" not in chunks.columns
    out_ddl = f"chunk int, {STATE}, " + ("one struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in DONE.split(", ")) + ">")

    def ask(chunk, table):
        w = _Windows(exchange.unpacked(table), length, _marks(table), half, False)
        keys, counts = np.unique(w.keys, return_counts=True)
        return exchange.request_rows(chunk, keys, (counts > 1).astype(np.uint8), n_buckets, 4)

    def reply(table):
        keys, at = exchange.bucket_keys(table, 4)
        many = np.concatenate([np.frombuffer(x, np.uint8) for x in table["note"].to_pylist()])
        seen, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = (counts > 1) | (np.bincount(place, many, len(seen)) > 0)
        bits = again[place].astype(np.uint8)
        return [bits[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def tell(chunk, table, answers):
        texts = exchange.unpacked(table)
        w = _Windows(texts, length, _marks(table), half, False)
        keys, place = np.unique(w.keys, return_inverse=True)
        hit = exchange.answered(answers, len(keys), keys, n_buckets, np.uint8).astype(bool)[place]
        mark = np.zeros(w.total, bool)
        mark[w.places[hit]] = True
        # a document goes on if two windows side by side repeat
        on = np.zeros(w.total, bool)
        if w.total > length:
            on[:-length] = mark[:-length] & mark[length:]
        bounds = np.concatenate([[0], np.cumsum(w.n_words)])
        alive = np.diff(np.concatenate([[0], np.cumsum(on)])[bounds]) > 0
        rows = []
        if alive.any():
            keep = np.flatnonzero(alive)
            packed = texts.pick(keep)
            rows.append((chunk, *packed, np.packbits(mark[np.repeat(alive, w.n_words)]).tobytes(), None))
        for i in np.flatnonzero(~alive):
            rows.append((chunk, None, None, None, None, _done(texts, int(i), np.zeros(0, np.int64), 0, keep_text)))
        return rows

    columns = ["chunk", "ids", "lens", "text"] + ([] if first_level else ["marks"])
    return exchange.asked(chunks.select(*columns), n_buckets, ask, reply, tell, out_ddl)


def _done(texts: exchange.Texts, i: int, starts: np.ndarray, length: int, keep_text: bool) -> dict:
    """The result of one document: what is left when the windows at ``starts`` go."""
    parts = texts.text(i).split()
    n, spans = len(parts), []
    if len(starts):
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, starts, 1)
        np.add.at(gone, np.minimum(starts + length, n), -1)
        covered = np.cumsum(gone[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
        spans = [{"start": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        parts = [p for p, c in zip(parts, covered.tolist(), strict=True) if not c]
    kept = b" ".join(parts)
    doc = int(texts.ids[i])
    return {"doc_id": None if doc == exchange.NO_ID else doc, "n_words": n, "n_removed": n - len(parts), "spans": spans,
            "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": None if not keep_text else kept.decode("utf-8", "replace")}


def _last(chunks: DataFrame, n_buckets: int, length: int, half: int | None, keep_text: bool) -> DataFrame:
    """Decide on windows of the full length: each document's spans and what is left."""
    columns = ["chunk", "ids", "lens", "text"] + (["marks"] if half else [])

    def found(table):
        texts = exchange.unpacked(table)
        w = _Windows(texts, length, _marks(table), half or 0, True)
        order = np.lexsort((w.starts, texts.ids[w.docs], w.keys2, w.keys))
        k, k2 = w.keys[order], w.keys2[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
        return texts, w, order, new

    def ask(chunk, table):
        texts, w, order, new = found(table)
        first = order[new]
        note = np.empty(len(first), dtype=[("k", "<u8"), ("id", "<i8"), ("at", "<i8")])
        note["k"], note["id"], note["at"] = w.keys2[first], texts.ids[w.docs[first]], w.starts[first]
        return exchange.request_rows(chunk, w.keys[first], note, n_buckets, 8)

    def reply(table):
        keys, at = exchange.bucket_keys(table, 8)
        note = np.concatenate([np.frombuffer(x, dtype=[("k", "<u8"), ("id", "<i8"), ("at", "<i8")]) for x in table["note"].to_pylist()])
        order = np.lexsort((note["at"], note["id"], note["k"], keys))
        k, k2 = keys[order], note["k"][order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
        lead = order[new][np.cumsum(new) - 1]
        bits = np.zeros(len(keys), np.uint8)
        bits[order] = (note["id"][order] == note["id"][lead]) & (note["at"][order] == note["at"][lead])
        return [bits[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def tell(chunk, table, answers):
        texts, w, order, new = found(table)
        first = order[new]
        global_first = exchange.answered(answers, len(first), w.keys[first], n_buckets, np.uint8).astype(bool)
        group = np.cumsum(new) - 1
        lead = first[group]
        same = (texts.ids[w.docs[order]] == texts.ids[w.docs[lead]]) & (w.starts[order] == w.starts[lead])
        gone = order[~(same & global_first[group])]
        gone = gone[np.lexsort((w.starts[gone], w.docs[gone]))]
        cuts = np.searchsorted(w.docs[gone], np.arange(len(texts.ids) + 1))
        return [tuple(_done(texts, i, w.starts[gone[cuts[i]:cuts[i + 1]]], length, keep_text).values()) for i in range(len(texts.ids))]

    return exchange.asked(chunks.select(*columns), n_buckets, ask, reply, tell, DONE)


def dedup(docs: DataFrame, length: int = 20, start: int = 5, id_col: str = "doc_id", text_col: str = "text",
          keep_text: bool = True) -> DataFrame:
    """One row per document: word counts, removed spans, and the kept text with its SHA-256.

    The kept text is the kept words joined by one space (null with ``keep_text=False``).

    ``length`` must be ``start`` times a power of two.
    """
    levels = []
    n = start
    while n < length:
        levels.append(n)
        n *= 2
    if n != length or start < 1:
        raise ValueError("length must be start times a power of two")
    spark = docs.sparkSession
    n_chunks = exchange.chunk_count(spark, exchange.text_bytes(docs, text_col))
    chunks, done, half = exchange.chunked(docs, n_chunks, id_col, text_col), [], None
    for level in levels:
        out = exchange.saved(_level(chunks, n_chunks, level, half or 0, keep_text), f"windows-{level}")
        done.append(out.filter(F.col("one").isNotNull()).select("one.*"))
        chunks, half = out.filter(F.col("one").isNull()).drop("one"), level
        if chunks.isEmpty():
            return _union(done)
    return _union([*done, _last(chunks, n_chunks, length, half, keep_text)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
