"""Benchmark decontamination by greedy string tiling.

Words are lower case letters and digits. A seed is ``min_match`` consecutive
words (a Karp-Rabin window hash) that a document and a benchmark item share.
For each such pair the longest match in which no word of either side is marked
is marked, again and again, until no match of ``min_match`` words is left. A
document is contaminated by an item if the marked words cover at least
``coverage`` of the item, in whatever order its parts stand in the document.

The benchmark is read in slices of at most ``slice_bytes`` of text, each sent
to every task, and the documents are passed over once for each slice; so a
larger benchmark costs more passes, never a larger broadcast. Documents are not
shuffled. Before tiling, a pair must reach the coverage counting every seed of
the item that the document holds anywhere, which tiling cannot exceed.

Defined cases: null or empty texts match nothing; items of fewer than
``min_match`` words take no part; a document without an id is reported with a
null id and removed like any other; repeated rows are each reported; other
columns, whatever their names, are kept as they are; empty tables give empty
results (an empty benchmark leaves all documents clean).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgewatch.llm import exchange, words

SLICE_BYTES = 16 << 20
FILTER_BITS = 22
MATCHES = "doc_id bigint, item_id bigint, coverage double, n_tiles int, n_words int, item_words int, tiles array<struct<at:int,item_at:int,words:int>>"


class Seeds:
    """All seeds of a slice of the benchmark, sorted, with the items and places that hold them."""

    def __init__(self, ids: list, texts: list[str | None], min_match: int):
        # lower case as of the documents: other rules differ for some Greek and Turkish letters
        data, offsets = exchange.lowered(exchange.Texts(np.zeros(len(texts), np.int64), *words.buffers(pa.array(texts, pa.large_string()))))
        s, e, bounds = words.split(data, offsets, words.NORMAL)
        first, keys = words.windows(words.hash_spans(data, s, e), bounds, min_match)
        item = np.searchsorted(bounds, first, side="right") - 1
        order = np.lexsort((first, keys))
        self.ids, self.lengths, self.min_match = ids, np.diff(bounds), min_match
        self.item, self.at = item[order], (first - bounds[item])[order]
        self.keys, begin = np.unique(keys[order], return_index=True)
        self.begin = np.r_[begin, len(keys)]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys & words.U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``keys`` (repeated), item and place in it, of every holder of the keys."""
        n = self.begin[keys + 1] - self.begin[keys]
        flat = np.repeat(self.begin[keys] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(np.arange(len(keys)), n), self.item[flat], self.at[flat]


def tiles(d: np.ndarray, i: np.ndarray, item_words: int, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(place in document, place in item, words)`` from the places of shared seeds.

    Seeds that follow one another on both sides are one match. The longest match
    goes first (then the earliest in the document, then in the item); a match that
    meets marked words is cut to its unmarked runs and waits again.
    """
    if not len(d):
        return []
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(d) != 1) | (np.diff(i) != 1)])
    heap = [(-(int(b - a) + min_match - 1), int(d[a]), int(i[a])) for a, b in zip(cut, np.r_[cut[1:], len(d)], strict=True)]
    heapq.heapify(heap)
    used_d: set[int] = set()
    used_i = np.zeros(item_words, bool)
    out = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = [not used_i[y + k] and (x + k) not in used_d for k in range(n)]
        if all(free):
            out.append((x, y, n))
            used_i[y:y + n] = True
            used_d.update(range(x, x + n))
            if used_i.all():
                break
            continue
        k = 0
        while k < n:
            if free[k]:
                end = k
                while end < n and free[end]:
                    end += 1
                if end - k >= min_match:
                    heapq.heappush(heap, (-(end - k), x + k, y + k))
                k = end
            k += 1
    return out


def reached(seeds: Seeds, item: np.ndarray, item_at: np.ndarray, coverage: float) -> np.ndarray:
    """The items of which the shared seeds, wherever they stand, cover enough: one count over all of them."""
    its, which = np.unique(item, return_inverse=True)
    sizes = seeds.lengths[its]
    base = np.r_[0, np.cumsum(sizes + 1)]   # the items side by side, a free place after each
    at = base[which] + item_at
    covered = np.cumsum(np.bincount(at, minlength=base[-1]) - np.bincount(at + seeds.min_match, minlength=base[-1])) > 0
    return its[np.add.reduceat(covered, base[:-1]) >= coverage * sizes]


def found(seeds: Seeds, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """``(row, item, tiles)`` of each text and item with enough coverage."""
    n = seeds.min_match
    plain = exchange.Texts(np.zeros(len(texts), np.int64), *words.buffers(texts))
    data, offsets = exchange.lowered(plain)
    mask = words.U64((1 << FILTER_BITS) - 1)
    for lo, _, part, offs in words.blocks(data, offsets):
        s, e, bounds = words.split(part, offs, words.NORMAL)
        first, keys = words.windows(words.hash_spans(part, s, e), bounds, n)
        maybe = np.flatnonzero(seeds.filter[(keys & mask).astype(np.int64)])
        slot = np.searchsorted(seeds.keys, keys[maybe])
        slot[slot == len(seeds.keys)] = 0
        hit = seeds.keys[slot] == keys[maybe] if len(seeds.keys) else np.zeros(0, bool)
        at, slot = first[maybe[hit]], slot[hit]
        docs = np.searchsorted(bounds, at, side="right") - 1
        for doc in np.unique(docs):
            own = docs == doc
            places, seed = at[own] - bounds[doc], slot[own]
            distinct, which = np.unique(seed, return_inverse=True)
            holder, item, item_at = seeds.places(distinct)
            for it in reached(seeds, item, item_at, coverage).tolist():
                sel = item == it
                size = int(seeds.lengths[it])
                # every place of the document with a seed, against every place of the item with that seed
                pos = {}
                for h, a in zip(holder[sel].tolist(), item_at[sel].tolist(), strict=True):
                    pos.setdefault(h, []).append(a)
                pairs = [(p, a) for p, w in zip(places.tolist(), which.tolist(), strict=True) for a in pos.get(w, ())]
                d, i = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
                got = tiles(d, i, size, n)
                if sum(t[2] for t in got) >= coverage * size:
                    yield int(doc) + lo, int(it), got


def slices(benchmark: DataFrame, min_match: int, slice_bytes: int, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """The benchmark's seeds, a bounded slice at a time, sent to the executors."""
    spark = benchmark.sparkSession
    n = max(1, -(-exchange.text_bytes(benchmark, text_col) // slice_bytes))
    for k in range(n):
        part = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        if n > 1:
            part = part.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        rows = part.filter("text is not null").orderBy("id", "text").collect()
        yield spark.sparkContext.broadcast(Seeds([r.id for r in rows], [r.text for r in rows], min_match))


def matches(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, slice_bytes: int = SLICE_BYTES,
            id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each contaminated document and item, with the tiles."""
    schema = exchange.arrow_schema(MATCHES)
    out = None
    for seeds in slices(benchmark, min_match, slice_bytes, item_id, item_text):
        def scan(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            s = seeds.value
            for batch in batches:
                ids = batch["id"].to_pylist()
                rows = [(ids[row], s.ids[it], min(1.0, sum(t[2] for t in got) / int(s.lengths[it])), len(got), sum(t[2] for t in got), int(s.lengths[it]),
                         [{"at": a, "item_at": b, "words": c} for a, b, c in sorted(got)]) for row, it, got in found(s, batch["text"], coverage)]
                yield exchange.table_of(rows, schema).combine_chunks().to_batches()[0] if rows else pa.RecordBatch.from_pylist([], schema=schema)

        part = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, MATCHES)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, slice_bytes: int = SLICE_BYTES,
          text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that no item contaminates, unchanged."""
    place = docs.columns.index(text_col)
    first = True
    for seeds in slices(benchmark, min_match, slice_bytes, item_id, item_text):
        def keep(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                ok[[row for row, _, _ in found(seeds.value, batch.column(place), coverage)]] = False
                yield batch.filter(pa.array(ok))

        # what is left is written before the next slice, so a worker holds one slice
        docs = (docs if first else exchange.saved(docs, "clean")).mapInArrow(keep, docs.schema)
        first = False
    return docs
