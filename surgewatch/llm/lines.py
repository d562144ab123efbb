"""Line dedup: a segment-partition edit join over all lines of the corpus.

Two lines (trimmed of white space) are linked if their edit distance in
characters is at most ``min(max_edits, length // chars_per_edit)``, with the
length of the shorter one; so short lines must be equal. Classes of lines are
the connected components; the first occurrence of a class (smallest document
id, then line number) stays and every other occurrence is removed.

A line of length ``l`` that may differ by ``k`` edits is cut into ``k + 1``
segments; a line within ``k`` edits of it holds one of them unchanged, at a
place that the lengths bound. Every line sends its index keys (length, segment,
content) and its probe keys through the chunk and bucket exchange. Lines without
a shared key are done; the rest are joined on their keys and verified with a
banded bit-parallel edit distance.

Defined cases: a null text is an empty text, which has no lines; blank lines
are kept, unless nothing else is left; a null id counts as one document below
all others; rows that share an id and line number are the same occurrence;
other columns are carried along whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from surgewatch.llm import exchange, linking, words

WIDTH = 4
CANDIDATES = "sig string, line string, doc bigint, at int, chunk int"
#: White space that is trimmed from a line: space and the characters 9 to 13.
BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``: a band of ``2k + 1`` diagonals, one bit each.

    Bit ``t`` of the band at column ``j`` is row ``j - k + t``; ``up`` and ``down`` say that
    the distance grows or falls by one from the row above.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > k:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < hi - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo:len(a) - end], b[lo:len(b) - end]
    m, n = len(a), len(b)
    if min(m, n) == 0:
        return max(m, n) <= k
    band = (1 << (2 * k + 1)) - 1
    rows: dict[str, int] = {}
    for r, c in enumerate(a):
        rows[c] = rows.get(c, 0) | (1 << (r + k))
    up, down = band & ~((1 << k) - 1), 0
    lowest = k   # distance at the band's last row
    for j, c in enumerate(b):
        same = (rows.get(c, 0) >> j) & band
        diagonal = ((((same & up) + up) ^ up) | same | down) & band
        right_up = (down | ~(diagonal | up)) & band
        right_down = diagonal & up
        lowest += 1 - (diagonal >> (2 * k))
        diagonal >>= 1
        up, down = (right_down | ~(diagonal | right_up)) & band, diagonal & right_up
    below = ((1 << (n + k - m)) - 1) << (m - n + k)   # rows m + 1 to n + k of the last column
    return lowest - (up & below).bit_count() + (down & below).bit_count() <= k


class Lines:
    """All lines of the texts of a chunk: place, trimmed span, two hashes."""

    def __init__(self, texts: exchange.Texts):
        doc, at, sig, sig2, size, self.spans = [], [], [], [], [], []
        for lo, hi, data, offsets in words.blocks(texts.data, texts.offsets):
            raw = data.tobytes().decode("utf-8", "replace")
            chars = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            edges = lead[offsets]
            if edges[-1] != len(chars):   # bytes that are not UTF-8
                parts = [data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(hi - lo)]
                chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
                edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            some = np.flatnonzero(np.diff(edges) > 0)
            breaks = np.flatnonzero(chars == 10)
            owner = np.searchsorted(edges, breaks, side="right") - 1
            starts = np.concatenate([edges[some], breaks + 1])
            ends = np.concatenate([breaks, edges[some + 1]])
            who = np.concatenate([some, owner])
            order = np.lexsort((starts, who))
            starts, who = starts[order], who[order]
            ends = ends[np.lexsort((ends, np.concatenate([owner, some])))]
            first = np.searchsorted(who, np.arange(hi - lo))
            number = np.arange(len(who)) - first[who]
            solid = np.flatnonzero(~np.isin(chars, BLANKS))
            i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
            full = j > i
            s, e = starts.copy(), starts.copy()
            s[full], e[full] = solid[i[full]], solid[j[full] - 1] + 1
            h = words.hash_spans(chars, s, e)
            up, down = words.powers(words.WORD_BASE, len(chars) + 1)
            sums = np.zeros(len(chars) + 1, words.U64)
            np.cumsum((chars.astype(words.U64) + words.U64(7)) * up[:len(chars)], out=sums[1:])
            doc.append(who + lo)
            at.append(number)
            sig.append(h)
            sig2.append(words.mix((sums[e] - sums[s]) * down[s] + (e - s).astype(words.U64)))
            size.append(e - s)
            self.spans.append((chars, s, e, starts, ends))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.doc, self.at, self.size = cat(doc, np.int64), cat(at, np.int64), cat(size, np.int64)
        self.sig, self.sig2 = cat(sig, np.uint64), cat(sig2, np.uint64)

    def firsts(self, ids: np.ndarray) -> np.ndarray:
        """The first occurrence of each distinct line that is not blank."""
        order = np.lexsort((self.at, ids[self.doc], self.sig2, self.sig))
        order = order[self.size[order] > 0]
        k, k2 = self.sig[order], self.sig2[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
        return np.sort(order[new])

    def runs(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(characters, starts, ends, rows) of the given lines, block by block."""
        base = 0
        for chars, s, e, _, _ in self.spans:
            lo, hi = np.searchsorted(rows, [base, base + len(s)])
            own = rows[lo:hi]
            yield chars, s[own - base], e[own - base], own
            base += len(s)

    def text(self, row: int) -> str:
        for chars, s, e, _, _ in self.spans:
            if row < len(s):
                return chars[s[row]:e[row]].tobytes().decode("utf-32-le", "replace")
            row -= len(s)
        raise IndexError(row)


def allowed(length: np.ndarray, max_edits: int, chars_per_edit: int) -> np.ndarray:
    return np.minimum(max_edits, length // chars_per_edit)


def segment_keys(chars: np.ndarray, s: np.ndarray, e: np.ndarray, max_edits: int, chars_per_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the lines' own segments and of the substrings that they look up: (key, line, own).

    For lines of length ``l`` (``k`` edits allowed), ``gap`` characters shorter, segment ``i``
    at ``p`` is looked up at every place from ``max(p - i, p + gap - (k - i))`` to
    ``min(p + i, p + gap + (k - i))``: elsewhere another segment matches too.
    """
    keys, owners, own = [], [], []
    size = e - s
    line = np.arange(len(s))
    up, down = words.powers(words.BYTE_BASE, len(chars) + 1)
    sums = np.zeros(len(chars) + 1, words.U64)
    np.cumsum((chars.astype(words.U64) + words.U64(1)) * up[:len(chars)], out=sums[1:])
    for k in range(max_edits + 1):
        for gap in range(k + 1):
            short = size - gap
            sel = (short > 0) & (allowed(short, max_edits, chars_per_edit) == k)
            if not sel.any():
                continue
            n, l, begin, who = size[sel], short[sel], s[sel], line[sel]
            base, longer = l // (k + 1), l % (k + 1)
            for i in range(k + 1):
                # the last ``longer`` segments have one character more
                width = base + (i >= k + 1 - longer)
                p = i * base + np.maximum(0, i - (k + 1 - longer))
                tag = words.mix(l.astype(words.U64) * words.U64(64) + words.U64(i))
                for shift in range(max(-i, gap - (k - i)), min(i, gap + (k - i)) + 1):
                    at = p + shift
                    ok = (at >= 0) & (at + width <= n)
                    a = begin[ok] + at[ok]
                    h = (sums[a + width[ok]] - sums[a]) * down[a]
                    keys.append(words.mix(words.mix(h) + tag[ok]))
                    owners.append(who[ok])
                    own.append(np.full(int(ok.sum()), gap == 0 and shift == 0))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(own)


def _chunk_keys(lines: Lines, rows: np.ndarray, max_edits: int, chars_per_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(k, own_rows[o], f) for chars, s, e, own_rows in lines.runs(rows)
             for k, o, f in [segment_keys(chars, s, e, max_edits, chars_per_edit)]]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _candidates(chunks: DataFrame, n: int, max_edits: int, chars_per_edit: int) -> DataFrame:
    """Distinct lines of each chunk that share a key with another line, with their first occurrence there."""

    def keyed(table):
        texts = exchange.unpacked(table)
        lines = Lines(texts)
        rows = lines.firsts(texts.ids)
        keys, owners, own = _chunk_keys(lines, rows, max_edits, chars_per_edit)
        return texts, lines, rows, keys, owners, own

    def ask(chunk, table):
        _, _, _, keys, owners, own = keyed(table)
        order, at = exchange.distinct_pairs(keys, owners)
        seen, counts = np.unique(keys[order][at], return_counts=True)
        indexed = np.zeros(len(seen), np.uint8)
        indexed[np.searchsorted(seen, keys[own])] = 1
        return exchange.request_rows(chunk, seen, indexed + 2 * (counts > 1).astype(np.uint8), n, WIDTH)

    def reply(table):
        keys, at = exchange.bucket_keys(table, WIDTH)
        note = np.concatenate([np.frombuffer(x, np.uint8) for x in table["note"].to_pylist()])
        seen, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        hit = (np.bincount(place, note & 1, len(seen)) > 0) & ((counts > 1) | (np.bincount(place, note & 2, len(seen)) > 0))
        bits = hit[place].astype(np.uint8)
        return [bits[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def tell(chunk, table, answers):
        texts, lines, rows, keys, owners, _ = keyed(table)
        seen, place = np.unique(keys, return_inverse=True)
        hit = exchange.answered(answers, len(seen), seen, n, np.uint8).astype(bool)[place]
        # equal lines of one chunk are one distinct line: they count as candidates too
        _, which, counts = np.unique(lines.sig[lines.size > 0], return_inverse=True, return_counts=True)
        many = np.zeros(len(lines.sig), bool)
        many[np.flatnonzero(lines.size > 0)] = counts[which] > 1
        chosen = np.zeros(len(lines.sig), bool)
        chosen[owners[hit]] = True
        picked = rows[chosen[rows] | many[rows]]
        out = []
        for chars, s, e, own in lines.runs(picked):
            for a, b, r in zip(s.tolist(), e.tolist(), own.tolist(), strict=True):
                out.append((f"{int(lines.sig[r]):016x}{int(lines.sig2[r]):016x}", chars[a:b].tobytes().decode("utf-32-le", "replace"),
                            int(texts.ids[lines.doc[r]]), int(lines.at[r]), chunk))
        return out

    return exchange.asked(chunks.select("chunk", "ids", "lens", "text"), n, ask, reply, tell, CANDIDATES)


def histograms(chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each line 32 counts of its characters, folded by their low bits and cut at 255, as four 64-bit numbers."""
    n = len(ends)
    size = np.diff(np.concatenate([[0], ends]))
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    counts = np.bincount(owner * 32 + (chars & np.uint32(31)).astype(np.int64), minlength=n * 32)
    return np.minimum(counts, 255).astype(np.uint8).reshape(n, 32).view("<i8")


def alike(max_edits: int) -> Callable[[Column, Column], Column]:
    """Whether two lines' lengths and histograms allow ``max_edits`` edits: each edit moves a length by one, the counts by two."""
    def possible(x: Column, y: Column) -> Column:
        apart = [F.abs(F.shiftrightunsigned(x[f"h{i}"], at).bitwiseAND(255) - F.shiftrightunsigned(y[f"h{i}"], at).bitwiseAND(255))
                 for i in range(4) for at in range(0, 64, 8)]
        return (F.abs(x["size"] - y["size"]) <= max_edits) & (reduce(lambda a, b: a + b, apart) <= 2 * max_edits)

    return possible


def _near(pairs: DataFrame, lines: DataFrame, max_edits: int, chars_per_edit: int) -> DataFrame:
    text = lines.select("sig", "line")
    joined = (pairs.join(text.toDF("b", "tb"), "b").join(text.toDF("a", "ta"), "a").select("a", "b", "ta", "tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within(x, y, min(max_edits, min(len(x), len(y)) // chars_per_edit))
                    for x, y in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist(), strict=True)]
            kept = batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.ones(kept.num_rows))], names=["a", "b", "sim"])

    return joined.mapInArrow(check, "a string, b string, sim double")


def decisions(candidates: DataFrame, max_edits: int, chars_per_edit: int) -> DataFrame:
    """``chunk, sig, doc, at``: for each candidate line of a chunk, the occurrence that its class keeps."""
    lines = exchange.saved(candidates.groupBy("sig").agg(F.min("line").alias("line"), F.min(F.struct("doc", "at")).alias("first")), "lines")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch["line"])
            for lo, hi, _, _ in words.blocks(data, offsets):
                texts = batch["line"].slice(lo, hi - lo).to_pylist()
                chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
                size = np.array([len(t) for t in texts], np.int64)
                ends = np.cumsum(size)
                keys, owners, own = segment_keys(chars, ends - size, ends, max_edits, chars_per_edit)
                order, at = exchange.distinct_pairs(keys, owners)
                mine = np.add.reduceat(own[order].astype(np.int64), at) > 0 if len(at) else np.zeros(0, bool)
                lines_of = owners[order][at]
                counts = histograms(chars, ends)[lines_of]
                info = pa.StructArray.from_arrays([pa.array(size[lines_of].astype(np.int32)), *[pa.array(counts[:, i].copy()) for i in range(4)]], ["size", "h0", "h1", "h2", "h3"])
                yield pa.RecordBatch.from_arrays([pa.array(keys[order][at].view(np.int64)), batch["sig"].take(pa.array(lines_of + lo)), pa.array(mine), info], names=["bucket", "node", "own", "info"])

    members = exchange.saved(lines.mapInArrow(keys_of, "bucket bigint, node string, own boolean, info struct<size: int, h0: bigint, h1: bigint, h2: bigint, h3: bigint>"), "segments")
    # buckets that no line's own segment is in, or that one line has for itself, link nothing
    live = members.groupBy("bucket").agg(F.max("own").alias("own"), F.min("node").alias("x"), F.max("node").alias("y")).filter("own and x <> y").select("bucket")
    members = members.join(live, "bucket").select("bucket", "node", "info")
    comps, _ = linking.link(members, alike(max_edits), lambda pairs: _near(pairs, lines, max_edits, chars_per_edit), 1.0)
    classed = lines.join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first", F.coalesce("comp", "sig").alias("class"))
    keep = classed.groupBy("class").agg(F.min("first").alias("keep"))
    classed = classed.join(keep, "class").select("sig", "keep.doc", "keep.at")
    return candidates.select("chunk", "sig").join(classed, "sig").select("chunk", "sig", "doc", "at")


def dedup(docs: DataFrame, max_edits: int = 2, chars_per_edit: int = 20, id_col: str = "doc_id", text_col: str = "text",
          rest: list[str] | None = None, keep_text: bool = True, own_prefix: str = "") -> DataFrame:
    """One row per document: id, ``text`` without the removed lines, counts and numbers of removed lines.

    ``rest`` names further columns to carry along; ``own_prefix`` keeps the operator's columns apart from them. ``keep_text=False`` gives the text's
    SHA-256 alone. Kept lines are unchanged and joined by ``\\n``.
    """
    rest = rest or []
    spark = docs.sparkSession
    n = exchange.chunk_count(spark, exchange.text_bytes(docs, text_col))
    # the number of lines decides how many candidates there are, not how large a chunk may be
    candidates = exchange.saved(_candidates(exchange.chunked(docs, n, id_col, text_col), n, max_edits, chars_per_edit), "line-candidates")
    kept = decisions(candidates, max_edits, chars_per_edit)
    own = T.StructType.fromDDL("doc_id bigint, text string, text_sha256 string, n_lines bigint, n_removed bigint, removed array<int>")
    carried = [T.StructField(f"rest_{i}", docs.schema[c].dataType, True) for i, c in enumerate(rest)]
    out_schema = T.StructType([*own.fields, *carried])
    arrow = to_arrow_schema(out_schema)

    def tell(key, table, answers):
        texts = exchange.unpacked(table)
        lines = Lines(texts)
        first = {}
        for sig, doc, at in zip(answers["sig"].to_pylist(), answers["doc"].to_pylist(), answers["at"].to_pylist(), strict=True):
            first[sig] = (doc, at)
        gone = np.zeros(len(lines.sig), bool)
        known = np.array([int(x[:16], 16) for x in first], np.uint64)
        for r in np.flatnonzero(np.isin(lines.sig, known) & (lines.size > 0)).tolist():
            keep = first.get(f"{int(lines.sig[r]):016x}{int(lines.sig2[r]):016x}")
            gone[r] = keep is not None and keep != (int(texts.ids[lines.doc[r]]), int(lines.at[r]))
        bounds = np.searchsorted(lines.doc, np.arange(len(texts.ids) + 1))
        solid = np.concatenate([[0], np.cumsum(~gone & (lines.size > 0))])
        cols = {f.name: [] for f in own}
        for i in range(len(texts.ids)):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            raw = texts.text(i)
            removed = np.flatnonzero(gone[lo:hi]).tolist()
            if removed:
                out = set(removed)
                raw = b"\n".join(x for k, x in enumerate(raw.split(b"\n")) if k not in out) if solid[hi] > solid[lo] else b""
            doc = int(texts.ids[i])
            cols["doc_id"].append(None if doc == exchange.NO_ID else doc)
            cols["text"].append(raw.decode("utf-8", "replace") if keep_text else None)
            cols["text_sha256"].append(hashlib.sha256(raw).hexdigest())
            cols["n_lines"].append(hi - lo)
            cols["n_removed"].append(len(removed))
            cols["removed"].append(removed)
        arrays = [pa.array(v, arrow.field(k).type) for k, v in cols.items()]
        if rest and texts.rest is not None:
            arrays += [texts.rest.column(i).combine_chunks().cast(arrow.field(f"rest_{i}").type) for i in range(len(rest))]
        elif rest:
            arrays += [pa.array([], f.type) for f in list(arrow)[len(own):]]
        return pa.Table.from_arrays(arrays, schema=arrow)

    chunks = exchange.chunked(docs, n, id_col, text_col, rest)
    out = chunks.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(tell, out_schema)
    return out.select(*[F.col(c).alias(own_prefix + c) for c in own.names], *[F.col(f"rest_{i}").alias(c) for i, c in enumerate(rest)])
