"""Hard negatives by filtering on segment summaries.

A vector is cut into 1, 2, 4 and 8 segments. For each segment its mean and its standard deviation
are stored. Over a segment of ``n`` components the inner product of two vectors is
``n m1 m2`` plus or minus at most ``n d1 d2`` (Cauchy-Schwarz on the centred parts), so the
summaries alone bound a score from both sides. Anchors meet rows at the coarsest level first; a
pair goes on to the next level only while its bounds still allow a place in the result, and only
pairs that pass the finest level are scored exactly, in whole numbers.

Anchors are taken in slices of bounded size. A slice is sent to all tasks, which read the stored
summaries and vectors once and keep, for each anchor, no more than the best few; vectors are never
shuffled. What the tasks kept is merged by anchor, so a hot label or a large group of equal
vectors adds no more than the best few a task. The best scores so far tighten the bounds.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take
no part; an anchor meets only vectors of its own length; rows that repeat an id are rows of their
own, but never a positive of the anchor with that id; an anchor that is repeated whole counts
once, and anchors that share an id with other vectors are mined one by one; without a positive, or
without a row in the range of a positive, an anchor gives no row; a positive score below zero has
an empty range; other columns, whatever their names, are left out; an empty table gives an empty
result. Scores must fit 64 bits: a component that could exceed that raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgewatch.llm.exchange import saved

SEGMENTS = (1, 2, 4, 8)
SLICE_BYTES = 16 << 20
BLOCK_PAIRS, PAIRS = 1 << 20, 1 << 16
#: Share of the pairs of a block above which bounds are taken for the whole block.
DENSE = 0.02
LOW = -(1 << 62)


def cuts(d: int, segments: int) -> np.ndarray:
    return np.arange(segments + 1) * d // segments


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled means and deviations (``sqrt(n)`` times each) of the segments of all levels, side by side."""
    d, means, devs = x.shape[1], [], []
    for s in SEGMENTS:
        if s > d:
            break
        at = cuts(d, s)
        n = np.diff(at)
        m = np.add.reduceat(x, at[:-1], axis=1) / n
        centred = x - np.repeat(m, n, axis=1)
        means.append(m * np.sqrt(n))
        devs.append(np.sqrt(np.add.reduceat(centred * centred, at[:-1], axis=1)))
    return (np.concatenate(means, axis=1), np.concatenate(devs, axis=1)) if means else (np.zeros((len(x), 0)),) * 2


def levels(d: int) -> list[slice]:
    """Where each level lies in a summary."""
    ends = np.cumsum([0, *[s for s in SEGMENTS if s <= d]]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def lists(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


class Vectors:
    """Vectors of one length with their ids, labels and summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, means: np.ndarray, devs: np.ndarray):
        self.ids, self.labels, self.x, self.means, self.devs = ids, labels, x, means, devs

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray | slice) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.x[at], self.means[at], self.devs[at])


def by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, Vectors]]:
    """``(places in the batch, vectors)`` for each vector length."""
    flat, offsets = lists(batch["x"], np.int64)
    means, m_at = lists(batch["means"], np.float64)
    devs, _ = lists(batch["devs"], np.float64)
    ids, labels, n = batch["id"].to_numpy(), batch["label"].to_numpy(), np.diff(offsets)
    for d in np.unique(n).tolist():
        at = np.flatnonzero(n == d)
        wide = int(np.diff(m_at)[at[0]])
        rows, more = offsets[at][:, None] + np.arange(d), m_at[at][:, None] + np.arange(wide)
        yield at, Vectors(ids[at], labels[at], flat[rows], means[more], devs[more])


def pairs_left(a: Vectors, b: Vectors, wanted: np.ndarray, least: np.ndarray, most: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(anchor, row, exact score)`` of the wanted pairs whose score is ``least`` or more (and ``most`` or less), in runs of bounded size.

    Level by level, pairs whose bounds rule that out go. While many pairs of the block are left, a
    level's bounds are one matrix product each; once few are, they are computed pair by pair.
    """
    d = a.x.shape[1]
    steps, left = levels(d), wanted
    for k, level in enumerate(steps):
        if k and np.count_nonzero(left) <= DENSE * left.size:
            yield from _sparse(a, b, left, steps[k:], least, most)
            return
        slack = 1e-9 * (1.0 + float(np.abs(a.means[:, level]).sum(axis=1).max(initial=0) + a.devs[:, level].sum(axis=1).max(initial=0))
                        * float(np.abs(b.means[:, level]).max(initial=0) + b.devs[:, level].max(initial=0)))
        theirs = np.concatenate([b.means[:, level], b.devs[:, level]], axis=1).T
        left = left & (np.concatenate([a.means[:, level], a.devs[:, level]], axis=1) @ theirs >= (least - slack)[:, None])
        if most is not None:
            left &= np.concatenate([a.means[:, level], -a.devs[:, level]], axis=1) @ theirs <= (most + slack)[:, None]
    if np.count_nonzero(left) <= DENSE * left.size:
        yield from _sparse(a, b, left, [], least, most)
    elif len(left):
        # whole numbers below 2 ** 53 are exact in a product of doubles
        exact = d * float(np.abs(a.x).max(initial=0)) * float(np.abs(b.x).max(initial=0)) < 1 << 53
        scores = a.x.astype(np.float64) @ b.x.T.astype(np.float64) if exact else a.x @ b.x.T
        left = left & (scores >= least[:, None])
        if most is not None:
            left &= scores <= most[:, None]
        i, j = np.nonzero(left)
        yield i, j, scores[i, j].astype(np.int64)


def _sparse(a: Vectors, b: Vectors, left: np.ndarray, steps: list[slice], least: np.ndarray, most: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    i_all, j_all = np.nonzero(left)
    for at in range(0, len(i_all), PAIRS):
        i, j = i_all[at:at + PAIRS], j_all[at:at + PAIRS]
        for level in steps:
            mid = np.einsum("ij,ij->i", a.means[i, level], b.means[j, level])
            off = np.einsum("ij,ij->i", a.devs[i, level], b.devs[j, level])
            off = off + 1e-9 * (1.0 + np.abs(mid) + off)   # rounding
            keep = mid + off >= least[i]
            if most is not None:
                keep &= mid - off <= most[i]
            i, j = i[keep], j[keep]
        yield i, j, np.einsum("ij,ij->i", a.x[i], b.x[j])


class Best:
    """The best ``k`` scores of each of ``n`` lists, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), LOW, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.filled = np.zeros(n, np.int64)

    def last(self) -> np.ndarray:
        """The score to reach for a place: that of the ``k``-th, or the lowest while there are fewer."""
        return self.scores[:, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.last()[at]
        at, scores, ids = at[keep], scores[keep], ids[keep]
        if not len(at):
            return
        lists = np.unique(at)
        held = np.repeat(lists, self.filled[lists])
        place = np.arange(len(held)) - np.repeat(np.cumsum(self.filled[lists]) - self.filled[lists], self.filled[lists])
        at = np.concatenate([held, at])
        scores, ids = np.concatenate([self.scores[held, place], scores]), np.concatenate([self.ids[held, place], ids])
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        first = np.searchsorted(at, lists)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        top = place < self.k
        self.scores[at[top], place[top]], self.ids[at[top], place[top]] = scores[top], ids[top]
        self.filled[lists] = np.bincount(np.searchsorted(lists, at[top]), minlength=len(lists))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(np.arange(self.k)[None, :] < self.filled[:, None])
        return at, self.ids[at, place], self.scores[at, place]


def blocks(rows: Vectors, anchors: int) -> Iterator[Vectors]:
    """Runs of rows of which the bounds with all anchors fit the memory of a task."""
    step = max(1, BLOCK_PAIRS // anchors)
    for lo in range(0, len(rows), step):
        yield rows.take(slice(lo, lo + step))


def meet_positives(a: Vectors, b: Vectors, best: Best) -> None:
    """Rows of an anchor's label, other than itself."""
    for rows in blocks(b, len(a)):
        for label in np.intersect1d(a.labels, rows.labels).tolist():
            mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(rows.labels == label)
            some, others = a.take(mine), rows.take(theirs)
            for i, j, scores in pairs_left(some, others, some.ids[:, None] != others.ids[None, :], best.last()[mine].astype(np.float64), None):
                best.add(mine[i], scores, others.ids[j])


def meet_negatives(a: Vectors, b: Vectors, floor: np.ndarray, ceiling: np.ndarray, best: Best) -> None:
    """Rows of other labels with a score from ``floor`` to ``ceiling``, for each of an anchor's positives (columns)."""
    many = floor.shape[1]
    for rows in blocks(b, len(a)):
        need = np.maximum(floor, best.last().reshape(len(a), many)).astype(np.float64)
        need[floor > ceiling] = np.inf
        top = np.where(floor > ceiling, -np.inf, ceiling.astype(np.float64))
        for i, j, scores in pairs_left(a, rows, a.labels[:, None] != rows.labels[None, :], need.min(axis=1), top.max(axis=1)):
            pair, slot = np.nonzero((scores[:, None] >= floor[i]) & (scores[:, None] <= ceiling[i]))
            best.add(i[pair] * many + slot, scores[pair], rows.ids[j[pair]])


def summarised(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, label, x, means, devs`` of the rows that take part; ``x`` are the components times ``scale``, rounded down."""
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter("id is not null and label is not null and v is not null"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = lists(batch["v"], np.float64)   # a null component reads as NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fine = np.flatnonzero(bad[offsets[1:]] == bad[offsets[:-1]])
            n = np.diff(offsets)[fine]
            ends = np.concatenate([[0], np.cumsum(n)])
            x = np.floor(scale * flat[np.repeat(offsets[fine] - ends[:-1], n) + np.arange(ends[-1])])
            if float(np.abs(x).max(initial=0)) ** 2 * float(n.max(initial=0)) >= 1 << 62:
                raise ValueError("a component is too large for scores of 64 bits")
            x = x.astype(np.int64)
            wide = {d: sum(s for s in SEGMENTS if s <= d) for d in np.unique(n).tolist()}
            stops = np.concatenate([[0], np.cumsum([wide[d] for d in n.tolist()])]).astype(np.int64)
            means, devs = np.empty(stops[-1]), np.empty(stops[-1])
            for d, width in wide.items():
                at = np.flatnonzero(n == d)
                places = stops[at][:, None] + np.arange(width)
                means[places], devs[places] = summaries(x[ends[at][:, None] + np.arange(d)].astype(np.float64))
            listed = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v)) for e, v in ((ends, x), (stops, means), (stops, devs))]
            chosen = pa.array(fine)
            yield pa.RecordBatch.from_arrays([batch["id"].take(chosen), batch["label"].take(chosen), *listed], ["id", "label", "x", "means", "devs"])

    return rows.mapInArrow(store, "id bigint, label bigint, x array<bigint>, means array<double>, devs array<double>")


def best_of(rows: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "other")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _tasks(held: DataFrame, anchors: pa.Table, slots: int, k: int, meet: Callable[[Vectors, np.ndarray, Vectors, Best], None]) -> DataFrame:
    """``anchor, slot, other, score``: the best ``k`` of each anchor and slot in every task."""
    sent = held.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {v.x.shape[1]: (at, v, Best(len(v) * slots, k)) for at, v in by_length(sent.value)}
        for batch in batches:
            for _, rows in by_length(batch) if batch.num_rows else ():
                if (group := groups.get(rows.x.shape[1])) is not None:
                    meet(group[1], group[0], rows, group[2])
        for at, _, best in groups.values():
            place, ids, scores = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(at[place // slots], pa.int32()), pa.array(place % slots, pa.int32()), pa.array(ids), pa.array(scores)], ["anchor", "slot", "other", "score"])

    return held.mapInArrow(run, "anchor int, slot int, other bigint, score bigint")


def mine(vectors: DataFrame, anchor: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         id_col: str = "id", vec_col: str = "vector", label_col: str = "label", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor (a condition over ``id``) has as positives its ``positives`` best rows of the same
    label. For each, the best ``negatives`` rows of other labels whose score is ``low`` to ``high``
    per cent of the positive's are returned.
    """
    spark = vectors.sparkSession
    held = saved(summarised(vectors, scale, id_col, vec_col, label_col), "segment-summaries")
    chosen = saved(held.filter(anchor).dropDuplicates(["id", "label", "x"]), "anchors")
    size = chosen.agg(F.sum(F.size("x") * 8 + F.size("means") * 16 + 16)).first()[0] or 0
    slices = -(-size // slice_bytes)
    dealt = F.pmod(F.xxhash64("id", "x"), F.lit(max(1, slices)))
    out = None
    for part in range(slices):
        anchors = chosen.filter(dealt == part).toArrow()
        if anchors.num_rows:
            found = _mined(spark, held, anchors, positives, negatives, low, high)
            out = found if out is None else out.unionByName(found)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.createDataFrame([], schema) if out is None else out


def _mined(spark, held: DataFrame, anchors: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    def same(a: Vectors, at: np.ndarray, rows: Vectors, best: Best) -> None:
        meet_positives(a, rows, best)

    near = saved(best_of(_tasks(held, anchors, 1, positives, same), positives, "anchor"), "positives")
    # at most ``positives`` rows for each anchor of the slice
    known = near.toArrow()
    score = np.full((anchors.num_rows, positives), -1, np.int64)
    score[known["anchor"].to_numpy(), known["rank"].to_numpy() - 1] = known["score"].to_numpy()
    floor, ceiling = -((-low * score) // 100), high * score // 100

    def differing(a: Vectors, at: np.ndarray, rows: Vectors, best: Best) -> None:
        meet_negatives(a, rows, floor[at], ceiling[at], best)

    far = best_of(_tasks(held, anchors, positives, negatives, differing), negatives, "anchor", "slot")
    names = spark.createDataFrame(pa.table({"anchor": pa.array(range(anchors.num_rows), pa.int32()), "anchor_id": anchors["id"]}))
    firsts = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(firsts, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The registered query as DuckDB SQL over ``embeddings``: every anchor against every row.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), TRUE))) = 0),
s AS (SELECT a.vec_id AS a, a.label AS a_label, b.vec_id AS b, b.label AS b_label, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE a_label = b_label QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER q)::INTEGER AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND n.b_label <> p.a_label AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW q AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) QUALIFY row_number() OVER q <= 3
"""
