"""From candidate buckets to classes: leaders, verified links, connected components.

Nodes that share a bucket may be similar. All pairs of a bucket would be
quadratic, so every node is first verified against its bucket's leader (the node
that shares most buckets with others), and the components of those links are found. A pair inside one component can add
nothing. Buckets that still hold several components then get every pair across
components verified (each node outside the bucket's main component against the
whole bucket, where bounds on both allow a link), so no link that the buckets
propose is lost and no cap is set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgewatch.llm.exchange import saved


def _size(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of every node with a link: ``comp`` is the smallest node that it reaches.

    Alternates large-star and small-star steps until the links no longer change
    (a number of rounds that grows with the logarithm of the longest chain).
    Links of a hot node are reduced to its minimum before they are joined back.
    """
    e = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    size = _size(e)
    while size[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        e = saved(small.select("e.*").filter("hi <> lo").distinct(), "links")
        before, size = size, _size(e)
        if size == before:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(e.select("lo", "lo").distinct())


def link(members: DataFrame, possible: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame], threshold: float,
         bound: Callable[..., Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes and links of ``members`` (``bucket, node, info``): ``(node, comp)`` and ``(a, b)``.

    Rows of ``members`` are distinct. ``possible`` tells from the ``info`` of two nodes
    whether they can be similar at all. ``verify`` takes distinct pairs ``(a, b)`` and
    returns ``(a, b, sim)``; a link is a ``sim`` of at least ``threshold`` (pairs below it
    may be left out). ``bound(x, x_sim, y, y_sim, leader)`` may rule out more pairs from
    the similarities to the bucket's leader (null where not computed). Nodes without a
    link are in no class.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = saved(members.join(sizes, "bucket"), "buckets")
    # the leader of a bucket is its node with the most company in all its buckets: the likeliest centre
    company = held.groupBy("node").agg(F.sum("n").alias("company"))
    leaders = saved(held.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node", "info")).alias("top"))
                    .select("bucket", F.col("top.node").alias("leader"), F.col("top.info").alias("leader_info")), "leaders")
    led = held.join(leaders, "bucket").select("bucket", "node", "info", "leader", "leader_info",
                                              F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    stars = saved(led.filter("node <> leader").filter(possible(F.col("info"), F.col("leader_info"))).select("a", "b").distinct(), "stars")
    tested = saved(verify(stars), "tested")
    links = tested.filter(F.col("sim") >= threshold).select("a", "b")
    comps = components(links)

    now = saved(held.select("bucket", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
    per = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "comp")).alias("main")).filter("parts > 1")
    split = saved(split.select("bucket", F.col("main.comp").alias("main")), "split")
    open_ = led.join(split, "bucket").join(tested, ["a", "b"], "left").drop("a", "b")
    open_ = open_.withColumn("sim", F.when(F.col("node") == F.col("leader"), F.lit(1.0)).otherwise(F.col("sim")))
    open_ = saved(open_.join(now, ["bucket", "node"]), "open")
    out = open_.filter("comp <> main").select(F.col("bucket").alias("x_bucket"), F.col("node").alias("x"), F.col("comp").alias("x_comp"),
                                              F.col("info").alias("x_info"), F.col("sim").alias("x_sim"))
    near = possible(F.col("x_info"), F.col("info"))
    if bound is not None:
        near = near & bound(F.col("x_info"), F.col("x_sim"), F.col("info"), F.col("sim"), F.col("leader_info"))
    cross = out.join(open_, (F.col("x_bucket") == F.col("bucket")) & (F.col("comp") != F.col("x_comp"))
                     & ((F.col("comp") == F.col("main")) | (F.col("x") < F.col("node"))) & near)
    pairs = cross.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = saved(verify(pairs).filter(F.col("sim") >= threshold).select("a", "b"), "pairs")
    if more.isEmpty():
        return comps, links
    links = links.union(more)
    return components(links), links
