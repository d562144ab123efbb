"""Mixing sources to target weights: hierarchical budgeting over a domain, language, source tree.

A budget of tokens flows down the tree. At each node it is shared among the
children by their weights; a child that cannot use its share (its tokens times
``max_epochs``) takes what it can, and the shortage goes to its siblings. Only
what a whole subtree cannot use reaches the siblings of its parent, because a
node's capacity is the sum of its children's. The division is exact: whole
tokens, remainders to the first children by name.

A leaf with ``t`` tokens and a budget ``b`` is read ``b div t`` times in full
and then up to ``b mod t`` tokens of one more epoch, whose order is the hash of
(seed, epoch, id, text). The last document of that prefix counts for the tokens
that still fit (``take_tokens``). The prefix is found by sums over hash ranges
and one ordered range per leaf, so no task sorts a leaf.

DataFrame functions only. Defined cases: a null text has no tokens; a document
without a token is in no leaf and is not selected; a null language or source is
the empty name; rows that share id and text stand at one place of the order,
and at the cut each counts for the tokens that are left; weights default to 1,
a weight of 0 gives nothing; other columns, whatever
their names, are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgewatch.llm.exchange import saved

TOKEN = r"[^\x20\x09-\x0D]+"
LEAF = ["domain", "language", "origin"]
BIG = "decimal(38,0)"
MAX_BROADCAST_LEAVES = 50_000
ROWS_PER_RANGE = 20_000


def case(col: Column, values: Mapping[str, int | str], other: int | str) -> Column:
    """``CASE`` over fixed values."""
    out = None
    for key, value in values.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (``parent``, ``name``, ``weight``, ``cap``, ``budget`` of the parent) with ``alloc``.

    In the order of capacity per weight the children that are used up come first: child
    ``i`` is used up if ``cap_i * (weights from i on) <= (budget - caps before i) * weight_i``.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap").cast("double") / F.col("weight"), name)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (children.filter("weight > 0")
            .withColumn("caps", F.sum("cap").over(upto)).withColumn("ws", F.sum("weight").over(upto))
            .withColumn("all_w", F.sum("weight").over(by)).withColumn("spent", F.col("caps") - F.col("cap"))
            .withColumn("full", F.col("cap").cast(BIG) * (F.col("all_w") - F.col("ws") + F.col("weight"))
                        <= (F.col("budget") - F.col("spent")).cast(BIG) * F.col("weight"))
            .withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by))
            .withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(by))
            .withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(
                F.expr("(cast(left as decimal(38,0)) * weight) div nullif(open_w, 0)").cast("long"))))
    first = Window.partitionBy(*parent, "full")
    rows = (rows.withColumn("rest", F.col("left") - F.sum(F.when(F.col("full"), 0).otherwise(F.col("part"))).over(by))
            .withColumn("no", F.row_number().over(first.orderBy(name)))
            .withColumn("alloc", F.col("part") + F.when(~F.col("full") & (F.col("no") <= F.col("rest")), 1).otherwise(0)))
    return rows.select(*parent, name, "alloc")


def leaves(meta: DataFrame, weights: Mapping[str, Mapping[str, int]], numerator: int, denominator: int, max_epochs: int) -> DataFrame:
    """Tokens and budget of every leaf: ``domain, language, origin, tokens, budget``.

    The whole budget is ``numerator / denominator`` of all tokens, at most what ``max_epochs`` give.
    """
    used = reduce(lambda x, y: x & y, [case(F.col(name), weights.get(name, {}), 1) > 0 for name in LEAF])
    leaf = (meta.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
            .withColumn("cap", F.when(used, F.col("tokens") * max_epochs).otherwise(F.lit(0).cast("long"))))
    tokens, cap = leaf.agg(F.sum("tokens"), F.sum("cap")).first()
    whole = min((tokens or 0) * numerator // denominator, cap or 0)
    above: list[str] = []
    budget = None
    for depth, name in enumerate(LEAF):
        nodes = leaf.groupBy(*above, name).agg(F.sum("cap").alias("cap"))
        weight = case(F.col(name), weights.get(name, {}), 1).cast("long")
        rows = nodes.withColumn("weight", weight)
        rows = rows.withColumn("budget", F.lit(whole).cast("long")) if budget is None else rows.join(budget, above)
        budget = share(rows, above, name).withColumnRenamed("alloc", "budget")
        above = LEAF[:depth + 1]
    return leaf.select(*LEAF, "tokens").join(budget, LEAF)


def _cuts(meta: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``LEAF, cut, cut_take``: the last key of each leaf's partial epoch and the tokens that its document counts for."""
    n = meta.count()
    digits = 1
    while 16 ** digits * ROWS_PER_RANGE < n:
        digits += 1
    part = plan.filter("partial > 0").select(*LEAF, "epochs", "partial")
    rows = (meta.join(_small(part), LEAF).withColumn("key", epoch_key(seed, F.col("epochs") + 1, F.col("id"), F.col("text_md5")))
            .withColumn("range", F.substring("key", 1, digits)))
    sums = rows.groupBy(*LEAF, "range").agg(F.sum("tokens").alias("n"), F.first("partial").alias("partial"))
    upto = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = sums.withColumn("before", F.sum("n").over(upto) - F.col("n")).filter("before < partial and partial <= before + n").select(*LEAF, "range", "before")
    inside = rows.join(_small(at), [*LEAF, "range"]).groupBy(*LEAF, "key", "partial", "before").agg(F.sum("tokens").alias("n"), F.min("tokens").alias("one"))
    upto = Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("before", F.col("before") + F.sum("n").over(upto) - F.col("n")).filter("before < partial and partial <= before + n")
    return inside.select(*LEAF, F.col("key").alias("cut"), F.least("one", F.col("partial") - F.col("before")).alias("cut_take"))


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast, if counting proves that the rows are few."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_LEAVES else df


def epoch_key(seed: str, epoch: Column, id_col: Column, text_md5: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("")), text_md5))


def measured(docs: DataFrame, domains: Mapping[str, str], id_col: str, text_col: str, lang_col: str, source_col: str, *carry: str) -> DataFrame:
    """Leaf, tokens and hash of the text of each document that has a token."""
    text, source = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(source_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), case(source, domains, "other").alias("domain"), F.coalesce(F.col(lang_col), F.lit("")).alias("language"),
                       source.alias("origin"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"), F.md5(text).alias("text_md5"),
                       *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]).filter("tokens > 0")


def mix(docs: DataFrame, domains: Mapping[str, str], weights: Mapping[str, Mapping[str, int]], numerator: int = 1, denominator: int = 2,
        max_epochs: int = 4, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row for each selected document and epoch: ``doc_id, domain, language, origin, epoch, tokens, take_tokens``.

    ``domains`` maps a source to its domain; ``weights`` has ``domain``, ``language`` and
    ``origin`` weights by name; ``carry`` names columns of ``docs`` to add.
    """
    carry = carry or []
    meta = saved(measured(docs, domains, id_col, text_col, lang_col, source_col), "mix-meta")
    plan = saved(leaves(meta, weights, numerator, denominator, max_epochs), "mix-leaves")
    plan = plan.selectExpr(*LEAF, "cast(budget div tokens as int) as epochs", "budget % tokens as partial")
    cuts = saved(_cuts(meta, plan, seed), "mix-cuts")
    plan = plan.join(cuts, LEAF, "left")
    rows = measured(docs, domains, id_col, text_col, lang_col, source_col, *carry) if carry else meta
    rows = rows.join(_small(plan), LEAF).withColumn("key", epoch_key(seed, F.col("epochs") + 1, F.col("id"), F.col("text_md5")))
    last = F.coalesce(F.col("key") <= F.col("cut"), F.lit(False))
    rows = rows.withColumn("times", F.col("epochs") + last.cast("int")).filter("times > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"))
    take = F.when((F.col("epoch") > F.col("epochs")) & (F.col("key") == F.col("cut")), F.col("cut_take")).otherwise(F.col("tokens"))
    return rows.select(F.col("id").alias("doc_id"), *LEAF, "epoch", "tokens", take.alias("take_tokens"),
                       *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])


def oracle_sql(domains: Mapping[str, str], weights: Mapping[str, Mapping[str, int]], numerator: int, denominator: int, max_epochs: int, seed: str) -> str:
    """The same selection as DuckDB SQL over ``documents``, with one ordered sum over each leaf."""
    def cases(col: str, values: Mapping, other) -> str:
        q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
        return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {q(other)} END" if values else q(other)

    def level(depth: int) -> str:
        above, name = LEAF[:depth], LEAF[depth]
        part = ", ".join(above) or "1"
        on = " AND ".join(f"n.{c} = u.{c}" for c in above) or "TRUE"
        up = f"b{depth - 1}" if depth else "(SELECT * FROM whole)"
        cols = "".join(f"{c}, " for c in above)
        return f"""
n{depth} AS (SELECT n.*, {cases('n.' + name, weights.get(name, {}), 1)}::HUGEINT AS w, u.budget::HUGEINT AS budget
  FROM (SELECT {cols}{name}, sum(cap)::HUGEINT AS cap FROM leaf GROUP BY ALL) n JOIN {up} u ON {on}),
o{depth} AS (SELECT *, sum(cap) OVER q - cap AS spent, sum(w) OVER (PARTITION BY {part}) - sum(w) OVER q + w AS w_on
  FROM n{depth} WHERE w > 0 WINDOW q AS (PARTITION BY {part} ORDER BY cap::DOUBLE / w::DOUBLE, {name} ROWS UNBOUNDED PRECEDING)),
f{depth} AS (SELECT *, cap * w_on <= (budget - spent) * w AS used FROM o{depth}),
l{depth} AS (SELECT *, budget - sum(CASE WHEN used THEN cap ELSE 0 END) OVER (PARTITION BY {part}) AS rest,
  sum(CASE WHEN used THEN 0 ELSE w END) OVER (PARTITION BY {part}) AS w_open FROM f{depth}),
p{depth} AS (SELECT *, CASE WHEN used THEN cap ELSE ((rest::HUGEINT * w) // w_open) END AS part FROM l{depth}),
b{depth} AS (SELECT {cols}{name}, (part + CASE WHEN NOT used AND row_number() OVER (PARTITION BY {part}, used ORDER BY {name})
  <= rest - sum(CASE WHEN used THEN 0 ELSE part END) OVER (PARTITION BY {part}) THEN 1 ELSE 0 END)::BIGINT AS budget FROM p{depth})"""

    key = f"md5(concat_ws(':', '{seed}', (epochs + 1)::VARCHAR, coalesce(doc_id::VARCHAR, ''), h))"
    names = ", ".join(LEAF)
    return f"""
WITH d AS (SELECT doc_id, {cases("coalesce(source, '')", domains, 'other')} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
  len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::BIGINT AS tokens, md5(coalesce(text, '')) AS h FROM documents),
leaf AS (SELECT {names}, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {max_epochs} AS cap FROM d WHERE tokens > 0 GROUP BY ALL),
whole AS (SELECT least(sum(tokens) * {numerator} // {denominator}, sum(cap)) AS budget FROM leaf),
{",".join(level(k) for k in range(len(LEAF)))},
plan AS (SELECT l.{names.replace(", ", ", l.")}, (b.budget // l.tokens)::INTEGER AS epochs, b.budget % l.tokens AS partial
  FROM leaf l JOIN b{len(LEAF) - 1} b USING ({names})),
k AS (SELECT d.*, p.epochs, p.partial, {key} AS key FROM d JOIN plan p USING ({names}) WHERE d.tokens > 0),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {names} ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
  - sum(tokens) OVER (PARTITION BY {names}, key) AS before FROM k),
e AS (SELECT *, unnest(range(1, epochs + 1 + CASE WHEN before < partial THEN 1 ELSE 0 END)) AS epoch FROM s)
SELECT doc_id, {names}, epoch::INTEGER AS epoch, tokens,
  (CASE WHEN epoch > epochs THEN least(tokens, partial - before) ELSE tokens END)::BIGINT AS take_tokens FROM e"""
