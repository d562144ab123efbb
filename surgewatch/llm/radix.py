"""Final ranks of rows by a distributed LSD radix sort: stable counting-sort passes over key digits.

The rows lie in blocks. A pass looks at one digit of the key, from the least significant to the
most: it counts the rows of every (digit, block), turns the counts into global prefix offsets (all
smaller digits, then the same digit in earlier blocks), and a row's destination is its offset plus
its place among the block's rows of that digit. Destinations are dense, so the next pass cuts them
into blocks of equal size. After the last digit the destination is the rank.

A digit that every row shares makes no hot group: a window holds the rows of one digit in one
block, never more than a block. Each pass is written to the shared folder, so a lost executor
repeats a part of one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgewatch.llm.exchange import saved

DIGIT_BITS = 11
BLOCK_ROWS = 1 << 20
SIGN = -(1 << 63)


def digits_of(key: str, lo: int | None, hi: int | None, has_null: bool, bits: int) -> list[Column]:
    """Digits of a whole-number column between ``lo`` and ``hi``, the least significant first; null is above all."""
    out = []
    if lo is not None:
        near = hi - lo < 1 << 63
        # distances from the smallest value, or the value with its sign turned where distances overflow
        base = F.col(key) - F.lit(lo) if near else F.col(key).bitwiseXOR(F.lit(SIGN))
        for at in range(0, (hi - lo).bit_length() if near else 64, bits):
            out.append(F.coalesce(F.shiftrightunsigned(base, at).bitwiseAND(F.lit((1 << bits) - 1)), F.lit(0)).cast("int"))
    return [*out, F.col(key).isNull().cast("int")] if has_null else out


def counting_pass(held: DataFrame, digit: Column, block_rows: int) -> DataFrame:
    """One stable pass: ``radix_pos`` becomes the destination, ``radix_block`` the block of it."""
    rows = held.withColumn("radix_digit", digit)
    counts = saved(rows.groupBy("radix_digit", "radix_block").agg(F.count(F.lit(1)).alias("radix_n")), "radix-counts")
    # at most 2 ** DIGIT_BITS rows: one for each digit
    totals = counts.groupBy("radix_digit").agg(F.sum("radix_n").alias("radix_all"))
    smaller = totals.select("radix_digit", (F.sum("radix_all").over(Window.orderBy("radix_digit")) - F.col("radix_all")).alias("radix_before"))
    earlier = Window.partitionBy("radix_digit").orderBy("radix_block")
    offsets = (counts.withColumn("radix_earlier", F.sum("radix_n").over(earlier) - F.col("radix_n")).join(F.broadcast(smaller), "radix_digit")
               .select("radix_digit", "radix_block", (F.col("radix_before") + F.col("radix_earlier")).alias("radix_offset")))
    place = F.row_number().over(Window.partitionBy("radix_digit", "radix_block").orderBy("radix_pos"))
    moved = rows.withColumn("radix_place", place).join(offsets, ["radix_digit", "radix_block"])
    moved = moved.withColumn("radix_pos", F.col("radix_offset") + F.col("radix_place") - 1).withColumn("radix_block", F.expr(f"radix_pos div {block_rows}"))
    return saved(moved.select(*held.columns), "radix-pass")


def ranked(rows: DataFrame, keys: list[str], bits: int = DIGIT_BITS, block_rows: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ...) in ascending order of the bigint columns ``keys``, the first the most significant.

    A null key comes after all other values of its column. Rows that agree in all keys get
    neighbouring ranks, in an order fixed once the rows are written. No column of ``rows`` is
    named ``rank`` or begins with ``radix_``. By default there are at least four blocks for each
    shuffle partition, of at most ``BLOCK_ROWS`` rows.
    """
    spark, columns = rows.sparkSession, rows.columns
    # a row is told apart by its written part and its place there
    held = saved(rows.withColumn("radix_pos", F.monotonically_increasing_id()), "radix-rows")
    ends = held.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(k)).alias(f"{name}_{i}") for i, k in enumerate(keys) for name, f in (("lo", F.min), ("hi", F.max), ("some", F.count))]).first()
    block_rows = block_rows or min(BLOCK_ROWS, -(-ends.n // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))) or 1)
    held = held.withColumn("radix_block", F.shiftright("radix_pos", 33).cast("bigint"))
    passes = [d for i, k in reversed(list(enumerate(keys))) for d in digits_of(k, ends[f"lo_{i}"], ends[f"hi_{i}"], ends[f"some_{i}"] < ends.n, bits)]
    for digit in passes or [F.lit(0)]:
        held = counting_pass(held, digit, block_rows)
    return held.select(*columns, (F.col("radix_pos") + 1).alias("rank"))
