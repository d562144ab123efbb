"""Document fingerprints by consistent weighted sampling.

A text is a bag of words; a word's weight is the number of times it occurs. Sample ``k``
gives every word a step ``r`` and a rate ``c``, both Gamma(2, 1), and a shift ``b``, uniform,
that depend on the word and ``k`` alone. The weight is rounded down on a logarithmic grid,
``t = floor(ln w / r + b)``, ``ln y = r (t - b)``, and the word with the smallest
``a = c / (y exp r)`` is sampled together with its ``t``. Two texts take the same
sample with a probability of sum(min weight) / sum(max weight), the generalised Jaccard
similarity, so the share of equal samples estimates it.

DataFrame functions only. One shuffle: rows are dealt by ranges of their order (of 16 MB of text; at most
65,536 ranges, which then grow), and words, counts and samples of a row are found where the row lies. The grouping by word is an
aggregation inside the task, so a word that every text holds is as cheap as any other.

Defined cases: a null text is an empty text; a text without a word has the empty
fingerprint, which is like another empty one (1) and like nothing else (0); a null id comes
after all others; rows that share an id are ordered by the MD5 of their text, so equal rows
are neighbours; a single row is its own next row; other columns, whatever their names, are
left out; an empty table gives an empty result. Equal rows (same id and same text) are
interchangeable and lie in one range.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgewatch.llm.exchange import text_bytes

TOKEN = r"[^\x20\x09-\x0D]+"
SAMPLES = 32
RANGE_BYTES, MAX_RANGES = 16 << 20, 1 << 16
#: The prime of the hash functions, and the multipliers and increments of a sample's four uniform numbers.
PRIME = 2147483647
SPREAD = [(48271, 11), (69621, 1299709), (16807, 15485863), (1583458089, 49979687)]


def multipliers(samples: int) -> list[tuple[int, int]]:
    """One multiplier and one increment a sample: powers of two fixed numbers modulo the prime."""
    return [(pow(742938285, k + 1, PRIME), pow(950706376, k + 1, PRIME)) for k in range(samples)]


def spread_sql(k: tuple[int | str, int | str], xor: str, shift: str) -> str:
    """Hash of ``term`` (32 bits) for one sample; ``xor`` and ``shift`` are patterns of the two bit operations."""
    z = f"((term * {k[0]} + {k[1]}) % {PRIME})"
    return xor.format(z, shift.format(z))


def sample_sql(z: str) -> str:
    """Sample of ``term`` with the hash ``z`` and the weight ``w``: ``a`` in the upper 39 bits, the word and its ``t`` in the lower 24.

    With exponential ``e1 = -ln v1`` and ``e2 = -ln v2``, the step ``r = e1 + e2`` is Gamma(2, 1) and the
    shift ``b = e2 / r`` is uniform and independent of it. Then ``t`` is 0 where ``w v1 < 1``, as for
    every weight of 1, and ``a = c / (y exp r) = c v1 (v1 v2) ** t`` needs one logarithm there.
    """
    v1, v2, v3, v4 = [f"((({z} * {m} + {add}) % {PRIME} + 0.5D) / {PRIME}.0D)" for m, add in SPREAD]
    t = f"floor((ln(w) + ln({v1})) / -ln({v1} * {v2})) + 1"
    a = f"-ln({v3} * {v4}) * {v1} * CASE WHEN w * {v1} < 1.0D THEN 1.0D ELSE power({v1} * {v2}, {t}) END"
    low = f"(term + CASE WHEN w * {v1} < 1.0D THEN 0 ELSE cast({t} as bigint) % 65536 * 2654435761 END) % 16777216"
    return f"cast(floor({a} * 8589934592.0D) as bigint) * 16777216 + {low}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def signatures(rows: DataFrame, keys: list[str], texts: list[str], digests: list[str] | None = None, numbers: list[str] | None = None,
               samples: int = SAMPLES) -> DataFrame:
    """``keys``, ``sig_<text>`` (array of samples; null without a word) of each text column, ``digests`` and ``numbers``.

    ``keys`` (numbers) tell rows apart; if the rows are already dealt by some of them, nothing is
    shuffled. ``digests`` are columns of 64 hex digits that come along, as eight numbers beside the
    words, and ``numbers`` bigint columns: keys are held for every sample, so they are few. A word that has the same weight in several texts of a row is sampled once for all of them.
    """
    digests, numbers, n = digests or [], numbers or [], len(texts)

    def tagged(tag: int, term: Column) -> Column:
        return F.struct(F.lit(tag).alias("tag"), term.alias("term"))

    # tags: a word's text, the places of the digests' pieces after those, and one marker that keeps rows without a word
    def of_words(i: int) -> Column:
        return F.transform(words(F.col(texts[i])), lambda t: tagged(i, F.crc32(t.cast("binary"))))

    pieces = [tagged(n + 8 * j + i, F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("bigint")) for j, c in enumerate(digests) for i in range(8)]
    pieces += [tagged(n + 8 * len(digests) + j, F.col(c).cast("bigint")) for j, c in enumerate(numbers)]
    marker = tagged(-1, F.lit(0).cast("bigint"))
    terms = rows.select(*keys, F.explode(F.concat(*[of_words(i) for i in range(n)], F.array(*pieces, marker))).alias("e")).select(*keys, "e.*")
    is_word = F.col("tag").between(0, n - 1)
    counts = (terms.groupBy(*keys, F.when(is_word, 0).otherwise(F.col("tag")).alias("tag"), "term")
              .agg(*[F.sum(F.when(F.col("tag") == i, 1).otherwise(0)).alias(f"w{i}") for i in range(n)]))

    # a row for each text with its weight of the word, unless a text before it has the same weight
    def each(i: int) -> Column:
        same = [F.lit(True) if j == i else F.col(f"w{j}") == F.col(f"w{i}") for j in range(n)]
        mask = reduce(lambda x, y: x + y, [F.when(same[j], 1 << j).otherwise(0) for j in range(n)])
        return F.struct(F.lit(i).alias("i"), F.col(f"w{i}").alias("w"), mask.alias("mask"), reduce(lambda x, y: x | y, same[:i], F.lit(False)).alias("seen"))

    held = counts.select(*keys, "tag", "term", F.explode(F.array(*[each(i) for i in range(n)])).alias("s"))
    a_word = F.col("tag").between(0, n - 1)
    held = held.filter((a_word & (F.col("s.w") > 0) & ~F.col("s.seen")) | (~a_word & (F.col("s.i") == 0)))

    def place(k: int, by: int, add: int) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(by).cast("bigint").alias("by"), F.lit(add).cast("bigint").alias("add"))

    # one row for each sample of a word; the other rows stand at places beyond the samples
    each_sample = F.array(*[place(k, by, add) for k, (by, add) in enumerate(multipliers(samples))])
    other = F.array(F.struct((F.col("tag") + samples).alias("k"), F.lit(0).cast("bigint").alias("by"), F.lit(0).cast("bigint").alias("add")))
    # words of weight 1 stand in for what is no word, so that a sample needs no condition around it
    held = (held.select(*keys, F.when(a_word, F.col("s.mask")).otherwise(0).alias("mask"), F.when(~a_word, F.col("term")).alias("piece"),
                        F.when(a_word, F.col("term")).otherwise(0).alias("term"), F.when(a_word, F.col("s.w").cast("double")).otherwise(1.0).alias("w"),
                        F.explode(F.when(a_word, each_sample).otherwise(other)).alias("k"))
            .select("*", F.expr(spread_sql(("k.by", "k.add"), "({} ^ {})", "shiftright({}, 16)")).alias("z")))
    per = held.select(*keys, "mask", "piece", F.col("k.k").alias("k"), F.expr(sample_sql("z")).alias("value")).groupBy(*keys, "k").agg(
        *[F.min(F.when((F.col("mask").bitwiseAND(1 << i)) > 0, F.col("value"))).alias(f"a{i}") for i in range(n)], F.max("piece").alias("piece"))

    def listed(value: str, first: int, end: int) -> Column:
        held_in = F.when(F.col("k").between(first, end - 1) & F.col(value).isNotNull(), F.struct("k", F.col(value).alias("value")))
        return F.sort_array(F.collect_list(held_in))["value"]

    out = per.groupBy(*keys).agg(*[listed(f"a{i}", 0, samples).alias(f"sig_{c}") for i, c in enumerate(texts)],
                                 *[listed("piece", samples + n + 8 * j, samples + n + 8 * j + 8).alias(c) for j, c in enumerate(digests)],
                                 *[F.max(F.when(F.col("k") == samples + n + 8 * len(digests) + j, F.col("piece"))).alias(c) for j, c in enumerate(numbers)])
    return out.select(*keys, *[F.when(F.size(f"sig_{c}") > 0, F.col(f"sig_{c}")).alias(f"sig_{c}") for c in texts], *[hex_digits(F.col(c), 8).alias(c) for c in digests], *numbers)


def hex_digits(values: Column, digits: int) -> Column:
    """The lower bits of each value as hex digits, one after the other; ``''`` for null."""
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit((1 << 4 * digits) - 1)))), digits, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two signatures: an estimate of the generalised Jaccard similarity."""
    low = F.lit(16777215)
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.bitwiseAND(low) == y.bitwiseAND(low), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal / F.size(a))


def in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``range, no, halo, id, n_chars, text, next_text`` in descending order of the ids: dealt by ``range``, ordered by ``no`` within it.

    A range begins at one of the table's rows. That row lies in the range before it too, as its last
    row (``halo``), and the first row of all in the last range, so each row's next row is beside it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("bigint")
    rows = docs.select(ident.alias("id"), text.alias("text")).withColumn("key", F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("down"), F.md5("text").alias("md5")))
    ranges = min(MAX_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(rows) // RANGE_BYTES)))
    # the smallest key of each range: at most MAX_RANGES rows
    starts = rows.select("key.*").repartitionByRange(ranges, "none", "down", "md5").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("none", "down", "md5")).alias("key"))
    bounds = sorted((tuple(r.key) for r in starts.collect()), key=lambda k: (k[0], k[1] or 0, k[2]))
    if not bounds:
        bounds = [(False, 0, "")]
    literal = F.from_json(F.lit(json.dumps([{"none": a, "down": b, "md5": c} for a, b, c in bounds])), "array<struct<none: boolean, down: bigint, md5: string>>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    # binary search for the last bound that is not after the key
    at = F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step < len(bounds)) & (F.try_element_at(F.col("bounds"), lo + step + 1) <= F.col("key")), lo + step).otherwise(lo))
    rows = rows.withColumn("bounds", literal).withColumn("at", at)
    before = F.when(F.col("at") == 0, len(bounds) - 1).otherwise(F.col("at") - 1)
    places = F.when(F.element_at("bounds", F.col("at") + 1) == F.col("key"),
                    F.array(F.struct(F.col("at").alias("range"), F.lit(0).alias("halo")), F.struct(before.alias("range"), F.lit(1).alias("halo"))))
    rows = rows.withColumn("place", F.explode(F.coalesce(places, F.array(F.struct(F.col("at").alias("range"), F.lit(0).alias("halo"))))))
    order = Window.partitionBy("range").orderBy("halo", "key")
    return (rows.select("place.*", "id", "text", "key").withColumn("no", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
            .select("range", "no", "halo", "id", F.char_length("text").cast("bigint").alias("n_chars"), "text", "next_text"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that of the next text.

    The edited text has its last third (rounded down) replaced by as many of the first characters of
    the next text, or all of them; the next text is that of the next smaller id.
    """
    third = F.expr("cast(n_chars div 3 as int)")
    rows = in_ranges(docs, id_col, text_col)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    sigs = signatures(rows, ["range", "no"], ["text", "edited"], ["edited_sha256"], ["halo", "id", "n_chars"], samples)
    nexts = Window.partitionBy("range").orderBy("no")
    sigs = sigs.withColumn("sig_next", F.lead("sig_text").over(nexts)).filter("halo = 0")
    return sigs.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", hex_digits(F.col("sig_text"), 6).alias("fingerprint"),
                       hex_digits(F.col("sig_edited"), 6).alias("edited_fingerprint"), likeness(F.col("sig_text"), F.col("sig_edited")).alias("near_edited"),
                       likeness(F.col("sig_text"), F.col("sig_next")).alias("near_next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``doc_id, fingerprint`` of every text: one row a document, dealt by a number of its row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sigs = signatures(rows, ["row"], ["text"], numbers=["id"], samples=samples)
    return sigs.select(F.col("id").alias("doc_id"), hex_digits(F.col("sig_text"), 6).alias("fingerprint"))


def oracle_sql(samples: int = SAMPLES) -> str:
    """``digests`` as DuckDB SQL over ``documents``, with one ordered window over all rows."""
    table = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(multipliers(samples)))
    spread, sample = spread_sql(("a_k", "b_k"), "xor({}, {})", "({} >> 16)"), sample_sql("z").replace("0.5D", "0.5").replace(".0D", ".0::DOUBLE")
    return f"""
WITH RECURSIVE ks(k, a_k, b_k) AS (VALUES {table}),
d AS (SELECT doc_id AS id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, row_number() OVER q AS no,
  lead(coalesce(text, '')) OVER q AS after, first_value(coalesce(text, '')) OVER q AS top
  FROM documents WINDOW q AS (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substring(text, 1, n - n // 3) || substring(coalesce(after, top), 1, n // 3) AS edited FROM d),
pair AS (SELECT no, 0 AS which, text AS t FROM e UNION ALL SELECT no, 1, edited FROM e),
w AS (SELECT no, which, unnest(regexp_extract_all(t, '{TOKEN}')) AS word FROM pair),
c AS (SELECT no, which, word, count(*)::BIGINT AS n FROM w GROUP BY ALL),
bytes(b, s, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, i + 1 FROM bytes WHERE i < 8),
tab AS (SELECT b, s FROM bytes WHERE i = 8),
v AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM c),
crc(word, h, i, s) AS (SELECT word, h, 0, 4294967295::BIGINT FROM v UNION ALL
  SELECT word, h, crc.i + 1, xor(crc.s >> 8, tab.s) FROM crc JOIN tab ON tab.b = xor(crc.s & 255, ('0x' || substring(h, crc.i * 2 + 1, 2))::BIGINT) WHERE crc.i < length(h) // 2),
terms AS (SELECT word, xor(s, 4294967295) AS term FROM crc WHERE i = length(h) // 2),
weighted AS (SELECT no, which, term, sum(n) AS n FROM c JOIN terms USING (word) GROUP BY ALL),
sampled AS (SELECT no, which, k, min({sample}) & 16777215 AS s
  FROM (SELECT no, which, term, n::DOUBLE AS w, k, {spread} AS z FROM weighted CROSS JOIN ks) x GROUP BY ALL),
sig AS (SELECT no, which, string_agg(printf('%06x', s), '' ORDER BY k) AS f, list(s ORDER BY k) AS l FROM sampled GROUP BY ALL),
f AS (SELECT e.*, coalesce(a.f, '') AS fp, coalesce(b.f, '') AS efp, a.l AS l, b.l AS el FROM e LEFT JOIN sig a ON a.no = e.no AND a.which = 0 LEFT JOIN sig b ON b.no = e.no AND b.which = 1),
g AS (SELECT *, CASE WHEN no = count(*) OVER () THEN first_value(l) OVER q ELSE lead(l) OVER q END AS nl
  FROM f WINDOW q AS (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT id AS doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint,
  CASE WHEN l IS NULL AND el IS NULL THEN 1.0 WHEN l IS NULL OR el IS NULL THEN 0.0
    ELSE len(list_filter(list_zip(l, el), lambda p: p[1] = p[2]))::DOUBLE / {samples} END::DOUBLE AS near_edited,
  CASE WHEN l IS NULL AND nl IS NULL THEN 1.0 WHEN l IS NULL OR nl IS NULL THEN 0.0
    ELSE len(list_filter(list_zip(l, nl), lambda p: p[1] = p[2]))::DOUBLE / {samples} END::DOUBLE AS near_next
FROM g"""
