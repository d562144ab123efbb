"""Readers: file globs, any Spark data source, JDBC, document stores.

Options are passed per read, never put into the session configuration, so
two loads with different queries cannot interfere.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Fail at once, and by name, when expected top-level or dotted columns are missing."""
    missing = []
    for name in columns:
        head, *rest = name.split(".")
        if head not in df.columns:
            missing.append(name)
            continue
        dtype = df.schema[head].dataType
        for part in rest:
            if not isinstance(dtype, T.StructType) or part not in dtype.fieldNames():
                missing.append(name)
                break
            dtype = dtype[part].dataType
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; has {df.columns}")
    return df


def read_files(spark: SparkSession, paths: str | Sequence[str], format: str = "parquet",
               schema: T.StructType | str | None = None, options: Mapping[str, str] | None = None,
               columns: Iterable[str] | None = None) -> DataFrame:
    """Read one path, a glob (``sales-*``) or a list of paths as one table."""
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if options:
        reader = reader.options(**options)
    df = reader.load(paths if isinstance(paths, str) else list(paths))
    if columns is not None:
        require_columns(df, columns)
    return df


def document_store_options(resource: str, options: Mapping[str, str] | None = None, query: str | None = None,
                           query_option: str = "es.query", resource_option: str = "es.resource") -> dict[str, str]:
    """The options of one document-store read: the caller's, plus resource and raw query.

    A new dict per read: nothing goes into the session configuration, so two
    reads with different queries cannot see each other's settings.
    """
    opts = dict(options or {})
    opts[resource_option] = resource
    if query is not None:
        opts[query_option] = query
    return opts


def read_document_store(spark: SparkSession, resource: str, format: str,
                        options: Mapping[str, str] | None = None, query: str | None = None,
                        query_option: str = "es.query", resource_option: str = "es.resource",
                        columns: Iterable[str] | None = None) -> DataFrame:
    """Scan a document index (or a wildcard set of indices) through a Spark connector.

    ``format`` names the connector's data source; its jar must be on the
    classpath (none is shipped here, so only the option handling is tested).
    A raw store query can be passed through per read with ``query``; prefer a
    DataFrame ``filter``, which the connector receives as a pushed filter.
    """
    opts = document_store_options(resource, options, query, query_option, resource_option)
    df = spark.read.format(format).options(**opts).load()
    if columns is not None:
        require_columns(df, columns)
    return df


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 driver: str | None = None, partition_column: str | None = None,
                 lower_bound=None, upper_bound=None, num_partitions: int | None = None,
                 fetch_size: int | None = None, batch_size: int | None = None,
                 extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options for Spark's ``jdbc`` source.

    Without ``partition_column`` the table is read by one task, as a plain
    JDBC read is; with it, ``num_partitions`` range queries run in parallel.
    """
    opts = {"url": url, "dbtable": table}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver is not None:
        opts["driver"] = driver
    parts = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(p is not None for p in parts):
        if any(p is None for p in parts):
            raise ValueError("partition_column, lower_bound, upper_bound and num_partitions go together")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    if fetch_size is not None:
        opts["fetchsize"] = str(fetch_size)
    if batch_size is not None:
        opts["batchsize"] = str(batch_size)
    opts.update(extra or {})
    return opts


def read_jdbc(spark: SparkSession, url: str, table: str, columns: Iterable[str] | None = None,
              **kwargs) -> DataFrame:
    """A relational table through JDBC; filters and projections are pushed to the database."""
    df = spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()
    if columns is not None:
        require_columns(df, columns)
    return df


# ---- balanced key ranges ---------------------------------------------------------------------

def key_histogram(df: DataFrame, key: str, bins: int = 4096) -> list[tuple[int, int, int]]:
    """``(low, high, rows)`` of at most ``bins`` equal steps over a whole-number key that hold rows, in order.

    ``low`` and ``high`` are the smallest and largest key found in the step, so a step of one hot key is told apart.
    """
    ends = df.agg(F.min(key).cast("bigint"), F.max(key).cast("bigint")).first()
    if ends[0] is None:
        return []
    step = (ends[1] - ends[0]) // bins + 1
    place = F.floor((F.col(key).cast("decimal(20,0)") - F.lit(ends[0])) / F.lit(step))
    rows = (df.filter(F.col(key).isNotNull()).groupBy(place.alias("place"))
            .agg(F.min(key).cast("bigint").alias("low"), F.max(key).cast("bigint").alias("high"), F.count(F.lit(1)).alias("n")).collect())
    return sorted((r.low, r.high, r.n) for r in rows)


def equi_depth_bounds(histogram: Iterable[tuple[int, int, int]], parts: int) -> list[int]:
    """Ascending keys at which a new range begins, so that each range holds about as many rows.

    A range is closed when it has reached its share of the rows that were left when it began; a step
    heavier than a share gets ranges of its own. At most ``parts - 1`` bounds.
    """
    if parts < 1:
        raise ValueError("parts must be positive")
    steps = sorted(histogram)
    left, open_parts, held, bounds = sum(n for _, _, n in steps), parts, 0, []
    for k, (low, _, n) in enumerate(steps):
        share = left / open_parts
        # begin before a step that would overshoot by more than what is missing
        if k and open_parts > 1 and held and held + n - share > share - held:
            bounds.append(low)
            left, open_parts, held = left - held, open_parts - 1, 0
        held += n
    return bounds


def range_predicates(key: str, bounds: Sequence[int]) -> list[str]:
    """SQL conditions that cover every row exactly once: the ranges between ``bounds``, null keys in the first."""
    bounds = list(bounds)
    if bounds != sorted(set(bounds)):
        raise ValueError(f"bounds must ascend: {bounds}")
    if not bounds:
        return ["1 = 1"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [f"({key} < {bounds[0]} OR {key} IS NULL)", *inner, f"{key} >= {bounds[-1]}"]


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, key: str, histogram: Iterable[tuple[int, int, int]], parts: int,
                     columns: Iterable[str] | None = None, **kwargs) -> DataFrame:
    """A JDBC table read by ``parts`` queries of about equal depth instead of equal steps.

    ``histogram`` counts the key's rows, e.g. from :func:`key_histogram` over a copy, or from the
    database's own statistics.
    """
    options = jdbc_options(url, table, **kwargs)
    properties = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    df = spark.read.jdbc(url, table, predicates=range_predicates(key, equi_depth_bounds(histogram, parts)), properties=properties)
    return require_columns(df, columns) if columns is not None else df
