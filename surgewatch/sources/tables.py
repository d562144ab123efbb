"""Table-set jobs: schema rows, profile, copy, export and restore.

Export writes ``<dest>/mapping/<table>`` (the schema as JSON text) and
``<dest>/data/<table>`` (the rows as JSON lines, packed); restore reads the schemas
first and then the data with them, so no type is inferred. Timestamps are
written with microseconds: the JSON default would drop them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The timestamp text formats used by export and restore.
TIMESTAMP_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
JSON_OPTIONS = {"timestampNTZFormat": TIMESTAMP_NTZ_FORMAT, "timestampFormat": TIMESTAMP_FORMAT}
# As text the rows are many times their size in Parquet, since each repeats its fields' names: files are packed.
EXPORT_COMPRESSION = "gzip"
EXPORT_FILE_ROWS = 500_000   # one task reads a packed file: a task that writes more rows goes on in another file


def schema_rows(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The schema as rows (position, name, type, nullable), like ``printSchema`` as data."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def table_profile(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name, row count, column count (one Spark job over all tables)."""
    parts = [df.groupBy().agg(F.count(F.lit(1)).alias("row_count"))
               .select(F.lit(name).alias("table_name"), "row_count",
                       F.lit(len(df.columns)).cast("bigint").alias("column_count"))
             for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_sizes(spark: SparkSession, paths: Mapping[str, str], pattern: str = "*.{parquet,json,csv,orc,avro,txt}*") -> DataFrame:
    """One row per table: name, number of data files, their bytes. Lists the files; reads none of them.

    ``paths`` are files or folders, in any store that Spark reads; in a folder the files whose names
    match ``pattern`` count, at any depth. A table without files has 0 and 0.
    """
    parts = []
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        parts.append(files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
                     .select(F.lit(name).alias("table_name"), "file_count", "size_bytes"))
    return reduce(DataFrame.unionByName, parts)


def _number_text(x: Column) -> Column:
    """A number with a fraction as whole millionths and the nine digits after them."""
    y = x.cast("double") * F.lit(1e6)
    return F.concat(F.floor(y).cast("bigint").cast("string"), F.lit("."), F.floor((y - F.floor(y)) * F.lit(1e9)).cast("bigint").cast("string"))


def _value_text(field: T.StructField) -> Column:
    """A column's value as text that any engine can state; arrays element by element, in order."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.FractionalType):
        text = _number_text(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        text = F.concat(F.size(c).cast("string"), F.lit(":"), F.array_join(F.transform(c, lambda x: F.coalesce(_number_text(x), F.lit("~"))), ","))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("~"))


def table_sums(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name, row count, and a sum over its rows' contents that no order changes."""
    parts = []
    for name, df in frames.items():
        row = F.md5(F.concat_ws("|", *[_value_text(f) for f in df.schema]))
        number = F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")
        parts.append(df.select(number.alias("n")).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("content_sum"))
                     .select(F.lit(name).alias("table_name"), "row_count", "content_sum"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _run_all(jobs: Iterable[Callable[[], None]], parallelism: int) -> None:
    jobs = list(jobs)
    if parallelism <= 1 or len(jobs) <= 1:
        for job in jobs:
            job()
        return
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        for fut in [pool.submit(job) for job in jobs]:
            fut.result()


def copy_tables(read: Callable[[str], DataFrame], write: Callable[[str, DataFrame], None],
                names: Iterable[str], parallelism: int = 4) -> list[str]:
    """Copy every named table from one store to another.

    ``read(name)`` and ``write(name, df)`` wrap the two stores (JDBC writers
    take ``batchsize``; connectors their own bulk option). Tables are copied
    concurrently, each as one distributed job.
    """
    names = list(names)
    _run_all([lambda n=n: write(n, read(n)) for n in names], parallelism)
    return names


def copy_resumable(spark: SparkSession, read: Callable[[str], DataFrame], dest: str, names: Iterable[str], parts: int | Mapping[str, int] = 16,
                   parallelism: int = 4, run: str = "") -> dict[str, int]:
    """Copy tables to Parquet folders ``<dest>/<name>/part=<k>`` in parts, and go on where a copy broke off.

    A row belongs to the part that a hash of its content names, so a rerun finds the same parts whatever
    the layout. A part is written as a whole, then an entry of the manifest (``<dest>/_manifest``) says
    that it is complete: name, part, rows and content sum. A rerun reads the manifest first and writes
    only the parts that are missing from it; what a broken part left is overwritten. ``run`` names the
    state of the source, so a new state is copied anew. Returns the parts written for each table.

    :func:`read_copied` reads the tables back; :func:`verify_copied` compares them with the manifest.
    """
    names = list(names)
    done = {(r.table_name, r.part) for r in manifest(spark, dest).filter(F.col("run") == run).collect()}
    written = dict.fromkeys(names, 0)
    jobs = []
    for name in names:
        df, n = read(name), parts[name] if isinstance(parts, Mapping) else parts
        number = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(n))
        for k in (k for k in range(n) if (name, k) not in done):
            def one(name=name, k=k, rows=df.filter(number == k)) -> None:
                target = f"{dest}/{name}/part={k}"
                rows.write.mode("overwrite").parquet(target)
                entry = table_sums({name: spark.read.schema(rows.schema).parquet(target)})
                entry.select("table_name", F.lit(k).alias("part"), "row_count", "content_sum", F.lit(run).alias("run")).coalesce(1).write.mode("append").parquet(f"{dest}/_manifest")
                written[name] += 1

            jobs.append(one)
    _run_all(jobs, parallelism)
    return written


MANIFEST = "table_name string, part int, row_count bigint, content_sum bigint, run string"


def manifest(spark: SparkSession, dest: str) -> DataFrame:
    """The complete parts of a resumable copy; empty before the first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{dest}/_manifest")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{dest}/_manifest")


def read_copied(spark: SparkSession, dest: str, name: str, run: str = "") -> DataFrame:
    """A copied table: its complete parts of this run."""
    done = sorted(r.part for r in manifest(spark, dest).filter((F.col("table_name") == name) & (F.col("run") == run)).select("part").distinct().collect())
    if not done:
        raise ValueError(f"no complete part of {name!r} in {dest}")
    return spark.read.parquet(*[f"{dest}/{name}/part={k}" for k in done])


def verify_copied(spark: SparkSession, dest: str, names: Iterable[str], run: str = "") -> DataFrame:
    """One row for each table: rows and content sum by the manifest and as read back."""
    names = list(names)
    told = manifest(spark, dest).filter(F.col("run") == run).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("row_count").alias("row_count"), F.sum("content_sum").alias("content_sum"))
    held = table_sums({n: read_copied(spark, dest, n, run) for n in names})
    return told.join(held.toDF("table_name", "rows_read", "sum_read"), "table_name")


def export_tables(spark: SparkSession, frames: Mapping[str, DataFrame], dest: str,
                  columns: Mapping[str, list[str]] | list[str] | None = None,
                  parallelism: int = 4, compression: str = EXPORT_COMPRESSION) -> list[str]:
    """Write each table's schema to ``mapping/<t>`` and rows to ``data/<t>`` as JSON.

    ``columns`` exports chosen (possibly nested, dotted) fields only, the same
    for every table (a list) or per table (a mapping). ``compression`` is Spark's name of the
    data files' codec (``none`` for plain text); their ending tells readers which it is.
    """
    options = JSON_OPTIONS | {"compression": compression, "maxRecordsPerFile": EXPORT_FILE_ROWS}

    def one(name: str, df: DataFrame) -> None:
        cols = columns.get(name) if isinstance(columns, Mapping) else columns
        if cols:
            df = df.select(*[F.col(c).alias(c.replace(".", "_")) for c in cols])
        (spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1)
         .write.mode("overwrite").text(f"{dest}/mapping/{name}"))
        df.write.mode("overwrite").options(**options).json(f"{dest}/data/{name}")

    _run_all([lambda n=n, d=d: one(n, d) for n, d in frames.items()], parallelism)
    return list(frames)


def read_schemas(spark: SparkSession, src: str) -> dict[str, T.StructType]:
    """Schemas of an export folder (one small text row per table)."""
    rows = (spark.read.text(f"{src}/mapping/*")
            .select(F.regexp_extract(F.input_file_name(), r"/mapping/([^/]+)/[^/]*$", 1).alias("name"), "value")
            .collect())
    return {r["name"]: T.StructType.fromJson(json.loads(r["value"])) for r in rows}


def restore_tables(spark: SparkSession, src: str,
                   write: Callable[[str, DataFrame], None] | None = None,
                   parallelism: int = 4) -> dict[str, DataFrame]:
    """Read an export folder back: schemas first, then data with those schemas.

    With ``write`` each restored table is also written to the destination store.
    """
    frames = {name: spark.read.schema(schema).options(**JSON_OPTIONS).json(f"{src}/data/{name}")
              for name, schema in read_schemas(spark, src).items()}
    if write is not None:
        _run_all([lambda n=n, d=d: write(n, d) for n, d in frames.items()], parallelism)
    return frames
