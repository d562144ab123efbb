"""A data source over folders of documents: ``mapping/<table>`` and ``data/<table>``, as exports write them.

:func:`read_document_folder` (format ``document-folder``, options ``path`` and ``resource``) reads
every table that a wildcard such as ``sales-*`` matches as one frame, as a store reads a set of indices. Comparisons
with literals are taken from the query (``spark.sql.python.filterPushdown.enabled``, Spark 4.1; the
session's owner sets it): they are applied while a file is read, and a file whose smallest and
largest values (``stats/<table>``, written by :func:`write_stats`) rule them out is not opened. One
task reads one file. Without the setting, or without statistics, the same rows come back.

Files are opened by the workers themselves, through Arrow's file systems (local and mounted
folders, HDFS, S3, GCS); a store that only Spark's own readers know is read with
``tables.restore_tables``.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan,
                                    LessThanOrEqual)
from pyspark.sql.pandas.types import to_arrow_schema

from surgewatch.sources.tables import JSON_OPTIONS

FORMAT, PUSH_SETTING = "document-folder", "spark.sql.python.filterPushdown.enabled"
COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


class File(InputPartition):
    """One data file. Also what the statistics say of it: field to (smallest, largest, has nulls)."""

    def __init__(self, path: str, stats: dict[str, tuple] | None = None):
        super().__init__(path)
        self.path, self.stats = path, stats


def _folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _files(fs: pa.fs.FileSystem, folder: str) -> list[str]:
    found = fs.get_file_info(pa.fs.FileSelector(folder, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def _lines(fs: pa.fs.FileSystem, folder: str) -> list[str]:
    out = []
    for path in _files(fs, folder):
        with fs.open_input_stream(path) as f:
            out += f.read().decode().splitlines()
    return out


def tables_of(root: str, resource: str) -> list[str]:
    """The tables whose names match the wildcard, in order; raises if there is none."""
    fs, base = _folder(root)
    names = {f.base_name for f in fs.get_file_info(pa.fs.FileSelector(f"{base}/mapping")) if not f.base_name.startswith((".", "_"))}
    found = sorted(n for n in names if fnmatch.fnmatchcase(n, resource))
    if not found:
        raise ValueError(f"no table {resource!r} in {root}")
    return found


def schema_of(root: str, resource: str) -> T.StructType:
    """The tables' common schema; raises where they differ."""
    fs, base = _folder(root)
    schemas = {t: T.StructType.fromJson(json.loads("".join(_lines(fs, f"{base}/mapping/{t}")))) for t in tables_of(root, resource)}
    first = next(iter(schemas.values()))
    if other := [t for t, s in schemas.items() if s != first]:
        raise ValueError(f"tables {other} have another schema than {next(iter(schemas))}")
    return first


def _order(value: object, dtype: T.DataType) -> object:
    """A literal or a statistic in the form that the column's values compare in."""
    if value is None or not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value
    return pa.scalar(value).cast(to_arrow_schema(T.StructType([T.StructField("v", dtype)])).field(0).type).as_py()


def _type_at(schema: T.StructType, path: Sequence[str]) -> T.DataType | None:
    dtype: T.DataType = schema
    for part in path:
        if not isinstance(dtype, T.StructType) or part not in dtype.fieldNames():
            return None
        dtype = dtype[part].dataType
    return dtype


def possible(stats: dict[str, tuple] | None, test: Filter, schema: T.StructType) -> bool:
    """Whether a file with these statistics can hold a row that passes the filter."""
    field = ".".join(test.attribute)
    if not stats or field not in stats:
        return True
    dtype = _type_at(schema, test.attribute)
    low, high = (_order(v, dtype) for v in stats[field][:2])
    if low is None:   # nulls only
        return False
    if isinstance(test, IsNotNull):
        return True
    value = _order(test.value, dtype)
    return {EqualTo: lambda: low <= value <= high, GreaterThan: lambda: high > value, GreaterThanOrEqual: lambda: high >= value,
            LessThan: lambda: low < value, LessThanOrEqual: lambda: low <= value}[type(test)]()


class Reader(DataSourceReader):
    def __init__(self, root: str, resource: str, schema: T.StructType):
        self.root, self.resource, self.schema, self.filters = root, resource, schema, []

    def files(self) -> list[File]:
        """All data files, with their statistics where there are any."""
        fs, base = _folder(self.root)
        out = []
        for table in tables_of(self.root, self.resource):
            stats = {row["file"]: {k: (v.get("low"), v.get("high")) for k, v in row["fields"].items()} for row in map(json.loads, _lines(fs, f"{base}/stats/{table}"))}
            out += [File(p, stats.get(p.rsplit("/", 1)[-1])) for p in _files(fs, f"{base}/data/{table}")]
        return out

    def partitions(self) -> Sequence[InputPartition]:
        kept = [f for f in self.files() if all(possible(f.stats, test, self.schema) for test in self.filters)]
        return kept or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _folder(self.root)
        schema = to_arrow_schema(self.schema)
        # times are read as text: their offsets and fractions are parsed by the cast below
        plain = pa.schema([f if not pa.types.is_temporal(f.type) else pa.field(f.name, pa.string()) for f in schema])
        with fs.open_input_stream(partition.path) as f:   # unpacked as the file's ending says
            if not f.read(1):
                return
        with fs.open_input_stream(partition.path) as f:
            reader = pa.json.open_json(f, parse_options=pa.json.ParseOptions(explicit_schema=plain, unexpected_field_behavior="ignore"))
            for batch in reader:
                batch = pa.RecordBatch.from_arrays([batch[f.name].cast(f.type) for f in schema], schema=schema)
                for test in self.filters:
                    column = batch
                    for part in test.attribute:
                        column = column[part] if isinstance(column, pa.RecordBatch) else pc.struct_field(column, part)
                    if isinstance(test, IsNotNull):
                        keep = column.is_valid()
                    else:
                        keep = pc.fill_null(COMPARE[type(test)](column, pa.scalar(_order(test.value, _type_at(self.schema, test.attribute)), column.type)), False)
                    batch = batch.filter(keep)
                if batch.num_rows:
                    yield batch


class PushingReader(Reader):
    """The reader where the session lets filters be pushed (Spark refuses it elsewhere)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            dtype = _type_at(self.schema, getattr(test, "attribute", ()))
            if dtype is not None and (isinstance(test, IsNotNull) or type(test) in COMPARE and not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))):
                self.filters.append(test)
            else:
                yield test


class DocumentFolder(DataSource):
    """Options ``path`` (the root folder), ``resource`` (a table name or wildcard, by default all tables) and
    ``push`` (``true`` where the session pushes filters to Python sources)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _where(self) -> tuple[str, str]:
        if not self.options.get("path"):
            raise ValueError("the option path names the root folder")
        return self.options["path"].rstrip("/"), self.options.get("resource", "*")

    def schema(self) -> T.StructType:
        return schema_of(*self._where())

    def reader(self, schema: T.StructType) -> Reader:
        return (PushingReader if self.options.get("push") == "true" else Reader)(*self._where(), schema)


def read_document_folder(spark: SparkSession, root: str, resource: str = "*") -> DataFrame:
    """The tables of an export folder that ``resource`` matches, as one frame."""
    spark.dataSource.register(DocumentFolder)
    push = spark.conf.get(PUSH_SETTING, "false").lower()
    return spark.read.format(FORMAT).option("path", root).option("resource", resource).option("push", push).load()


def write_stats(spark: SparkSession, root: str, schemas: dict[str, T.StructType], fields: Sequence[str]) -> None:
    """Write ``stats/<table>``: for each data file the smallest and largest value of the given (dotted) fields."""
    for name, schema in schemas.items():
        df = spark.read.schema(schema).options(**JSON_OPTIONS).json(f"{root}/data/{name}")
        some = [f for f in fields if _type_at(schema, f.split(".")) is not None]
        if not some:
            continue
        per_file = df.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(
            *[agg(F.col(f)).alias(f"{n}_{i}") for i, f in enumerate(some) for n, agg in (("low", F.min), ("high", F.max))])
        values = F.struct(*[F.struct(F.col(f"low_{i}").alias("low"), F.col(f"high_{i}").alias("high")).alias(f) for i, f in enumerate(some)])
        per_file.select("file", values.alias("fields")).coalesce(1).write.mode("overwrite").options(**JSON_OPTIONS).json(f"{root}/stats/{name}")
