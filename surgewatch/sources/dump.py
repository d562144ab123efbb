"""Command line for table sets: ``python -m surgewatch.sources.dump {copy,export,restore} INPUT DEST``.

copy     every table of INPUT (a folder of ``<table>`` or ``<table>.parquet`` entries) to DEST
export   every table of INPUT to DEST/mapping/<table> (schema) and DEST/data/<table> (JSON rows)
restore  every table of an export folder INPUT to DEST, schemas first

``--tables a,b`` limits the set; without it the tables are the entries of the
folder (listed through Hadoop's file system, so any cluster path works).
``--fields f1,f2`` exports chosen (dotted) fields only. Each table is its own
distributed job; up to ``--parallelism`` run at once. This entry point creates
its own session (the library never does).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from surgewatch.sources import tables


def folder_entries(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, hidden ones (``.x``, ``_x``) skipped."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = (status.getPath().getName() for status in fs.listStatus(path))
    return sorted(n for n in names if not n.startswith((".", "_")))


def run(spark: SparkSession, action: str, src: str, dest: str, names: list[str] | None = None,
        fields: list[str] | None = None, parallelism: int = 4) -> list[str]:
    """Copy, export or restore a set of tables; returns the table names handled."""
    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{dest}/{name}")

    if action == "restore":
        return sorted(tables.restore_tables(spark, src, write, parallelism))
    entries = folder_entries(spark, src)
    names = names or sorted({e.removesuffix(".parquet") for e in entries})
    frames = {n: spark.read.parquet(f"{src}/{n}.parquet" if f"{n}.parquet" in entries else f"{src}/{n}")
              for n in names}
    if action == "copy":
        return tables.copy_tables(lambda n: frames[n], write, names, parallelism)
    if action == "export":
        return tables.export_tables(spark, frames, dest, columns=fields, parallelism=parallelism)
    raise ValueError(f"unknown action {action!r}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("action", choices=["copy", "export", "restore"])
    parser.add_argument("input")
    parser.add_argument("dest")
    parser.add_argument("--tables", default=None)
    parser.add_argument("--fields", default=None)
    parser.add_argument("--parallelism", type=int, default=4)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"surgewatch-dump-{args.action}").getOrCreate()
    done = run(spark, args.action, args.input, args.dest,
               args.tables.split(",") if args.tables else None,
               args.fields.split(",") if args.fields else None, args.parallelism)
    print(f"{args.action}: {', '.join(done)}")


if __name__ == "__main__":
    main()
