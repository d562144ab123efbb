from datetime import datetime

from surgewatch.sources import tables
from surgewatch.sources.fixtures import Tables, tickets
from tests.conftest import SF_SMALL


def test_export_restore_identity_with_microseconds(spark, tmp_dir):
    t = Tables(spark, SF_SMALL)
    frames = {"events": t["events"], "nation": t["nation"]}
    tables.export_tables(spark, frames, tmp_dir)
    back = tables.restore_tables(spark, tmp_dir)
    assert set(back) == {"events", "nation"}
    for name, df in frames.items():
        assert back[name].schema == df.schema
        assert df.exceptAll(back[name]).count() == 0 and back[name].exceptAll(df).count() == 0


def test_default_json_loses_microseconds(spark, tmp_dir):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 7, 179575),)], "ts timestamp_ntz")
    df.write.json(f"{tmp_dir}/plain")
    back = spark.read.schema(df.schema).json(f"{tmp_dir}/plain").first().ts
    assert back != datetime(2024, 1, 1, 0, 0, 7, 179575)


def test_projected_export(spark, tmp_dir):
    t = Tables(spark, SF_SMALL)
    fields = ["ticket.issueDate", "ticket.cashAmount"]
    tables.export_tables(spark, {"tickets": tickets(t)}, tmp_dir, columns=fields)
    back = tables.restore_tables(spark, tmp_dir)["tickets"]
    assert back.columns == ["ticket_issueDate", "ticket_cashAmount"]
    assert back.count() == t["lineitem"].count()


def test_copy_profile_schema(spark, tmp_dir):
    t = Tables(spark, SF_SMALL)
    written = {}

    def write(name, df):
        df.write.parquet(f"{tmp_dir}/{name}")
        written[name] = True

    assert tables.copy_tables(lambda n: t[n], write, ["nation", "region"]) == ["nation", "region"]
    assert spark.read.parquet(f"{tmp_dir}/nation").count() == 25
    prof = {r.table_name: (r.row_count, r.column_count)
            for r in tables.table_profile({"nation": t["nation"], "region": t["region"]}).collect()}
    assert prof == {"nation": (25, 3), "region": (5, 2)}
    sch = tables.schema_rows(spark, t["nation"]).orderBy("position").collect()
    assert [(r.name, r.type, r.nullable) for r in sch] == [("n_nationkey", "int", True), ("n_name", "string", True),
                                                          ("n_regionkey", "int", True)]


def test_dump_copy_export_restore(spark, tmp_dir):
    from surgewatch.sources import dump

    src = "/root/testdata/sf0.001"
    assert dump.run(spark, "copy", src, f"{tmp_dir}/copy", ["nation", "region"]) == ["nation", "region"]
    assert spark.read.parquet(f"{tmp_dir}/copy/nation").count() == 25
    assert dump.run(spark, "export", f"{tmp_dir}/copy", f"{tmp_dir}/export") == ["nation", "region"]
    assert dump.run(spark, "restore", f"{tmp_dir}/export", f"{tmp_dir}/restored") == ["nation", "region"]
    back = spark.read.parquet(f"{tmp_dir}/restored/region")
    orig = spark.read.parquet(f"{src}/region.parquet")
    assert back.schema == orig.schema and back.exceptAll(orig).count() == 0 and orig.exceptAll(back).count() == 0
    assert "events" in dump.folder_entries(spark, src) or "events.parquet" in dump.folder_entries(spark, src)


def test_table_sizes_equal_the_files(spark, tmp_dir):
    import os

    spark.range(100).repartition(3).write.parquet(f"{tmp_dir}/folder")
    files = [f for f in os.listdir(f"{tmp_dir}/folder") if f.endswith(".parquet")]
    paths = {"region": f"{SF_SMALL}/region.parquet", "folder": f"{tmp_dir}/folder"}
    got = {r.table_name: (r.file_count, r.size_bytes) for r in tables.table_sizes(spark, paths).collect()}
    assert got == {"region": (1, os.path.getsize(paths["region"])), "folder": (3, sum(os.path.getsize(f"{tmp_dir}/folder/{f}") for f in files))}


def test_content_sums_see_late_decimals_and_array_order(spark):
    total = lambda x, a: tables.table_sums({"t": spark.createDataFrame([(x, a)], "x double, a array<float>")}).first().content_sum
    base = total(1.5, [1.0, 2.0])
    assert total(1.5, [1.0, 2.0]) == base and total(1.5000000001, [1.0, 2.0]) != base and total(1.5, [2.0, 1.0]) != base


def test_a_broken_copy_goes_on(spark, tmp_dir):
    rows = spark.range(500).selectExpr("id", "id % 7 as k", "cast(id as string) as name").union(spark.range(3).selectExpr("null", "id", "null"))
    names = ["a", "b"]
    calls = []

    def read(name):
        calls.append(name)
        return rows

    real = tables.table_sums

    def broken(frames):
        if len(done) == 5:
            raise OSError("lost")
        done.append(1)
        return real(frames)

    done = []
    tables.table_sums = broken
    try:
        tables.copy_resumable(spark, read, tmp_dir, names, parts=4, parallelism=1)
        raise AssertionError("not broken")
    except OSError:
        pass
    finally:
        tables.table_sums = real
    assert tables.manifest(spark, tmp_dir).count() == 5
    # the part that was written without its entry is written again, the others are not
    assert tables.copy_resumable(spark, read, tmp_dir, names, parts=4) == {"a": 0, "b": 3}
    assert tables.copy_resumable(spark, read, tmp_dir, names, parts=4) == {"a": 0, "b": 0}
    for name in names:
        back = tables.read_copied(spark, tmp_dir, name)
        assert back.count() == 503 and back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    assert all(r.parts == 4 and r.row_count == r.rows_read == 503 and r.content_sum == r.sum_read for r in tables.verify_copied(spark, tmp_dir, names).collect())
    assert tables.copy_resumable(spark, read, tmp_dir, ["a"], parts=4, run="2") == {"a": 4}


def test_exports_are_packed(spark, tmp_dir):
    """Packed files hold the same rows in a fraction of the text; many rows go to several files."""
    df = spark.range(0, 20_000, 1, 1).selectExpr("id", "cast(id as string) as client_name", "id / 8 as amount", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id / 7) as sold_at")
    df = df.unionByName(df.limit(1).selectExpr(*[f"nullif({c}, {c}) as {c}" for c in df.columns]))
    tables.export_tables(spark, {"sales": df}, f"{tmp_dir}/packed")
    tables.export_tables(spark, {"sales": df}, f"{tmp_dir}/plain", compression="none")
    sizes = {k: tables.table_sizes(spark, {k: f"{tmp_dir}/{k}/data/sales"}).first() for k in ("packed", "plain")}
    assert sizes["packed"].size_bytes * 3 < sizes["plain"].size_bytes
    for k in sizes:
        back = tables.restore_tables(spark, f"{tmp_dir}/{k}")["sales"]
        assert back.schema == df.schema and back.count() == 20_001
        assert df.exceptAll(back).count() == 0 and back.exceptAll(df).count() == 0


def test_a_large_export_is_read_by_many_tasks(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(tables, "EXPORT_FILE_ROWS", 100)
    tables.export_tables(spark, {"numbers": spark.range(0, 1000, 1, 1)}, tmp_dir)
    back = tables.restore_tables(spark, tmp_dir)["numbers"]
    assert tables.table_sizes(spark, {"numbers": f"{tmp_dir}/data/numbers"}).first().file_count == 10
    assert sorted(r.id for r in back.collect()) == list(range(1000))


def test_document_folders_read_packed_and_plain_files(spark, tmp_dir):
    from surgewatch.sources import docfolder

    df = spark.range(0, 50, 1, 4).selectExpr("id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) as at").filter("id < 30")   # the last files are empty
    for name, compression in (("packed", "gzip"), ("plain", "none")):
        tables.export_tables(spark, {"sales-1": df}, f"{tmp_dir}/{name}", compression=compression)
        back = docfolder.read_document_folder(spark, f"{tmp_dir}/{name}", "sales-*")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
