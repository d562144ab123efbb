from surgewatch.session import ensure_checkpoint_dir, shared_dir


def test_shared_dir_under_checkpoint_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    a, b = shared_dir(spark, "export"), shared_dir(spark, "export")
    assert a != b
    assert a.startswith(base.rstrip("/") + "/export-") and b.startswith(base.rstrip("/") + "/export-")
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
