"""Command line for the whole job: ``python -m surgewatch.plans.job <tables_dir> <out_dir> [anchor]``.

Reads ``<tables_dir>/<table>.parquet``, labels the hourly sales in the lookback
before ``anchor``, trains and scores the network, and writes ``labelled``,
``scored`` and ``report`` as parquet under ``out_dir``. The report is also shown.
This entry point creates its own session (the library never does).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from surgewatch.operators import evaluate
from surgewatch.plans import flagship
from surgewatch.sources.fixtures import Tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("tables_dir")
    parser.add_argument("out_dir")
    parser.add_argument("anchor", nargs="?", default=flagship.DEFAULT_ANCHOR)
    parser.add_argument("--lookback-days", type=int, default=flagship.DEFAULT_LOOKBACK_DAYS)
    parser.add_argument("--iterations", type=int, default=None)
    parser.add_argument("--seed", type=int, default=None)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("surgewatch-job").getOrCreate()
    labelled, net, scored = flagship.run_job(Tables(spark, args.tables_dir), args.anchor,
                                             args.lookback_days, args.iterations, args.seed)
    labelled.write.mode("overwrite").parquet(f"{args.out_dir}/labelled")
    scored.drop("features", "rawPrediction", "probability").write.mode("overwrite").parquet(f"{args.out_dir}/scored")
    # the report comes from the written scores: the test part is scored once
    evaluate.report(spark.read.parquet(f"{args.out_dir}/scored")).write.mode("overwrite").parquet(f"{args.out_dir}/report")
    print(f"training error on the held-out part: {net.error_pct:.2f}%")
    spark.read.parquet(f"{args.out_dir}/report").show(truncate=False)


if __name__ == "__main__":
    main()
