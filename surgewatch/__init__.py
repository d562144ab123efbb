"""surgewatch: sales-spike analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or a SparkSession and paths) and
returns DataFrames. No session is created here; the caller owns it.

Layout
------
sources/    readers (files, JDBC, document store), derived test views, table jobs
functions/  Column builders: time windows, hour buckets, exact money sums, alert rule
operators/  DataFrame -> DataFrame steps: rollups, baselines, labels, search,
            evaluation, statistics, classifier
plans/      composed jobs (the spike labelling chain) and the query catalog
llm/        training-data operators (nothing else imports them)
"""

__version__ = "0.1.0"
