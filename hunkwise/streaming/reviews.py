"""Reviews of diffs as they arrive, and change counts of files kept as state.

A diff is a whole row, so a review needs no state: every micro-batch is reviewed and written to a folder of its
own, which a batch that runs again replaces. Change counts are a running aggregate over commits: each micro-batch writes the
paths that it changed with their counts up to then, and the newest counts of every path are the table that the
hotspot rule reads. What a batch reviews and what is counted need not come at the same time.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from hunkwise.operators.context_rules import busiest, path_counts
from hunkwise.plans.review import Options, review
from hunkwise.sources.connectors import COMMIT_MARK, file_path, parse_log
from hunkwise.sources.worktables import scope


def diff_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """diff_id (the file's path), text of the diff files that come into a folder."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    return files.select(file_path().alias("diff_id"), F.col("value").alias("text"))


def commit_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """message, paths of the commits in the log files that come into a folder."""
    log = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, lineSep=COMMIT_MARK)
    return parse_log(log.select(F.col("value").alias("text")))


def _started(df: DataFrame, batch, checkpoint: str, trigger: dict | None, mode: str) -> StreamingQuery:
    return df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_reviews(diffs: DataFrame, to: str, checkpoint: str, options: Options = Options(), trigger: dict | None = None, stats_from: str | None = None) -> StreamingQuery:
    """Review every micro-batch of a stream (diff_id, text) into Parquet, one folder for each batch, so
    that a batch that runs again replaces what it wrote. ``stats_from``: the folder of ``start_file_stats``, as
    it stands when a batch begins."""

    def batch(rows: DataFrame, number: int) -> None:
        own = options
        if stats_from is not None and (stats := latest_file_stats(rows.sparkSession, stats_from)) is not None:
            own = replace(options, file_stats=stats)
        with scope():
            review(rows, own).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return _started(diffs, batch, checkpoint, trigger, "append")


def start_file_stats(commits: DataFrame, to: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the commits and fixes of every path of a stream (message, paths) as state, and write with each
    micro-batch those of the paths that it changed."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return _started(path_counts(commits), batch, checkpoint, trigger, "update")


def latest_file_stats(spark: SparkSession, path: str) -> DataFrame | None:
    """path, commits, fixes, busiest as the last micro-batches left them; None before the first one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where) or not files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "batch=*/_SUCCESS")):
        return None
    written = spark.read.schema("path string, commits long, fixes long, batch long").parquet(path)
    last = written.groupBy("path").agg(F.max_by(F.struct("commits", "fixes"), "batch").alias("n"))
    return busiest(last.select("path", "n.*"))
