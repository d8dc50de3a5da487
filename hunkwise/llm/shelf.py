"""Where intermediate tables live, and how a query cuts its lineage.

Tables are written under ``spark.checkpoint.dir``, the one folder that all executors and the
driver share. A lost executor then costs the running tasks only: finished steps are read again
from the shared folder.

What an operator returns may read its shelf's tables, so they stay until the session ends, or
until the scope does in which the operator ran. As long, Python is handed few rows at a time:

    with scope(spark):
        near_duplicates(docs).write.parquet(path)
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from hunkwise.sources import worktables
from hunkwise.sources.worktables import WorkTables, shared_folder

__all__ = ["Shelf", "scope", "shared_folder", "small_batches"]

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand Python 8 MB of rows at a time, so that long texts do not fill a worker. Results are the same. What an
    operator returns runs later, so the setting stays until the scope ends, or the session."""
    spark.conf.set(_BATCH, str(_BATCH_BYTES))


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables of all shelves that are made inside, and restore the session's settings, at the end."""
    before = spark.conf.get(_BATCH)
    with worktables.scope():
        try:
            yield
        finally:
            spark.conf.set(_BATCH, before)


class Shelf(WorkTables):
    """The intermediate tables of one query run of an operator that hands rows to Python."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        super().__init__(spark)
