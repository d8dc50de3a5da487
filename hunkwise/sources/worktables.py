"""Intermediate tables, written under ``spark.checkpoint.dir``: the one folder that the driver and all executors share.

A branch of a plan that several others read is written once and read by each. A lost executor then costs its running
tasks only. Tables stay until the session ends, or until the scope does in which they were written:

    with scope():
        review(diffs, options).write.parquet(path)
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the session names none, a temporary one of a local session,
    as in tests; executors of a cluster would not see it, so there the setting must be made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="hunkwise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Tables made in each open scope, the innermost last.
_scopes: list[list[WorkTables]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Remove at the end the tables that are written inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for tables in _scopes.pop():
            tables.clear()


class WorkTables:
    """The intermediate tables of one query run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/hunkwise/{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._leave)
        if _scopes:
            _scopes[-1].append(self)

    def put(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """Write a table and read it back; the returned plan starts at its files."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        if files:
            df = df.coalesce(files)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later step reads."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.folder.split("://")[-1] in path:
                _remove(self.spark, path)

    def clear(self) -> None:
        """Remove all tables."""
        atexit.unregister(self._leave)
        _remove(self.spark, self.folder)

    def _leave(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _remove(self.spark, self.folder)
        except Exception:  # noqa: BLE001 - the session is already gone; the cluster clears its folder
            pass
