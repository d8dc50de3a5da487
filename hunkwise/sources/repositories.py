"""Many repositories at once, as a data source: a partition for each of them, read by git where the task runs.

    spark.dataSource.register(RepositoryDiffs)
    spark.read.format("repository_diffs").option("repositories", json).load()

``repositories`` is a JSON list of objects: ``repo`` (a folder that the executors see), and ``range`` or ``staged``; a
repository may be listed with several ranges. Rows are diff_id, repo, range, text, error: a repository that git cannot
read gives its error in words, unless ``mode`` is ``fail``. An empty diff is a row with an empty text.

``repository_commits`` takes the same list (``range``: what git log shall list) and gives repo, message, paths, a row for
each commit, out of the log as git writes it: no log is held as a whole.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hunkwise.sources import connectors


@dataclass(frozen=True)
class Asked(InputPartition):
    """One repository and what to read of it."""

    repo: str
    range_spec: str | None = None
    staged: bool = False

    @property
    def diff_id(self) -> str:
        return self.repo + (f"@{self.range_spec}" if self.range_spec else "@index" if self.staged else "")


def asked_of(options: dict[str, str]) -> list[Asked]:
    """The list, checked."""
    try:
        rows = json.loads(options.get("repositories", ""))
    except json.JSONDecodeError as e:
        raise connectors.SourceError(f"the option 'repositories' is not JSON: {e}") from e
    if not isinstance(rows, list) or not all(isinstance(r, dict) and isinstance(r.get("repo"), str) and r["repo"] for r in rows):
        raise connectors.SourceError("the option 'repositories' must be a list of objects with a 'repo'")
    for r in rows:
        if unknown := r.keys() - {"repo", "range", "staged"}:
            raise connectors.SourceError(f"repositories have no {', '.join(sorted(unknown))}")
        if r.get("range") and r.get("staged"):
            raise connectors.SourceError(f"{r['repo']}: a range or the index, not both")
        if str(r.get("range") or "").startswith("-"):
            raise connectors.SourceError(f"{r['repo']}: not a range: {r['range']}")
    return [Asked(r["repo"], r.get("range") or None, bool(r.get("staged"))) for r in rows]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.asked = asked_of(options)
        self.strict = options.get("mode", "keep") == "fail"

    def partitions(self) -> Sequence[InputPartition]:
        return self.asked

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # an empty list
            return
        try:
            yield from self.rows(partition)
        except connectors.SourceError as e:
            if self.strict:
                raise
            yield from self.failed(partition, str(e))

    def rows(self, partition: InputPartition) -> Iterator[tuple]:
        raise NotImplementedError

    def failed(self, partition: InputPartition, words: str) -> Iterator[tuple]:
        raise NotImplementedError


class _Diffs(_Reader):
    def rows(self, partition: InputPartition) -> Iterator[tuple]:
        text = connectors.git_diff(partition.repo, partition.staged, partition.range_spec)
        yield partition.diff_id, partition.repo, partition.range_spec, text, None

    def failed(self, partition: InputPartition, words: str) -> Iterator[tuple]:
        yield partition.diff_id, partition.repo, partition.range_spec, None, words


def commits_of(lines: Iterator[str]) -> Iterator[tuple[str, list[str]]]:
    """(message, paths) of the commits of a log's lines: paths follow the last blank line, else the first line."""
    for record in _records(lines):
        body = record.strip("\n")
        if not body:
            continue
        own = body.split("\n")
        blank = next((i for i in range(len(own) - 1, -1, -1) if not own[i].strip()), None)
        message, paths = (own[:1], own[1:]) if blank is None else (own[:blank], own[blank + 1 :])
        yield "\n".join(message).strip(), [p for p in map(str.strip, paths) if p]


def _records(lines: Iterator[str]) -> Iterator[str]:
    held: list[str] = []
    for line in lines:
        before, mark, after = line.partition(connectors.COMMIT_MARK)
        held.append(before)
        while mark:
            yield "".join(held)
            before, mark, after = after.partition(connectors.COMMIT_MARK)
            held = [before]
    yield "".join(held)


class _Commits(_Reader):
    def rows(self, partition: InputPartition) -> Iterator[tuple]:
        argv = ["git", "log", "--no-merges", f"--format={connectors.COMMIT_MARK}%n%B", "--name-only", *([partition.range_spec] if partition.range_spec else [])]
        try:
            run = subprocess.Popen(argv, cwd=partition.repo, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace")
        except OSError as e:
            raise connectors.SourceError(f"git cannot be run in {partition.repo}: {e}") from e
        with run:
            assert run.stdout is not None and run.stderr is not None
            for message, paths in commits_of(run.stdout):
                yield partition.repo, message, paths, None
            said = run.stderr.read().strip()
        if run.returncode:
            raise connectors.SourceError(f"git log failed in {partition.repo}: {said}")

    def failed(self, partition: InputPartition, words: str) -> Iterator[tuple]:
        yield partition.repo, None, [], words


class RepositoryDiffs(DataSource):
    """Diffs of many repositories."""

    @classmethod
    def name(cls) -> str:
        return "repository_diffs"

    def schema(self) -> str:
        return "diff_id string, repo string, range string, text string, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Diffs(self.options)


class RepositoryCommits(DataSource):
    """Commits of many repositories."""

    @classmethod
    def name(cls) -> str:
        return "repository_commits"

    def schema(self) -> str:
        return "repo string, message string, paths array<string>, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Commits(self.options)


def _load(spark: SparkSession, source: type[DataSource], repositories: Sequence[dict], mode: str) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("repositories", json.dumps(list(repositories))).option("mode", mode).load()


def repository_diffs(spark: SparkSession, repositories: Sequence[dict], mode: str = "keep") -> DataFrame:
    """diff_id, repo, range, text, error: one row for each of the repositories."""
    return _load(spark, RepositoryDiffs, repositories, mode)


def repository_commits(spark: SparkSession, repositories: Sequence[dict], mode: str = "keep") -> DataFrame:
    """repo, message, paths, error: one row for each commit."""
    return _load(spark, RepositoryCommits, repositories, mode)
