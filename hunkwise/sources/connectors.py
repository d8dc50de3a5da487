"""Where diffs and the tables beside them come from.

Readers of folders are distributed. What git and the file system of one machine say about one
repository is fetched by the driver, and is as long as that repository.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates commits in the log, bounds, places of CODEOWNERS, source files, and folders without any.
COMMIT_MARK = "\x1e"
MOST_COMMITS, MOST_FILES, PR_SECONDS = 5000, 5000, 20
CODEOWNERS_PLACES = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")
SOURCE_EXTENSIONS = (
    ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".rb", ".rs", ".java", ".kt", ".kts", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs",
    ".php", ".swift", ".scala", ".sh", ".bash", ".pl", ".pm", ".lua", ".r", ".m", ".mm", ".vue", ".svelte", ".sql", ".gradle", ".groovy",
)
SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".tox", "target",
    ".idea", ".gradle", "vendor", ".next", ".cache",
)

#: What a task reads from files.
SPLIT_BYTES = 128 << 20

Run = Callable[..., "subprocess.CompletedProcess[str]"]


class SourceError(RuntimeError):
    """A source that cannot be read, in words for the user."""


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small table to all cores, for small files come in fewer splits than there are
    cores. Beyond a split's worth of bytes for each core the table stays as it is read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def diffs_of(spark: SparkSession, texts: Iterable[tuple[str, str]]) -> DataFrame:
    """diff_id, text of diffs that the driver holds, such as one from standard input."""
    return spark.createDataFrame(list(texts), "diff_id string, text string")


def file_path() -> Column:
    """The path of a row's file, as it is called in its file system."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_diffs(spark: SparkSession, path: str, diff_id: Callable[[Column], Column] = lambda path: path) -> DataFrame:
    """diff_id, text of every diff file below a path; ``diff_id`` names a diff by its file's path."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(diff_id(file_path()).alias("diff_id"), F.col("value").alias("text"))


def _below(folder: str) -> Callable[[Column], Column]:
    """Paths of files as they are called below a folder."""
    base = "/" + folder.strip("/") + "/"
    return lambda p: F.regexp_replace(p, "^.*?" + "".join(f"\\x{{{ord(c):x}}}" for c in base), "")


def _folders(spark: SparkSession, root: str, skipped: Sequence[str]) -> Iterator[list[tuple[str, bool]]]:
    """The (path, whether it is a folder) entries of a tree, folder by folder and level by level, each in the order of
    their names; skipped folders are named but never entered, nor are links."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    level, leave = [jvm.org.apache.hadoop.fs.Path(root)], set(skipped)
    while level:
        below = []
        for folder in level:
            found = sorted(files.listStatus(folder), key=lambda f: f.getPath().getName())
            yield [(f.getPath().toString(), f.isDirectory()) for f in found]
            below += [f.getPath() for f in found if f.isDirectory() and not f.isSymlink() and f.getPath().getName() not in leave]
        level = below


def read_tree(spark: SparkSession, path: str, extensions: Sequence[str] = SOURCE_EXTENSIONS, skipped: Sequence[str] = SKIPPED_FOLDERS, most: int | None = None) -> DataFrame:
    """path (below ``path``), text of the source files below a path.

    The tree is listed breadth first, and folders that hold no sources are never entered. ``most`` keeps the first
    files of that order (by level, then by path): a limit that belongs to the feature, for trees that no version
    control bounds; the listing ends where it is reached.
    """
    below = _below(path.split("://")[-1])
    ends = tuple(extensions)
    taken: list[str] = []
    for entries in _folders(spark, path, skipped):
        names = [p for p, is_folder in entries if not is_folder]
        taken += [p for p in names if not ends or os.path.splitext(p.rsplit("/", 1)[-1])[1].lower() in ends]
        if most is not None and len(taken) >= most:
            break
    return _read_files(spark, taken if most is None else taken[:most], below)


def _read_files(spark: SparkSession, paths: list[str], named: Callable[[Column], Column]) -> DataFrame:
    """The files of that names, whatever signs are in them."""
    if not paths:
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths], wholetext=True).select(named(file_path()).alias("path"), F.col("value").alias("text"))


def _git(repo: str, *args: str, run: Run = subprocess.run) -> str:
    """What git says, or SourceError."""
    argv = ["git", *args]
    try:
        out = run(argv, cwd=repo, capture_output=True, text=True, check=False)
    except OSError as e:
        raise SourceError("git cannot be run; install it, or give a diff on standard input") from e
    if out.returncode:
        said = ((out.stderr or "").strip().splitlines() or [""])[0]
        low = said.lower()
        if "not a git repository" in low or "unknown option `cached'" in low:  # outside a repository git compares files
            raise SourceError("not a git repository; run inside one, or give a diff on standard input")
        if any(x in low for x in ("unknown revision", "bad revision", "ambiguous argument")):
            raise SourceError(f"git does not know that range or revision: {said}")
        raise SourceError(f"`{' '.join(argv)}` failed with exit code {out.returncode}{': ' + said if said else ''}")
    return out.stdout


def git_diff(repo: str = ".", staged: bool = False, range_spec: str | None = None, run: Run = subprocess.run) -> str:
    """The text of one diff, from git: of the index, of a range, or of the working tree."""
    return _git(repo, "--no-pager", "diff", "--no-color", "--no-ext-diff", *(["--cached"] if staged else [range_spec] if range_spec else []), run=run)


def tracked_files(repo: str = ".", run: Run = subprocess.run) -> list[str] | None:
    """Paths that git tracks, or None outside a repository."""
    try:
        return [p for p in _git(repo, "ls-files", "-z", run=run).split("\0") if p]
    except SourceError:
        return None


def repo_tree(spark: SparkSession, repo: str = ".", run: Run = subprocess.run) -> DataFrame | None:
    """path, text of a repository's source files: those that git tracks, else those of a bounded walk. None if there are none."""
    root = Path(repo).resolve()
    if not root.is_dir():
        return None
    tracked = tracked_files(str(root), run)
    if tracked is None:
        tree = read_tree(spark, f"file://{root}", most=MOST_FILES)
        return None if tree.isEmpty() else tree
    wanted = [f"file://{root / p}" for p in tracked if os.path.splitext(p)[1].lower() in SOURCE_EXTENSIONS and (root / p).is_file()]
    return _read_files(spark, wanted, _below(str(root))) if wanted else None


def parse_log(log: DataFrame) -> DataFrame:
    """message, paths of every commit in logs (text), each commit started by ``COMMIT_MARK``.
    What follows a commit's last blank line are paths; without one, the first line is the message."""
    one = log.select(F.explode(F.split("text", COMMIT_MARK)).alias("c")).select(F.regexp_replace("c", r"\A\n+|\n+\z", "").alias("c")).where("c != ''")
    blank = F.rlike("c", F.lit(r"\n\s*\n"))
    message = F.when(blank, F.regexp_extract("c", r"(?s)\A(.*)\n\s*\n", 1)).otherwise(F.substring_index("c", "\n", 1))
    rest = F.when(blank, F.regexp_extract("c", r"(?s)\A.*\n\s*\n(.*)\z", 1)).otherwise(F.regexp_extract("c", r"(?s)\A[^\n]*\n(.*)\z", 1))
    bare = lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")
    return one.select(bare(message).alias("message"), F.filter(F.transform(F.split(rest, "\n"), bare), lambda p: p != "").alias("paths"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """message, paths of every commit in the log files below a path. A line of such a file ends at ``COMMIT_MARK``, so
    that a long log is split over many tasks."""
    log = spark.read.option("recursiveFileLookup", True).option("lineSep", COMMIT_MARK).text(path)
    return parse_log(log.select(F.col("value").alias("text")))


def git_log(spark: SparkSession, repo: str = ".", run: Run = subprocess.run) -> DataFrame:
    """message, paths of the last commits without merges."""
    said = _git(repo, "log", "--no-merges", f"--max-count={MOST_COMMITS}", f"--format={COMMIT_MARK}%n%B", "--name-only", run=run)
    return parse_log(spark.createDataFrame([(said,)], "text string"))


def repo_history(spark: SparkSession, repo: str = ".", run: Run = subprocess.run) -> DataFrame | None:
    """As ``git_log``; None outside a repository and in one without commits."""
    try:
        log = git_log(spark, repo, run)
    except SourceError:
        return None
    return None if log.isEmpty() else log


def find_codeowners(root: str = ".") -> str | None:
    """The text of the first CODEOWNERS file where such files may be."""
    for place in CODEOWNERS_PLACES:
        file = Path(root, place)
        if file.is_file():
            return file.read_text(encoding="utf-8", errors="replace")
    return None


def intent_from_pr(pr: str, repo: str | None = None, run: Run = subprocess.run) -> str | None:
    """A pull request's title and body by the ``gh`` tool; None whenever that fails."""
    argv = ["gh", "pr", "view", *(["-R", repo] if repo else []), pr, "--json", "title,body", "-q", '.title + "\\n" + .body']
    try:
        out = run(argv, capture_output=True, text=True, timeout=PR_SECONDS, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return (out.stdout.strip() or None) if out.returncode == 0 else None
