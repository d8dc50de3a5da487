"""Many repositories, logs, trees and streams."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from hunkwise.operators.context_rules import file_stats
from hunkwise.plans.review import Options
from hunkwise.sources import connectors, repositories
from hunkwise.streaming import reviews
from test_review import DIFF


def git(folder, *args):
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *args], cwd=folder, check=True, capture_output=True)


@pytest.fixture
def two(tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        git(tmp_path / name, "init", "-q")
        for i in range(3):
            (tmp_path / name / "a.py").write_text(f"x = {i}\n")
            git(tmp_path / name, "add", ".")
            git(tmp_path / name, "commit", "-qm", f"fix {name} {i}\n\nsecond part\n\nthird part")
        (tmp_path / name / "b.py").write_text("eval(x)\n")
        git(tmp_path / name, "add", ".")
    return tmp_path


def test_many_repositories(spark, two):
    asked = [{"repo": str(two / "one"), "range": "HEAD~1..HEAD"}, {"repo": str(two / "one"), "staged": True}, {"repo": str(two / "two"), "range": "HEAD~2..HEAD"}, {"repo": str(two / "two"), "range": "nowhere"}, {"repo": str(two / "none")}]
    df = repositories.repository_diffs(spark, asked)
    assert df.rdd.getNumPartitions() == len(asked)  # a partition each
    rows = {r.diff_id: r for r in df.collect()}
    one, two_ = str(two / "one"), str(two / "two")
    assert rows[f"{one}@HEAD~1..HEAD"].text == connectors.git_diff(one, range_spec="HEAD~1..HEAD") and "+x = 2" in rows[f"{one}@HEAD~1..HEAD"].text
    assert "+eval(x)" in rows[f"{one}@index"].text and "-x = 0" in rows[f"{two_}@HEAD~2..HEAD"].text
    assert "does not know" in rows[f"{two_}@nowhere"].error and rows[f"{two_}@nowhere"].text is None and rows[str(two / "none")].error
    with pytest.raises(Exception, match="does not know"):
        repositories.repository_diffs(spark, asked, mode="fail").collect()
    assert repositories.repository_diffs(spark, []).count() == 0
    for bad in ("", "{}", '[{"repo": ""}]', '[{"repo": "a", "what": 1}]', '[{"repo": "a", "range": "x", "staged": true}]', '[{"repo": "a", "range": "--output=x"}]'):
        with pytest.raises(connectors.SourceError):
            repositories.asked_of({"repositories": bad})


def test_commits_of_many_repositories(spark, two):
    rows = repositories.repository_commits(spark, [{"repo": str(two / "one")}, {"repo": str(two / "two"), "range": "HEAD~1..HEAD"}, {"repo": str(two)}]).collect()
    want = {(r.message, tuple(r.paths)) for r in connectors.git_log(spark, str(two / "one")).collect()}
    assert {(r.message, tuple(r.paths)) for r in rows if r.repo == str(two / "one")} == want and len(want) == 3
    assert [r.message for r in rows if r.repo == str(two / "two")] == ["fix two 2\n\nsecond part\n\nthird part"]
    assert [bool(r.error) for r in rows if r.repo == str(two)] == [True]


def test_logs_are_split_at_commits(spark, two, tmp_path_factory):
    """A folder of logs gives the rows of its logs, however they are split over tasks and lines of reading."""
    folder = tmp_path_factory.mktemp("logs")
    odd = "\x1e\nonly a message\x1e\nsubject\n0path/a.py\n1b.py1\x1e\n\n\x1e\nbody\n \nwith blank\n\n  c d.py \n\n"
    said = [connectors._git(str(two / name), "log", "--no-merges", f"--format={connectors.COMMIT_MARK}%n%B", "--name-only") for name in ("one", "two")] + [odd, "", odd * 500]
    for i, text in enumerate(said):
        (folder / f"{i}.log").write_text(text)
    of = lambda df: sorted((r.message, tuple(r.paths)) for r in df.collect())
    want = of(connectors.parse_log(spark.createDataFrame([(t,) for t in said], "text string")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        log = connectors.read_log(spark, str(folder))
        assert log.rdd.getNumPartitions() > len(said) and of(log) == want and len(want) == 6 + 3 * 501
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plain = sorted((m, tuple(p)) for t in said for m, p in repositories.commits_of(iter(t.splitlines(keepends=True))))
    assert plain == want


def test_skipped_folders_are_never_listed(spark, tmp_path, monkeypatch):
    for p in ("b.py", "z/c.py", "a/d.PY", "a/deep/er/e.js", "node_modules/x/y.js", "a/.git/f.py", "a/notes.txt", "a/{odd} [name].py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    listed = []
    of_tree = connectors._folders

    def watched(*args):
        for entries in of_tree(*args):
            listed.extend(p for p, _ in entries)
            yield entries

    monkeypatch.setattr(connectors, "_folders", watched)
    rows = {r.path: r.text for r in connectors.read_tree(spark, str(tmp_path)).collect()}
    assert rows == {p: p for p in ("b.py", "z/c.py", "a/d.PY", "a/deep/er/e.js", "a/{odd} [name].py")}
    assert not any("node_modules/" in p or "/.git/" in p for p in listed) and any(p.endswith("/node_modules") for p in listed)
    first = [r.path for r in connectors.read_tree(spark, str(tmp_path), most=3).orderBy("path").collect()]
    assert first == ["a/d.PY", "a/{odd} [name].py", "b.py"]  # level by level
    listed.clear()
    assert connectors.read_tree(spark, str(tmp_path), most=1).count() == 1 and not any("/deep/" in p for p in listed)
    assert connectors.read_tree(spark, str(tmp_path), extensions=(".none",)).count() == 0


def rows_of(spark, path):
    return sorted((r.batch, r.diff_id.rsplit("/", 1)[-1], r.id, r.score, r["rank"]) for r in spark.read.parquet(path).collect())


def test_streamed_reviews(spark, tmp_path):
    diffs, logs, to, stats, marks = (str(tmp_path / n) for n in ("diffs", "logs", "to", "stats", "marks"))
    for p in (diffs, logs):
        (tmp_path / p).mkdir()

    def count():
        reviews.start_file_stats(reviews.commit_stream(spark, logs), stats, f"{marks}/stats").awaitTermination()

    def look():
        options = Options(no_tests=True, tree=spark.createDataFrame([("z.py", "helper " * 20)], "path string, text string"))
        reviews.start_reviews(reviews.diff_stream(spark, diffs), to, f"{marks}/reviews", options, stats_from=stats).awaitTermination()

    (tmp_path / "diffs" / "first.patch").write_text(DIFF)
    look()  # before any counts
    first = rows_of(spark, to)
    assert len(first) == 2 and {r[1] for r in first} == {"first.patch"}
    commit = lambda words, *paths: f"{connectors.COMMIT_MARK}\n{words}\n\n" + "\n".join(paths) + "\n"
    (tmp_path / "logs" / "1.log").write_text(commit("fix it", "src/auth/login.py", "b.py") * 3)
    count()
    (tmp_path / "logs" / "2.log").write_text(commit("more", "src/auth/login.py") * 4)
    count()  # a new query on the same marks: the counts go on
    got = {(r.path, r.commits, r.fixes, r.busiest) for r in reviews.latest_file_stats(spark, stats).collect()}
    everything = connectors.read_log(spark, logs)
    assert got == {tuple(r) for r in file_stats(everything).select("path", "commits", "fixes", "busiest").collect()} == {("src/auth/login.py", 7, 3, 7), ("b.py", 3, 3, 7)}
    (tmp_path / "diffs" / "second.patch").write_text(DIFF)
    look()
    both = rows_of(spark, to)
    assert [r for r in both if r[0] == 0] == first and [(r[1], r[2]) for r in both if r[0] == 1] == [("second.patch", r[2]) for r in first]
    hot = spark.read.parquet(f"{to}/batch=1").select(F.explode("signals").alias("s")).where("s.rule = 'hotspots'")
    assert hot.count() == 1 and hot.first().s.reason.startswith("hotspot: file a top change hotspot and is repeatedly fixed (7 commits, 3 fixes)")
    # batches whose ends were not noted run again, and leave one result
    for name in ("stats", "reviews"):
        for n in ("1", ".1.crc"):
            (tmp_path / "marks" / name / "commits" / n).unlink(missing_ok=True)
    count()
    look()
    assert rows_of(spark, to) == both
    assert {(r.path, r.commits, r.fixes, r.busiest) for r in reviews.latest_file_stats(spark, stats).collect()} == got


def test_patterns_are_the_jvms(spark, tmp_path, capsys):
    import io

    from hunkwise import cli
    from hunkwise.plans import config

    file = tmp_path / "s.toml"
    settings = lambda p: file.write_text(f"[[surface]]\npattern = {json.dumps(p)}\npoints = 1\nreason = 'x'\n")
    for bad in ("(?P<n>x)", "(", "(?<n>a)(?<n>b)", "[a", "x{2,1}", r"\p{Nothing}"):
        settings(bad)
        with pytest.raises(config.ConfigError, match="surface 1: not a pattern"):
            config.load_config(explicit=file)
        assert cli.main(["--config", str(file)], io.StringIO(DIFF), spark) == 2
        assert "not a pattern" in capsys.readouterr().err
    for good in (r"(?<n>x)\k<n>", r"a++b", r"\p{Lu}", r"(^|/)pay(?!er)"):
        settings(good)
        assert cli.main(["--config", str(file), "--json"], io.StringIO(DIFF), spark) == 0
        capsys.readouterr()


def test_other_failures_are_not_the_gates(spark, capsys, monkeypatch):
    import io

    from hunkwise import cli

    def broken(*args, **kwargs):
        raise RuntimeError("no room left\nmore")

    monkeypatch.setattr(cli, "review", broken)
    assert cli.main(["--no-config"], io.StringIO(DIFF), spark) == 2
    assert capsys.readouterr().err == "hunkwise: failed: no room left\n"
    assert cli.main(["--no-config", "--diffs", "/nowhere/at/all"], io.StringIO(""), spark) == 2
