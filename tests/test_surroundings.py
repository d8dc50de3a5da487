"""Owners, symbols, settings, sources, notes, documents and the command line."""

import fnmatch
import io
import json
import random
import re
import subprocess
import textwrap
import warnings

import pytest
from pyspark.sql import functions as F

from hunkwise import cli
from hunkwise.functions import bitmap
from hunkwise.functions.signals import none
from hunkwise.operators import budgets, context_rules, enrich, owner_index, parse, profiles, render
from hunkwise.plans import config
from hunkwise.plans.review import Options, review
from hunkwise.sources import connectors, worktables
from test_review import DIFF, frame


def test_owner_patterns_as_shells_match(spark):
    """Random patterns, with ranges, negations and open brackets, against the standard library."""
    rng = random.Random(7)
    signs = ["a", "b", "c", "/", ".", "*", "?", "[", "]", "!", "-", "^", "\\", "&", "py", "[a-c]", "[!b]", "[]a]", "[c-a]"]
    patterns = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 6))) for _ in range(250)] + ["[a-c]*.py", "x[1.py", "*", "/*", "a/", "/a/b", "a/**"]
    patterns = [p for p in dict.fromkeys(patterns) if p.strip("/")]
    paths = ["".join(rng.choice(["a", "b", "c", "/", ".", "-", "!", "]", "[", "\\", "x1", "py"]) for _ in range(rng.randint(1, 7))) for _ in range(80)] + ["b.py", "x[1.py", "a/b/c", "a/bb", "q/b.py"]

    def owns(pattern, path):
        if pattern in ("*", "/*"):
            return True
        body = pattern.strip("/")
        if pattern.endswith("/"):
            return path == body or path.startswith(body + "/")
        if "/" not in body:
            return fnmatch.fnmatchcase(path, body) or fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], body)
        return fnmatch.fnmatchcase(path, body) or path.startswith(body + "/") or (body.endswith("/**") and path.startswith(body[:-3]))

    some = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "p string")
    # by the index, every pattern an entry: the last that fits
    found = {r.path: r.owners for r in owner_index.path_owners(some.select(F.col("p").alias("path")), [(x, [x]) for x in patterns]).collect()}
    assert found == {p: [x] for p in paths for x in [next((x for x in reversed(patterns) if owns(x, p)), None)] if x is not None}
    # and every pattern alone has a key that its paths have, or none
    index = owner_index.owner_index([(x, [x]) for x in patterns])
    assert len(index.rest) < len(patterns) and {len(k) for kind, k, *_ in index.rows if kind == "start"} == set(index.starts)
    for lo in range(0, len(patterns), 60):
        part = patterns[lo : lo + 60]
        rows = some.select("p", *[(F.size(context_rules.owners_of(F.col("p"), [(x, ["@o"])])) > 0).alias(f"c{i}") for i, x in enumerate(part)]).collect()
        wrong = [(x, r.p) for r in rows for i, x in enumerate(part) if r[f"c{i}"] != owns(x, r.p)]
        assert not wrong


def test_an_index_gives_what_each_pattern_gives(spark):
    """Entries a hunk and entries an index, on the same hunks; no pattern is tried at hunks."""
    entries = [(p, [f"@{i}"]) for i, p in enumerate(["*", "src/**", "docs/", "*.md", "*.test.py", "a?b.*", "**/x*.go", "q*", "lib/[a-c]*/z", "lib/a", "/lib/b/", "README", "src/*/deep.py", "we.ird*"] * 3)] + [("*.none", []), ("docs/own.md", ["@me", "@you"])]
    paths = ["x.py", "src/a", "srcs/a", "docs/y/z.md", "docs/own.md", "t/u.test.py", "t/acb.txt", "p/xy.go", "quick", "p/quick", "lib/ab/z", "lib/a/k", "lib/b/c", "lib/b", "README", "d/README", "src/q/deep.py", "we.irdly/p", "r.none", "a/b/c.none", ".md", "trailing/"]
    hunks = spark.createDataFrame([(1, i, 1, p) for i, p in enumerate(paths * 2)] + [(1, 999, 1, None)], "diff_id long, file_seq int, hunk_seq int, file_path string").withColumn("signals", none())
    assert len(entries) > context_rules.OWNERS_IN_ROW
    by_index = context_rules.with_owners(hunks, entries, "@ME")
    one = hunks.select("*", F.explode(F.array(context_rules.owners_of(context_rules.slashed("file_path"), entries))).alias("_owners"))
    tried = one.withColumn("signals", context_rules.owners("@ME"))
    of = lambda df: {(r.file_seq, s.reason) for r in df.collect() for s in r.signals}
    assert of(by_index) == of(tried) and by_index.count() == len(paths) * 2 + 1
    plan = by_index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [path") > 0 and "CASE WHEN RLIKE(file_path" not in plan


def test_thousands_of_entries_by_index(spark):
    entries = [("*", ["@all"])] + [(f"dir{i}/", [f"@o{i}"]) for i in range(5000)] + [("*.md", [])]
    rows = owner_index.path_owners(spark.createDataFrame([("dir7/x.py",), ("y.py",), ("dir9/a.md",), ("dir4999",)], "path string"), entries).collect()
    assert {r.path: r.owners for r in rows} == {"dir7/x.py": ["@o7"], "y.py": ["@all"], "dir9/a.md": [], "dir4999": ["@o4999"]}


def test_words_that_nobody_asks_for_are_not_shuffled(spark, tmp_path):
    (tmp_path / "t").mkdir()
    tree = spark.createDataFrame([(f"f{i}.py", " ".join(f"w{i}_{j}" for j in range(400)) + " load_user") for i in range(20)], "path string, text string")
    own = spark.createDataFrame([(1, 1, 1, "f0.py", "load_user"), (1, 1, 1, "f0.py", "nowhere"), (1, 1, 2, "other.py", "load_user")], "diff_id long, file_seq int, hunk_seq int, path string, symbol string")
    uses = context_rules.symbol_uses(own, tree)
    assert {(r.hunk_seq, r.symbol, r.uses) for r in uses.collect()} == {(1, "load_user", 19), (2, "load_user", 20)}
    words = context_rules._words_in(tree, own)
    assert words.count() <= 25  # of 8,020 words
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # that of the map


def test_bit_maps_keep_all_that_is_asked_for(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id") * 3).alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    rows = spark.range(15000).select(F.concat(F.lit("k"), F.col("id")).alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    kept = bitmap.maybe_among(rows, "key", bitmap.bit_map(keys, "key"))
    assert kept.join(keys, "key", "left_semi").count() == 5000 and kept.count() < 5100
    few = bitmap.maybe_among(rows, "key", bitmap.bit_map(keys, "key", bits=8), bits=8)
    assert few.join(keys, "key", "left_semi").count() == 5000  # a full map keeps all
    assert bitmap.maybe_among(rows, "key", bitmap.bit_map(keys.where("false"), "key")).count() == 0


def test_a_review_parses_its_diffs_once(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.patch").write_text(DIFF)
    tree = spark.createDataFrame([("z.py", "helper " * 30)], "path string, text string")
    read = lambda **o: review(connectors.read_diffs(spark, str(tmp_path / "d")), Options(**o))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")
    assert scans(read(no_tests=True, intent=F.lit("words of no kind"))) == 1
    with worktables.scope():
        full = read(no_tests=True, tree=tree, bodies=False)
        rows = full.collect()
        assert "body" not in full.columns and {s.rule for r in rows for s in r.signals} >= {"danger", "blast-radius", "no-tests"}
        # the text of diffs is behind: what is left starts at the written rows
        assert not any("a.patch" in f for f in full.inputFiles())
    plain = read(no_tests=True, tree=tree)
    assert {(r.id, r.raw, r["rank"]) for r in plain.collect()} == {(r.id, r.raw, r["rank"]) for r in rows} and "body" in plain.columns


def test_roll_ups_are_one_aggregate(spark):
    hunks = spark.createDataFrame([(1, 1, 2, 1), (1, 1, 3, 0), (1, 2, 1, 1), (2, 1, 0, 0), (None, 1, 4, 4)], "diff_id long, file_seq int, added int, removed int")
    out = parse.file_rollup(hunks)
    assert sorted(tuple(r) for r in out.where("diff_id is not null").collect()) == [(1, 0, 6, 2, 3), (1, 1, 5, 1, 2), (1, 2, 1, 1, 1), (2, 0, 0, 0, 1), (2, 1, 0, 0, 1)]
    assert sorted(tuple(r)[1:] for r in out.where("diff_id is null").collect()) == [(0, 4, 4, 1), (1, 4, 4, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_words_of_paths_without_their_extension(spark):
    hunks = spark.createDataFrame([("src/a.my_file_name", ""), ("src/report.TXT", ""), ("x.y/zed", ""), ("deep.er/name.tar.gz", "")], "file_path string, body string")
    assert [r.k for r in hunks.select(context_rules.hunk_keywords().alias("k")).collect()] == [["src", "file", "name"], ["src", "report"], ["zed"], ["deep", "name", "tar"]]


def test_last_entry_counts_and_thousands_are_taken(spark):
    entries = [("*", ["@all"])] + [(f"dir{i}/", [f"@o{i}"]) for i in range(1500)] + [("*.md", [])]
    rows = spark.createDataFrame([("dir7/x.py",), ("y.py",), ("dir9/a.md",)], "p string").select("p", context_rules.owners_of(F.col("p"), entries).alias("o")).collect()
    assert {r.p: r.o for r in rows} == {"dir7/x.py": ["@o7"], "y.py": ["@all"], "dir9/a.md": []}


def test_names_with_dollars_are_counted(spark):
    body = "+let $scope = 1\n+export const load$user = 2\n+const foo$ = 3\n+def plain_name(x):\n+let $a$a = 1"
    diff = f"--- a/own.js\n+++ b/own.js\n@@ -1 +1,5 @@\n{body}\n"
    tree = [("own.js", "load$user load$user plain_name"), ("b.js", "a$scope $scope load$user x.load$user;foo$ foo$b plain_name b$a$a$a"), ("c.js", "load$users b$scope$c ($scope)")]
    hunks = parse.parse_hunks(frame(spark, diff))
    uses = context_rules.symbol_uses(context_rules.hunk_symbols(hunks), spark.createDataFrame(tree, "path string, text string"))
    want = {}
    for name in ("$scope", "load$user", "foo$", "plain_name", "$a$a"):
        n = {path: len(re.findall(rf"\b{re.escape(name)}\b", text)) for path, text in tree}
        if any(n.values()):
            want[name] = sum(n.values()) - n["own.js"]
    assert {r.symbol: r.uses for r in uses.collect()} == want and want["$scope"] == 2 and want["foo$"] == 1


def test_quoted_paths_as_the_interpreter_reads_them(spark):
    rng = random.Random(1)
    signs = ["\\", "\\", "n", "t", "3", "0", "7", "x", "u", "a", "b", "é", '"', " ", "q", "'", "4", "1", "0"]
    paths = ['"' + "".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) + '"' for _ in range(800)] + ['"caf\\303\\251"', '"a\\U0001f600"', '"\\U99999999"', '"\\1"']

    def read(path):
        inner = path[1:-1]
        try:
            return inner.encode("latin-1", "backslashreplace").decode("unicode_escape")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return inner

    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", parse._unquoted(F.col("p")).alias("o")).collect()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert [(r.p, r.o) for r in rows if r.o != read(r.p)] == []


def test_settings(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    assert config.load_config(start=tmp_path).is_default
    file = tmp_path / config.FILE_NAME
    file.write_text('[weights]\nsize = 0\n"no-tests" = 2\n[[surface]]\npattern = "(^|/)pay"\npoints = 12\nreason = "pays"\n[profiles.mine]\nauth = 1.5\n')
    got = config.load_config(start=tmp_path / "deep" / "er")
    assert (got.weights, got.extra_surface, got.profiles, got.path) == ({"size": 0.0, "no-tests": 2.0}, (("(^|/)pay", 12, "pays"),), {"mine": {"auth": 1.5}}, file)
    (tmp_path / "deep" / config.FILE_NAME).write_text("")
    assert config.load_config(start=tmp_path / "deep" / "er").is_default  # the nearest counts
    assert config.load_config(explicit=file, enabled=False).is_default and not config.load_config(explicit=file).is_default
    bad = ["[weights]\ncontrol = 1", "[weights]\nsize = true", "[weights]\nsize = -1", "weights = 3", "surface = 3", "[[surface]]\npattern = '('\npoints = 1\nreason = 'x'", "[[surface]]\npattern = 'a'\npoints = 0\nreason = 'x'",
           "[[surface]]\npattern = 'a'\npoints = true\nreason = 'x'", "[[surface]]\npattern = 'a'\npoints = 1", "[profiles.x]\nnothing = 1", "[profiles.x]\nauth = -1", "[profiles.x]\nauth = true", "profiles = 1", "[profiles]\nx = 1", "not toml"]
    for text in bad:
        file.write_text(text)
        with pytest.raises(config.ConfigError, match="hunkwise.toml"):
            config.load_config(explicit=file)
    with pytest.raises(config.ConfigError):
        config.load_config(explicit=tmp_path / "none.toml")


def test_custom_profiles():
    assert profiles.composed(["backend", " mine ", ""], {"mine": {"auth": 2}})["auth"] == 2.6
    assert profiles.composed(["security"], {"security": {"ci": 3}}) == {"ci": 3.0}
    for custom in ({"x": {"nothing": 1}}, {"x": {"auth": -1}}, {"x": {"auth": True}}, {"x": 3}):
        with pytest.raises(profiles.ProfileError):
            Options(custom_profiles=custom)
    with pytest.raises(profiles.ProfileError):
        profiles.composed(["nobody"])


@pytest.fixture
def repo(tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *args], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a b.py").write_text("def load_user(): pass\n")
    (tmp_path / "c.py").write_text("load_user load_user load_user load_user load_user load_user\n")
    (tmp_path / "notes.md").write_text("load_user\n")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "CODEOWNERS").write_text("*.py @py\n")
    git("add", ".")
    git("commit", "-qm", "fix bug\n\nmore words")
    return tmp_path


def test_repositories(spark, repo, tmp_path_factory):
    tree = {r.path: r.text for r in connectors.repo_tree(spark, str(repo)).collect()}
    assert tree.keys() == {"a b.py", "c.py"} and tree["a b.py"].startswith("def load_user")
    history = connectors.repo_history(spark, str(repo)).collect()
    assert [(r.message, sorted(r.paths)) for r in history] == [("fix bug\n\nmore words", ["a b.py", "c.py", "docs/CODEOWNERS", "notes.md"])]
    assert connectors.find_codeowners(str(repo)) == "*.py @py\n"
    (repo / "CODEOWNERS").write_text("* @first\n")
    assert connectors.find_codeowners(str(repo)) == "* @first\n"
    (repo / "c.py").write_text("eval(x)\n")
    assert "+eval(x)" in connectors.git_diff(str(repo))
    assert connectors.git_diff(str(repo), staged=True) == ""
    with pytest.raises(connectors.SourceError, match="does not know"):
        connectors.git_diff(str(repo), range_spec="nowhere..HEAD")
    plain = tmp_path_factory.mktemp("plain")
    (plain / "node_modules").mkdir()
    (plain / "node_modules" / "x.js").write_text("x")
    (plain / "sub").mkdir()
    (plain / "sub" / "y.JS").write_text("y")
    (plain / "z.txt").write_text("z")
    with pytest.raises(connectors.SourceError, match="not a git repository"):
        connectors.git_diff(str(plain))
    assert connectors.repo_history(spark, str(plain)) is None and connectors.tracked_files(str(plain)) is None and connectors.find_codeowners(str(plain)) is None
    assert [(r.path, r.text) for r in connectors.repo_tree(spark, str(plain)).collect()] == [("sub/y.JS", "y")]
    (plain / "sub" / "y.JS").unlink()
    assert connectors.repo_tree(spark, str(plain)) is None

    def missing(*args, **kwargs):
        raise FileNotFoundError

    with pytest.raises(connectors.SourceError, match="cannot be run"):
        connectors.git_diff(str(repo), run=missing)
    assert connectors.intent_from_pr("7", run=missing) is None
    done = subprocess.CompletedProcess([], 0, " Title\nbody \n", "")
    seen = []
    assert connectors.intent_from_pr("7", "o/r", run=lambda argv, **k: (seen.append(argv), done)[1]) == "Title\nbody"
    assert seen[0][:5] == ["gh", "pr", "view", "-R", "o/r"] and connectors.intent_from_pr("7", run=lambda *a, **k: subprocess.CompletedProcess([], 1, "x", "")) is None


def test_backends(spark):
    hunks = review(frame(spark, DIFF, DIFF.replace("eval", "exec")))
    asked = enrich.requests(hunks)
    by_backend = {(r.diff_id, r.id, r.note) for r in enrich.notes_of(asked, enrich.EchoBackend()).collect()}
    assert by_backend == {(r.diff_id, r.id, r.note) for r in enrich.echo_notes(asked).collect()} and len(by_backend) == 4
    noted = enrich.enrich(hunks, env={enrich.VARIABLE: " Echo "}, top=1).orderBy("diff_id", "rank").collect()
    assert [[s.rule for s in r.signals if s.rule == "llm"] for r in noted] == [["llm"], [], ["llm"], []]
    assert {(r.diff_id, r.id, r.score, r["rank"]) for r in noted} == {(r.diff_id, r.id, r.score, r["rank"]) for r in hunks.collect()}
    assert enrich.enrich(hunks, top=0, env={}) is hunks
    for env in ({}, {enrich.VARIABLE: "nobody"}):
        with pytest.raises(enrich.EnrichmentError):
            enrich.enrich(hunks, env=env)

    class Broken:
        def explain(self, requests):
            raise RuntimeError("no network")

    class Odd:
        def explain(self, requests):
            return [1]

    for backend, words in ((Broken(), "no network"), (Odd(), "mapping")):
        with pytest.raises(Exception, match=words):
            enrich.enrich(hunks, backend).collect()


def test_wrapping_as_the_library_does(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  c-dé  ") for _ in range(rng.randint(0, 60))).lstrip() for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", render.wrapped(F.col("t"), F.lit(12)).alias("w")).collect()
    assert all(r.w == (textwrap.wrap(r.t, 12, break_long_words=False, break_on_hyphens=False) or [""]) for r in rows)


def test_documents_of_diffs_without_hunks(spark):
    diffs = frame(spark, DIFF, "", None)
    hunks = review(diffs)
    blocks = budgets.within(render.bundle_blocks(hunks), budgets.Budget(tokens=50), render.block_cost())
    for documents, empty in (
        (render.menu(hunks, diffs=diffs), "nothing to taste"), (render.markdown(hunks, diffs=diffs), "Nothing to taste"), (render.json_documents(hunks, diffs), "[]"),
        (render.sarif(hunks, diffs=diffs, title="T"), '"results":[]'), (render.bundle(blocks, "Why", diffs), "nothing to review"),
    ):
        rows = {r.diff_id: r.document for r in documents.collect()}
        assert rows.keys() == {0, 1, 2} and empty in rows[1] == rows[2] and "login.py" in rows[0]
    document = render.bundle(blocks, " Why ", diffs).where("diff_id = 0").first().document
    assert "**Stated intent:** Why" in document and document.endswith("_Budget reached: showing the 1 highest-risk of 2 hunks; 1 lower-risk hunk omitted._")
    coloured = render.menu(hunks, color=True).first().document
    assert "\x1b[1;31mGULP\x1b[0m" in coloured and "█" in coloured


def test_colour_tables(spark):
    """Columns, a cut row and folded lines; without colours the words are those of the plain menu's rows."""
    long = DIFF.replace("src/auth/login.py", "src/auth/" + "deep" * 30 + "/login.py")
    hunks = budgets.within(review(frame(spark, DIFF, long)), budgets.Budget(hunks=1))
    out = {r.diff_id: r.document.split("\n") for r in render.menu(hunks, budgets.Budget(hunks=1), width=100, color=True).collect()}
    plain = {d: [re.sub("\x1b\\[[0-9;]*m", "", line) for line in lines] for d, lines in out.items()}
    assert plain[0][:3] == ["🍷 hunkwise — 2 hunks across 2 files · top risk 80", " # ┃ TIER ┃ SCR ┃ RISK                 ┃ WHY", "━━━╇━━━━━━╇━━━━━╇━━━━━━━━━━━━━━━━━━━━━━╇" + "━" * 60]
    assert plain[0][3].startswith(" 1 │ GULP │  80 │ ████████████████░░░░ │ src/auth/login.py:1  adds dynamic eval/exec (+16); touches")
    assert plain[0][-3:] == ["── │ CUT  │ ─── │ ──────────────────── │ review 1 above · skim 1 below · budget 1 of 2 hunks", " 2 │ SAVR │   0 │ ░░░░░░░░░░░░░░░░░░░░ │ README.md:1  (no notable signals — skim-safe)", "Tiers: GULP (read first, ≥60) · SIP (read, ≥25) · SAVR (skim-safe, <25).  Listed most-risky-first."]
    assert all(len(line) <= 100 for line in plain[1][1:-1])
    at = [line for line in plain[1][3:-3]]
    assert all(line.startswith("   │      │     │                      │ ") for line in at[1:]) and "".join(line[41:] for line in at).startswith("src/auth/" + "deep" * 30 + "/login.py:1")
    assert "\x1b[1;31mGULP\x1b[0m" in out[0][3] and "\x1b[1msrc/auth/login.py:1\x1b[0m" in out[0][3] and "\x1b[1;36mCUT \x1b[0m" in out[0][-3] and "\x1b[32mSAVR\x1b[0m" in out[0][-1]
    words = lambda lines: " ".join(" ".join(lines).split())
    text = render.menu(hunks, budgets.Budget(hunks=1), width=100).where("diff_id = 0").first().document
    assert words(x.split("│")[-1] for x in plain[0][3:5]) == words([text.split("\n")[4][41:], *[x for x in text.split("\n")[5:6] if x.startswith("    ")]])


def run(spark, capsys, *argv, diff=DIFF, repo="."):
    code = cli.main(["--no-config", *argv] if "--config" not in argv else list(argv), io.StringIO(diff), spark, str(repo))
    said = capsys.readouterr()
    return code, said.out, said.err


def test_command_line(spark, capsys, repo, tmp_path, monkeypatch):
    code, out, _ = run(spark, capsys)
    assert code == 0 and out.startswith("🍷 hunkwise — 2 hunks across 2 files · top risk 80") and out.rstrip().endswith("Listed most-risky-first.")
    code, out, _ = run(spark, capsys, "--budget", "1")
    assert "cut: review 1 above · skim 1 below · budget 1 of 2 hunks" in out
    code, out, err = run(spark, capsys, "--json", "--fail-over", "80", "--budget", "nonsense")
    assert code == 1 and [r["score"] for r in json.loads(out)] == [80, 0] and "80" in err
    assert run(spark, capsys, "--json", "--fail-over", "81")[0] == 0
    assert "CI gate" in run(spark, capsys, "--markdown", "--fail-over", "60", "--title", "Mine")[1]
    log = json.loads(run(spark, capsys, "--sarif", "--title", "Mine", "--fail-over", "90")[1])
    assert log["runs"][0]["properties"] == {"title": "Mine", "failOver": 90} and [r["level"] for r in log["runs"][0]["results"]] == ["error", "note"]
    assert "### 1. src/auth/login.py:1 — gulp (risk 80)" in run(spark, capsys, "--context-budget", "1hunk")[1]
    assert "nothing to taste" in run(spark, capsys, diff="")[1]
    for argv in (["--budget", "soon"], ["--context-budget", "5m"], ["--as", "nobody"], ["--config", str(tmp_path / "none")], ["--range", "no..where"]):
        code, out, err = run(spark, capsys, *argv, repo=repo)
        assert code == 2 and err.startswith("hunkwise: ") and not out
    monkeypatch.delenv(enrich.VARIABLE, raising=False)
    assert run(spark, capsys, "--explain-llm")[0] == 2 and run(spark, capsys, "--explain-llm", "--explain-llm-top", "0")[0] == 0 and run(spark, capsys, "--explain-llm", diff="")[0] == 0
    monkeypatch.setenv(enrich.VARIABLE, "echo")
    assert "model: [echo]" in run(spark, capsys, "--explain-llm")[1]
    with pytest.raises(SystemExit) as e:
        cli.main(["--json", "--sarif"])
    assert e.value.code == 2


def test_command_line_in_a_repository(spark, capsys, repo):
    (repo / "a b.py").write_text("def load_user():\n    eval(x)\n")
    (repo / "new.toml").write_text("[weights]\ndanger = 0\n")
    flags = ["--blast-radius", "--hotspots", "--owners", "--author", "@me", "--no-tests", "--intent", "spelling of words", "--as", "backend,security"]
    code = cli.main(["--range", "HEAD", "--json", "--no-config", *flags], spark=spark, repo=str(repo))
    rules = {s["rule"] for r in json.loads(capsys.readouterr().out) for s in r["signals"]}
    assert code == 0 and rules >= {"danger", "blast-radius", "owners", "no-tests", "intent"}
    assert cli.main(["--range", "HEAD", "--json", "--config", str(repo / "new.toml")], spark=spark, repo=str(repo)) == 0
    assert "danger" not in capsys.readouterr().out
    (repo / "d").mkdir()
    (repo / "d" / "one.patch").write_text(DIFF)
    (repo / "d" / "two.patch").write_text(DIFF)
    assert cli.main(["--diffs", str(repo / "d"), "--no-config"], spark=spark, repo=str(repo)) == 0
    assert capsys.readouterr().out.count("top risk 80") == 2
