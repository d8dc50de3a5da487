"""The command line: every output, budget, gate, source and flag."""

import io
import json
import re
import subprocess
import sys

import pytest

from hunkwise import __version__, cli
from hunkwise.operators import enrich

SAMPLE = """diff --git a/src/auth/login.py b/src/auth/login.py
--- a/src/auth/login.py
+++ b/src/auth/login.py
@@ -1,2 +1,4 @@ def helper():
 x
+api_key = "abcdef123456"
+eval(x)
diff --git a/src/app.py b/src/app.py
--- a/src/app.py
+++ b/src/app.py
@@ -10,2 +10,2 @@ def thing():
-    return 1
+    return 2
@@ -20 +20,2 @@ def other():
 x = 1
+subprocess.run(y)
diff --git a/README.md b/README.md
--- a/README.md
+++ b/README.md
@@ -1 +1,2 @@
 words
+more words
"""


class Piped(io.StringIO):
    def isatty(self):
        return False


@pytest.fixture
def cut(spark, capsys, tmp_path):
    """(exit code, what it said, what it complained) of a run over a diff."""

    def run(*argv, diff=SAMPLE, repo=None, config=False):
        code = cli.main([*([] if config else ["--no-config"]), *argv], Piped(diff), spark, str(repo or tmp_path))
        said = capsys.readouterr()
        return code, said.out, said.err

    return run


def git(folder, *args):
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *args], cwd=folder, check=True, capture_output=True)


def test_version():
    out = subprocess.run([sys.executable, "-m", "hunkwise", "--version"], capture_output=True, text=True)
    assert out.returncode == 0 and __version__ in out.stdout


def test_menus(cut):
    code, out, err = cut()
    lines = out.splitlines()
    assert code == 0 and not err and lines[0] == "🍷 hunkwise — 4 hunks across 3 files · top risk 92"
    assert [x.split()[0] for x in lines[4:] if re.match(r"  +\d", x)] == ["1", "2", "3", "4"] and lines[-1].startswith("Tiers: GULP (read first, ≥60)")
    assert "\x1b[" not in out and cut("--no-color")[1] == out
    code, out, _ = cut(diff="")
    assert code == 0 and "nothing to taste (0 hunks)" in out
    assert cut(diff="words, but no diff\n")[1] == out


def test_json(cut):
    rows = json.loads(cut("--json")[1])
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True) and len(rows) == 4
    top = rows[0]
    assert top["file"] == "src/auth/login.py" and top["new_start"] == 1 and (top["added"], top["removed"]) == (2, 0) and len(top["id"]) == 12
    assert [s["points"] for s in top["signals"]] == sorted((s["points"] for s in top["signals"]), reverse=True) and sum(s["points"] for s in top["signals"]) == top["raw"]
    assert json.loads(cut("--json", diff="")[1]) == []


def test_markdown_and_its_gate(cut):
    code, out, err = cut("--markdown", "--title", "Read this", "--fail-over", "90")
    assert code == 1 and "Read this" in out and "92" in err and out.count("\n| ") >= 4 and "`src/auth/login.py:1`" in out
    assert cut("--markdown", "--fail-over", "93")[0] == 0
    code, out, _ = cut("--markdown", diff="")
    assert code == 0 and "Nothing to taste" in out


def test_sarif(cut):
    code, out, _ = cut("--sarif", "--title", "A log", "--fail-over", "10")
    log = json.loads(out)
    run = log["runs"][0]
    assert code == 1 and log["version"] == "2.1.0" and run["properties"] == {"title": "A log", "failOver": 10}
    assert [r["level"] for r in run["results"]] == ["error", "warning", "note", "note"] and run["tool"]["driver"]["version"] == __version__
    assert {r["ruleId"] for r in run["results"]} <= {r["id"] for r in run["tool"]["driver"]["rules"]}
    empty = json.loads(cut("--sarif", diff="")[1])
    assert empty["runs"][0]["results"] == []


def test_bundles(cut):
    code, out, _ = cut("--context-budget", "2hunks", "--title", "Because")
    assert code == 0 and "**Stated intent:** Because" in out and out.count("### ") == 2 and "2 lower-risk hunks omitted" in out and "+eval(x)" in out
    assert cut("--context-budget", "100000tok")[1].count("### ") == 4 and "omitted" not in cut("--context-budget", "9")[1]
    small = cut("--context-budget", "1tok")[1]
    assert small.count("### ") == 1  # the first is shown whatever it costs
    assert cut("--context-budget", "2hunks", "--fail-over", "50")[0] == 1
    code, out, _ = cut("--context-budget", "2hunks", diff="")
    assert code == 0 and "nothing to review" in out
    for bad in ("0hunks", "soon", "5m", "-1tok"):
        code, out, err = cut("--context-budget", bad) if not bad.startswith("-") else cut(f"--context-budget={bad}")
        assert code == 2 and not out and bad in err


def test_budgets(cut):
    assert "cut: review 2 above · skim 2 below · budget 2 of 4 hunks" in cut("--budget", "2hunks")[1]
    out = cut("--budget", "25s")[1]
    assert re.search(r"cut: review \d above · skim \d below · budget 25s · ≈\d+s above", out)
    assert "cut:" not in cut("--budget", "1h")[1] and "cut:" not in cut("--budget", "4")[1]
    assert cut("--budget", "2", "--json")[1] == cut("--json")[1]  # a menu's alone
    assert cut("--budget", "nonsense", "--json")[0] == 0
    code, out, err = cut("--budget", "nonsense")
    assert code == 2 and not out and "nonsense" in err
    code, out, _ = cut("--budget", "1", "--fail-over", "92")
    assert code == 1 and "cut: review 1 above" in out


def test_outputs_exclude_one_another(cut):
    outputs = (["--json"], ["--markdown"], ["--sarif"], ["--context-budget", "2"])
    for i, one in enumerate(outputs):
        for other in outputs[i + 1 :]:
            with pytest.raises(SystemExit) as e:
                cut(*one, *other)
            assert e.value.code == 2
    for argv in (["--staged", "--range", "a..b"], ["--staged", "--diffs", "x"], ["--config", "x", "--no-config"], ["--fail-over", "x"], ["--nothing"]):
        with pytest.raises(SystemExit) as e:
            cli.main(argv)
        assert e.value.code == 2


def test_terminals_are_asked_for_a_diff(spark, capsys):
    class Terminal(io.StringIO):
        def isatty(self):
            return True

    assert cli.main([], Terminal(), spark) == 0
    said = capsys.readouterr()
    assert "usage:" in said.out and "no diff on standard input" in said.err


def test_profiles_reorder(cut):
    top = lambda *argv: [(r["file"], r["raw"]) for r in json.loads(cut("--json", *argv)[1])]
    plain, security = top(), top("--as", "security")
    assert dict(security)["src/auth/login.py"] > dict(plain)["src/auth/login.py"]
    assert top("--as", "backend,security") == top("--as", "backend", "--as", "security")
    assert "% by profile: security)" in cut("--json", "--as", "security")[1]
    code, out, err = cut("--as", "backend,nobody")
    assert code == 2 and not out and "nobody" in err


def test_settings_of_a_folder(cut, tmp_path):
    (tmp_path / ".hunkwise.toml").write_text('[weights]\ndanger = 0\n[[surface]]\npattern = "^README"\npoints = 30\nreason = "touches the words"\n[profiles.words]\nauth = 3\n')
    rows = json.loads(cut("--json", config=True)[1])
    assert rows[0]["file"] == "README.md" and rows[0]["signals"] == [{"rule": "surface", "points": 30, "reason": "touches the words"}]
    assert not any(s["rule"] == "danger" for r in rows for s in r["signals"])
    assert json.loads(cut("--json")[1])[0]["file"] == "src/auth/login.py"  # --no-config
    assert json.loads(cut("--json", "--as", "words", config=True)[1])[0]["file"] == "src/auth/login.py"
    assert cut("--as", "words")[0] == 2
    (tmp_path / ".hunkwise.toml").write_text("[weights]\nnothing = 1\n")
    code, out, err = cut(config=True)
    assert code == 2 and not out and ".hunkwise.toml" in err and "nothing" in err
    assert cut("--config", str(tmp_path / "none.toml"), config=True)[0] == 2


def test_notes(cut, monkeypatch):
    monkeypatch.delenv(enrich.VARIABLE, raising=False)
    for argv in (["--explain-llm"], ["--explain-llm", "--json"]):
        code, out, err = cut(*argv)
        assert code == 2 and not out and enrich.VARIABLE in err
    monkeypatch.setenv(enrich.VARIABLE, "nobody")
    assert cut("--explain-llm")[0] == 2 and "nobody" in cut("--explain-llm")[2]
    monkeypatch.setenv(enrich.VARIABLE, "echo")
    rows = json.loads(cut("--explain-llm", "--explain-llm-top", "2", "--json")[1])
    assert [[s["points"] for s in r["signals"] if s["rule"] == "llm"] for r in rows] == [[0], [0], [], []]
    assert [r["score"] for r in rows] == [r["score"] for r in json.loads(cut("--json")[1])]
    assert "model: [echo]" in cut("--explain-llm")[1] and "(+0)" not in cut("--explain-llm")[1] and "model:" not in cut()[1]


def test_a_repository_gives_diff_tree_history_and_owners(cut, spark, capsys, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    git(repo, "init", "-q")
    (repo / "core.py").write_text("def widely_used(x):\n    return 1\n")
    for i in range(8):
        (repo / f"user{i}.py").write_text("from core import widely_used\nwidely_used(1)\n")
    (repo / "CODEOWNERS").write_text("*.py @core-team\n")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "first")
    for i in range(6):
        (repo / "core.py").write_text(f"def widely_used(x):\n    return {i + 2}\n")
        git(repo, "commit", "-qam", f"fix number {i}")
    (repo / "core.py").write_text("def widely_used(x):\n    return 9\n")
    git(repo, "add", ".")
    rules = lambda *argv: {s["rule"]: s for r in json.loads(cut("--json", *argv, repo=repo)[1]) for s in r["signals"]}
    assert rules("--staged") == {} and json.loads(cut("--json", "--range", "HEAD~1..HEAD", repo=repo)[1])[0]["file"] == "core.py"
    got = rules("--staged", "--blast-radius", "--hotspots", "--owners", "--author", "@me")
    assert got.keys() == {"blast-radius", "hotspots", "owners"} and "'widely_used' is widely used (16 places" in got["blast-radius"]["reason"]
    assert got["hotspots"]["reason"] == "hotspot: file a top change hotspot and is repeatedly fixed (7 commits, 6 fixes)" and got["owners"]["points"] == 8
    assert rules("--staged", "--owners") == {} and rules("--staged", "--owners", "--author", "@core-team") == {}  # no author; an owner
    (repo / ".hunkwise.toml").write_text('[weights]\n"blast-radius" = 0\nhotspots = 2\nowners = 0\n')
    weighed = {s["rule"]: s["points"] for r in json.loads(cut("--json", "--staged", "--blast-radius", "--hotspots", "--owners", "--author", "@me", repo=repo, config=True)[1]) for s in r["signals"]}
    assert weighed == {"hotspots": 2 * got["hotspots"]["points"]}
    code, out, err = cut("--range", "nowhere..HEAD", repo=repo)
    assert code == 2 and not out and "does not know" in err
    # flags are harmless where there is no repository
    plain = tmp_path / "plain"
    plain.mkdir()
    assert cut("--json", "--blast-radius", "--hotspots", "--owners", "--author", "@me", repo=plain)[1] == cut("--json", repo=plain)[1]
    code, _, err = cut("--staged", repo=plain)
    assert code == 2 and "not a git repository" in err


def test_tests_and_intent(cut):
    rules = lambda *argv, diff=SAMPLE: [(r["file"], s["points"]) for r in json.loads(cut("--json", *argv, diff=diff)[1]) for s in r["signals"] if s["rule"] in ("no-tests", "intent")]
    assert rules() == [] and rules("--no-tests") == [("src/auth/login.py", 9), ("src/app.py", 9)]
    touched = SAMPLE + "diff --git a/tests/test_login.py b/tests/test_login.py\n--- a/tests/test_login.py\n+++ b/tests/test_login.py\n@@ -1 +1 @@\n-a\n+b\n"
    assert rules("--no-tests", diff=touched) == [("src/app.py", 6)]
    assert ("README.md", 12) in rules("--intent", "login keys") and ("src/auth/login.py", 12) not in rules("--intent", "login keys")
    assert rules("--intent", "  ") == []
