from hunkwise.operators import budgets, context_rules
from hunkwise.operators.parse import parse_files, parse_hunks
from hunkwise.plans.review import Options, review
from pyspark.sql import functions as F
import pytest

DIFF = """diff --git a/src/auth/login.py b/src/auth/login.py
--- a/src/auth/login.py
+++ b/src/auth/login.py
@@ -1,2 +1,3 @@ def helper():
 x
-if i < n:
+if i <= n:
+eval(x)
diff --git a/README.md b/README.md
--- a/README.md
+++ b/README.md
@@ -1 +1,2 @@
 a
+b
"""
ODD = """diff --git a/q.sql b/q.sql
--- a/q.sql
+++ b/q.sql
@@ -1,2 +1,1 @@
 a
--- dropped
+lost
@@ -9 +9 @@
-x
+y
diff --git a/b.bin b/b.bin
new file mode 100644
Binary files /dev/null and b/b.bin differ
diff --git a/old name b/new name
rename from old name
rename to new name
"""


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "diff_id long, text string")


def test_parse(spark):
    rows = parse_hunks(frame(spark, DIFF, None, "", "no diff")).orderBy("file_seq").collect()
    assert [(r.file_path, r.old_start, r.old_lines, r.new_lines, r.heading, r.added, r.removed) for r in rows] == [("src/auth/login.py", 1, 2, 3, " def helper():", 2, 1), ("README.md", 1, 1, 2, "", 1, 0)]


def test_parser_quirks(spark):
    rows = parse_hunks(frame(spark, ODD)).orderBy("hunk_seq").collect()
    assert [r.body for r in rows] == [" a", "-x\n+y"]  # a removed comment ends the body; the next hunk goes on
    files = {r.path: r for r in parse_files(frame(spark, ODD)).collect()}
    assert files["b.bin"].is_binary and files["b.bin"].change_type == "added"
    assert (files["new name"].change_type, files["new name"].old_path) == ("renamed", "old name")


def test_plain_diff_and_line_ends(spark):
    text = "--- old.txt\t2020\r\n+++ new.txt\t2021\r\n@@ -1 +1 @@\r\n-a\r\n+é\r\n"
    r = parse_hunks(frame(spark, text)).first()
    assert (r.file_path, r.body) == ("new.txt", "-a\n+é")


def test_scores(spark):
    rows = review(frame(spark, DIFF)).orderBy("rank").collect()
    assert [(r.file_path, r.raw, r.score, r.tier) for r in rows] == [("src/auth/login.py", 30, 80, "gulp"), ("README.md", 0, 0, "savor")]
    reasons = [s.reason for s in review(frame(spark, DIFF), Options(pack="library")).where("rank = 1").first().signals]
    assert "comparison operator changed (· → <=) — off-by-one risk" in reasons


def test_owner_patterns(spark):
    entries = [("*", ["@a"]), ("docs/", ["@d"]), ("*.md", []), ("/src/api/**", ["@s"]), ("a*", ["@x"])]
    paths = ["x.py", "docs/y/z", "q/r.md", "src/apiary/x", "lib/ab/c", "lib/ab"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", context_rules.owners_of(F.col("p"), entries).alias("o")).collect()
    assert {r.p: r.o for r in rows} == {"x.py": ["@a"], "docs/y/z": ["@d"], "q/r.md": [], "src/apiary/x": ["@s"], "lib/ab/c": ["@a"], "lib/ab": ["@x"]}


def test_budget_grammar():
    assert budgets.parse_budget("1h 30M").seconds == 5400 and budgets.parse_budget("5 hunks").hunks == 5 and budgets.parse_budget(" 12 ").hunks == 12
    assert budgets.parse_context_budget("2000 Tok").tokens == 2000 and budgets.parse_context_budget("8hunk").hunks == budgets.parse_context_budget("8").hunks == 8
    for bad in ("", "0", "x", "-3m", "0s", "2000tok", "5m x", "m5", None):
        with pytest.raises(budgets.BudgetError):
            budgets.parse_budget(bad)
    for bad in ("", "0tok", "5m", "1h30m", "tok", None):
        with pytest.raises(budgets.BudgetError):
            budgets.parse_context_budget(bad)


def test_options():
    with pytest.raises(ValueError):
        Options(weights={"control": 1.0})
