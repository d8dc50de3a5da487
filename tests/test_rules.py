"""Corner cases of every rule, many hunks a job: what fires, how often it is said, and what stays quiet."""

import pytest
from pyspark.sql import functions as F

from hunkwise.functions.signals import none
from hunkwise.operators import context_rules, rules
from hunkwise.operators.parse import parse_hunks
from hunkwise.plans.review import Options, review


def hunk(path, body, heading="", kind=""):
    old, new = ("/dev/null" if kind == "added" else f"a/{path}"), ("/dev/null" if kind == "deleted" else f"b/{path}")
    mode = {"added": "new file mode 100644\n", "deleted": "deleted file mode 100644\n"}.get(kind, "")
    return f"diff --git a/{path} b/{path}\n{mode}--- {old}\n+++ {new}\n@@ -1 +1 @@{' ' if heading else ''}{heading}\n{body}\n"


def judged(spark, signals, cases):
    """{name: [(points, reason)]} of cases name -> diff text."""
    names = list(cases)
    frame = spark.createDataFrame([(i, cases[n]) for i, n in enumerate(names)], "diff_id long, text string")
    rows = rules.with_text(parse_hunks(frame)).withColumn("signals", signals()).select("diff_id", "file_seq", "hunk_seq", "signals").collect()
    out = {n: [] for n in names}
    for r in sorted(rows):
        out[names[r.diff_id]] += [(s.points, s.reason) for s in r.signals]
    return out


def test_size_by_changed_lines(spark):
    lines = lambda a, r, c=0: "\n".join([*["+x"] * a, *["-y"] * r, *[" z"] * c])
    of = {"14": (14, 0), "15": (15, 0), "both": (8, 7), "39": (20, 19), "40": (40, 0), "99": (0, 99), "100": (100, 0), "199": (100, 99), "200": (0, 200), "context": (3, 3, 300)}
    got = judged(spark, rules.size, {n: hunk("a.py", lines(*v)) for n, v in of.items()})
    assert {n: [p for p, _ in s] for n, s in got.items()} == {"14": [], "15": [3], "both": [3], "39": [3], "40": [7], "99": [7], "100": [12], "199": [12], "200": [18], "context": []}
    assert got["both"] == [(3, "moderate hunk: 15 changed lines (+8/-7)")] and got["200"][0][1] == "very large hunk: 200 changed lines (+0/-200)"


def test_surface_by_path(spark):
    of = {
        "src/app.py": [], "src/auth/session.py": ["authentication/session", ], "login.py": ["authentication"], "src/author.py": [], "pkg/crypto/aes.go": ["cryptography"], "x/secrets.py": [], "x/secret_store.py": ["cryptography"],
        "db/migrations/0001.py": ["migration"], "schema.sql": ["migration"], ".github/workflows/ci.yml": ["CI workflow"], "Dockerfile": ["container/build"], "docker-compose.prod.yml": ["container/build"], ".gitlab-ci.yml": ["CI/CD pipeline"],
        "sub/Jenkinsfile": ["CI/CD pipeline"], "package.json": ["dependencies"], "requirements-dev.txt": ["dependencies"], "go.mod": ["dependencies"], "my_package.json": [], "yarn.lock": ["lockfile"], "Cargo.lock": ["lockfile"], ".env": ["environment"],
        ".env.local": ["environment"], "x.env": [], "src\\auth\\login.py": ["authentication"], "PACKAGE.JSON": ["dependencies"], "auth/migrations/crypto.py": ["authentication", "cryptography", "migration"],
    }
    got = judged(spark, rules.surface, {p: hunk(p, "+x") for p in of})
    for path, words in of.items():
        assert len(got[path]) == len(words) and all(w in r for w, (_, r) in zip(words, got[path])), path
    assert dict(got)["yarn.lock"][0][0] < got["package.json"][0][0]


def test_dangers_of_added_lines(spark):
    of = {
        "+x = 1\n+y = 2": [], "+result = eval(payload)": [(16, "adds dynamic eval/exec")], "-result = eval(payload)": [(4, "net deletion (-1/+0)")], "+evaluate(x)": [], "+EXEC (x)": [(16, "adds dynamic eval/exec")],
        "+eval(a)\n+eval(b)\n+eval(c)": [(16, "adds dynamic eval/exec (x3)")], "+eval(a) + eval(b)": [(16, "adds dynamic eval/exec (x2)")],
        "+subprocess.run(cmd, shell=True)": [(10, "adds a shell/subprocess call"), (8, "uses shell=True")], "+pickle.load(f)": [(10, "adds pickle deserialization")], "+pickle.dump(f)": [],
        '+api_key = "abcdef123456"': [(18, "adds a hardcoded secret-looking literal")], "+password: 'longer than six'": [(18, "adds a hardcoded secret-looking literal")], '+token = "short"': [], "+token = os.environ['TOKEN_NAME']": [],
        "+-----BEGIN RSA PRIVATE KEY-----": [(20, "adds an embedded private key")], "+-----BEGIN CERTIFICATE-----": [], "+chmod 777 f": [(9, "changes file permissions")], "+chmod +x f": [(9, "changes file permissions")], "+sudo rm -rf x": [(8, "invokes elevated privileges")],
        "+pseudo code": [], "+requests.get(u, verify=False)": [(14, "disables TLS/cert verification")], "+ssl.CERT_NONE": [(14, "disables TLS/cert verification")], "+Access-Control-Allow-Origin: *": [(8, "opens CORS to all origins")],
        '+cur.execute(f"SELECT * FROM users WHERE id={u}")': [(9, "adds raw SQL")], "+please select one from": [(9, "adds raw SQL")], "+selected from": [], " eval(x)\n+y": [], "+a\n-b": [], "+a\n-b\n-c": [(4, "net deletion (-2/+1)")],
        "\n".join(["-x"] * 60): [(10, "large deletion: -60 lines")], "\n".join(["-x"] * 60 + ["+y"] * 70): [(10, "large deletion: -60 lines")], '+eval(x)\n+api_key = "abcdef123456"': [(16, "adds dynamic eval/exec"), (18, "adds a hardcoded secret-looking literal")],
    }
    got = judged(spark, rules.danger, {b: hunk("a.py", b) for b in of} | {"deleted": hunk("a.py", "-x", kind="deleted"), "emptied": hunk("a.py", "\n".join(["-x"] * 99), kind="deleted"), "new": hunk("a.py", "+x", kind="added")})
    assert {b: sorted(s) for b, s in got.items()} == {b: sorted(s) for b, s in of.items()} | {"deleted": [(12, "deletes a file")], "emptied": [(12, "deletes a file")], "new": []}


def test_control_flow_of_changed_lines(spark):
    of = {
        "+# this used to be a range() loop\n+# and an if branch": [], "+x = 1\n+y = 2": [], "-if i < n:\n+if i <= n:": ["comparison operator changed (· → <=)", "conditional"], "-if i < n:\n+if i < m:": ["conditional"],
        "+    except:\n+        pass": ["bare or swallowed", "error-handling"], "+    except ValueError: pass": ["bare or swallowed", "error-handling"], "+    try:\n+        do()\n+    except KeyError as e:\n+        handle(e)": ["error-handling flow (try/except/finally) (x2)"],
        "+    raise ValueError(x)": ["changes a raise"], "-if not ready:\n+if ready:": ["negation removed", "conditional"], "-if ready:\n+if not ready:": ["negation added", "conditional"], "+    while i < n:": ["loop bound"],
        "+    for i in range(len(xs) - 1):": ["loop bound", "index/bound arithmetic"], "+    if a and b or c:": ["conditional", "boolean logic"], "+        return None": ["early return/continue/break"], "+    if a:\n+    if b:\n+    if c:": ["conditional (x3)"],
        " if context:\n+x": [], "-    break": ["early return/continue/break"], "+x = a if b else c": ["conditional"], "+orb = android": [], "+returned = 1": [], "+i = j + 1": ["index/bound arithmetic"], "+i = j + 2": [],
    }
    got = judged(spark, rules.control, {b: hunk("a.py", b) for b in of})
    for body, words in of.items():
        reasons = [r for _, r in got[body]]
        assert len(reasons) == len(words) or body.startswith("-if"), (body, reasons)
        assert all(any(w in r for r in reasons) for w in words), (body, reasons)


@pytest.mark.parametrize("asked", ["fix typo in README", "fix login session expiry bug", "refactor the authentication layer " + "blah " * 40])
def test_intent_by_shared_words(spark, asked):
    of = {"same": ("src/auth/session.py", "+login(session)"), "case": ("src/AUTH/Session.py", "+x = Login"), "other": ("db/migrations/0007_users.py", "+def upgrade():\n+    table.create()"), "read": ("docs/README.md", "+welcome text"), "none": ("x", "+   ")}
    got = judged(spark, none, {n: hunk(*v) for n, v in of.items()})
    assert not any(got.values())
    frame = spark.createDataFrame([(i, hunk(*v)) for i, v in enumerate(of.values())], "diff_id long, text string")
    rows = context_rules.with_intent(parse_hunks(frame).withColumn("signals", none()), F.lit(asked)).collect()
    out = {list(of)[r.diff_id]: [(s.points, s.reason) for s in r.signals] for r in rows}
    assert out["none"] == [] and out["other"][0][0] == 12 and "migrations" in out["other"][0][1] and "no" in out["other"][0][1]
    if "README" in asked:
        assert out["read"] == [] and out["same"][0][0] == 12
    elif "login" in asked:
        assert out["same"] == out["case"] == [] and out["read"][0][0] == 12
    else:
        assert "…" in out["other"][0][1] and len(out["other"][0][1]) < 200


def test_intent_that_says_nothing(spark):
    frame = spark.createDataFrame([(0, hunk("a/b.py", "+words"))], "diff_id long, text string")
    hunks = parse_hunks(frame).withColumn("signals", none())
    for asked in ("", "   ", "fix the and or to", None):
        assert context_rules.with_intent(hunks, F.lit(asked).cast("string")).first().signals == []


def test_paths_of_tests(spark):
    yes = ["tests/test_parser.py", "test/x.py", "parser_test.py", "pkg/parser_test.go", "src/foo.test.ts", "src/foo.spec.js", "__tests__/foo.js", "TestFoo.java", "a\\tests\\b.py", "Tests/X.py", "testing.py"]
    no = ["src/parser.py", "src/app.ts", "main.go", "README.md", "attest/x.py", "src/latest/x.py", "contest.go", "test", "specs/x.py"]
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string").select("p", context_rules.is_test("p").alias("t")).collect()
    assert [r.p for r in rows if r.t] == yes


def test_changes_without_tests(spark):
    big = lambda p: hunk(p, "-old\n" + "\n".join(["+line"] * 120))
    small = lambda p: hunk(p, "-old\n+new")
    of = {
        "alone": big("src/foo.py"), "own test": big("src/foo.py") + small("tests/test_foo.py"), "other test": big("src/foo.py") + small("tests/test_other.py"), "folder of tests": big("src/foo.py") + small("tests/foo/test_cases.py"), "suffix": big("src/Foo.ts") + small("src/foo.spec.ts"), "go": big("pkg/foo.go") + small("pkg/foo_test.go"),
        "trivial": small("src/foo.py"), "test itself": big("tests/test_foo.py"), "words": big("README.md"), "data": big("x/foo.json"), "two": big("src/foo.py") + big("src/bar.py") + small("tests/test_foo.py"), "binary test": big("src/foo.py") + "diff --git a/tests/foo.png b/tests/foo.png\nBinary files a/tests/foo.png and b/tests/foo.png differ\n",
    }
    frame = spark.createDataFrame(list(enumerate(of.values())), "diff_id long, text string")
    out = {n: [] for n in of}
    for r in review(frame, Options(no_tests=True)).collect():
        out[list(of)[r.diff_id]] += [(r.file_path, s.points, s.reason) for s in r.signals if s.rule == "no-tests"]
    soft = "risky change to {} with no matching test change in this diff (other tests moved)"
    assert out == {
        "alone": [("src/foo.py", 9, "risky change with no test changes anywhere in this diff")], "own test": [], "other test": [("src/foo.py", 6, soft.format("foo"))], "folder of tests": [], "suffix": [], "go": [], "trivial": [], "test itself": [], "words": [], "data": [],
        "two": [("src/bar.py", 6, soft.format("bar"))], "binary test": [],
    }
    weighed = review(frame.where("diff_id = 0"), Options(no_tests=True, weights={"no-tests": 2.0})).first()
    assert [s.points for s in weighed.signals if s.rule == "no-tests"] == [18]
    assert not [s for r in review(frame.where("diff_id = 0"), Options(no_tests=True, weights={"no-tests": 0.0})).collect() for s in r.signals if s.rule == "no-tests"]


def test_symbols_of_hunks(spark):
    of = {
        "-def old_name(x):\n+def new_name(x):\n+class Widget:\n     pass": ("", ["old_name", "new_name", "Widget"]), "+export const doThing = () => 1\n+const helperFn = 2": ("", ["doThing", "helperFn"]), "+func ComputeTotal(items []int) int {": ("", ["ComputeTotal"]),
        "-    return total\n+    return total + 1": ("def compute_total(items):", ["compute_total"]), " def in_context(items):\n-    return sum(items)": ("", ["in_context"]), " total = 0\n-    return total": ("", []), "+MAX_RETRIES = 5": ("", ["MAX_RETRIES"]),
        "+def if_(x):\n+    id = 1\n+class Y:": ("", ["if_"]), "+def alpha():\n+def beta():\n+def alpha():": ("", ["alpha", "beta"]), "+x == compute(a)": ("", []), "+total: int = 4": ("", ["total"]), "+let $scope = 2": ("", ["$scope"]), "+value = 3\n+Data = 4": ("", []),
    }
    frame = spark.createDataFrame([(i, hunk("a.py", b, h)) for i, (b, (h, _)) in enumerate(of.items())], "diff_id long, text string")
    rows = parse_hunks(frame).select("diff_id", context_rules.symbols().alias("s")).collect()
    assert {list(of)[r.diff_id]: sorted(r.s) for r in rows} == {b: sorted(names) for b, (_, names) in of.items()}


def test_blast_radius_by_uses(spark):
    tree = [(f"c{i}.py", "big() mid() small() precompute = 1") for i in range(6)] + [(f"d{i}.py", "big(); mid()") for i in range(10)] + [(f"e{i}.py", "big") for i in range(24)] + [("own.py", "small small small few few"), ("f.py", "few few few few bigger")]
    frame = spark.createDataFrame([(0, hunk("own.py", "+def small():\n+def big():\n+def mid():\n+def few():\n+def compute():\n+def nowhere():")), (1, hunk("other.py", "+def small():\n+def few():")), (2, hunk("x.py", "-    y = 1"))], "diff_id long, text string")
    hunks = parse_hunks(frame).withColumn("signals", none())
    rows = context_rules.with_blast_radius(hunks, context_rules.hunk_symbols(hunks), spark.createDataFrame(tree, "path string, text string")).collect()
    said = lambda name, words, n: f"blast radius: '{name}' {words} ({n} places in the repo)"
    assert {r.diff_id: [(s.points, s.reason) for s in r.signals] for r in rows} == {
        0: [(16, said("big", "reverberates across the codebase", 40)), (11, said("mid", "is widely used", 16)), (6, said("small", "is used in several places", 6))],
        1: [(6, said("small", "is used in several places", 9)), (6, said("few", "is used in several places", 6))], 2: [],
    }


def test_hotspots_by_share(spark):
    commits = [("fix it", ["hot.py"])] * 2 + [("more", ["hot.py"])] * 8 + [("bugfix in it", ["mid.py"])] * 4 + [("prefix", ["low.py", "./low.py"])] * 3 + [("x", ["rare.py"])] * 2 + [("one fix", ["once.py"])] + [("two", ["once.py"])] * 3
    stats = context_rules.file_stats(spark.createDataFrame(commits, "message string, paths array<string>"))
    frame = spark.createDataFrame([(i, hunk(p, "+x")) for i, p in enumerate(["hot.py", "mid.py", "low.py", "rare.py", "never.py", "once.py"])], "diff_id long, text string")
    rows = context_rules.with_hotspots(parse_hunks(frame).withColumn("signals", none()), stats).collect()
    assert {r.file_path: [(s.points, s.reason) for s in r.signals] for r in rows} == {
        "hot.py": [(14, "hotspot: file a top change hotspot (10 commits, 2 fixes)")], "mid.py": [(14, "hotspot: file changes very frequently and is repeatedly fixed (4 commits, 4 fixes)")], "low.py": [(6, "hotspot: file changes often (3 commits)")],
        "rare.py": [], "never.py": [], "once.py": [(10, "hotspot: file changes very frequently (4 commits, 1 fix)")],
    }


def test_owners_of_hunks(spark):
    entries = context_rules.parse_codeowners("# comment\n\n* @all\nsrc/ @core @lead\n*.md\ndocs/api.md @a @b @c\n/web/ @Me")
    assert entries == [("*", ["@all"]), ("src/", ["@core", "@lead"]), ("*.md", []), ("docs/api.md", ["@a", "@b", "@c"]), ("/web/", ["@Me"])]
    frame = spark.createDataFrame([(i, hunk(p, "+x")) for i, p in enumerate(["x.py", "src/y.py", "z.md", "docs/api.md", "web/a.ts", "src\\w.py"])], "diff_id long, text string")
    hunks = parse_hunks(frame).withColumn("signals", none())
    want = {"x.py": [(8, "owned by @all, not the author")], "src/y.py": [(8, "owned by @core and @lead, not the author")], "z.md": [(12, "no CODEOWNERS entry — unowned file")], "docs/api.md": [(8, "owned by @a, @b, and @c, not the author")], "web/a.ts": [], "src\\w.py": [(8, "owned by @core and @lead, not the author")]}
    of = lambda df: {r.file_path: [(s.points, s.reason) for s in r.signals] for r in df.collect()}
    assert of(context_rules.with_owners(hunks, entries, "@me")) == want
    assert of(context_rules.with_owners(hunks, entries + [("nothing/here", ["@x"])] * 20, "@me")) == want  # by the index
    assert context_rules.with_owners(hunks, [], "@me") is hunks and context_rules.with_owners(hunks, entries, "") is hunks
    weighed = review(frame.where("diff_id = 2"), Options(codeowners=entries, author="@me", weights={"owners": 0.5})).first()
    assert [s.points for s in weighed.signals if s.rule == "owners"] == [6]


def test_scores_and_their_ties(spark):
    from hunkwise.operators.score import normalized, tier

    rows = spark.createDataFrame([(r,) for r in (-5, 0, 1, 5, 10, 20, 30, 45, 90, 500)], "raw int").select("raw", normalized(F.col("raw")).alias("s")).withColumn("t", tier(F.col("s"))).collect()
    import math

    assert [r.s for r in rows] == [0 if r.raw <= 0 else min(100, max(0, round(100 * (1 - math.exp(-r.raw / (45 / 2.4)))))) for r in rows]
    assert [r.t for r in rows] == ["gulp" if r.s >= 60 else "sip" if r.s >= 25 else "savor" for r in rows] and rows[-1].s == 100
    # equal scores: by points, then by id
    frame = spark.createDataFrame([(0, "".join(hunk(f"f{i}.py", "+x = 1") for i in range(8)))], "diff_id long, text string")
    ranked = sorted(review(frame).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 9)) and [r.id for r in ranked] == sorted(r.id for r in ranked)
