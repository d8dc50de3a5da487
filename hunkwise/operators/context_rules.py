"""The opt-in rules: each reads a table, or words, beside the hunk."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.functions.bitmap import bit_map, maybe_among
from hunkwise.functions.rx import found, rx
from hunkwise.functions.signals import none, signal, total
from hunkwise.operators.owner_index import Entries, first_of, path_owners
from hunkwise.sources.worktables import WorkTables

# Fixed values of the hotspot rule: words of fixes, shares and floors, and the bonus.
FIX = r"\b(?:fix(?:e[sd])?|fixing|bug(?:s|fix|fixes)?|hotfix|revert(?:s|ed)?|regress(?:ion|ions|ed)?|patch(?:e[sd])?|broke|broken|breakage|defect|issue|repair(?:s|ed)?)\b"
HOT = ((0.60, 6, 14, "a top change hotspot"), (0.30, 4, 10, "changes very frequently"), (0.15, 3, 6, "changes often"))
FIX_RATIO, FIX_POINTS, FIX_WORDS = 0.34, 4, " and is repeatedly fixed"
# Fixed values of the owner rule.
OTHER_OWNER, UNOWNED = 8, 12
#: Entries that are tried at each hunk.
OWNERS_IN_ROW = 16
UNOWNED_REASON = "no CODEOWNERS entry — unowned file"
# Fixed values of the intent rule.
INTENT_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "for", "to", "of", "in", "on", "at", "by", "is", "are", "be", "this", "that", "with", "from", "it", "as",
    "if", "add", "adds", "added", "fix", "fixes", "fixed", "update", "updates", "updated", "change", "changes", "changed", "pr", "prs", "make",
    "makes", "use", "uses", "new", "remove", "removes", "removed", "refactor", "wip", "chore", "feat", "docs", "test", "tests", "into", "when", "not",
    "no", "so", "we", "our", "you", "your", "can", "will",
)
NO_OVERLAP, WEAK_OVERLAP, WEAK_RATIO = 12, 6, 0.15
# Fixed values of the test rule.
TEST_PATHS = (r"(^|/)tests?/", r"(^|/)__tests__/", r"(^|/)test_[^/]+$", r"_test\.[^/.]+$", r"\.test\.[^/.]+$", r"\.spec\.[^/.]+$", r"(^|/)test[^/]*\.[^/.]+$")
NON_CODE = (".md", ".rst", ".txt", ".json", ".toml", ".yaml", ".yml", ".ini", ".cfg", ".lock", ".csv", ".svg", ".png", ".jpg", ".gif")
GENERIC_STEMS = ("test", "tests", "__tests__", "spec")
RISKY, NO_TESTS, OTHER_TESTS = 10, 9, 6
NO_TESTS_REASON = "risky change with no test changes anywhere in this diff"
OTHER_TESTS_REASON = "risky change to {} with no matching test change in this diff (other tests moved)"
# Fixed values of the blast radius rule.
SYMBOL_STOPWORDS = (
    "if", "else", "elif", "for", "while", "return", "def", "class", "func", "function", "const", "let", "var", "import", "from", "export", "default",
    "public", "private", "protected", "static", "void", "int", "str", "bool", "true", "false", "none", "null", "self", "this", "new", "type",
    "interface", "package", "module", "async", "await", "try", "catch", "except", "finally", "with", "as", "in", "is", "and", "or", "not", "pass",
    "break", "continue", "get", "set", "data", "value", "key", "name", "id", "i", "j", "k", "x", "y",
)
CONTEXT_SYMBOLS = (
    r"\b(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"\b(?:func|function)\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)?\s*([A-Za-z_$][A-Za-z0-9_$]*)",
)
CHANGED_SYMBOLS = (
    r"\b(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"\b(?:func|function)\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"\b(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=",
    r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?::[^=]+)?=(?!=)",
    r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)?\s*([A-Za-z_$][A-Za-z0-9_$]*)",
)
BLAST = ((40, 16, "reverberates across the codebase"), (15, 11, "is widely used"), (5, 6, "is used in several places"))


# ---- hotspots


def slashed(path: Column | str) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def path_counts(commits: DataFrame) -> DataFrame:
    """path, commits, fixes from commits (message, paths), which may be a stream."""
    touched = commits.select(found("message", FIX).alias("fix"), F.explode(F.array_distinct(F.transform("paths", slashed))).alias("path"))
    return touched.groupBy("path").agg(F.count("*").alias("commits"), F.count_if("fix").alias("fixes"))


def busiest(stats: DataFrame) -> DataFrame:
    """Add ``busiest``: the commits of the busiest path."""
    return stats.crossJoin(F.broadcast(stats.agg(F.max("commits").alias("busiest"))))  # one row


def file_stats(commits: DataFrame) -> DataFrame:
    """path, commits, fixes, busiest (commits of the busiest path) from commits (message, paths)."""
    return busiest(path_counts(commits))


def with_hotspots(hunks: DataFrame, stats: DataFrame) -> DataFrame:
    """Append the hotspot signal to ``signals``."""
    side = stats.select(F.col("path").alias("_path"), F.col("commits").alias("_c"), F.col("fixes").alias("_f"), F.col("busiest").alias("_b"))
    out = hunks.withColumn("_path", slashed("file_path")).join(side, "_path", "left")
    c, f = F.col("_c"), F.col("_f")
    fixed = (f > 0) & (f / c >= FIX_RATIO)
    counts = F.concat(c.cast("string"), F.lit(" commits"), F.when(f > 0, F.concat(F.lit(", "), f.cast("string"), F.when(f == 1, " fix").otherwise(" fixes"))).otherwise(""))
    hot = none()
    for share, floor, points, label in reversed(HOT):
        reason = F.concat(F.lit("hotspot: file " + label), F.when(fixed, FIX_WORDS).otherwise(""), F.lit(" ("), counts, F.lit(")"))
        hot = F.when((c / F.col("_b") >= share) & (c >= floor), F.array(signal("hotspots", points + F.when(fixed, FIX_POINTS).otherwise(0), reason))).otherwise(hot)
    return out.withColumn("signals", F.concat("signals", hot)).drop("_path", "_c", "_f", "_b")


# ---- owners


def parse_codeowners(text: str) -> list[tuple[str, list[str]]]:
    """(pattern, owners) of each line, in order."""
    rows = [line.split() for line in text.splitlines()]
    return [(r[0], r[1:]) for r in rows if r and not r[0].startswith("#")]


def owners_of(path: Column, entries: Entries) -> Column:
    """The owners by the last entry that fits, tried by its pattern; empty if none."""
    values = [(pattern, F.array(*map(F.lit, owners)).cast("array<string>")) for pattern, owners in entries]
    return first_of(path, values, F.array().cast("array<string>"))


def owners(author: str) -> Column:
    """The signal by the owners in ``_owners``."""
    mine = F.exists("_owners", lambda o: F.lower(o) == author.lower())
    n = F.size("_owners")
    named = F.when(n == 1, F.get("_owners", F.lit(0))).when(n == 2, F.array_join("_owners", " and ")).otherwise(
        F.concat(F.array_join(F.slice("_owners", 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.try_element_at("_owners", F.lit(-1)))
    )
    return F.when(n == 0, F.array(signal("owners", UNOWNED, UNOWNED_REASON))).when(mine, none()).otherwise(
        F.array(signal("owners", OTHER_OWNER, F.concat(F.lit("owned by "), named, F.lit(", not the author"))))
    )


def with_owners(hunks: DataFrame, entries: Entries, author: str) -> DataFrame:
    """Append the signal on files that others own. A few entries are tried where the hunk is; more are looked
    up once for each distinct path."""
    if not entries or not author:
        return hunks
    if len(entries) <= OWNERS_IN_ROW:
        # a generator keeps the choice from being made again for each use below
        out = hunks.select("*", F.explode(F.array(owners_of(slashed("file_path"), entries))).alias("_owners"))
    else:
        named = hunks.withColumn("_path", slashed("file_path"))
        found = path_owners(named.select(F.col("_path").alias("path")).distinct(), entries).toDF("_path", "_owners")
        out = named.join(found, "_path", "left").withColumn("_owners", F.coalesce("_owners", F.array().cast("array<string>"))).drop("_path")
    return out.withColumn("signals", F.concat("signals", owners(author))).drop("_owners")


# ---- intent


def keywords(text: Column) -> Column:
    """Distinct lower-case words and parts of identifiers, without short and empty ones."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), 1)
    parts = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit("([A-Z]?[a-z0-9]+|[A-Z]+(?![a-z]))"), 1)))
    low = F.transform(parts, F.lower)
    return F.array_distinct(F.filter(low, lambda w: (F.length(w) >= 3) & ~w.isin(*INTENT_STOPWORDS)))


def hunk_keywords() -> Column:
    """Of the path without its extension, and of the changed lines."""
    changed = F.filter(F.split("body", "\n"), lambda x: F.rlike(x, F.lit("^[+-]")) & ~F.rlike(x, F.lit(r"^(?:\+\+\+|---)")))
    path = F.regexp_replace("file_path", r"\.[A-Za-z0-9]+$", "")
    return keywords(F.concat_ws("\n", path, F.array_join(F.transform(changed, lambda x: F.substring(x, 2, 1 << 30)), "\n")))


def with_intent(hunks: DataFrame, intent: Column) -> DataFrame:
    """``intent``: the stated purpose, a column of hunks; null or without keywords: no signal."""
    text = F.trim(F.regexp_replace(intent, rx(r"\s+"), " "))
    short = F.when(F.char_length(text) <= 60, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, 59)), F.lit("…")))
    out = hunks.withColumns({"_own": hunk_keywords(), "_asked": keywords(intent), "_short": short})
    shared, n = F.size(F.array_intersect("_own", "_asked")), F.size("_own")
    path = F.col("file_path")
    never = F.concat(F.lit("touches "), path, F.lit(" but the PR is about '"), "_short", F.lit("' — nothing here matches that story"))
    little = F.concat(path, F.lit(" barely relates to the stated PR intent '"), "_short", F.lit("' — possible scope creep"))
    judged = (
        F.when(F.coalesce(F.size("_asked") == 0, F.lit(True)) | F.col("_asked").isNull() | (n == 0), none())
        .when(shared == 0, F.array(signal("intent", NO_OVERLAP, never)))
        .when(shared / n < WEAK_RATIO, F.array(signal("intent", WEAK_OVERLAP, little)))
        .otherwise(none())
    )
    return out.withColumn("signals", F.concat("signals", judged)).drop("_own", "_asked", "_short")


# ---- tests


def _low(path: Column | str) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def is_test(path: Column | str) -> Column:
    return F.rlike(_low(path), F.lit("|".join(f"(?:{p})" for p in TEST_PATHS)))


def _without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def stem(path: Column | str) -> Column:
    return _without_extension(F.substring_index(_low(path), "/", -1))


def test_stems(path: Column | str) -> Column:
    """Of every part of a test file's path."""
    parts = F.transform(F.split(_low(path), "/"), _without_extension)
    without = lambda p, affix: F.regexp_replace(p, affix, "")
    parts = F.transform(parts, lambda p: without(without(without(p, r"^test[_-]"), r"[_-]test$"), r"\.(?:test|spec)$"))
    return F.filter(parts, lambda p: (p != "") & ~p.isin(*GENERIC_STEMS))


def with_test_evidence(rows: DataFrame) -> DataFrame:
    """Rows of files and hunks (``parse_rows``) with ``stems``: of the test files of their diff, null without any.
    The rows of a diff meet as they do for their ranks, so this costs no exchange of its own."""
    found = F.when(F.col("hunk_seq") == 0, F.when(is_test("file_path"), test_stems("file_path")))
    of_diff = F.collect_list(found).over(Window.partitionBy("diff_id"))
    return rows.withColumn("_tests", of_diff).withColumn("stems", F.when(F.size("_tests") > 0, F.array_distinct(F.flatten("_tests")))).drop("_tests")


def with_no_tests(hunks: DataFrame) -> DataFrame:
    """Append the signal to risky hunks of code that no touched test covers (``stems``); after all other rules."""
    out = hunks
    code = ~F.rlike(_low("file_path"), F.lit("(?:" + "|".join(re.escape(s) for s in NON_CODE) + ")$"))
    own = stem("file_path")
    risky = ~is_test("file_path") & code & (total(F.col("signals")) >= RISKY)
    before, after = OTHER_TESTS_REASON.split("{}")
    signal_of = (
        F.when(~risky | F.coalesce(F.array_contains("stems", own) & (own != ""), F.lit(False)), none())
        .when(F.col("stems").isNull(), F.array(signal("no-tests", NO_TESTS, NO_TESTS_REASON)))
        .otherwise(F.array(signal("no-tests", OTHER_TESTS, F.concat(F.lit(before), own, F.lit(after)))))
    )
    return out.withColumn("signals", F.concat("signals", signal_of)).drop("stems")


# ---- blast radius


def symbols() -> Column:
    """Names that a hunk's heading, changed lines and context lines define."""
    def names(text: Column, patterns: Sequence[str]) -> Column:
        # over many lines at once, so that no pattern may reach beyond its line
        lined = [p.replace(r"\s", r"[^\S\n]").replace("[^=]", r"[^=\n]") for p in patterns]
        return F.concat(*[F.regexp_extract_all(text, F.lit("(?dmU)" + p), 1) for p in lined])

    lines = lambda signs: F.array_join(F.regexp_extract_all("body", F.lit(f"(?dm)^{signs}(.*)"), 1), "\n")
    every = F.concat(names(F.col("heading"), CHANGED_SYMBOLS), names(lines("[+-]"), CHANGED_SYMBOLS), names(lines(" "), CONTEXT_SYMBOLS))
    return F.array_distinct(F.filter(every, lambda s: (F.length(s) >= 3) & ~F.lower(s).isin(*SYMBOL_STOPWORDS)))


_WORD = r"(?U)(\w+)"


def _words_in(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """symbol, path: words of every file of a tree (path, text) that are surely, or by a rare chance, asked for."""
    words = tree.select("path", F.explode(F.regexp_extract_all("text", F.lit(_WORD), 1)).alias("symbol"))
    return maybe_among(words, "symbol", bit_map(asked, "symbol"))


def _dollars_in(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """symbol, path, n: uses at word boundaries of the symbols with a ``$``. Where such a symbol is, its first word is
    a whole word of a run of word signs and ``$``, by which symbols and runs meet."""
    first = asked.select("symbol", F.regexp_extract("symbol", _WORD, 1).alias("word")).distinct()
    runs = tree.where(F.contains("text", F.lit("$"))).select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?U)((?:\w*\$)+\w*)"), 1)).alias("run"))
    words = runs.select("path", "run", F.explode(F.array_distinct(F.regexp_extract_all("run", F.lit(_WORD), 1))).alias("word"))
    words = maybe_among(words, "word", bit_map(first, "word"))
    times = F.regexp_count("run", F.concat(F.lit(r"(?U)\b\Q"), "symbol", F.lit(r"\E\b")))
    return words.join(first, "word").select("symbol", "path", times.cast("long").alias("n")).where("n > 0")


def hunk_symbols(hunks: DataFrame, named: Column | None = None) -> DataFrame:
    """diff_id, file_seq, hunk_seq, path, symbol; ``named``: the symbols, where they are already found."""
    return hunks.select("diff_id", "file_seq", "hunk_seq", slashed("file_path").alias("path"), F.explode(symbols() if named is None else named).alias("symbol"))


def symbol_uses(own: DataFrame, tree: DataFrame, tables: WorkTables | None = None) -> DataFrame:
    """diff_id, file_seq, hunk_seq, symbol, uses outside the hunk's own file, for symbols that the tree (path, text) holds.

    The distinct (symbol, path) pairs of ``own`` (``hunk_symbols``) are written. A bit map of their symbols is
    broadcast to the tree, so that of its words only those that are asked for are counted and shuffled, summed up
    where they are read. The pairs then meet the tree's sums for each symbol, less the own file's: no pair of
    hunk and file is made.
    """
    tables = tables or WorkTables(own.sparkSession)
    dollar = F.contains("symbol", F.lit("$"))
    asked = tables.put(own.groupBy("symbol", "path").agg(F.lit(1).alias("asked")))
    seen = _words_in(tree, asked.where(~dollar)).withColumn("n", F.lit(1).cast("long"))
    if not asked.where(dollar).isEmpty():
        seen = seen.unionByName(_dollars_in(tree, asked.where(dollar)))
    seen = seen.withColumn("asked", F.lit(0)).unionByName(asked.withColumn("n", F.lit(0).cast("long")))
    at = seen.groupBy("symbol", "path").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    everywhere = at.groupBy("symbol").agg(F.sum("n").alias("all"), F.max("asked").alias("any")).where("any = 1 and all > 0")
    uses = at.where("asked = 1").join(everywhere, "symbol").select("symbol", "path", (F.col("all") - F.col("n")).alias("uses"))
    return own.join(uses, ["symbol", "path"]).select("diff_id", "file_seq", "hunk_seq", "symbol", "uses")


def with_blast_radius(hunks: DataFrame, own: DataFrame, tree: DataFrame, tables: WorkTables | None = None) -> DataFrame:
    """Append the signals of the hunks' symbols (``own``, read more than once) that a tree (path, text) uses elsewhere."""
    uses = symbol_uses(own, tree, tables)
    points, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for least, p, text in reversed(BLAST):
        points, label = F.when(F.col("uses") >= least, p).otherwise(points), F.when(F.col("uses") >= least, text).otherwise(label)
    reason = F.concat(F.lit("blast radius: '"), "symbol", F.lit("' "), label, F.lit(" ("), F.col("uses").cast("string"), F.lit(" places in the repo)"))
    hit = uses.where(F.col("uses") >= BLAST[-1][0]).withColumn("s", F.struct((-points).alias("p"), (-F.col("uses")).alias("u"), F.col("symbol").alias("n"), signal("blast-radius", points, reason).alias("s")))
    key = ["diff_id", "file_seq", "hunk_seq"]
    per = hit.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["s"]).alias("_blast"))
    return hunks.join(per, key, "left").withColumn("signals", F.concat("signals", F.coalesce("_blast", none()))).drop("_blast")
