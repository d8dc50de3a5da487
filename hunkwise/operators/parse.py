"""Unified diffs to files and hunks, without a shuffle.

A diff is cut into records, and a record into hunks, by splits before the lines that start them,
all in the row where the text is. Lines end where Python's ``splitlines`` ends them.

Edge cases: null or empty text has no files. Files without hunks (binary, mode change, pure
rename) are files. A record without any path is dropped. A body line that looks like a file header
ends its hunk; what follows, up to the next hunk, belongs to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINE_END = r"\r\n|[\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
_HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)"
_BEFORE_HUNK = r"(?dm)^(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"
_FIELD = r"(?dm)^((?:old mode |new mode |deleted file mode |new file mode |rename from |rename to |copy from |copy to |Binary files |GIT binary patch|--- |\+\+\+ ).*)"
#: Where a hunk's body ends although its record goes on.
_BROKEN_OFF = r"\n(?=\+\+\+ |--- |[^+\- \\\n])"
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\x07", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", '"': '"', "'": "'"}
#: What a quoted path is made of: escapes by number, other escapes, and plain text.
_PART = r"""\\[0-7]{1,3}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"""
#: Escapes that cannot be read leave the path between the quotes as it is.
_BROKEN = r"""^(?:[^\\]|\\[^xuU]|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4})*+\\"""


def records(diffs: DataFrame) -> DataFrame:
    """diff_id, file_seq (from 1), record: one row for each file of every diff (diff_id, text)."""
    text = F.regexp_replace("text", _LINE_END, "\n")
    text = F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))
    # a generator between keeps the text from being computed again for each use below
    diffs = diffs.where(F.length("text") > 0).select("diff_id", F.explode(F.array(text)).alias("text"))

    def starting(with_: str) -> Column:
        return F.filter(F.split("text", f"(?dm)^(?={with_})"), lambda r: F.startswith(r, F.lit(with_)))

    of_git = F.rlike("text", F.lit("(?dm)^diff --git "))
    parts = F.when(of_git, starting("diff --git ")).otherwise(starting("--- "))
    return diffs.select("diff_id", F.posexplode(parts).alias("file_seq", "record")).withColumn("file_seq", F.col("file_seq") + 1)


def _unquoted(path: Column) -> Column:
    """C escapes of a quoted path; those by number are single characters, unknown ones stay."""
    inside = F.substring(path, F.lit(2), F.length(path) - 2)
    parts = F.regexp_extract_all(inside, F.lit(f"(?s)({_PART})"), 1)

    def plain(p: Column) -> Column:
        number = F.when(F.rlike(p, F.lit(r"^\\[0-7]")), F.conv(F.substring(p, 2, 3), 8, 10)).when(F.rlike(p, F.lit(r"^\\[xuU]")), F.conv(F.substring(p, 3, 8), 16, 10)).cast("int")
        # one character of any plane, by its four UTF-32 bytes; half of a surrogate pair is none
        out = F.when(number.between(0xD800, 0xDFFF), "\ufffd").when(number.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        for name, value in _ESCAPES.items():
            out = out.when(p == F.lit("\\" + name), F.lit(value))
        return out.otherwise(p)

    quoted = F.startswith(path, F.lit('"')) & F.endswith(path, F.lit('"')) & (F.length(path) > 1)
    return F.when(quoted & F.rlike(inside, F.lit(_BROKEN)), inside).when(quoted, F.array_join(F.transform(parts, plain), "")).otherwise(path)


def _path(value: Column) -> Column:
    return _unquoted(F.regexp_replace(value, "^[ab]/", ""))


def _described(recs: DataFrame) -> DataFrame:
    """records with path, change_type, old_path, new_path, old_mode, new_mode, is_binary."""
    # a generator between keeps the fields from being found again for each use below
    recs = recs.select("*", F.explode(F.array(F.regexp_extract_all("record", F.lit(_FIELD), 1))).alias("_f"))

    def values(of: str) -> Column:
        return F.transform(F.filter("_f", lambda x: F.startswith(x, F.lit(of))), lambda x: F.substring(x, len(of) + 1, 1 << 20))

    def last(*of: str) -> Column:
        """The value of the last such field."""
        hits = F.filter("_f", lambda x: F.rlike(x, F.lit("^(?:" + "|".join(of) + ")")))
        return F.trim(F.regexp_replace(F.try_element_at(hits, F.lit(-1)), "^(?:" + "|".join(of) + ")", ""))

    def header(of: str) -> Column:
        return F.trim(F.substring_index(F.try_element_at(values(of), F.lit(1)), "\t", 1))

    git = r"^diff --git a/(.+) b/(.+)$"
    first = F.substring_index("record", "\n", 1)
    minus, plus = header("--- "), header("+++ ")
    kind = F.try_element_at(F.filter("_f", lambda x: F.rlike(x, F.lit("^(?:deleted file|new file|rename|copy) "))), F.lit(-1))
    change = (
        F.when(plus == "/dev/null", "deleted").when(minus == "/dev/null", "added")
        .when(F.startswith(kind, F.lit("deleted")), "deleted").when(F.startswith(kind, F.lit("new")), "added")
        .when(F.startswith(kind, F.lit("rename")), "renamed").when(F.startswith(kind, F.lit("copy")), "copied").otherwise("modified")
    )

    def side(n: int, of_header: Column, *moved: str) -> Column:
        """The path that a move names, else the first line, else the header; none where the header says so."""
        named = F.when(F.rlike(first, F.lit(git)), F.concat(F.lit("ab"[n - 1] + "/"), F.regexp_extract(first, git, n)))
        said = F.coalesce(last(*moved), named, F.nullif(of_header, F.lit("")))
        return F.when(~F.coalesce(of_header == "/dev/null", F.lit(False)), _path(said))

    old, new = side(1, minus, "rename from ", "copy from "), side(2, plus, "rename to ", "copy to ")
    out = recs.select(
        "diff_id", "file_seq", "record", change.alias("change_type"), old.alias("old_path"), new.alias("new_path"),
        last("old mode ", "deleted file mode ").alias("old_mode"),
        last("new mode ", "new file mode ").alias("new_mode"),
        F.exists("_f", lambda x: F.rlike(x, F.lit("^(?:Binary files |GIT binary patch)"))).alias("is_binary"),
    )
    # drops records without a path, where a filter would have the paths found twice
    return out.select("*", F.explode(F.array_compact(F.array(F.coalesce("new_path", "old_path")))).alias("path"))


def parse_files(diffs: DataFrame) -> DataFrame:
    return _described(records(diffs)).select("diff_id", "file_seq", "path", "change_type", "old_path", "new_path", "old_mode", "new_mode", "is_binary")


def _pieces(diffs: DataFrame) -> DataFrame:
    """A row for each file of every diff (hunk_seq 0) and for each of its hunks (from 1), with its text."""
    split = F.posexplode(F.split("record", _BEFORE_HUNK)).alias("hunk_seq", "piece")
    return _described(records(diffs)).select("diff_id", "file_seq", F.col("path").alias("file_path"), "change_type", split)


def _read(pieces: DataFrame) -> DataFrame:
    recs = pieces.select("*", F.explode(F.array(F.get(F.split(F.regexp_replace("piece", r"\n\z", ""), _BROKEN_OFF, 2), F.lit(0)))).alias("hunk"))
    head = F.substring_index("hunk", "\n", 1)
    body = F.substring("hunk", F.length(head) + 2, F.length("hunk"))
    part = lambda g: F.regexp_extract(head, "^" + _HUNK, g)
    number = lambda g: F.coalesce(F.nullif(part(g), F.lit("")), F.lit("1")).cast("int")
    hunks = recs.select(
        "diff_id", "file_seq", "hunk_seq", "file_path", "change_type",
        number(1).alias("old_start"), number(2).alias("old_lines"), number(3).alias("new_start"), number(4).alias("new_lines"),
        part(5).alias("heading"), body.alias("body"),
    )
    count = lambda sign: F.regexp_count("body", F.lit(r"(?dm)^\%s" % sign))
    hunks = hunks.withColumns({"added": count("+"), "removed": count("-")})
    return with_id(hunks.withColumn("changed", F.col("added") + F.col("removed")))


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """Every hunk of every diff (diff_id, text), with its file's path and kind of change."""
    return _read(_pieces(diffs).where("hunk_seq > 0"))


def parse_rows(diffs: DataFrame) -> DataFrame:
    """The rows of ``parse_hunks`` and, with hunk_seq 0 and no text, one for each file: both out of one parse."""
    return _read(_pieces(diffs).withColumn("piece", F.when(F.col("hunk_seq") > 0, F.col("piece"))))


def with_id(hunks: DataFrame) -> DataFrame:
    """id: twelve hexadecimal digits that name a hunk by path, place and body."""
    zero = F.lit("\0")
    return hunks.withColumn("id", F.substring(F.sha1(F.concat("file_path", zero, F.col("new_start").cast("string"), zero, "body").cast("binary")), 1, 12))


def header() -> Column:
    """A hunk's header line again: counts of 1 are left out."""
    count = lambda c: F.when(F.col(c) == 1, "").otherwise(F.concat(F.lit(","), F.col(c).cast("string")))
    heading = F.when((F.col("heading") == "") | F.startswith("heading", F.lit(" ")), F.col("heading")).otherwise(F.concat(F.lit(" "), "heading"))
    return F.concat(F.lit("@@ -"), F.col("old_start").cast("string"), count("old_lines"), F.lit(" +"), F.col("new_start").cast("string"), count("new_lines"), F.lit(" @@"), heading)


def diff_counts(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """diff_id, files, hunks, added, removed."""
    of_hunks = hunks.groupBy("diff_id").agg(F.count("*").alias("hunks"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    out = files.groupBy("diff_id").agg(F.count("*").alias("files")).join(of_hunks, "diff_id", "left")
    return out.select("diff_id", "files", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hunks", "added", "removed")])


def file_rollup(hunks: DataFrame) -> DataFrame:
    """Lines added and removed, for each file and (file_seq 0) each diff: one aggregate over both levels."""
    sums = [F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("hunks")]
    levels = hunks.groupingSets([["diff_id", "file_seq"], ["diff_id"]], "diff_id", "file_seq").agg(F.grouping("file_seq").alias("_diff"), *sums)
    return levels.withColumn("file_seq", F.when(F.col("_diff") == 1, 0).otherwise(F.col("file_seq"))).drop("_diff")
