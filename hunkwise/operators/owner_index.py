"""Who owns a path, by an index of the entries instead of a pattern a time.

An entry of CODEOWNERS mostly names a folder, a file or an extension. Such entries are rows of a table, keyed by
what a path must have for them to fit: a folder (or the path) itself, its last part, an ending from a dot on, or the
signs it begins with. Each distinct path is looked up by all that it has of these, an equi-join; where a key is not
yet proof, the entry's pattern decides. What has no key (a pattern that begins and ends with wildcards) is tried by its
pattern. The last entry that fits counts.

The work is distinct paths times their depth, however many entries there are. The index has a row or two for each
entry and is broadcast while it is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Entries = Sequence[tuple[str, list[str]]]
#: Rows of an index that is broadcast.
BROADCAST_ROWS = 200_000
_WILD = "*?["
_INDEX = "kind string, key string, line int, regex string, owners array<string>"
_NONE = "array<string>"


def _one_of(body: str) -> str:
    """What stands between the brackets of a shell pattern, as a regular expression for one sign."""
    negative, body = body.startswith("!"), body.removeprefix("!")
    spans, at = [], 0
    while at < len(body):
        if body[at + 1 : at + 2] == "-" and at + 2 < len(body):
            lo, hi, at = body[at], body[at + 2], at + 3
        else:
            lo, hi, at = body[at], body[at], at + 1
        if lo <= hi:  # a range that runs backwards holds nothing
            spans.append(f"\\x{{{ord(lo):x}}}-\\x{{{ord(hi):x}}}")
    if not spans:
        return "." if negative else "(?!)"
    return f"[{'^' if negative else ''}{''.join(spans)}]"


def _glob(pattern: str) -> str:
    """A shell pattern as a regular expression; ? and * stand for any sign, slashes too. An open bracket is a sign."""
    out, at = [], 0
    while at < len(pattern):
        c, at = pattern[at], at + 1
        end = -1
        if c == "[":
            first = at + (pattern[at : at + 1] == "!")
            end = pattern.find("]", first + 1)  # a bracket that comes first is one of the signs
        if end >= 0:
            out.append(_one_of(pattern[at:end]))
            at = end + 1
        else:
            out.append(".*" if c == "*" else "." if c == "?" else f"\\x{{{ord(c):x}}}")
    return "".join(out)


def _literal(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def owner_pattern(pattern: str) -> tuple[str, bool]:
    """(regular expression of the paths that a CODEOWNERS pattern owns, whether a path's last part may fit as well)."""
    if pattern in ("*", "/*"):
        return r"(?s)\A.*\z", False
    body = pattern.lstrip("/").rstrip("/")
    below = _literal(body) + "/.*"
    if pattern.endswith("/"):
        return rf"(?s)\A(?:{_literal(body)}|{below})\z", False
    if "/" not in body:
        return rf"(?s)\A{_glob(body)}\z", True
    more = f"|{_literal(body[:-3])}.*" if body.endswith("/**") else ""
    return rf"(?s)\A(?:{_glob(body)}|{below}{more})\z", False


class Key(NamedTuple):
    """What a path must have for an entry to fit. ``sure``: having it is enough."""

    kind: str
    key: str
    sure: bool


def _ending(body: str) -> str | None:
    """What follows the last wildcard of a pattern, from its first dot on: all that fits ends with it."""
    tail = body[max(body.rfind(c) for c in "*?[]") + 1 :]
    return tail[tail.find(".") :] if "." in tail else None


def keys_of(pattern: str) -> list[Key]:
    """A path that the pattern owns has one of these; none: any path may be owned."""
    if pattern in ("*", "/*"):
        return [Key("all", "", True)]
    body = pattern.lstrip("/").rstrip("/")
    if pattern.endswith("/"):
        return [Key("folder", body, True)]
    wild = next((i for i, c in enumerate(body) if c in _WILD), None)
    if "/" not in body:
        if wild is None:
            return [Key("name", body, True)]
        ending = _ending(body)
        return [Key("ending", ending, body == "*" + ending)] if ending else []
    if wild is None:
        return [Key("folder", body, True)]
    if body.endswith("/**") and wild == len(body) - 2:
        return [Key("start", body[:-3], True)]
    lead = body.rfind("/", 0, wild)
    if lead > 0:
        return [Key("folder", body[:lead], False)]
    ending = _ending(body.rsplit("/", 1)[-1])
    return [Key("ending", ending, False), Key("folder", body, False)] if ending else []


class OwnerIndex(NamedTuple):
    rows: list[tuple[str, str, int, str | None, list[str]]]
    """kind, key, line, pattern that decides, owners"""
    rest: list[tuple[int, str, list[str]]]
    """entries without a key"""
    starts: list[int]
    """lengths of the beginnings that are keys"""


def owner_index(entries: Entries) -> OwnerIndex:
    rows, rest, starts = [], [], set()
    for line, (pattern, owners) in enumerate(entries):
        keys = keys_of(pattern)
        if not keys:
            rest.append((line, pattern, owners))
        for kind, key, sure in keys:
            rows.append((kind, key, line, None if sure else owner_pattern(pattern)[0], owners))
            if kind == "start":
                starts.add(len(key))
    return OwnerIndex(rows, rest, sorted(starts))


def _fits(path: Column, pattern: str) -> Column:
    regex, by_part = owner_pattern(pattern)
    fits = F.rlike(path, F.lit(regex))
    return fits | F.rlike(F.substring_index(path, "/", -1), F.lit(regex)) if by_part else fits


def first_of(path: Column, entries: Sequence[tuple[str, Column]], otherwise: Column) -> Column:
    """The value of the last entry that fits. One flat choice, however many entries."""
    out = None
    for pattern, value in reversed(entries):
        out = F.when(_fits(path, pattern), value) if out is None else out.when(_fits(path, pattern), value)
    return otherwise if out is None else out.otherwise(otherwise)


def _looked_up(path: Column, starts: Sequence[int]) -> Column:
    """All keys that a path has."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dots = F.split(F.substring_index(path, "/", -1), r"\.")
    endings = F.transform(F.filter(F.sequence(F.lit(1), F.size(dots)), lambda i: i > 1), lambda i: F.concat(F.lit("."), F.array_join(F.slice(dots, i, F.size(dots)), ".")))
    of = lambda kind, values: F.transform(values, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    begins = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in starts]), lambda s: s.isNotNull()) if starts else F.array().cast("array<string>")
    return F.concat(of("all", F.array(F.lit(""))), of("folder", folders), of("name", F.array(F.substring_index(path, "/", -1))), of("ending", endings), of("start", begins))


def path_owners(paths: DataFrame, entries: Entries) -> DataFrame:
    """path, owners by the last entry that fits, for the paths (path, distinct) that any entry fits."""
    spark = paths.sparkSession
    index = owner_index(entries)
    table = spark.createDataFrame(index.rows, _INDEX)
    table = F.broadcast(table) if len(index.rows) <= BROADCAST_ROWS else table
    # a key that the table does not have is left behind here; the rest meets patterns
    found = paths.select("path", F.inline(_looked_up(F.col("path"), index.starts))).join(table, ["kind", "key"])
    # an ending may be that of the path, where its last part alone is another
    fits = F.rlike("path", F.col("regex")) | ((F.col("kind") == "ending") & F.rlike(F.substring_index("path", "/", -1), F.col("regex")))
    found = found.where(F.col("regex").isNull() | fits).select("path", "line", "owners")
    if index.rest:
        struct = [(pattern, F.struct(F.lit(line).alias("line"), F.array(*map(F.lit, owners)).cast(_NONE).alias("owners"))) for line, pattern, owners in index.rest]
        tried = paths.select("path", first_of(F.col("path"), struct, F.lit(None)).alias("e")).where("e is not null")
        found = found.unionByName(tried.select("path", "e.line", "e.owners"))
    return found.groupBy("path").agg(F.max_by("owners", "line").alias("owners"))
