"""The rules that need the hunk alone, as columns over hunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.rx import found, times
from hunkwise.functions.signals import counted, none, pack, signal, weighted, when

# Points, labels, patterns and reasons of the rules.
SIZE = ((200, 18, "very large hunk"), (100, 12, "large hunk"), (40, 7, "sizeable hunk"), (15, 3, "moderate hunk"))
SURFACE = (
    (r"(^|/)(auth|authn|authz|login|session|password|oauth|jwt)([./_-]|$)", 14, "touches authentication/session code"),
    (r"(^|/)(crypto|cipher|encrypt|secret|signing|keystore|tls|ssl)([./_-]|$)", 14, "touches cryptography/secrets code"),
    (r"(^|/)(migrations?|alembic|schema)([./_-]|/|$)", 13, "touches a database migration/schema"),
    (r"(^|/)\.github/workflows/", 10, "touches CI workflow"),
    (r"(^|/)(dockerfile|docker-compose|\.dockerignore)", 9, "touches container/build config"),
    (r"(^|/)(\.gitlab-ci\.yml|\.circleci/|jenkinsfile|\.travis\.yml|azure-pipelines)", 10, "touches CI/CD pipeline config"),
    (r"(^|/)(package\.json|pyproject\.toml|requirements[^/]*\.txt|setup\.(py|cfg)|go\.mod|cargo\.toml|gemfile|build\.gradle|pom\.xml)$", 8, "changes declared dependencies/build"),
    (r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|cargo\.lock|gemfile\.lock|go\.sum|composer\.lock)$", 6, "changes a dependency lockfile"),
    (r"(^|/)(\.env|\.npmrc|\.pypirc)([./_-]|$)", 12, "touches environment/credentials config"),
)
DANGER = (
    (r"\b(eval|exec)\s*\(", True, 16, "adds dynamic eval/exec"),
    (r"\b(os\.system|subprocess\.\w+|popen)\b", True, 10, "adds a shell/subprocess call"),
    (r"\bshell\s*=\s*True\b", True, 8, "uses shell=True"),
    (r"\bpickle\.(loads?|Unpickler)\b", True, 10, "adds pickle deserialization"),
    (r"""(api[_-]?key|secret|token|passwd|password|access[_-]?key)\s*[:=]\s*['"][^'"]{6,}['"]""", True, 18, "adds a hardcoded secret-looking literal"),
    (r"-----BEGIN (RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----", False, 20, "adds an embedded private key"),
    (r"\bchmod\s+(0?7[0-7][0-7]|[+-]?[ugoa]*\+?x)\b|\bchmod\s+777\b", False, 9, "changes file permissions"),
    (r"\b(sudo|setuid|seteuid|setgid)\b", False, 8, "invokes elevated privileges"),
    (r"verify\s*=\s*False|CERT_NONE|rejectUnauthorized\s*:\s*false|InsecureSkipVerify|NODE_TLS_REJECT_UNAUTHORIZED", True, 14, "disables TLS/cert verification"),
    (r"""Access-Control-Allow-Origin['"]?\s*[:,]\s*['"]?\*""", True, 8, "opens CORS to all origins"),
    (r"""\b(SELECT|INSERT|UPDATE|DELETE|DROP)\b.*\b(FROM|INTO|SET|TABLE)\b|(execute|query)\s*\(\s*f?['"].*\b(SELECT|INSERT|UPDATE|DELETE)\b""", True, 9, "adds raw SQL"),
)
DELETED, LARGE_DELETION, LARGE_FROM, NET_DELETION = 12, 10, 60, 4
OPERATORS = ("<=", ">=", "<", ">", "==", "!=")
COMPARISON, NEGATION = 9, 8
CONTROL = (
    (r"\bexcept\s*:|\bexcept\b[^:]*:\s*pass\b", 11, "adds/changes a bare or swallowed exception handler"),
    (r"\b(try|except|finally)\b", 6, "changes error-handling flow (try/except/finally)"),
    (r"\braise\b", 5, "changes a raise"),
    (r"\b(range\s*\(|while\b)", 6, "changes a loop bound (range/while) — off-by-one risk"),
    (r"(\blen\s*\([^)]*\)\s*[+\-]\s*\d+|\b[A-Za-z_]\w*\s*[+\-]\s*1\b)", 5, "changes index/bound arithmetic — off-by-one risk"),
    (r"\b(if|elif)\b|[^=!<>]=\s*.+\bif\b.+\belse\b", 4, "changes a conditional"),
    (r"\b(and|or)\b", 3, "changes boolean logic (and/or)"),
    (r"\b(return|continue|break)\b", 4, "adds/removes an early return/continue/break"),
)
COMPARISON_REASON = "comparison operator changed ({}) — off-by-one risk"
NEGATION_REASON = "negation {} on a condition — inverts control flow"


def _filled(text: str, value: Column) -> Column:
    before, after = text.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def side(sign: str) -> Column:
    """The lines of a body that start with a sign, without it, as one text."""
    return F.array_join(F.regexp_extract_all("body", F.lit(rf"(?dm)^\{sign}(.*)"), 1), "\n")


def with_text(hunks: DataFrame) -> DataFrame:
    """Add the texts that the rules read: added and removed lines."""
    return hunks.withColumns({"_added": side("+"), "_removed": side("-")})


def size() -> Column:
    out = none()
    for least, points, label in reversed(SIZE):
        reason = F.concat(F.lit(label + ": "), F.col("changed").cast("string"), F.lit(" changed lines (+"), F.col("added").cast("string"), F.lit("/-"), F.col("removed").cast("string"), F.lit(")"))
        out = F.when(F.col("changed") >= least, F.array(signal("size", points, reason))).otherwise(out)
    return out


def surface(extra: Sequence[tuple[str, int, str]] = ()) -> Column:
    """Sensitive paths; ``extra`` adds (pattern, points, reason)."""
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    return F.flatten(F.array(*[when(found(path, p), "surface", points, reason) for p, points, reason in (*SURFACE, *extra)]))


def deletion() -> Column:
    a, r = F.col("added").cast("string"), F.col("removed").cast("string")
    return (
        F.when(F.col("change_type") == "deleted", F.array(signal("danger", DELETED, "deletes a file")))
        .when(F.col("removed") == 0, none())
        .when(F.col("removed") >= LARGE_FROM, F.array(signal("danger", LARGE_DELETION, F.concat(F.lit("large deletion: -"), r, F.lit(" lines")))))
        .when(F.col("removed") > F.col("added"), F.array(signal("danger", NET_DELETION, F.concat(F.lit("net deletion (-"), r, F.lit("/+"), a, F.lit(")")))))
        .otherwise(none())
    )


def danger() -> Column:
    return F.concat(deletion(), counted("danger", [(times("_added", p, i), points, reason) for p, i, points, reason in DANGER]))


def control() -> Column:
    bare = lambda text: F.regexp_replace(text, "(?d)(?:#|//).*", "")
    plus, minus = bare(F.col("_added")), bare(F.col("_removed"))
    text = F.when(F.col("added") == 0, minus).when(F.col("removed") == 0, plus).otherwise(F.concat(plus, F.lit("\n"), minus))
    holds = lambda side: F.array_compact(F.array(*[F.when(F.contains(side, F.lit(o)), F.lit(o)) for o in OPERATORS]))
    shown = lambda ops: F.when(F.size(ops) == 0, "·").otherwise(F.array_join(F.array_sort(ops), "/"))
    negated = lambda side: found(side, r"\bnot\b", False)

    def signals(t: Column) -> Column:
        lost, gained = F.array_except(t["minus"], t["plus"]), F.array_except(t["plus"], t["minus"])
        flips = (F.size(t["plus"]) > 0) & (F.size(t["minus"]) > 0) & ((F.size(lost) > 0) | (F.size(gained) > 0))
        parts = [
            when(flips, "control", COMPARISON, _filled(COMPARISON_REASON, F.concat(shown(lost), F.lit(" → "), shown(gained)))),
            when(t["not_plus"] != t["not_minus"], "control", NEGATION, _filled(NEGATION_REASON, F.when(t["not_plus"], "added").otherwise("removed"))),
            counted("control", [(times(t["text"], p, False), points, reason) for p, points, reason in CONTROL]),
        ]
        return F.when(F.rlike(t["text"], F.lit("[^ \n]")), F.flatten(F.array(*parts))).otherwise(none())

    # bound by a lambda variable, so that comments are cut off once
    seen = F.struct(holds(plus).alias("plus"), holds(minus).alias("minus"), negated(plus).alias("not_plus"), negated(minus).alias("not_minus"), text.alias("text"))
    return F.flatten(F.transform(F.array(seen), signals))


def base_pack(kind: str = "cli", weights: dict[str, float] | None = None, extra: Sequence[tuple[str, int, str]] = ()) -> Column:
    """Signals of the ``cli`` pack (size, surface, danger) or the ``library`` pack (and control)."""
    w = weights or {}
    rules = [("size", size()), ("surface", surface(extra)), ("danger", danger())]
    if kind == "library":
        rules.append(("control", control()))
    elif kind != "cli":
        raise ValueError(f"unknown pack {kind!r}")
    return pack(*[weighted(rule, w.get(name, 1.0)) for name, rule in rules])
