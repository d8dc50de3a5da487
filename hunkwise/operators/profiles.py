"""Reviewer profiles: multipliers for categories of signals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.rx import found
from hunkwise.functions.signals import none, signal
from hunkwise.operators.score import ranked, scored

# Categories by words of a reason, the paths of front ends, and the profiles.
CATEGORY_OF = (
    ("authentication/session", "auth"),
    ("cryptography/secrets", "crypto"),
    ("database migration/schema", "migration"),
    ("CI workflow", "ci"),
    ("CI/CD pipeline", "ci"),
    ("container/build config", "container"),
    ("declared dependencies", "deps"),
    ("dependency lockfile", "lockfile"),
    ("environment/credentials", "env"),
    ("raw sql", "sql"),
)
FRONTEND_PATH = r"\.(css|scss|sass|less|styl|html?|htm|vue|svelte|jsx|tsx|astro)$|(^|/)(components?|styles?|assets|public|templates?|views?|pages?)/"
FRONTEND_REASON, FRONTEND_POINTS = "touches frontend surface (markup/styles/components)", 8
PROFILES = {
    "backend": {"migration": 1.4, "sql": 1.4, "auth": 1.3, "deps": 1.15, "frontend": 0.5},
    "frontend": {"frontend": 1.6, "migration": 0.6, "sql": 0.6, "container": 0.7, "lockfile": 0.6},
    "security": {"auth": 1.5, "crypto": 1.5, "env": 1.5, "deps": 1.3, "lockfile": 1.2},
}

#: What a profile may weigh.
CATEGORIES = ("auth", "crypto", "migration", "sql", "ci", "container", "deps", "lockfile", "env", "frontend")


class ProfileError(ValueError):
    """A profile that is not known, or not one."""


def checked(custom: Mapping[str, Mapping[str, float]]) -> dict[str, dict[str, float]]:
    """Custom profiles, whose categories are known and whose multipliers are numbers from 0 on."""
    for name, by in custom.items():
        if not isinstance(by, Mapping):
            raise ProfileError(f"profile {name!r} is not a table of category = multiplier")
        for category, m in by.items():
            if category not in CATEGORIES:
                raise ProfileError(f"profile {name!r}: unknown category {category!r}; there are {', '.join(CATEGORIES)}")
            if isinstance(m, bool) or not isinstance(m, int | float) or not m >= 0:
                raise ProfileError(f"profile {name!r}: the multiplier of {category!r} must be a number from 0 on, not {m!r}")
    return {name: {c: float(m) for c, m in by.items()} for name, by in custom.items()}


def composed(names: Iterable[str], custom: Mapping[str, Mapping[str, float]] | None = None) -> dict[str, float]:
    """The product of the named profiles, category by category."""
    known = {**PROFILES, **checked(custom or {})}
    out: dict[str, float] = {}
    for name in filter(None, map(str.strip, names)):
        if name not in known:
            raise ProfileError(f"unknown profile {name!r}; there are {', '.join(sorted(known))}")
        for category, by in known[name].items():
            out[category] = out.get(category, 1.0) * by
    return out


def category(reason: Column) -> Column:
    """auth, crypto, ... frontend, or null."""
    out = F.lit(None).cast("string")
    for words, name in reversed(CATEGORY_OF):
        out = F.when(F.contains(F.lower(reason), F.lit(words.lower())), name).otherwise(out)
    return F.when(reason == FRONTEND_REASON, "frontend").otherwise(out)


def with_profiles(hunks: DataFrame, names: list[str], custom: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Scored hunks, weighted anew and ranked."""
    by = {c: m for c, m in composed(names, custom).items() if m != 1.0}
    if not by:
        return hunks
    label = "+".join(names)
    signals = F.col("signals")
    if "frontend" in by:
        path = F.replace("file_path", F.lit("\\"), F.lit("/"))
        signals = F.concat(signals, F.when(found(path, FRONTEND_PATH), F.array(signal("surface", FRONTEND_POINTS, FRONTEND_REASON))).otherwise(none()))

    def again(s: Column) -> Column:
        points, reason, of = s["points"], s["reason"], category(s["reason"])
        for name, m in by.items():
            percent = round((m - 1.0) * 100)
            note = f" ({'boosted +' if percent > 0 else 'eased '}{percent}% by profile: {label})"
            points = F.when(of == name, F.greatest(F.lit(0), F.bround(s["points"] * F.lit(float(m)))).cast("int")).otherwise(points)
            reason = F.when(of == name, F.concat(s["reason"], F.lit(note))).otherwise(reason)
        return F.struct(s["rule"].alias("rule"), points.cast("int").alias("points"), reason.alias("reason"))

    signals = F.filter(F.transform(signals, again), lambda s: (s["points"] > 0) | (s["rule"] == "llm"))
    return ranked(scored(hunks.drop("raw", "score", "tier", "rank").withColumn("signals", signals)))
