"""Signals as columns: arrays of (rule, points, reason)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<rule:string,points:int,reason:string>>"


def none() -> Column:
    return F.array().cast(TYPE)


def signal(rule: str, points: Column | int, reason: Column | str) -> Column:
    points = F.lit(points) if isinstance(points, int) else points
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(rule).alias("rule"), points.cast("int").alias("points"), reason.alias("reason"))


def when(condition: Column, rule: str, points: Column | int, reason: Column | str) -> Column:
    """The signal, or none."""
    return F.when(condition, F.array(signal(rule, points, reason))).otherwise(none())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def counted(rule: str, checks: Sequence[tuple[Column, int, str]]) -> Column:
    """Signals of the checks (count, points, reason) that count more than 0, which say how often beyond one."""
    fixed = F.expr("array(" + ", ".join(f"struct({points} as points, {_quoted(reason)} as reason)" for _, points, reason in checks) + ")")
    met = F.filter(F.arrays_zip(F.array(*[n for n, _, _ in checks]).alias("n"), fixed.alias("fixed")), lambda x: x["n"] > 0)
    return F.transform(met, lambda x: signal(rule, x["fixed"]["points"], F.concat(x["fixed"]["reason"], F.when(x["n"] > 1, F.concat(F.lit(" (x"), x["n"].cast("string"), F.lit(")"))).otherwise(""))))


def pack(*rules: Column) -> Column:
    """All signals with points, in the order of the rules."""
    return F.filter(F.flatten(F.array(*rules)), lambda s: s["points"] > 0)


def weighted(signals: Column, weight: float) -> Column:
    """Points times a weight, half to even, not below 0."""
    if weight == 1.0:
        return signals
    return F.transform(signals, lambda s: F.struct(s["rule"].alias("rule"), F.greatest(F.lit(0), F.bround(s["points"] * F.lit(float(weight)))).cast("int").alias("points"), s["reason"].alias("reason")))


def strongest_first(signals: Column) -> Column:
    """By points, ties in the given order."""
    keyed = F.transform(signals, lambda s, i: F.struct((-s["points"]).alias("p"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def total(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0), lambda a, s: a + s["points"])
