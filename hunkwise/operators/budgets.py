"""How far down the ranking a budget of hunks, reading time or tokens goes."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds to read, and characters of a token.
SECONDS_PER_HUNK, SECONDS_PER_LINE, CHARS_PER_TOKEN = 8.0, 1.5, 4
_UNITS = {"h": 3600, "m": 60, "s": 1}


class BudgetError(ValueError):
    """A budget that cannot be read."""


class Budget(NamedTuple):
    """One of the three is set."""

    hunks: int | None = None
    seconds: float | None = None
    tokens: int | None = None


_COUNT = re.compile(r"(\d+)\s*(?:hunks?)?")
_TOKENS = re.compile(r"(\d+)\s*(?:t|toks?|tokens?)")
_TIME = re.compile(r"(\d+(?:\.\d+)?)\s*([hms])\s*")


def _more_than_nothing(budget: Budget, text: str) -> Budget:
    if not max(x or 0 for x in budget) > 0:
        raise BudgetError(f"a budget must be more than nothing: {text!r}")
    return budget


def parse_budget(text: str) -> Budget:
    """A reviewer's budget: ``5``, ``5hunks``, ``90s``, ``1h 30m``."""
    spec = (text or "").strip().lower()
    if m := _COUNT.fullmatch(spec):
        return _more_than_nothing(Budget(hunks=int(m[1])), text)
    if spec and not _TIME.sub("", spec):
        return _more_than_nothing(Budget(seconds=sum(float(n) * _UNITS[u] for n, u in _TIME.findall(spec))), text)
    raise BudgetError(f"not a budget: {text!r}; say '5m', '90s', '1m30s' or '10hunks'")


def parse_context_budget(text: str) -> Budget:
    """A model's budget: ``8``, ``8hunks``, ``6000tok``."""
    spec = (text or "").strip().lower()
    if m := _TOKENS.fullmatch(spec):
        return _more_than_nothing(Budget(tokens=int(m[1])), text)
    if m := _COUNT.fullmatch(spec):
        return _more_than_nothing(Budget(hunks=int(m[1])), text)
    raise BudgetError(f"not a context budget: {text!r}; say '6000tok' or '8hunks'")


class TimeModel(NamedTuple):
    """What reading a hunk costs: seconds for the hunk, and for each changed line."""

    per_hunk: float = SECONDS_PER_HUNK
    per_line: float = SECONDS_PER_LINE

    def seconds(self) -> Column:
        if self.per_hunk < 0 or self.per_line < 0:
            raise ValueError("reading takes no less than no time")
        return F.lit(float(self.per_hunk)) + F.col("changed") * F.lit(float(self.per_line))


def tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / CHARS_PER_TOKEN).cast("long")


def within(hunks: DataFrame, budget: Budget, cost: Column | None = None, model: TimeModel = TimeModel()) -> DataFrame:
    """Ranked hunks with cost, spent so far, and reviewed: the longest prefix within the budget.
    The first hunk is always reviewed when time or tokens count."""
    so_far = Window.partitionBy("diff_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    if budget.hunks is not None:
        return hunks.withColumn("cost", F.lit(1.0)).withColumn("spent", F.col("rank").cast("double")).withColumn("reviewed", F.col("rank") <= budget.hunks)
    most = budget.seconds if budget.seconds is not None else budget.tokens
    out = hunks.withColumn("cost", (model.seconds() if cost is None else cost).cast("double")).withColumn("spent", F.sum("cost").over(so_far))
    return out.withColumn("reviewed", (F.col("spent") <= float(most)) | (F.col("rank") == 1))


def budget_summary(marked: DataFrame, model: TimeModel = TimeModel()) -> DataFrame:
    """diff_id, total, reviewed, skimmed, spent_seconds, total_seconds."""
    out = marked.groupBy("diff_id").agg(
        F.count("*").alias("total"),
        F.count_if("reviewed").alias("reviewed"),
        F.sum(F.when(F.col("reviewed"), model.seconds()).otherwise(0.0)).alias("spent_seconds"),
        F.sum(model.seconds()).alias("total_seconds"),
    )
    return out.withColumn("skimmed", F.col("total") - F.col("reviewed"))


def duration(value: Column) -> Column:
    """``45s``, ``2m``, ``2m05s``, ``1h05m``."""
    n = F.bround(value).cast("long")
    part = lambda x, unit: F.when(x == 0, "").otherwise(F.concat(F.lpad(x.cast("string"), 2, "0"), F.lit(unit)))
    minutes = F.floor(n / 60)
    long = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), part(minutes % 60, "m"))
    short = F.concat(minutes.cast("string"), F.lit("m"), part(n % 60, "s"))
    return F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).when(minutes < 60, short).otherwise(long)
