"""Regular expressions that mean the same in the JVM as in the tools whose rules we keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, ignore_case: bool = False) -> str:
    """Unicode classes, and only line feeds end lines."""
    return ("(?iudU)" if ignore_case else "(?dU)") + pattern


def found(text: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    return F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(rx(pattern, ignore_case)))


def times(text: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    """Matches that do not overlap."""
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(rx(pattern, ignore_case)))
