"""Scores, ranks, tiers and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.functions.signals import strongest_first, total

# The scale of scores and the least scores of the tiers.
SCALE = 45 / 2.4
TIERS = (("gulp", 60), ("sip", 25), ("savor", 0))


def normalized(raw: Column) -> Column:
    """0 to 100, half to even."""
    score = F.bround(100 * (1 - F.exp(-raw / F.lit(SCALE))))
    return F.when(raw <= 0, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), score))).cast("int")


def tier(score: Column) -> Column:
    out = F.lit(TIERS[-1][0])
    for name, least in TIERS[-2::-1]:
        out = F.when(score >= least, name).otherwise(out)
    return out


def scored(hunks: DataFrame) -> DataFrame:
    """Add raw, score and tier from ``signals``, which come strongest first."""
    out = hunks.withColumn("signals", strongest_first(F.col("signals"))).withColumn("raw", total(F.col("signals")))
    return out.withColumn("score", normalized(F.col("raw"))).withColumn("tier", tier(F.col("score")))


def in_order() -> Window:
    """The reading order of a diff's hunks. A diff is a row of the source, so a window holds no more than that row."""
    return Window.partitionBy("diff_id").orderBy(F.col("score").desc(), F.col("raw").desc(), "id", "file_seq", "hunk_seq")


def ranked(hunks: DataFrame) -> DataFrame:
    return hunks.withColumn("rank", F.row_number().over(in_order()))


def why(joiner: str = "; ") -> Column:
    """The reasons with their points, as one text."""
    return F.array_join(F.transform("signals", lambda s: F.when(s["points"] > 0, F.concat(s["reason"], F.lit(" (+"), s["points"].cast("string"), F.lit(")"))).otherwise(s["reason"])), joiner)


def summary(hunks: DataFrame) -> DataFrame:
    """diff_id, hunks, files with hunks, and the worst score."""
    return hunks.groupBy("diff_id").agg(F.count("*").alias("hunks"), F.countDistinct("file_path").alias("files"), F.max("score").alias("worst"))


def gate(hunks: DataFrame, least: int) -> DataFrame:
    """diff_id, worst, tripped: whether a hunk reaches the score."""
    return hunks.groupBy("diff_id").agg(F.max("score").alias("worst"), F.max(F.col("score") >= least).alias("tripped"))
