"""Rows whose key may be among others, before anything is shuffled.

The keys set bits in a map of fixed size, which is small enough to broadcast however many keys there are. A row whose
bit is clear is surely not among them. With very many keys the map fills up and keeps more rows; a later exact step
gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in a map, as a power of two: 2**18 rows of 16 bytes at most.
BITS = 24


def bit_map(keys: DataFrame, key: Column | str, bits: int = BITS) -> DataFrame:
    """_word, _set: the words of the map that have a bit set."""
    spot = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    each = keys.where(F.col(key).isNotNull() if isinstance(key, str) else key.isNotNull()).select(spot.alias("_spot"))
    words = each.groupBy(F.shiftright("_spot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_spot & 63 as int))")).alias("_set"))
    return F.broadcast(words)


def maybe_among(df: DataFrame, key: str, words: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of df whose key's bit is set; all whose key is one of the map's are kept."""
    marked = df.withColumn("_spot", F.shiftrightunsigned(F.xxhash64(key), 64 - bits))
    near = marked.join(words, (F.shiftright("_spot", 6) == F.col("_word")) & (F.expr("shiftright(_set, cast(_spot & 63 as int)) & 1") == 1))
    return near.drop("_spot", "_word", "_set")
