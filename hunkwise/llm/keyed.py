"""Exact tests of membership in a large set of keys that shuffle few rows.

The keys set bits in a map of fixed size, which is small enough to broadcast whatever the number
of keys. Rows whose bit is clear are surely outside; only the others take part in an exact join.
With very many keys the map fills up and the join has all the work; the result is the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits in a map, as a power of two: 2 MB.
MAP_BITS = 24


def _words(keys: DataFrame, key: str, bits: int) -> DataFrame:
    spot = F.shiftrightunsigned(F.col(key), 64 - bits)
    word = keys.where(F.col(key).isNotNull()).select(F.shiftright(spot, 6).alias("w"), spot.bitwiseAND(63).alias("bit"))
    return word.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("v"))


def bit_map(keys: DataFrame, key: str, bits: int = MAP_BITS) -> np.ndarray:
    """The map of a column of 64-bit hashes, as 64-bit words. At most 2**(bits - 6) rows reach the driver."""
    out = np.zeros(1 << (bits - 6), np.int64)
    for row in _words(keys, key, bits).collect():
        out[row.w] = row.v
    return out


def held(words: np.ndarray, hashes: np.ndarray, bits: int = MAP_BITS) -> np.ndarray:
    """Whether each 64-bit hash has its bit set."""
    at = hashes.view(np.uint64) >> np.uint64(64 - bits)
    of = words[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64)
    return (of >> (at & np.uint64(63))) & np.uint64(1) == 1


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such columns."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any(lead + n.lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def _near(df: DataFrame, keys: DataFrame, key: str, near: str) -> DataFrame:
    """df with a column ``near``: false where the key is surely not among ``keys``. The joined map has at
    most 2**(MAP_BITS - 6) rows of 16 bytes whatever the number of keys."""
    spot, w, v = fresh(df, "spot", "w", "v")
    words = _words(keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")), "h", MAP_BITS).toDF(w, v)
    marked = df.withColumn(spot, F.shiftrightunsigned(F.xxhash64(key), 64 - MAP_BITS)).join(F.broadcast(words), F.shiftright(spot, 6) == F.col(w), "left")
    bit = F.expr(f"shiftright({v}, cast({spot} & 63 as int)) & 1") == 1
    return marked.withColumn(near, F.col(key).isNotNull() & F.coalesce(bit, F.lit(False))).drop(spot, w, v)


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not among keys[key]; null keys stay."""
    (flag,) = fresh(df, "near")
    near = _near(df, keys, key, flag)
    out = near.where(~F.col(flag)).drop(flag)
    return out.unionByName(near.where(flag).drop(flag).join(keys.select(key).distinct(), key, "left_anti").select(*df.columns))


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is among keys[key]."""
    (flag,) = fresh(df, "near")
    near = _near(df, keys, key, flag).where(flag).drop(flag)
    return near.join(keys.select(key).distinct(), key, "left_semi").select(*df.columns)
