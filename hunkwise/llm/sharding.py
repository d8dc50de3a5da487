"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts are a group and stay together. Groups of one size are alike, so what is packed
is the table of sizes and how many groups have each. It has at most sqrt(2 x bytes) rows, for that many
different sizes add up to all bytes. Sizes, largest first, go to the bin with the least remaining room
that still takes them, found in a balanced tree, as many groups at once as that bin takes: each
group goes where it would go alone. The groups of a size are then numbered, and looked up by number.

With a capacity, as few bins are opened as the method needs. With a number of bins the smallest
capacity for which it succeeds is searched, which makes the bins nearly equal in bytes. A group larger
than the capacity stays whole in a bin of its own.

Numbers and slots count within small sections, after the counts of the sections before, so that
neither groups of one size nor rows of one shard are numbered in one task; rows are dealt to sections by a number of
their own, for many may be alike. The groups of more than a
small share of all bytes, of which there cannot be many, are broadcast to their rows.

Edge cases: null text is empty, with size 1. Repeated rows each have a slot. A null doc_id is a
row like any other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hunkwise.llm.shelf import Shelf

#: A group of more than this share of all bytes is broadcast: at most 1 / SHARE of them.
SHARE = 1 / 4096
#: Least sections of a shard, and rows of a section beyond them.
SECTIONS, SECTION_ROWS = 64, 500_000
#: Groups of one size that are looked up together, and rows of a table that is broadcast.
RUN, BROADCAST_ROWS = 4096, 200_000

#: Groups of a size: (bytes of each, how many), and where they go: (bytes, first, past the last, bin).
Sizes = Sequence[tuple[int, int]]
Places = list[tuple[int, int, int, int]]


class _Tree:
    """Bins by remaining room, in a balanced tree (a treap): insert, and take the tightest fit."""

    def __init__(self):
        self.root = None
        self.state = 88172645463325252

    def _priority(self) -> int:
        self.state ^= (self.state << 13) & (2**64 - 1)
        self.state ^= self.state >> 7
        self.state ^= (self.state << 17) & (2**64 - 1)
        return self.state

    def _split(self, t, key):
        """(keys below, keys from ``key`` on)."""
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            t[3] = a
            return t, b
        a, b = self._split(t[2], key)
        t[2] = b
        return a, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, key: tuple[int, int]) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self._priority(), None, None]), b)

    def take(self, room: int) -> tuple[int, int] | None:
        """Remove and return the smallest (room, bin) with at least ``room``."""
        a, b = self._split(self.root, (room, -1))
        found = b
        while found is not None and found[2] is not None:
            found = found[2]
        if found is None:
            self.root = a
            return None
        key = found[0]
        same, rest = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, rest)
        return key


def best_fit_decreasing(sizes: Sizes, capacity: int, bins: int | None = None) -> Places | None:
    """Where the groups of each size go. A new bin opens when no open one has room; None if that needs more
    than ``bins``."""
    tree, out, n = _Tree(), [], 0
    for size, count in sorted(sizes, reverse=True):
        at = 0
        while at < count:
            fit = tree.take(size)
            if fit is None:
                if n == bins:
                    return None
                fit, n = (max(capacity, size), n), n + 1
            room, bin_ = fit
            # while it takes another, this bin stays the tightest
            took = min(count - at, room // size)
            out.append((size, at, at + took, bin_))
            tree.insert((room - took * size, bin_))
            at += took
    return out


def even_bins(sizes: Sizes, bins: int) -> Places:
    """Best-fit-decreasing into ``bins`` bins of the smallest capacity for which that succeeds."""
    # groups beyond the mean of what is left have bins of their own
    rest, left = sum(size * n for size, n in sizes), bins
    largest = sorted(sizes, reverse=True)
    for size, n in largest:
        alone = 0
        while alone < n and left > 1 and size * left > rest:
            rest, left, alone = rest - size, left - 1, alone + 1
        if alone < n:
            break
    lo = -(-rest // left)
    hi = lo + max((size for size, _ in sizes if size <= lo), default=0)  # at which it must succeed
    # the mean of what is left mostly does, or little more: steps that double, then halves of the last one
    out, step = best_fit_decreasing(sizes, lo, bins), 1
    while out is None:
        out = best_fit_decreasing(sizes, min(lo + step, hi), bins)
        if out is None:
            lo, step = lo + step + 1, 2 * step
        else:
            hi = min(lo + step, hi)
            while lo < hi:
                mid = (lo + hi) // 2
                found = best_fit_decreasing(sizes, mid, bins)
                if found is None:
                    lo = mid + 1
                else:
                    hi, out = mid, found
    return out


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered(df: DataFrame, of: str, by: Sequence[str], sections: Column | int, name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... within each value of ``of``, by sections of a hash of ``by``."""
    df = df.withColumn("section", F.pmod(F.xxhash64(*by), sections if isinstance(sections, Column) else F.lit(sections)).cast("int"))
    before = Window.partitionBy(of).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy(of, "section").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = F.row_number().over(Window.partitionBy(of, "section").orderBy(*by)) - 1
    return df.withColumn("at", at).join(first, [of, "section"]).withColumn(name, (F.col("at") + F.col("first")).cast("long")).drop("at", "first", "section")


def shards(docs: DataFrame, n: int = 16, capacity: int | None = None, shelf: Shelf | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs (doc_id, text): ``n`` shards of nearly equal
    bytes, or few shards of ``capacity`` bytes."""
    spark: SparkSession = docs.sparkSession
    shelf = shelf or Shelf(spark)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = shelf.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.md5(data)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    groups = shelf.put(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    table = shelf.put(groups.groupBy("bytes").agg(F.count("*").alias("count"), F.sum("rows").alias("rows")))
    found = table.toArrow()  # at most sqrt(2 x bytes) rows
    sizes = list(zip(found.column("bytes").to_pylist(), found.column("count").to_pylist(), strict=True))
    total, n_rows = sum(size * k for size, k in sizes), sum(found.column("rows").to_pylist())
    places = best_fit_decreasing(sizes, capacity) if capacity else even_bins(sizes, n)
    assert places is not None
    # every run of numbers that a place reaches into
    runs = [(size, lo // RUN + i, lo, hi, bin_) for size, lo, hi, bin_ in places for i in range((hi - 1) // RUN - lo // RUN + 1)]
    where = spark.createDataFrame(pa.table(dict(zip(("bytes", "run", "lo", "hi", "shard"), map(list, zip(*runs)), strict=True)))) if runs else spark.createDataFrame([], "bytes long, run long, lo long, hi long, shard long")
    counted = groups.join(_small(table.select("bytes", "count"), len(sizes)), "bytes")
    counted = numbered(counted, "bytes", ["digest"], F.ceil(F.col("count") / SECTION_ROWS), "number").withColumn("run", F.floor(F.col("number") / RUN))
    placed = counted.join(_small(where, len(runs)), ["bytes", "run"]).where("number >= lo and number < hi")
    placed = shelf.put(placed.select("digest", "bytes", F.col("shard").cast("int").alias("shard")))
    hot = F.col("bytes") > max(1, int(total * SHARE))
    big = F.broadcast(placed.where(hot).select("digest", F.col("shard").alias("own")))  # at most 1 / SHARE rows
    rows = rows.join(big, "digest", "left")
    few = rows.where("own is null").join(placed.where(~hot).select("digest", "shard"), "digest")
    columns = ["doc_id", "size", "text_crc32", "row"]
    out = rows.where("own is not null").select(*columns, F.col("own").alias("shard")).unionByName(few.select(*columns, "shard"))
    n_shards = max((p[3] for p in places), default=0) + 1
    out = numbered(out, "shard", ["row"], max(SECTIONS, -(-n_rows // (n_shards * SECTION_ROWS))), "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
