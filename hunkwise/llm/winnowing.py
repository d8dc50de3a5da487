"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every sliding window of k-grams, with k and the
window chosen so that every shared span of ``span`` words holds a kept hash of both. A document's
kept hashes are held against those of the benchmark in a bit map of fixed size; around a hit, the
windows of ``span`` words that the benchmark may hold are extended to the longest stretch. The
stretches, each different text once, are then joined with the benchmark's windows word for word.

Edge cases: null or wordless texts have no words, no hits and no items. A benchmark item of fewer
than ``span`` words is one window of its own length. Rows of one item_id count as one item, a null
item_id as none. Every document row is judged for itself, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.keyed import bit_map, held
from hunkwise.llm.shelf import Shelf
from hunkwise.llm.textbits import U, Words, mix, runs

#: k of the k-grams; the window of k-grams follows from the span.
GRAM = 4
#: The benchmark's windows are broadcast up to so many, joined by shuffle beyond.
BROADCAST_ROWS = 100_000
#: The share of all quotes from which on a stretch is quoted very often.
HOT_SHARE = 1 / 1024


def kept(words: Words, span: int, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the k-grams that winnowing keeps."""
    at, grams = words.ngrams(k)
    width = span - k + 1
    if len(at) < width:
        return at[:0], grams[:0]
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    whole = at[width - 1 :] - at[: len(at) - width + 1] == width - 1
    whole &= words.doc[at[width - 1 :]] == words.doc[at[: len(at) - width + 1]]
    pick = np.unique((view.argmin(axis=1) + np.arange(len(view)))[whole])
    return at[pick], mix(grams[pick] ^ U(0x5851F42D4C957F2D))


def _spell(words: Words, lo: int, hi: int) -> str:
    low = words.low
    return " ".join(low[s:e].tobytes().decode() for s, e in zip(words.start[lo:hi], words.end[lo:hi], strict=True))


def _item_windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, text, hashes = [], [], [], []
            own = batch.column("item_id").to_pylist()
            for first, _, data, offs in runs(batch.column("text")):
                words = Words(data, offs, "alnum")
                at, fps = kept(words, span)
                for d in range(words.n_docs):
                    lo, hi = int(words.first[d]), int(words.first[d + 1])
                    if hi == lo:
                        continue
                    n = min(span, hi - lo)
                    starts, grams = words.ngrams(n)
                    a, b = np.searchsorted(starts, [lo, hi])
                    marks = np.concatenate((fps[(at >= lo) & (at < hi)], grams[a:b])).view(np.int64).tolist()
                    for i, s in enumerate(range(lo, hi - n + 1)):
                        ids.append(own[first + d])
                        size.append(n)
                        text.append(_spell(words, s, s + n))
                        hashes.append(marks if not i else [])
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(text, pa.string()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["item_id", "size", "window", "marks"],
            )

    return run


def _stretches(span: int, lengths: list[int], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        task, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            n_words, found = [], []
            for _, _, data, offs in runs(batch.column("text")):
                words = Words(data, offs, "alnum")
                n = len(words)
                n_words += np.diff(words.first).tolist()
                cover = np.zeros(n + 1, np.int64)
                for size in lengths:
                    starts, grams = words.ngrams(size)
                    if size == span:
                        at, fps = kept(words, span)
                        at = at[held(marks, fps)]
                        near = (at[:, None] - np.arange(span - GRAM + 1)).ravel()
                        spot = np.searchsorted(starts, near)
                        near = spot[(near >= 0) & (spot < len(starts))] if len(starts) else spot[:0]
                        near = np.unique(near)
                        starts, grams = starts[near], grams[near]
                    starts = starts[held(marks, grams)]
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + size, -1)
                inside = np.cumsum(cover)[:n] > 0
                head = np.zeros(n, bool)
                head[words.first[:-1][words.first[:-1] < n]] = True
                begin = np.flatnonzero(inside & (head | ~np.concatenate(([False], inside[:-1])))) if n else []
                end = np.flatnonzero(inside & np.concatenate((head[1:] | ~inside[1:], [True]))) + 1 if n else []
                of = [[] for _ in range(words.n_docs)]
                for b, e in zip(begin, end, strict=True):
                    of[words.doc[b]].append(_spell(words, b, e))
                found += of
            yield pa.record_batch(
                [pa.array(range(task + row, task + row + len(n_words)), pa.int64()), batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "stretches"],
            )
            row += len(n_words)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, shelf: Shelf | None = None) -> DataFrame:
    """row, doc_id, n_words, n_hit, items (sorted as strings) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    shelf = shelf or Shelf(spark)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    spelled = shelf.put(items.mapInArrow(_item_windows(span), "item_id long, size int, window string, marks array<long>"))
    marks = spark.sparkContext.broadcast(bit_map(spelled.select(F.explode("marks").alias("h")), "h"))
    lengths = sorted(r["size"] for r in spelled.select("size").distinct().collect())  # 1 to span
    windows = shelf.put(spelled.groupBy("window").agg(F.collect_set("item_id").alias("items")))
    if windows.count() <= BROADCAST_ROWS:
        windows = F.broadcast(windows)
    docs = docs.select("doc_id", "text")
    found = shelf.put(docs.mapInArrow(_stretches(span, lengths, marks), "row long, doc_id long, n_words long, stretches array<string>"))
    hit = found.where(F.size("stretches") > 0).select("row", "doc_id", "n_words", F.explode("stretches").alias("stretch"))
    # each different stretch once
    sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    words = F.split("stretch", " ")
    spans = F.flatten(F.transform(sizes, lambda n: F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda s: F.struct(s.alias("at"), n.alias("n")))).otherwise(F.array().cast("array<struct<at:int,n:int>>"))))
    one = hit.select("stretch").distinct().withColumn("words", words).withColumn("span", F.explode(spans))
    one = one.select("stretch", F.col("span.at").alias("at"), F.col("span.n").alias("n"), F.array_join(F.slice("words", F.col("span.at") + 1, F.col("span.n")), " ").alias("window"))
    one = one.join(windows, "window")
    judged = one.groupBy("stretch").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))))).cast("long").alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    judged = shelf.put(judged)
    if judged.count() <= BROADCAST_ROWS:
        looked_up = hit.join(F.broadcast(judged), "stretch", "left")
    else:
        # stretches that very many documents quote are looked up where they are: at most 1 / HOT_SHARE of them
        often = hit.groupBy("stretch").agg(F.count("*").alias("n")).where(F.col("n") > F.lit(max(1, int(HOT_SHARE * hit.count())))).select("stretch")
        hot = F.broadcast(shelf.put(often.join(judged, "stretch", "left").withColumn("hot", F.lit(True)).withColumnsRenamed({"hits": "hot_hits", "items": "hot_items"})))
        marked = hit.join(hot, "stretch", "left")
        rest = marked.where("hot is null").select(*hit.columns).join(judged, "stretch", "left")
        looked_up = rest.unionByName(marked.where("hot").select(*hit.columns, F.col("hot_hits").alias("hits"), F.col("hot_items").alias("items")))
    per_doc = looked_up.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    none = found.where(F.size("stretches") == 0).select("row", "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<long>").alias("items"))
    out = per_doc.select("row", "doc_id", "n_words", "n_hit", "items").union(none)
    return out.withColumn("items", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
