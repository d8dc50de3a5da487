"""Importance resampling towards a target distribution, in two passes over Arrow batches.

The features of a text are its runs of 1 to ``ngram`` words, hashed into buckets by crc32. The first pass counts the
buckets of all documents, and of all target texts: each partition gives one vector (np.bincount), and a tree of
tasks adds the vectors. A bucket's gain is the scaled logarithm of its smoothed share in the target over its share in
the documents; the gains, one number a bucket, are broadcast. The second pass adds up the gains of each document's
features (bincount with the gains as weights). Gumbel noise from a hash of the id makes the highest scores a
draw without replacement by importance.

Ranks come from a sort by ranges of (score, doc_id): rows are numbered within their partition, and a partition's
first number is the sum of the counts before it. Nothing but one count a partition reaches the driver.

Edge cases: null and empty texts have no features, weight 0, and are never drawn, as are all with too few words.
Repeated rows are drawn each; of rows with one score the smaller doc_id is first, a null doc_id last. The noise of a
null doc_id is that of an empty one. With no target texts, or no documents, all counts of theirs are 0. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.shelf import Shelf, small_batches
from hunkwise.llm.textbits import Words, runs

BUCKETS = 10_000
_SCORED = "doc_id long, n_words long, n_features long, weight long, score long, row long"
#: Bytes of a word beyond which it is hashed alone.
_LONG = 64


def _crc_table() -> np.ndarray:
    """The table of the reflected polynomial 0xEDB88320, as zlib has it."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of every data[start:end], each carried on from ``before``."""
    length = end - start
    out = np.zeros(len(start), np.uint32) if before is None else before.copy()
    for i in np.flatnonzero(length > _LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(out[i]))
    short = np.flatnonzero(length <= _LONG)
    order = short[np.argsort(-length[short].astype(np.int8), kind="stable")]
    at, c = start[order], ~out[order]
    shorter = np.searchsorted(-length[order], np.arange(0, -_LONG - 1, -1), side="left")  # how many are longer than 0, 1, ...
    for j in range(int(length[short].max(initial=0))):
        n = shorter[j]
        c[:n] = _CRC[(c[:n] ^ data[at[:n] + j]) & 0xFF] ^ (c[:n] >> 8)
    out[order] = ~c
    return out


def features(data: np.ndarray, offs: np.ndarray, ngram: int, buckets: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, document, bucket) of the runs of 1 to ``ngram`` words of every text."""
    words = Words(data, offs, "alnum")
    low = np.append(words.low, np.uint8(32))
    space = np.full(len(words), len(low) - 1)
    state, at = crc32s(low, words.start, words.end), np.arange(len(words))
    docs, found = [words.doc], [state]
    for k in range(1, ngram):
        longer = at[at + k < len(words)]
        longer = longer[words.doc[longer] == words.doc[longer + k]]
        state = crc32s(low, space[longer], space[longer] + 1, state[np.searchsorted(at, longer)])
        state, at = crc32s(low, words.start[longer + k], words.end[longer + k], state), longer
        docs.append(words.doc[at])
        found.append(state)
    return words, np.concatenate(docs), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, ngram: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (text) are in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offs in runs(batch.column("text")):
                total += np.bincount(features(data, offs, ngram, buckets)[2], minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select("text").mapInArrow(count, "counts binary").rdd.map(lambda row: np.frombuffer(row.counts, np.int64))
    return vectors.treeReduce(np.add, depth=3) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the source)) of each bucket."""
    more_s, more_t = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * more_s / ((s + 1.0) * more_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise, in thousandths, from the first 32 bits of a hash."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int, ngram: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs (doc_id, text), and a number of the row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.frombuffer(shared.value, np.int64)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], []]
            for _, _, data, offs in runs(batch.column("text")):
                words, doc, bucket = features(data, offs, ngram, len(of))
                n = len(offs) - 1
                # sums of integers in doubles: exact up to 2**53
                for c, v in zip(columns, (np.diff(words.first), np.bincount(doc, minlength=n), np.bincount(doc, of[bucket], minlength=n)), strict=True):
                    c.append(v.astype(np.int64))
            n_words, n_features, weight = (np.concatenate([np.zeros(0, np.int64), *c]) for c in columns)
            ids = batch.column("doc_id").to_pylist()
            score = weight + np.array([noise(seed, i) for i in ids], np.int64)
            numbers = row + np.arange(len(ids))
            row += len(ids)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight, score, numbers))], names=[f.split()[0] for f in _SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCORED)


def ranked(rows: DataFrame, shelf: Shelf) -> DataFrame:
    """Rows (doc_id, score, row, ...) with their rank by score from 1, ties to the smaller doc_id."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n), pa.int64())], names=[*batch.schema.names, "part", "at"])
            at += n

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = shelf.put(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{schema}, part int, at long"))
    first, firsts = 1, []
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):  # a row for each partition
        firsts.append((part, first))
        first += n
    return placed.join(F.broadcast(spark.createDataFrame(firsts, "part int, first long")), "part").withColumn("rank", F.col("at") + F.col("first")).drop("part", "at", "first")


def resample(
    docs: DataFrame, target: DataFrame, ngram: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, per_100: int = 10, shelf: Shelf | None = None
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs (doc_id, text): the ``per_100`` hundredths of the
    documents of ``least_words`` words with the highest scores, given texts of the target (text), have a rank."""
    small_batches(docs.sparkSession)
    shelf = shelf or Shelf(docs.sparkSession)
    gain = gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets))
    rows = shelf.put(scored(docs, gain, seed, ngram))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = per_100 * able.count() // 100
    out = ranked(able, shelf).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return out.select(*columns).unionByName(rest.select(*columns))
