"""Sparse linear text classifiers: hashed features of whole texts, and scoring by sparse dot products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.shelf import Shelf
from hunkwise.llm.textbits import runs

#: Bytes of a sample's features that reach the driver, and the part of them that one row may have at most.
MOST_BYTES, LARGE = 256 << 20, 64

#: features(bytes, offsets) -> (document, feature id, value), sorted by document
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; fold 0 is held out. A null id is in no fold of its own: 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


def score_column(features: Features, weights: np.ndarray, bias: float) -> Callable[[Column], Column]:
    """A column function text -> sigmoid(bias + sparse dot product of the text's features)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for _, _, data, offs in runs(pa.Array.from_pandas(texts, type=pa.large_string())):
            doc, ids, values = features(data, offs)
            raw = np.bincount(doc, weights[ids] * values, minlength=len(offs) - 1) + bias
            out.append(1 / (1 + np.exp(-np.clip(raw, -500, 500))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


class Rows(NamedTuple):
    """Labelled sparse rows: row i has ids[first[i] : first[i + 1]] with values of the same places (None: all 1)."""

    y: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    values: np.ndarray | None


def _described(features: Features, dim_bits: int):
    """Rows (y, draw, ids, vals) of rows (y, draw, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of, values_of = [], []
            for _, _, data, offs in runs(batch.column("text")):
                doc, ids, values = features(data, offs)
                key, at = np.unique((doc.astype(np.int64) << dim_bits) | ids, return_inverse=True)
                total = np.bincount(at, values, minlength=len(key)).astype(np.float32)
                own, ids = key >> dim_bits, (key & ((1 << dim_bits) - 1)).astype(np.int32)
                cut = np.searchsorted(own, np.arange(len(offs)))
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    ids_of.append(ids[lo:hi].tobytes())
                    values_of.append(total[lo:hi].tobytes())
            yield pa.record_batch([batch.column("y").cast(pa.int32()), batch.column("draw"), pa.array(ids_of, pa.binary()), pa.array(values_of, pa.binary())], names=["y", "draw", "ids", "vals"])

    return run


def _frequencies(dim_bits: int):
    """Rows (id, n): in how many of a task's documents each feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << dim_bits, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                n[np.frombuffer(ids.as_py(), np.int32)] += 1  # each id of a document once
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(used), pa.array(n[used])], names=["id", "n"])

    return run


def _only(usable: Broadcast):
    """Rows (y, draw, ids) without features that are not usable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(np.frombuffer(usable.value, np.uint8)).astype(bool)
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.int32) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("y"), batch.column("draw"), pa.array([x[keep[x]].tobytes() for x in ids], pa.binary())], names=["y", "draw", "ids"])

    return run


def _within(described: DataFrame, most: int) -> DataFrame:
    """The rows whose features are within the bytes that the driver takes."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in described.columns if c in ("ids", "vals")), F.lit(0))
    sizes = described.select("y", "draw", size.alias("size")).toArrow()  # a few numbers for each row of the sample
    y, draw, size = (sizes.column(c).to_numpy() for c in ("y", "draw", "size"))
    if size.sum() <= most:
        return described
    order = np.lexsort((draw, size > most // LARGE))
    order = order[: np.searchsorted(np.cumsum(size[order]), most, side="right")]
    order = order[size[order] <= most // LARGE]
    kept = described.sparkSession.createDataFrame(pa.table({"y": y[order], "draw": draw[order]}))
    return described.join(F.broadcast(kept), ["y", "draw"], "left_semi")


def flattened(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of bytes one after another, without a copy for each row, and where each row's begin."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    one = column.cast(pa.large_binary()).combine_chunks()
    _, at, data = one.buffers()
    at = np.frombuffer(at, np.int64)[one.offset : one.offset + len(one) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(data or b"", kind, (at[-1] - at[0]) // size, at[0]), (at - at[0]) // size


def sums(values: np.ndarray, at: np.ndarray, first: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """np.add.reduceat(values[at], first) of rising ``first``, for about ``most`` entries at a time."""
    cuts = np.unique([*np.searchsorted(first, np.arange(0, len(at), most)), len(first)])
    ends = np.append(first, len(at))
    return np.concatenate([np.add.reduceat(values[at[first[lo] : ends[hi]]], first[lo:hi] - first[lo]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])


def by_number(ids: np.ndarray, first: np.ndarray, n: int, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all entries, in the order of their numbers (0 to n - 1) and rows, and where each number's begin; ``most`` entries are sorted at a time."""
    begin = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=n))[:-1]])
    row_of, at = np.empty(len(ids), np.int32), begin.copy()
    for lo in range(0, len(ids), most):
        part = ids[lo : lo + most]
        order = np.argsort(part, kind="stable")
        part = part[order]
        new = np.flatnonzero(np.diff(part, prepend=-1))
        count = np.diff(new, append=len(part))
        row_of[at[part] + np.arange(len(part)) - np.repeat(new, count)] = np.searchsorted(first, lo + order, side="right") - 1
        at[part[new]] += count
    return row_of, begin


def gather(docs: DataFrame, features: Features, dim_bits: int, shelf: Shelf | None = None, least_docs: int = 0, most_share: float = 1.0) -> Rows:
    """The features of every row of docs (y, draw, text): a sample whose bound the caller states.

    At most ``MOST_BYTES`` of features reach the driver: where the sample has more, rows count in the order of ``draw``
    until these are used up, and one of more than a ``LARGE`` part of them not at all.

    With ``least_docs`` only the presence of those features comes that so many rows, and at most
    ``most_share`` of them, have; they are counted before anything reaches the driver. Rows come in
    the order of ``draw``, so that the model is the same whatever task they came from.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    described = shelf.put(docs.select("y", "draw", "text").mapInArrow(_described(features, dim_bits), "y int, draw long, ids binary, vals binary"))
    if least_docs:
        most = most_share * described.count()
        seen = described.select("ids").mapInArrow(_frequencies(dim_bits), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        usable = np.zeros(1 << dim_bits, bool)
        usable[seen.where((F.col("n") >= least_docs) & (F.col("n") <= most)).select("id").toArrow().column("id").to_numpy()] = True  # 2**dim_bits ids at most
        shared = docs.sparkSession.sparkContext.broadcast(np.packbits(usable).tobytes())
        described = described.mapInArrow(_only(shared), "y int, draw long, ids binary")
    rows = _within(described, MOST_BYTES).toArrow()
    rows = rows.take(np.lexsort((rows.column("draw").to_numpy(), rows.column("y").to_numpy())))

    def flat(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        return flattened(rows.column(name), kind)

    ids, first = flat("ids", np.int32)
    return Rows(rows.column("y").to_numpy(), first, ids, None if least_docs else flat("vals", np.float32)[0])


def sample(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """Up to ``most`` of the different doc_ids, the same ones on every run: doc_id, y, draw."""
    draw = F.xxhash64("doc_id", F.lit(seed))
    return ids.where("doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y")).select("doc_id", "y", draw.alias("draw")).orderBy("draw", "doc_id").limit(most)


def texts_of(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """y, draw, text of the drawn ids: a document once, by the smallest text of its rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    return rows.groupBy("doc_id", "y", "draw").agg(F.min("text").alias("text"))
