"""Quality by hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

The features of a text are its white-space words and word pairs, and runs of one to three word
shapes: upper case, capital, digits, the punctuation around the letters, and whether the word
repeats the one before. A feature's value is its share of the text's words, so that a score is a
sparse dot product plus a bias.

The sample that trains the model is bounded by ``most``; every document is scored over its whole
text. Null and empty texts score by the bias alone. Labels that are null, or of a held-out fold,
are never read; repeated labels of a document count once, the higher one; repeated rows train once, by
the smallest text. Without labels every
score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.linear import Rows, fold, gather, sample, score_column, texts_of
from hunkwise.llm.textbits import U, Words, mix

DIM_BITS = 18
MOST = 8_000


def _shapes(words: Words, data: np.ndarray) -> np.ndarray:
    """A small number for the look of each word."""
    upper = (data >= 65) & (data <= 90)
    lower = ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    mark = ~(upper | lower | digit)

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return total[words.end] - total[words.start]

    u, lo, d, p = count(upper), count(lower), count(digit), count(mark)
    again = np.zeros(len(words), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    last = np.where(p > 0, data[words.end - 1], 0)
    last = np.where((last > 32) & (last < 127) & mark[words.end - 1], last, 0)
    shape = (u > 1).astype(np.int64) + 2 * (u == 1) + 4 * (lo > 0) + 8 * (d > 0) + 16 * np.minimum(p, 3) + 64 * again
    return shape * 128 + last


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = Words(data, offs, "space")
    n = np.diff(words.first)
    docs, ids = [words.doc], [words.hash ^ U(1)]
    at, pairs = words.ngrams(2)
    docs, ids = [*docs, words.doc[at]], [*ids, pairs ^ U(2)]
    if len(words):
        shape = mix(_shapes(words, data).astype(np.uint64) + U(99))
        seen = shape
        for k in (1, 2, 3):
            if k > 1:
                seen = seen[:-1] * U(31) + shape[k - 1 :]
            one = words.doc[: len(seen)] == words.doc[k - 1 :]
            docs.append(words.doc[: len(seen)][one])
            ids.append(mix(seen[one] + U(k)))
    doc = np.concatenate(docs)
    return doc, (np.concatenate(ids) >> U(64 - DIM_BITS)).astype(np.int64), 1.0 / np.maximum(n, 1)[doc]


def fit_ftrl(rows: Rows, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, rounds: int = 3) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-proximal: weights and bias from rows, in a shuffled order each round."""
    dim = 1 << DIM_BITS
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    if not len(rows.y):
        return np.zeros(dim), 0.0

    def weight(at: np.ndarray) -> np.ndarray:
        small = np.where(at == dim, 0.0, l1)  # the bias, at dim, is not thresholded
        zi = z[at]
        return np.where(np.abs(zi) <= small, 0.0, (np.sign(zi) * small - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(3)
    for _ in range(rounds):
        for i in order.permutation(len(rows.y)):
            y, own = int(rows.y[i]), slice(rows.first[i], rows.first[i + 1])
            at, x = np.append(rows.ids[own], dim), np.append(rows.values[own], 1.0)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = weight(np.arange(dim + 1))
    return w[:dim], float(w[dim])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> tuple[np.ndarray, float]:
    """Train on docs (doc_id, text) and labels (doc_id, quality) outside fold 0."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = sample(known, most, 3)  # bounded
    return fit_ftrl(gather(texts_of(docs, drawn), features, DIM_BITS))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    weights, bias = fit(docs, labels, most)
    scored = docs.select("doc_id", score_column(features, weights, bias)(F.col("text")).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
