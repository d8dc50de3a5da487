"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; any documents, whatever their labels, are the
unlabelled set. The classifier is linear over the presence of hashed words and word beginnings and
minimises the class-prior-corrected risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-)):  when the second
part turns negative the step goes against it, so that the model cannot gain by calling the
positives among the unlabelled set negative. The prior is the share of toxic rows in the labels
that may be learned from.

The sample that trains the model is bounded by ``positives`` and ``unlabelled``; every document is
scored over its whole text. Null and empty texts score by the bias alone. Labels that are null, or
of a held-out fold, are never read; repeated labels of a document count once, as toxic if any is;
repeated rows train once, by the smallest text.
Without a toxic label nothing can be learned and every score is 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.linear import Rows, by_number, fold, gather, sample, score_column, sums, texts_of
from hunkwise.llm.textbits import U, Words

DIM_BITS = 18
POSITIVES, UNLABELLED = 2_000, 5_000
#: Bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 7, 9)
#: A feature must be in so many documents of the sample, and in at most this share of them.
LEAST_DOCS, MOST_SHARE = 20, 0.2


def _ids(words: Words) -> tuple[np.ndarray, np.ndarray]:
    parts = [words.hash ^ U(1)]
    parts += [words.prefix_hash(n) * U(2 * n + 1) for n in BEGINNINGS]
    ids = np.concatenate(parts) >> U(64 - DIM_BITS)
    return np.tile(words.doc, len(parts)), ids.astype(np.int64)


def presence(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each feature of a document once."""
    doc, ids = _ids(Words(data, offs, "alnum"))
    key = np.unique((doc << DIM_BITS) | ids)
    return key >> DIM_BITS, key & ((1 << DIM_BITS) - 1), np.ones(len(key))


def presence_of(weights: np.ndarray):
    """As ``presence``, without features that have no weight."""
    used = weights != 0

    def run(data: np.ndarray, offs: np.ndarray):
        doc, ids = _ids(Words(data, offs, "alnum"))
        at = used[ids]
        key = np.unique((doc[at] << DIM_BITS) | ids[at])
        return key >> DIM_BITS, key & ((1 << DIM_BITS) - 1), np.ones(len(key))

    return run


def fit_nnpu(rows: Rows, prior: float, steps: int = 200, rate: float = 0.05, l1: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from rows (y 1: positive, 0: unlabelled; feature ids), by Adam with soft thresholds."""
    weights, y = np.zeros(1 << DIM_BITS), rows.y
    if not (y == 1).any() or not (y == 0).any() or prior <= 0:
        return weights, -500.0
    if not len(rows.ids):
        return weights, float(np.log(prior / (1 - prior))) if prior < 1 else 500.0
    used = np.flatnonzero(np.bincount(rows.ids, minlength=len(weights)))
    place = np.zeros(len(weights), np.int32)
    place[used] = np.arange(len(used))
    ids = place[rows.ids]
    n = np.diff(rows.first)
    doc_of, feature_at = by_number(ids, rows.first, len(used))
    has, doc_at = np.flatnonzero(n), rows.first[:-1][n > 0]  # documents with a feature left
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior)) if prior < 1 else 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    pos, unl = y == 1, y == 0
    share = np.where(pos, prior / pos.sum(), 1 / unl.sum())
    for t in range(1, steps + 1):
        raw = np.full(len(y), b)
        raw[has] += sums(w, ids, doc_at)
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        # logistic losses: called positive log(1 + e^-raw), called negative log(1 + e^raw)
        negative = np.logaddexp(0, raw) * share
        slack = negative[unl].sum() - negative[pos].sum()
        back = np.where(unl, p * share, -p * share)  # gradient of R_u(-) - pi R_p(-)
        g = np.where(pos, (p - 1) * share, 0) + back if slack >= 0 else -back
        gw, gb = sums(g, doc_of, feature_at), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = rate / (1 - 0.9**t)
        size = np.sqrt(v / (1 - 0.999**t)) + 1e-6
        w -= scale * m / size
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1 / size)
        b -= scale * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    weights[used] = w
    return weights, float(b)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """Train on docs (doc_id, text) and labels (doc_id, toxic) outside fold 0."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    known = known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    prior = known.agg(F.avg("y")).first()[0] or 0.0
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("y"))
    # bounded: at most positives + unlabelled documents
    drawn = sample(known.where("y = 1"), positives, 1).unionByName(sample(some, unlabelled, 2))
    return fit_nnpu(gather(texts_of(docs, drawn), presence, DIM_BITS, least_docs=LEAST_DOCS, most_share=MOST_SHARE), prior)


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Column:
    """The score, 0 to 1, as a column over docs' ``text``."""
    weights, bias = fit(docs, labels, positives, unlabelled)
    return score_column(presence_of(weights), weights, bias)(F.col("text"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    scored = docs.select("doc_id", toxicity(docs, labels, **bounds).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
