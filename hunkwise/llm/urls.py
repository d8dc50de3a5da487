"""URL filtering by rules and by a likelihood ratio of character language models.

URLs that a rule decides are labelled: accepted or rejected. Two variable-order Markov models over
bytes, one for each class, are counted over all labelled URLs. A byte's probability is that of its
longest context, mixed with the next shorter one by the weight of an escape, down to the uniform
distribution. A URL's score is the mean over its bytes of the difference of the log-likelihoods;
the threshold maximises balanced accuracy over the labelled URLs of a fold that the calibration
models have not counted.

A byte with its longest context is a gram, coded without loss in 45 bits of a long. Counts are exact
tables of grams that grow with the URLs and stay on the executors; those of shorter contexts are
sums of them. URLs meet the grams' ratios in chunks of rows, so a gram that every URL holds is one row for
each chunk.

Edge cases: a null URL, or one without ``://``, has empty host and path and no rule. An empty URL
scores 0. With no labelled URL of a class, or none in the fold, the threshold is 0. Repeated rows
are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hunkwise.llm.shelf import Shelf
from hunkwise.llm.textbits import runs

ORDER = 4
ESCAPE = 2.0
#: A gram's byte plus 1 in the lowest 9 bits, then the bytes before it; 0 before the start of a URL.
BITS = 9
#: Rows of a chunk, as a power of two.
CHUNK_BITS = 12
CELLS = ("rejected", "accepted", "held_rejected", "held_accepted")
#: Histogram of scores for the threshold: steps of 1 / 100 within -10 to 10.
STEP, REACH = 0.01, 10.0

Rule = tuple[str, str]  # (allow or block, host/path)


def host_of(url: Column) -> Column:
    after = F.expr("substring(_url, locate('://', _url) + 3)")
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: Column) -> Column:
    after = F.expr("substring(_url, locate('://', _url) + 3)")
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, action) of the longest rule that fits a host, or a domain above it, and the start of a path."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(slash + of_path))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The gram of every byte."""
    at = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    byte = data.astype(np.int64) + 1
    out = byte.copy()
    for k in range(1, ORDER + 1):
        back = np.zeros(len(data), np.int64)
        back[k:] = byte[:-k]
        back[at < k] = 0
        out |= back << (BITS * k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, gram, count in each cell) of rows (chunk, cell, _url); cell -1 counts nowhere."""
    for batch in batches:
        chunk, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "cell"))
        for lo, hi, data, offs in runs(batch.column("_url")):
            code, n = grams(data, offs), np.diff(offs)
            order = np.lexsort((code, np.repeat(chunk[lo:hi], n)))
            of, code, own = np.repeat(chunk[lo:hi], n)[order], code[order], np.repeat(cell[lo:hi], n)[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
            group = np.cumsum(new) - 1
            counts = [pa.array(np.bincount(group[own == c], minlength=int(new.sum()))) for c in range(len(CELLS))]
            yield pa.record_batch([pa.array(of[new]), pa.array(code[new]), *counts], names=["chunk", "gram", *CELLS])


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, trial, ratio) of every gram: log-likelihood accepted less rejected, without the held fold and with it."""
    tables = [counts]
    for k in range(ORDER - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND((1 << BITS * (k + 1)) - 1)
        tables.append(tables[-1].groupBy(shorter.alias("gram")).agg(*[F.sum(c).alias(c) for c in CELLS]))
    below = None
    models = {"t0": F.col("rejected"), "t1": F.col("accepted"), "f0": F.col("rejected") + F.col("held_rejected"), "f1": F.col("accepted") + F.col("held_accepted")}
    for k, table in enumerate(reversed(tables)):
        whole = Window.partitionBy(F.shiftright("gram", BITS))  # at most 256 rows, the bytes after a context
        seen = table.select("gram", *[n.alias(m) for m, n in models.items()])
        seen = seen.select("gram", *models, *[F.sum(m).over(whole).alias("of_" + m) for m in models])
        if below is None:
            seen = seen.withColumns({"p_" + m: F.lit(1 / 256) for m in models})
        else:
            seen = seen.withColumn("shorter", F.col("gram").bitwiseAND((1 << BITS * k) - 1)).join(below, "shorter")
        mixed = {m: (F.col(m) + ESCAPE * F.col("p_" + m)) / (F.col("of_" + m) + ESCAPE) for m in models}
        below = seen.select(F.col("gram").alias("shorter"), *[p.alias("p_" + m) for m, p in mixed.items()])
    return below.select(F.col("shorter").alias("gram"), F.log(F.col("p_t1") / F.col("p_t0")).alias("trial"), F.log(F.col("p_f1") / F.col("p_f0")).alias("ratio"))


def _score(rows: pa.Table, known: pa.Table) -> pa.Table:
    """rows of a chunk with the means of their grams' ratios."""
    code = known.column("gram").to_numpy()
    order = np.argsort(code)
    code, value = code[order], [known.column(c).to_numpy()[order] for c in ("trial", "ratio")]
    out: list[list[np.ndarray]] = [[], []]
    for lo, hi, data, offs in runs(rows.column("_url")):
        n = np.diff(offs)
        at, own = np.searchsorted(code, grams(data, offs)), np.repeat(np.arange(hi - lo), n)
        for i in (0, 1):
            out[i].append(np.bincount(own, value[i][at], hi - lo) / np.maximum(n, 1))
    for name, scores in zip(("trial", "score"), out, strict=True):
        rows = rows.append_column(name, pa.array(np.concatenate(scores), pa.float64()))
    return rows


def scored(parts: DataFrame, shelf: Shelf) -> DataFrame:
    """parts (_url, accepted or null, held and more) with trial and score: by the models without the held fold, and by all labelled URLs."""
    cell = F.when(F.col("accepted").isNull(), -1).otherwise(F.col("accepted").cast("int") + 2 * F.col("held").cast("int"))
    rows = shelf.put(parts.withColumns({"cell": cell, "chunk": F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)}))
    held_by = shelf.put(rows.select("chunk", "cell", "_url").mapInArrow(_count, "chunk long, gram long, " + ", ".join(f"{c} long" for c in CELLS)))
    counts = shelf.put(held_by.groupBy("gram").agg(*[F.sum(c).alias(c) for c in CELLS]))
    known = held_by.select("chunk", "gram").distinct().join(ratios(counts), "gram")
    schema = StructType([*rows.schema.fields, StructField("trial", DoubleType()), StructField("score", DoubleType())])
    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score, schema)


def threshold(scored: DataFrame) -> float:
    """The score from which accepting has the best balanced accuracy, from rows (accepted, score)."""
    cell = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), "score")) / STEP)
    rows = scored.groupBy("accepted", cell.alias("cell")).agg(F.count("*").alias("n")).collect()  # 2 x 2001 at most
    size = int(REACH / STEP)
    seen = np.zeros((2, 2 * size + 1))
    for r in rows:
        seen[int(r["accepted"]), int(r["cell"]) + size] = r["n"]
    if not seen.sum(axis=1).all():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(seen, axis=1)), axis=1) / seen.sum(axis=1, keepdims=True)
    gain = below[0] - below[1]  # rejected below the threshold, less accepted below it
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 - size) * STEP


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages (page_id, url)."""
    shelf = Shelf(pages.sparkSession)
    parts = pages.select("page_id", F.coalesce("url", F.lit("")).alias("_url"))
    parts = parts.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    parts = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    parts = parts.withColumns({"accepted": F.col("found.action") == "allow", "held": F.crc32(F.col("_url").cast("binary")) % 5 == 0})
    parts = parts.select("page_id", "_url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.action").alias("action"), "accepted", "held")
    out = shelf.put(scored(parts, shelf))
    cut = threshold(out.where("accepted is not null and held").select("accepted", F.col("trial").alias("score")))
    verdict = F.coalesce("action", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
