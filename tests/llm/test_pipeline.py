"""The pipeline's stages against plain code."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from hunkwise.llm import queries as q
from hunkwise.llm import secrets, toxicity
from test_operators import components

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stages_by_brute_force(spark):
    """Each stage on what its predecessor kept."""
    docs = q.table(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]

    kept = stage["toxicity"](spark, docs, SF)
    weights, bias = toxicity.fit(docs, q.table(spark, SF, "labels"))
    used = {}
    for r in docs.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        _, ids, _ = toxicity.presence(data, np.array([0, len(data)]))
        used[r.doc_id] = 1 / (1 + np.exp(-(weights[ids].sum() + bias)))
    assert {r.doc_id for r in kept.collect()} == {d for d, s in used.items() if s < 0.5} and kept.columns == docs.columns

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    single = stage["near_dedup"](spark, kept, SF)
    groups = components([(r.doc_id, r.text) for r in kept.collect()], 5)
    assert {r.doc_id for r in single.collect()} == {d for d, (_, top) in groups.items() if d == top} and single.columns == docs.columns

    single = spark.createDataFrame(single.collect(), docs.schema)
    clean = stage["decontamination"](spark, single, SF)
    windows = set()
    for r in q.table(spark, SF, "benchmark").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not hit(r.text)}

    clean = spark.createDataFrame(clean.collect(), docs.schema)
    masked = stage["secrets"](spark, clean, SF)
    detector = secrets.train(secrets.language(clean))
    for r, before in zip(masked.orderBy("doc_id").collect(), clean.orderBy("doc_id").collect()):
        text = before.text
        for c, score in sorted(secrets.judged(text or "", before.source or "", detector), reverse=True):
            if score >= secrets.CUT:
                text = text[: c.start] + secrets.MASK + text[c.end :]
        assert r.text == text and r.n_chars == (len(text) if text is not None else before.n_chars)

    masked = spark.createDataFrame(masked.collect(), docs.schema)
    pieces = stage["packing"](spark, masked, SF).collect()
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert lengths == {p.doc_id: p.doc_tokens for p in pieces} and lengths.keys() == {r.doc_id for r in masked.collect()}


def test_run_is_its_stages(spark):
    whole = rows_of(corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").groupBy("doc_id").agg(F.sum("length")))
    docs = q.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert whole == rows_of(corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").agg(F.sum("length")))


def test_filters_of_edge_cases(spark):
    """Null ids and texts, repeated rows, one id with two texts, and columns with the helpers' names."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, "one two three four five six"), (None, "other words"), (5, text + " more"), (5, "an unlike text of some words"), (6, "x " * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_near", "_key", "_toxic", "_spot", "_w", "_v", "component_id", "n")})
    frame = frame.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    single = corpus_pipeline.drop_near_copies(spark, frame, SF)
    got = sorted((r.doc_id or -1, r.text or "") for r in single.collect())
    assert single.columns == frame.columns
    assert [d for d, _ in got] == [-1, -1, 1, 3, 4, 5, 6] and (5, "an unlike text of some words") in got
    for stage in (corpus_pipeline.drop_contaminated, corpus_pipeline.drop_toxic, corpus_pipeline.mask_secrets):
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns and stage(spark, frame.where("false"), SF).count() == 0
        assert out.count() == len(rows)
    assert corpus_pipeline.drop_near_copies(spark, frame.where("false"), SF).count() == 0
    assert corpus_pipeline.pack_sequences(spark, frame.where("false"), SF).count() == 0
