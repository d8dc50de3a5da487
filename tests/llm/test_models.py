"""The learned operators against plain loops over dense arrays."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hunkwise.llm import licenses, quality, secrets, toxicity
from hunkwise.llm.linear import Rows, gather, sample, texts_of


def random_rows(n, dim, seed, bits):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, dim)) < 0.3) * rng.integers(1, 5, (n, dim))
    y = (x[:, 0] + x[:, 1] > x[:, 2]).astype(np.int32)
    ids = [np.flatnonzero(r) for r in x]
    places = np.sort(np.random.default_rng(seed + 1).choice(1 << bits, dim, replace=False))
    first = np.cumsum([0, *map(len, ids)])
    rows = Rows(y, first, places[np.concatenate(ids)].astype(np.int32), np.concatenate([r[i] for r, i in zip(x, ids)]).astype(np.float32))
    return x.astype(float), y, places, rows


def test_nnpu_by_dense_steps():
    x, y, places, rows = random_rows(80, 12, 3, toxicity.DIM_BITS)
    x = (x > 0).astype(float)
    for prior in (0.05, 0.4):
        got, got_bias = toxicity.fit_nnpu(rows, prior, steps=40)
        w, b = np.zeros(12), math.log(prior / (1 - prior))
        m, v, mb, vb = np.zeros(12), np.zeros(12), 0.0, 0.0
        turned = 0
        for t in range(1, 41):
            risk_p_minus, risk_u_minus, g_plus, g_minus = 0.0, 0.0, np.zeros(13), np.zeros(13)
            n_p, n_u = (y == 1).sum(), (y == 0).sum()
            for row, label in zip(x, y):
                one = np.append(row, 1.0)
                raw = row @ w + b
                p = 1 / (1 + math.exp(-raw))
                if label:
                    risk_p_minus += math.log1p(math.exp(raw)) / n_p
                    g_plus += prior / n_p * (p - 1) * one
                    g_minus -= prior / n_p * p * one
                else:
                    risk_u_minus += math.log1p(math.exp(raw)) / n_u
                    g_minus += p / n_u * one
            ok = risk_u_minus - prior * risk_p_minus >= 0
            turned += not ok
            g = g_plus + g_minus if ok else -g_minus
            m, v = 0.9 * m + 0.1 * g[:12], 0.999 * v + 0.001 * g[:12] ** 2
            mb, vb = 0.9 * mb + 0.1 * g[12], 0.999 * vb + 0.001 * g[12] ** 2
            size = np.sqrt(v / (1 - 0.999**t)) + 1e-6
            w = w - 0.05 / (1 - 0.9**t) * m / size
            w = np.sign(w) * np.maximum(0, abs(w) - 0.05 * 5e-4 / size)
            b -= 0.05 / (1 - 0.9**t) * mb / (math.sqrt(vb / (1 - 0.999**t)) + 1e-6)
        assert np.allclose(got[places], w, atol=1e-9) and abs(got_bias - b) < 1e-9
        assert not got[np.setdiff1d(np.arange(len(got)), places)].any()


def test_ftrl_by_dense_updates():
    x, y, places, rows = random_rows(60, 9, 5, quality.DIM_BITS)
    got, got_bias = quality.fit_ftrl(rows, alpha=0.5, beta=1.0, l1=2.0, l2=0.1, rounds=2)
    z, n = [0.0] * 10, [0.0] * 10

    def weight(i):
        small = 2.0 if i < 9 else 0.0
        return 0.0 if abs(z[i]) <= small else (math.copysign(small, z[i]) - z[i]) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.1)

    order = np.random.default_rng(3)
    for _ in range(2):
        for r in order.permutation(60):
            one = [*x[r], 1.0]
            w = [weight(i) for i in range(10)]
            p = 1 / (1 + math.exp(-sum(a * c for a, c in zip(w, one))))
            for i, value in enumerate(one):
                if value:
                    g = (p - y[r]) * value
                    z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w[i]
                    n[i] += g * g
    assert np.allclose(got[places], [weight(i) for i in range(9)]) and abs(got_bias - weight(9)) < 1e-9
    assert any(weight(i) == 0 for i in range(9)) and any(weight(i) for i in range(9))


def test_gathered_features_by_count(spark):
    texts = ["red cat", "red dog", "red cow", "Red  bird cat", None, "", "cat " * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2 + [(3, "zebra")], "doc_id long, text string")
    drawn = sample(docs.select("doc_id", F.lit(0).alias("y")), 100, 1)
    rows = gather(texts_of(docs, drawn), toxicity.presence, toxicity.DIM_BITS, least_docs=3, most_share=0.5)
    words = [set((t or "").lower().split()) for t in texts]
    assert len(rows.y) == len(texts) and rows.values is None  # a document once, whatever its rows
    # features in 3 documents or more and in at most half of them: those of cat alone
    used = sorted(len(set(rows.ids[lo:hi])) > 0 for lo, hi in zip(rows.first[:-1], rows.first[1:]))
    assert used == sorted("cat" in w for w in words)
    assert sample(docs.select("doc_id", F.lit(0).alias("y")), 2, 1).count() == 2


def test_samples_within_bytes(spark):
    from hunkwise.llm import linear

    rows = [(i % 2, 100 - i, b"x" * 40, b"y" * 60) for i in range(90)] + [(1, -5, b"x" * 9000, b""), (0, 1000, None, b"y")]
    frame = spark.createDataFrame(rows, "y int, draw long, ids binary, vals binary").repartition(3)
    kept = lambda most: sorted(r.draw for r in linear._within(frame, most).collect())
    assert kept(1 << 20) == sorted(r[1] for r in rows)
    # in the order of the draw, without the row that is too large; 6,400 bytes are 64 rows
    assert kept(6400) == list(range(11, 75)) and kept(0) == []


def edge_docs(spark):
    rows = [(1, "good words " * 60, "a"), (2, None, None), (3, "", "b"), (4, "vile words " * 60, "c"), (None, "vile", "d"), (1, "good words " * 60, "e"), (6, "w" * 300_000, "f"), (7, "x y " * 60_000, "g")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").withColumns({c: F.lit(1) for c in ("y", "draw", "ids", "n", "held_out", "_toxic")})


def test_scores_of_edge_cases(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (7, 0, 1)], "doc_id long, toxic int, quality int")
    for scores in (toxicity.toxicity_scores, quality.quality_scores):
        got = scores(edge_docs(spark), labels).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        of = {}
        for r in got:
            of.setdefault(r.doc_id, set()).add(r.score)
        assert of[2] == of[3] and len(of[1]) == 1  # null as empty, repeated rows alike
        assert scores(edge_docs(spark).where("false"), labels).collect() == []
        assert len(scores(edge_docs(spark), labels.where("false")).collect()) == 8


def test_licences_by_plain_loops(spark):
    docs = [(i, f"the house number {i} of the town and the street by the river\nhe came to the office number {i}") for i in range(30)]
    lines = [t for of in licenses.TEMPLATES.values() for t in of] + [" ".join(t.split()[:9]) + " and so on" for of in licenses.TEMPLATES.values() for t in of]
    docs += [(100 + i, f"intro\n{t}\n\nend") for i, t in enumerate(lines)] + [(500 + i, t) for i, t in enumerate(licenses.OTHER)]
    docs += [(1000, None), (1001, ""), (1002, "\n \n"), (1003, "Released under the MIT License " * 9000), (100, f"intro\n{lines[0]}\n\nend")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "found", "ids", "paragraph", "similar")})
    families, weights, bias, least = licenses.fit(spark, frame)
    # features by Spark's own hash, one text at a time
    every = sorted({line for _, t in docs if t for line in t.split("\n") if line.strip()})
    ids = {r.t: r.f for r in spark.createDataFrame([(t,) for t in every], "t string").select("t", licenses.features(licenses.words_of(F.col("t"))).alias("f")).collect()}

    def pairs(t):
        w = [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
        return list(zip(w[:-1], w[1:]))

    want = set()
    for doc, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            if not line.strip():
                continue
            raw = [sum(weights[i][c] for i in ids[line]) / math.sqrt(max(1, len(ids[line]))) + bias[c] for c in range(len(families))]
            top = max(raw)
            p = 1 / sum(math.exp(r - top) for r in raw)
            family = families[raw.index(top)]
            if family == "unknown" or p < least:
                continue
            own = set(pairs(line))
            similar = max(len(own & set(pairs(t))) / min(len(set(pairs(t))), max(4, len(own))) for t in licenses.TEMPLATES[family])
            if similar >= licenses.LEAST_SIMILARITY:
                want.add((doc, at, family, round(p, 4)))
    got = [(r.doc_id, r.paragraph, r.family, round(r.probability, 4)) for r in licenses.scan(frame).collect()]
    assert set(got) == want and len(got) == len(want) + 1  # the repeated row gives its finding again
    assert {(100 + i) for i, t in enumerate(lines[: len(lines) // 2])} <= {d for d, *_ in got}
    assert licenses.scan(frame.where("false")).collect() == []


def test_wrapped_licences_are_paragraphs(spark):
    """Whole licences, wrapped at any width, in comments, without blank lines around: one finding for each paragraph."""
    import textwrap

    docs, want = [], set()
    for i, (family, marks, width) in enumerate([("mit", "# ", 60), ("bsd", " * ", 72), ("isc", "// ", 50), ("gpl", "", 78), ("apache-2.0", "-- ", 66)]):
        lines = ["the first words of the house and of the river", "code = other(code)"]
        for t in licenses.TEMPLATES[family]:
            if len(t.split()) < 20:
                continue
            want.add((i, len(lines), family))
            wrapped = textwrap.wrap(t, width)
            lines += [marks + x for x in wrapped] + ["", marks.strip() or "that was all of it"]
        docs.append((i, "\n".join([*lines, "the last words of the town"])))
    docs += [(50 + i, f"he came number {i} to the office of the town with a copy of the book, and in no event shall it be sold") for i in range(20)]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    # a paragraph may lose a last line of a word, never its beginning
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == want and max(r.lines for r in got) > 8
    assert all(r.similarity > 0.85 for r in got)


def test_secret_scan_equals_candidates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    known = secrets.language(docs)
    counts = {}
    texts = {r.doc_id: (r.text or "", r.source) for r in docs.collect()}
    for text, _ in texts.values():
        for w in re.findall("[a-z]+", re.sub(r"[^\x00-\x7f]", " ", text.lower())):
            if secrets.SHORTEST <= len(w) <= secrets.LONGEST:
                counts[w] = counts.get(w, 0) + 1
    assert known.words == set(sorted(counts, key=lambda w: (-counts[w], w))[: secrets.DICTIONARY])
    detector = secrets.train(known)
    want = {(d, c.start, c.end, c.kind, score) for d, (text, path) in texts.items() for c, score in secrets.judged(text, path or "", detector)}
    clash = docs.withColumns({c: F.lit(1) for c in ("_path", "start", "kind", "word", "n")})
    got = {(r.doc_id, r.start, r.end, r.kind, r.score) for r in secrets.scan(clash, "source", detector).collect()}
    assert got == want
    # planted: what the tables' secrets look like
    planted = {d for d, (text, _) in texts.items() if re.search(r'token = "[0-9a-f]{40}"', text)}
    assert planted and planted == {d for d, _, _, _, score in got if score >= secrets.CUT}
    precision, recall = secrets.held_out(known, secrets.example_findings())
    assert precision > 0.95 and recall > 0.95


def test_secrets_of_edge_cases(spark):
    known = secrets.Language({"token": 3, "words": 5})
    detector = secrets.train(known)
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join("Zq8Lm2Xv9Rt4" * 5 for _ in range(6)) + "\n-----END RSA PRIVATE KEY-----"
    rows = [(1, None), (2, ""), (3, key), (3, key), (None, key), (4, "token = '" + "aB3" * 40_000 + "'"), (5, "-----BEGIN RSA PRIVATE KEY-----\nexample\n-----END RSA PRIVATE KEY-----")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.is_secret) for r in secrets.scan(frame, detector=detector).collect()]
    assert got.count((3, True)) == 2 and got.count((None, True)) == 1 and {d for d, _ in got} == {3, 4, 5, None}
    assert (5, False) in got  # a block that holds no key is judged, too
    assert secrets.scan(frame.where("false"), detector=detector).collect() == []
    assert len(secrets.language(frame.where("false")).words) == 0
    low = "xxtokenwords9"
    assert secrets.Language({"token": 1}).covered(low) == 5 / 13 and known.covered(low) == 10 / 13 and known.covered("") == 0.0


def test_licence_classes_learn_from_all_texts(spark):
    """Every text that shares words with notices and is none counts: its own word has a weight, and the bound is that of all."""
    docs = [(i, f"the terms of the zq{i} and the use of the house by the river, provided with the keys") for i in range(700)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    families, weights, _, least = licenses.fit(spark, frame)
    ids = spark.createDataFrame([(f"zq{i}",) for i in range(700)], "t string").select(licenses.features(licenses.words_of(F.col("t"))).alias("f")).collect()
    assert all(np.abs(weights[r.f[0]]).max() > 0 for r in ids)
    assert families[-1] == "unknown" and 0.5 <= least < 1
    tops = spark.createDataFrame([(x / 999,) for x in range(1000)], "top double").repartition(5)
    for share in (0.001, 0.0305, 0.5):
        assert abs(licenses._upper(tops, share) - np.quantile(np.arange(1000) / 999, 1 - share)) < 1e-12
    assert licenses._upper(tops.where("false"), 0.001) == 0 and licenses._upper(tops.limit(1), 0.001) >= 0


def test_learner_takes_little_memory_beside_its_rows():
    """The driver's learner sorts and sums by blocks, with the same results."""
    import tracemalloc

    from hunkwise.llm import linear

    rng = np.random.default_rng(1)
    n = rng.integers(0, 900, 4000)
    ids = np.concatenate([np.sort(rng.choice(1 << toxicity.DIM_BITS, k, replace=False)) for k in n]).astype(np.int32)
    rows = linear.Rows((np.arange(4000) % 3 == 0).astype(np.int32), np.cumsum([0, *n]), ids, None)
    tracemalloc.start()
    toxicity.fit_nnpu(rows, 0.1, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 22 * len(ids)  # 28 bytes an entry before
    some, first = ids[:50_000] % 997, np.unique(np.concatenate([[0], rng.integers(0, 50_000, 300)]))
    got = linear.by_number(some, np.append(first, 50_000), 997, most=1000)
    order = np.argsort(some, kind="stable")
    assert (got[0] == np.repeat(np.arange(len(first)), np.diff(first, append=50_000))[order]).all() and (got[1] == np.searchsorted(some[order], np.arange(997))).all()
    values = rng.normal(size=997)
    assert (linear.sums(values, some, first, most=1000) == np.add.reduceat(values[some], first)).all()
    texts = [x.tobytes() for x in np.split(some.astype(np.int32), first[1:])]
    flat, at = linear.flattened(pa.chunked_array([pa.array(texts[:7], pa.binary()), pa.array([b"", *texts[7:]], pa.binary())]), np.int32)
    assert (flat == some).all() and at[-1] == len(some) and len(at) == len(texts) + 2
    assert len(linear.flattened(pa.chunked_array([], pa.binary()), np.int32)[0]) == 0
