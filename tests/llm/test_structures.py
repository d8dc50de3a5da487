"""Search, packing, sharding, near copies, windows and URLs against plain code, and their edge cases."""

import collections
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hunkwise.llm import queries as q
from hunkwise.llm import urls
from hunkwise.llm.keyed import only, without
from hunkwise.llm.maxscore import Shard, quantised, top_k
from hunkwise.llm.minhash import BANDS, MISS, ROWS, block_links, near_duplicates, signature
from hunkwise.llm.packing import Packer, pack
from hunkwise.llm.sharding import best_fit_decreasing, even_bins, shards
from hunkwise.llm.shelf import Shelf, scope, shared_folder
from hunkwise.llm.winnowing import contamination
from test_operators import components


def best(ids, vectors, query, own, k):
    scores = [(-sum(int(a) * int(b) for a, b in zip(v, query)), int(i)) for i, v in zip(ids, vectors) if i != own]
    return [(-s, i) for s, i in sorted(scores)[:k]]


def test_shards_of_vectors_by_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(40):
        n, d, size = int(rng.integers(1, 300)), int(rng.integers(1, 10)), (2, 100, 2**20, 2**28)[trial % 4]
        vectors = rng.integers(-size, size + 1, (n, d))
        vectors[rng.random((n, d)) < 0.4] = 0
        ids = np.arange(n) * 3
        got = Shard(ids, vectors).best(vectors[::5], ids[::5], 4)
        assert got == [best(ids, vectors, v, i, 4) for v, i in zip(vectors[::5], ids[::5])]


def test_postings_that_are_not_essential_are_not_traversed():
    rng = np.random.default_rng(2)
    # a few strong terms, as sparse learned vectors have, and weak ones
    scale = np.array([300] * 4 + [3] * 28)
    vectors = np.floor(rng.normal(size=(3000, 32)) * scale).astype(np.int64)
    shard, queries = Shard(np.arange(3000), vectors), vectors[:200]
    assert shard.best(queries, np.arange(200), 5) == [best(range(3000), vectors.tolist(), v.tolist(), i, 5) for i, v in enumerate(queries)]
    everything = 200 * 32 * 3000
    assert shard.touched < 0.5 * everything
    # unit vectors of random directions: some are left out, none is read twice
    vectors = rng.normal(size=(3000, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    shard = Shard(np.arange(3000), vectors)
    got = shard.best(vectors[:200], np.arange(200), 5)
    assert got == [best(range(3000), vectors.tolist(), v, i, 5) for i, v in enumerate(vectors[:200].tolist())]
    assert shard.touched < 0.99 * 200 * 64 * 3000


def test_top_k_ties_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.integers(-2, 3, 4).tolist() for i in range(120)}  # many ties
    rows = [(i, [float(x) / 256 for x in v], 0, "s") for i, v in vectors.items()]
    rows += [(7, rows[7][1], 1, "s"), (900, None, 0, "s"), (901, [None, 1.0, 0.0, 0.0], 0, "s"), (902, [float("nan")] * 4, 0, "s"), (903, [float("inf")] * 4, 0, "s"), (None, [1.0] * 4, 0, "s")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, s string")
    asked = frame.withColumn("vector", quantised(F.col("embedding"))).withColumns({"b": F.lit(1), "rank": F.lit(1), "query_id": F.lit(1)})
    got = {}
    for r in top_k(asked, F.col("vec_id") % 3 == 0, k=5, shard=16, block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    ids = sorted(vectors)
    assert got == {i: best(ids, [vectors[j] for j in ids], vectors[i], i, 5) for i in ids if i % 3 == 0}
    assert top_k(asked.where("vec_id < 2"), F.lit(True), k=5).count() == 2  # one candidate each
    assert top_k(asked.where("false"), F.lit(True)).count() == 0


def packed(docs, capacity, segments, loss):
    rows, left = Packer(capacity, segments, loss, 0).pack([(i, 0, n, silent) for i, (n, silent) in enumerate(docs)], last=True)
    assert not left
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, sequence, offset in rows:
        sequences[sequence].append((doc, start, length, offset))
        pieces[doc].append((start, length))
    for i, (n, _) in enumerate(docs):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == n
    return sequences.values()


@pytest.mark.parametrize("capacity,segments,loss,binding", [(64, 50, 64, "tokens"), (64, 3, 64, "segments"), (64, 50, 10, "loss")])
def test_each_limit_of_packing_binds(capacity, segments, loss, binding):
    rng = np.random.default_rng(0)
    docs = [(int(n), max(1, int(n * 0.5))) for n in rng.integers(1, 12 if binding == "segments" else 200, 80)]
    tops = {"tokens": 0, "segments": 0, "loss": 0}
    for own in packed(docs, capacity, segments, loss):
        used = {"tokens": sum(x[2] for x in own), "segments": len(own), "loss": sum(max(0, s + n - max(s, docs[d][1])) for d, s, n, _ in own)}
        assert used["tokens"] <= capacity and used["segments"] <= segments and used["loss"] <= loss
        tops = {k: max(tops[k], v) for k, v in used.items()}
    assert tops[binding] == {"tokens": capacity, "segments": segments, "loss": loss}[binding]
    if binding != "tokens":
        assert tops["tokens"] < capacity or binding == "loss"


def test_packing_of_many_short_documents():
    """100,000 documents of a token: seconds, for equal vectors are one class."""
    import time

    began = time.time()
    sequences = packed([(1, 1)] * 100_000, 4096, 512, 4096)
    assert time.time() - began < 60 and max(len(s) for s in sequences) == 512
    # whatever is packed is packed by the vectors alone: classes pick what a scan of all pieces would
    rng = np.random.default_rng(3)
    docs = [(int(n), max(1, int(n * f))) for n, f in zip(rng.integers(1, 40, 150), rng.choice([0.1, 0.5, 1], 150))]
    got = sorted(sorted(x[2] for x in s) for s in packed(docs, 64, 6, 40))
    assert got == sorted(sorted(s) for s in scanned(docs, 64, 6, 40))


def scanned(docs, capacity, segments, loss):
    """The lengths of the pieces of each sequence, by a scan of all pieces at each step."""
    limits, out = np.array([capacity, segments, loss], float), []
    vector = lambda p: np.array([p[1], 1, max(0, p[0] + p[1] - max(p[0], p[2]))], float)
    pool = [(0, n, silent) for n, silent in docs]
    while pool:
        room, chosen = limits.copy(), []
        while room[0] > 0 and room[1] > 0 and pool:
            worth = [float(vector(p) @ (room / limits**2)) for p in pool]
            fit = [i for i, p in enumerate(pool) if (vector(p) <= room).all()]
            i = max(fit or range(len(pool)), key=lambda i: worth[i])
            start, n, silent = pool[i]
            cut = n if fit else int(min(room[0], room[2] + max(0, silent - start), n))
            if cut <= 0:
                break
            pool.pop(i)
            if cut < n:
                pool.append((start + cut, n - cut, silent))
            chosen.append(cut)
            room -= vector((start, cut, silent))
        used = sum(chosen)
        sizes = [used] if used == capacity else [1 << i for i in range(used.bit_length() - 1, -1, -1) if used >> i & 1]
        chosen, own = chosen[::-1], []
        for size in sizes:
            own = []
            while size:
                n = chosen.pop()
                own.append(min(n, size))
                if n > size:
                    chosen.append(n - size)
                size -= own[-1]
            out.append(own)
    return out


def test_packing_of_prompts_and_edge_cases(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(q.tokenizer_file())
    rows = [(1, "What is it?", "A cat."), (2, None, "word " * 9000), (3, "Say nothing.", None), (None, "a", ""), (1, "What is it?", "A cat.")]
    frame = spark.createDataFrame(rows, "doc_id long, question string, text string").withColumns({c: F.lit("x") for c in ("prompt", "start", "ids")})
    got = pack(frame, q.tokenizer_file(), capacity=512, loss=64, prompt="question").collect()
    of = collections.defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
    for doc_id, question, text in rows[1:4]:
        ids = [i for t in (question, text) for i in tk.encode(t or "", add_special_tokens=False).ids] + [2]
        assert sum(r.length for r in of[doc_id]) == len(ids) == of[doc_id][0].doc_tokens
        silent = max(1, len(tk.encode(question or "", add_special_tokens=False).ids))
        assert sum(r.loss_tokens for r in of[doc_id]) == len(ids) - silent
        for r in of[doc_id]:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    loss = collections.Counter()
    for r in got:
        loss[r.sequence_id] += r.loss_tokens
    assert max(loss.values()) <= 64
    assert pack(frame.where("false"), q.tokenizer_file()).collect() == []


def plain_best_fit(sizes, capacity):
    bins, out = [], []
    for x in sorted(sizes, reverse=True):
        fit = [(room, i) for i, room in enumerate(bins) if room >= x]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append(max(capacity, x))
        bins[i] -= x
        out.append((x, i))
    return sorted(out)


def test_best_fit_by_plain_search():
    rng = np.random.default_rng(0)
    for trial in range(200):
        sizes, capacity = rng.integers(1, (6, 30, 1000)[trial % 3], int(rng.integers(0, 60))).tolist(), int(rng.integers(5, 60))
        table = list(collections.Counter(sizes).items())
        got = sorted((size, b) for size, lo, hi, b in best_fit_decreasing(table, capacity) for _ in range(lo, hi))
        assert got == plain_best_fit(sizes, capacity)
        if sizes:
            rooms = collections.Counter()
            for size, lo, hi, b in even_bins(table, 4):
                rooms[b] += size * (hi - lo)
            assert len(rooms) <= 4 and max(rooms.values()) <= max(max(sizes), -(-sum(sizes) // 4) + max(sizes))


def test_shards_of_edge_cases(spark):
    rows = [(i, "ab" * (i % 5)) for i in range(300)] + [(1, None), (1, None), (None, "x"), (5, "hot" * 5000)] + [(1000 + i, "copy") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("digest", "size", "bytes", "shard", "section", "own")})
    for out in (shards(frame, 4).collect(), shards(frame, capacity=3000).collect()):
        assert len(out) == len(rows)
        slots, bins = collections.defaultdict(list), collections.defaultdict(set)
        for r in out:
            slots[r.shard].append(r.slot)
            bins[r.text_crc32, r.size].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(b) == 1 for b in bins.values())
    assert shards(frame.where("false"), 4).collect() == [] and shards(frame.where("false"), capacity=9).collect() == []


def test_large_buckets_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base, docs = [f"b{i}" for i in range(120)], []
    for d in range(250):
        words = list(base)
        for _ in range(int(rng.integers(0, 14))):
            words[int(rng.integers(120))] = f"x{int(rng.integers(60))}"
        docs.append((d, " ".join(words)))
    docs += [(1000 + i, docs[0][1]) for i in range(400)] + [(3000, "one"), (3001, "long " + "w v " * 40_000), (3002, "long " + "w v " * 40_001)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("node", "bucket", "sig", "n", "comp")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, shingle=2, bands=40, rows=3).collect()}
    assert got == components(docs, 2) and len({c for _, c in got.values()}) > 20


def test_blocks_prune_by_signatures_and_lose_no_link():
    rng = np.random.default_rng(6)
    common = rng.integers(0, 2**63, 70, dtype=np.uint64)  # enough to share a bucket, too little for a link
    sets, comps = [], []
    for family in range(60):
        own = np.concatenate([common, rng.integers(0, 2**63, 130, dtype=np.uint64)])
        for copy in range(2):
            sets.append(np.unique(np.concatenate([own[copy * 8 :], rng.integers(0, 2**63, copy * 8, dtype=np.uint64)])))
            comps.append(2 * family + copy)
    block = pd.DataFrame({"node": comps, "comp": comps, "sig": [signature(s, BANDS * ROWS).tobytes() for s in sets], "shingles": [s.tobytes() for s in sets]})
    links, met = block_links(block, block, 80, MISS)
    assert sorted({(min(x), max(x)) for x in links}) == [(2 * f, 2 * f + 1) for f in range(60)]
    assert met < 2 * len(links) + 200 < 120 * 119 / 10
    # nodes of one component are not compared, and an empty side has no links
    assert block_links(block.assign(comp=0), block.assign(comp=0), 80, MISS) == ([], 0)
    assert block_links(block, block[:0], 80, MISS) == ([], 0) == block_links(block[:0], block, 80, MISS)


def test_windows_of_edge_cases(spark):
    item = " ".join(f"w{i}" for i in range(10))
    docs = [(1, item), (1, item), (None, item), (2, ""), (3, "x " * 50_000 + item + " y" * 50_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "stretch", "window", "items", "item_id")})
    bench = spark.createDataFrame([(5, item), (6, item), (5, item)], "item_id long, text string").withColumn("size", F.lit("x"))
    got = sorted((r.doc_id or -1, r.n_hit, r["items"]) for r in contamination(frame, bench).collect())
    assert got == [(-1, 10, ["5", "6"]), (1, 10, ["5", "6"]), (1, 10, ["5", "6"]), (2, 0, []), (3, 10, ["5", "6"])]
    assert contamination(frame, bench.where("false")).where("n_hit > 0").count() == 0 and contamination(frame, bench).count() == 5
    assert contamination(frame.where("false"), bench).count() == 0


def test_windows_quoted_very_often(spark, monkeypatch):
    """Nothing but the plan changes where windows and stretches are too many for a broadcast."""
    from hunkwise.llm import winnowing

    items = [" ".join(f"w{k}_{i}" for i in range(12)) for k in range(30)]
    docs = [(i, f"a {items[0]} b {items[i % 30]} c") for i in range(600)] + [(1000, "plain words"), (1001, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    of = lambda: sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in contamination(frame, bench).collect())
    want = of()
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(winnowing, "HOT_SHARE", 1 / 10)
    assert of() == want and len(want) == 602 and want[0][2] == 48


def test_equal_rows_are_numbered_in_many_sections(spark):
    from hunkwise.llm.sharding import SECTIONS, numbered

    rows = spark.createDataFrame([(None, "same")] * 4000, "doc_id long, text string")
    got = shards(rows, 4).groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert len(got) == 1 and got[0].s == list(range(4000))
    dealt = numbered(rows.withColumns({"row": F.monotonically_increasing_id(), "shard": F.lit(0)}), "shard", ["row"], SECTIONS, "slot")
    sections = dealt.groupBy(F.pmod(F.xxhash64("row"), F.lit(SECTIONS))).count().agg(F.max("count")).first()[0]
    assert sections < 4000 / SECTIONS * 3


def test_url_verdicts_by_plain_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        kind = i % 3
        letters = "abcde" if kind == 0 or (kind == 2 and i % 2) else "vwxyz"
        rows.append((i, f"http://{('x.com/fr', 'x.com/de', 'y.net')[kind]}/" + "".join(rng.choice(list(letters), 30))))
    rows += [(900, None), (901, ""), (902, "no scheme"), (0, rows[0][1]), (903, "http://y.net/" + "a" * 100_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("_url", "score", "trial", "gram", "chunk", "host")})
    rules = [("allow", "com/fr/"), ("block", "com/de/")]
    got = urls.judge(frame, rules).collect()
    assert len(got) == len(rows)
    parts = frame.select(F.coalesce("url", F.lit("")).alias("_url")).withColumn("accepted", F.when(F.contains("_url", F.lit("com/fr")), True).when(F.contains("_url", F.lit("com/de")), False))
    parts = parts.withColumn("held", F.crc32(F.col("_url").cast("binary")) % 5 == 0)
    held = [(r.trial, r.accepted) for r in urls.scored(parts, Shelf(spark)).where("held and accepted is not null").collect()]
    steps = [(np.floor(s / urls.STEP), a) for s, a in held]

    def balance(cut):
        yes, no = [s >= cut for s, a in steps if a], [s < cut for s, a in steps if not a]
        return sum(yes) / len(yes) + sum(no) / len(no)

    cuts = sorted({s for s, _ in steps} | {max(s for s, _ in steps) + 1})
    cut = urls.threshold(urls.scored(parts, Shelf(spark)).where("held and accepted is not null").select("accepted", F.col("trial").alias("score")))
    assert balance(cut / urls.STEP) == max(map(balance, cuts))
    for r in got:
        want = {"com/fr/": "allow", "com/de/": "block"}.get(r.rule) or ("allow" if r.score >= cut else "block")
        assert r.verdict == want
    # the method tells apart what no rule decides
    free = {r.page_id: r.verdict for r in got if r.rule is None and r.page_id < 240}
    assert all(v == ("allow" if i % 2 else "block") for i, v in free.items()) and free
    assert urls.judge(frame.where("false"), rules).collect() == []


def test_keyed_filters_leave_columns_alone(spark):
    frame = spark.createDataFrame([(i, i, i, i, i) for i in range(50)] + [(None, 0, 0, 0, 0)], "key long, _near long, _spot long, _w long, __v long")
    keys = spark.createDataFrame([(i,) for i in range(0, 50, 3)] + [(None,)], "key long")
    kept, gone = without(frame, keys, "key"), only(frame, keys, "key")
    assert kept.columns == gone.columns == frame.columns
    assert sorted(r.key for r in gone.collect()) == list(range(0, 50, 3))
    assert sorted(-1 if r.key is None else r.key for r in kept.collect()) == [-1, *[i for i in range(50) if i % 3]]


def test_shelves(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with scope(spark):
        shelf = Shelf(spark)
        table = shelf.put(spark.range(5).toDF("n"))
        assert table.count() == 5
        files = table.inputFiles()
    assert spark.conf.get(name) == before
    fs = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        shared_folder(Cluster)
