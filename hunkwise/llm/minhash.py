"""MinHash near-duplicate groups with sequential Bayesian verification.

Every text becomes its set of word shingles. Equal sets are one class at once. Classes that share
a band of their MinHash signature are candidates; their signatures are compared batch by batch, a
candidate going as soon as the posterior probability of reaching the wanted similarity is below
``miss``; survivors are confirmed on the full sets. Linked classes form components.

No step emits all pairs of a group. First each class meets one leader per bucket. Then only
buckets that still hold several components go on: small ones compare across components; in a
large one the classes outside its largest component meet all its classes, block against block inside
tasks, pruned and confirmed alike, and only links that join components leave a block. Large buckets of the same
classes count once. No step deals rows by bucket where a bucket may be large. Confirmations are done best estimate first, and pairs whose
ends a confirmed link has joined meanwhile need none.

Edge cases: null or wordless text is empty and linked with nothing. Rows that share a doc_id share
its text; where their texts differ, each is of its own text's class, and only one of the texts that have
the id as their smallest is compared with others. A row with a null doc_id cannot name a document: it is linked with nothing and kept.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm.keyed import only
from hunkwise.llm.shelf import Shelf
from hunkwise.llm.textbits import U, Words, mix, runs

#: 36 bands of 5 rows miss a pair of similarity 0.8 with a probability of 6e-7.
BANDS, ROWS = 36, 5
BATCH = 36
#: A pair of the wanted similarity is pruned with at most this posterior probability.
MISS = 1e-6
#: Buckets of up to so many classes compare across components as pairs, larger ones in blocks.
SMALL = 32
#: Classes of a block, and shingles that its classes have together on average.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Tables of large buckets are broadcast up to so many rows (24 bytes each), joined by shuffle beyond.
BROADCAST_ROWS = 200_000


@lru_cache(maxsize=2)
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, n, dtype=np.uint64) | U(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes; fewer than k words make one shingle."""
    for _, _, data, offs in runs(column):
        words = Words(data, offs, "space")
        at, grams = words.ngrams(k)
        cut = np.searchsorted(at, words.first)
        for d in range(words.n_docs):
            lo, hi = words.first[d], words.first[d + 1]
            if hi == lo:
                yield np.zeros(0, np.uint64)
            elif hi - lo < k:
                codes = words.hash[lo:hi] * (np.arange(1, hi - lo + 1, dtype=np.uint64) * U(2) + U(1))
                yield mix(codes.sum(dtype=np.uint64, keepdims=True) ^ U(hi - lo))
            else:
                yield np.unique(grams[cut[d] : cut[d + 1]])


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values, the low 16 bits of each kept."""
    a, b = _seeds(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, ((shingles[i : i + 1024, None] * a + b) >> U(24)).min(axis=0), out=low)
    return low.astype(np.uint16)


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sigs.append(signature(s, bands * rows).tobytes() if len(s) else None)
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sig"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [s.tobytes() for s in shingle_sets(batch.column("text"), k)]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(got, pa.binary())], names=["node", "shingles"])

    return run


@lru_cache(maxsize=8)
def least_matches(n: int, similarity: float, miss: float) -> int:
    """Fewest matches among n hashes that leave similarity >= the wanted one a posterior
    probability of at least ``miss``, from a uniform prior."""
    total = 0.0
    for m in range(n + 1):
        # P(J >= t) under Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m)
        total += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survives(x: np.ndarray, y: np.ndarray, similarity: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of the surviving rows, their share of matches) for two arrays of signatures."""
    alive = np.arange(len(x))
    matches = np.zeros(len(x), np.int64)
    width = x.shape[1]
    for lo in range(0, width, BATCH):
        hi = min(width, lo + BATCH)
        matches[alive] += (x[alive, lo:hi] == y[alive, lo:hi]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(hi, similarity, miss)]
    return alive, matches[alive] / width


def _unpack(values, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(-1, width)


def _prune(width: int, similarity: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_unpack(batch.column(c).to_pylist(), width) for c in ("sig_a", "sig_b"))
                alive, share = survives(x, y, similarity, miss)
                take = pa.array(alive)
                yield pa.record_batch([batch.column("a").take(take), batch.column("b").take(take), pa.array(share)], names=["a", "b", "est"])

    return run


def _confirm(per_100: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for p, q in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= per_100 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _pairs(a: Column | str, b: Column | str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class _Links:
    """Components of the classes, grown by confirmed links."""

    def __init__(self, shelf: Shelf):
        self.shelf, self.of = shelf, None  # of: (node, comp) for every node in a component of two or more

    def comp(self, df: DataFrame, node: str, name: str) -> DataFrame:
        if self.of is None:
            return df.withColumn(name, F.col(node))
        m = self.of.select(F.col("node").alias(node), F.col("comp").alias("_comp"))
        return df.join(m, node, "left").withColumn(name, F.coalesce("_comp", node)).drop("_comp")

    def crossing(self, pairs: DataFrame) -> DataFrame:
        """Pairs between different components, with both (ca, cb)."""
        return self.comp(self.comp(pairs, "a", "ca"), "b", "cb").where("ca != cb")

    def add(self, links: DataFrame) -> None:
        """Hook every component under the smallest neighbour, jump once, contract; to the end."""
        edges = self.shelf.put(self.crossing(links).select(*_pairs("ca", "cb")).distinct())
        while not edges.isEmpty():
            both = edges.union(edges.select("b", "a")).toDF("comp", "to")
            hook = both.groupBy("comp").agg(F.least(F.min("to"), F.col("comp")).alias("up"))
            hook = self.shelf.put(hook)
            top = hook.toDF("up", "top")
            hook = self.shelf.put(hook.join(top, "up", "left").select("comp", F.coalesce("top", "up").alias("up")))
            if self.of is None:
                new = hook.select(F.col("comp").alias("node"), F.col("up").alias("comp"))
            else:
                old = self.of.join(hook, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
                more = hook.join(self.of.select(F.col("node").alias("comp")), "comp", "left_anti")
                new = old.union(more.select("comp", "up"))
            self.of = self.shelf.put(new)
            up = lambda c: hook.select(F.col("comp").alias(c), F.col("up").alias(f"up_{c}"))
            nxt = edges.join(up("a"), "a").join(up("b"), "b").where("up_a != up_b").select(*_pairs("up_a", "up_b")).distinct()
            edges = self.shelf.put(nxt)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    per_100: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
    shelf: Shelf | None = None,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    shelf = shelf or Shelf(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = bands * rows
    signed = shelf.put(docs.mapInArrow(_sign(shingle, bands, rows), "doc_id long, n_shingles long, digest binary, sig binary"))
    whole = signed.where("digest is not null and doc_id is not null")
    # one node for each class of equal sets, named by its smallest doc_id
    classes = shelf.put(whole.groupBy("digest").agg(F.min("doc_id").alias("node")))
    nodes = shelf.put(whole.join(classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"], "left_semi").groupBy("doc_id").agg(F.first("sig").alias("sig"), F.max("n_shingles").alias("size")).withColumnRenamed("doc_id", "node"))
    signed_nodes = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    band = [F.xxhash64(F.substring("sig", 2 * rows * i + 1, 2 * rows), F.lit(i)) for i in range(bands)]
    banded = nodes.select("node", F.explode(F.array(*band)).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = shelf.put(banded.join(shared, "bucket"))  # rows of buckets with two classes or more

    links = _Links(shelf)
    similarity = per_100 / 100
    pair_columns = "a long, b long, est double"

    def pruned(pairs: DataFrame) -> DataFrame:
        with_sigs = pairs.join(signed_nodes("a"), "a").join(signed_nodes("b"), "b")
        return with_sigs.mapInArrow(_prune(width, similarity, miss), pair_columns)

    def sets_of(ends: DataFrame) -> DataFrame:
        wanted = only(docs, ends.select(F.col("node").alias("doc_id")), "doc_id")
        return shelf.put(wanted.mapInArrow(_sets(shingle), "node long, shingles binary").distinct())

    def confirmed(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
        out = shelf.put(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(per_100), "a long, b long"))
        shelf.drop(sets)
        return out

    def settle(pool: DataFrame) -> None:
        """Confirm the pool's pairs, best first, as long as they join different components."""
        done = None
        for most in (2, 32, None):
            cross = links.crossing(pool)
            if done is not None:
                cross = cross.join(done, ["a", "b"], "left_anti")
            if most:
                cross = _best(cross, most)
            todo = shelf.put(cross.select("a", "b").distinct())
            if todo.isEmpty():
                return
            links.add(confirmed(todo))
            done = todo if done is None else done.union(todo)

    pool = shelf.put(pruned(members.where("node != leader").select(*_pairs("node", "leader")).distinct()))
    settle(pool)
    # buckets of three or more that still hold several components
    many = members.where("n > 2").select("bucket", "node", "n")

    def mixed(rows: DataFrame) -> DataFrame:
        rows = links.comp(rows, "node", "comp")
        lo = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket", "lo")
        return shelf.put(rows.join(lo, "bucket"))

    small = mixed(many.where(F.col("n") <= SMALL))
    x, y = (small.select("bucket", F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in ("a", "b"))
    pairs = x.join(y, "bucket").where("a < b and ca != cb").select("a", "b").distinct()
    settle(shelf.put(pruned(pairs.join(pool.select("a", "b"), ["a", "b"], "left_anti"))))
    large = links.comp(many.where(F.col("n") > SMALL).select("bucket", "node"), "node", "comp")
    # of buckets with the same classes, one; those that hold one component are done
    alike = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("m")]
    left = large.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *alike).where("lo != hi").groupBy("x", "y", "m").agg(F.min("bucket").alias("bucket"))
    left = shelf.put(left.select("bucket"))
    if not left.isEmpty():
        near = shelf.put(large.join(_small(left), "bucket").join(nodes.select("node", "size"), "node"))
        full = nodes.select("node", "sig").join(sets_of(near.select("node").distinct()), "node")
        links.add(shelf.put(_blocks(shelf, near, full, per_100, miss)))

    out = signed.join(classes, "digest", "left")
    if links.of is not None:
        out = out.join(links.of, "node", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _best(cross: DataFrame, most: int) -> DataFrame:
    """The best pairs of each component towards any other."""
    ends = cross.withColumn("end", F.explode(F.array("ca", "cb")))
    by = Window.partitionBy("end").orderBy(F.col("est").desc(), "a", "b")
    return ends.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def _small(df: DataFrame) -> DataFrame:
    """A table on the shelf, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def block_links(p: pd.DataFrame, q: pd.DataFrame, per_100: int, miss: float) -> tuple[list[tuple[int, int]], int]:
    """A spanning forest of the links between two blocks (node, comp, sig, shingles), and how many pairs met on full sets.

    Signatures of different components are compared batch by batch, as candidates of small buckets are. The
    survivors of a node meet it on the full sets, by an index over the block that is made for the first of them.
    """
    links: list[tuple[int, int]] = []
    up: dict[int, int] = {}
    met = 0

    def top(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    if not (len(p) and len(q)):
        return links, met
    width = len(p["sig"].iloc[0]) // 2
    sigs_p, sigs_q = _unpack(p["sig"], width), _unpack(q["sig"], width)
    yc, yn = q["comp"].to_numpy(), q["node"].to_numpy()
    flat = None
    for sig, node, comp, data in zip(sigs_p, p["node"], p["comp"], p["shingles"], strict=True):
        others = np.flatnonzero(yc != comp)
        alive, _ = survives(np.broadcast_to(sig, (len(others), width)), sigs_q[others], per_100 / 100, miss)
        alive = others[alive]
        if not len(alive):
            continue
        if flat is None:
            sets_q = [np.frombuffer(s, np.uint64) for s in q["shingles"]]
            sizes, flat = np.array([len(s) for s in sets_q]), np.concatenate(sets_q)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(sets_q)), sizes)[order]
        met += len(alive)
        mine = np.frombuffer(data, np.uint64)
        lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        both = np.bincount(owner[at], minlength=len(sizes))[alive]
        linked = alive[100 * both >= per_100 * (len(mine) + sizes[alive] - both)]
        for c, i in zip(*np.unique(yc[linked], return_index=True), strict=True):
            x, y = top(int(comp)), top(int(c))
            if x != y:
                up[max(x, y)] = min(x, y)
                links.append((int(node), int(yn[linked[i]])))
    return links, met


def _blocks(shelf: Shelf, near: DataFrame, sets: DataFrame, per_100: int, miss: float) -> DataFrame:
    """Confirmed links that join the components of each bucket (bucket, node, size, comp), by signatures and full sets (node, sig, shingles).

    Nodes outside the bucket's largest component meet all its nodes, block against block, in tasks
    of bounded size that compare signatures and then the full sets. A block gives a spanning forest of
    its links: at most one row for each component in it, and no link is lost to the components.
    """
    parts = near.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    parts = parts.groupBy("bucket").agg(F.max(F.struct("m", "comp", "s")).alias("top"), F.sum("m").alias("n"), F.sum("s").alias("s"))
    main = shelf.put(parts.select("bucket", F.col("top.comp").alias("main"), "n", "s", (F.col("n") - F.col("top.m")).alias("n_odd"), (F.col("s") - F.col("top.s")).alias("s_odd")))
    sized = near.join(_small(main), "bucket").join(sets, "node")
    blocks = lambda of: F.greatest(F.ceil(F.col("n" + of) / BLOCK), F.ceil(F.col("s" + of) / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), blocks("_odd"))).cast("int")
    other = F.pmod(F.xxhash64("node", F.lit(1)), blocks("")).cast("int")
    left = sized.where("comp != main").withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), blocks("") - 1)))
    right = sized.where("n_odd > 0").withColumn("j", other).withColumn("i", F.explode(F.sequence(F.lit(0), blocks("_odd") - 1)))
    keep = ["bucket", "i", "j", "node", "comp", "sig", "shingles"]

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(p, q, per_100, miss)[0], columns=["a", "b"]).astype("int64")

    left, right = left.select(keep).toDF(*keep), right.select(keep).toDF(*keep)  # apart, although of one origin
    return left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket", "i", "j")).applyInPandas(run, "a long, b long")
