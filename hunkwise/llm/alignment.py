"""Tokens of two tokenizers aligned by a dictionary of groups.

Where a token of tokenizer A and a token of tokenizer B end at the same byte, both sequences are cut. What lies
between two cuts is a group: some ids of A beside some ids of B for the same bytes. Texts repeat groups all the
time, so each step works on different groups:

1. Documents are read in chunks, a bounded batch of rows each. A chunk interns its groups: documents become lists
   of small codes, the chunk a list of different groups with their frequencies.
2. The chunks' groups meet once by group. The links of each different group are expanded once and multiplied by
   its frequency, which gives the count of every linked id pair of the corpus.
3. Each group's results go back by its key to the chunks that hold it, and a chunk's documents add them up by code.

A group occurs once per chunk in what is shuffled, however many documents repeat it. The tokens of a group but the
last ones end where no token of the other side ends, so a group has one link: its last ids.

Both tokenizers code what stands between single spaces alone (a byte-level vocabulary splits there before it
merges; the pieces of the other hold the sign for a space at their beginning only, which is checked), so such
units are coded once and remembered, in two generations of bounded size. A text whose units do not give its bytes
back is coded as a whole.

Edge cases: null and empty texts, and texts whose tokens do not spell them (they hold U+2581), have no tokens: zeros
and an empty digest. Repeated rows count each. A null doc_id is a row like any other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.shelf import Shelf

#: Units of a generation that a worker remembers, and different groups.
REMEMBERED, GROUPS = 200_000, 400_000
#: New units that are coded in one call.
LINE = 256
#: Id pairs of a table that is broadcast: 24 bytes each.
BROADCAST_PAIRS = 400_000

_CHUNKS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, codes binary, groups array<string>, times array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: A single space between signs that are no space to either tokenizer.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"

#: Tokens of A and of B, the groups' numbers as 32-bit integers, and the groups as text: ``a1,a2|b1;a3|b2,b3``.
Unit = tuple[int, int, bytes, str]
_NOTHING: Unit = (0, 0, b"", "")


def byte_letters() -> dict[str, int]:
    """The byte for each letter of a byte-level vocabulary: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """The groups of texts by a byte-level BPE file (A) and a sentence-piece model (B)."""

    def __init__(self, a_file: str, b_file: str, remembered: int = REMEMBERED):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        splitter = json.loads(self.a.to_str())
        before = splitter["pre_tokenizer"] or {}
        self.by_units = splitter["normalizer"] is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.a_length, self.b_length = (np.array([len(x) for x in of]) for of in (self.a_bytes, self.b_bytes))
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, Unit | None] = {}
        self.old: dict[str, Unit | None] = {}
        self.number: dict[tuple[bytes, bytes], int] = {}  # of a group, by its ids
        self.text: list[str] = []  # of a group

    def units(self, text: str) -> list[str]:
        return _BETWEEN.split(text) if self.by_units else [text]

    def _cut(self, a: list[int], b: list[int], data: bytes, ends: np.ndarray) -> list[Unit] | None:
        """The units that end at those bytes; None where the tokens of a side do not spell the bytes, or go across."""
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        a_ids, b_ids = np.array(a, "<i4"), np.array(b, "<i4")
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last = np.searchsorted(both, ends)
        if not np.array_equal(both[np.minimum(last, len(both) - 1)], ends):
            return None
        to_a, to_b = np.searchsorted(a_ends, both) + 1, np.searchsorted(b_ends, both) + 1
        a_data, b_data, number, codes = a_ids.tobytes(), b_ids.tobytes(), self.number, []
        i = j = 0
        for k, n in zip((4 * to_a).tolist(), (4 * to_b).tolist(), strict=True):
            ids = a_data[i:k], b_data[j:n]
            i, j = k, n
            code = number.get(ids)
            if code is None:
                code = number[ids] = len(number)
                self.text.append("|".join(",".join(map(str, np.frombuffer(x, "<i4").tolist())) for x in ids))
            codes.append(code)
        texts, data = [self.text[c] for c in codes], np.array(codes, "<i4").tobytes()
        cuts = [0, *(last + 1).tolist()]
        n_a, n_b = (np.diff(to[last], prepend=0).tolist() for to in (to_a, to_b))
        return [(x, y, data[4 * lo : 4 * hi], ";".join(texts[lo:hi])) for x, y, lo, hi in zip(n_a, n_b, cuts, cuts[1:])]

    def coded(self, lines: list[list[str]]) -> list[list[Unit] | None]:
        """The units of each line, which is coded as a whole."""
        texts = [" ".join(line) for line in lines]
        a = self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        b = self.b.encode(texts, num_threads=1)
        ends = [np.cumsum([len(u.encode()) + 1 for u in line]) for line in lines]
        return [self._cut(x.ids, y, f" {t}".encode(), e) for x, y, t, e in zip(a, b, texts, ends, strict=True)]

    def whole(self, texts: list[str]) -> list[Unit | None]:
        """Each text as one unit."""
        return [x[0] if x else None for x in self.coded([[t] for t in texts])]

    def learn(self, units: Iterable[str]) -> None:
        """Afterwards ``known`` holds every one of the units."""
        if len(self.known) > self.remembered:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = []
        for u in units:
            if u in old:
                known[u] = old[u]
            else:
                new.append(u)
        # a unit with white space at an end is a text's first or last
        plain = [u for u in new if u and not u[0].isspace() and not u[-1].isspace()] if self.by_units else []
        alone = [u for u in new if not u or u[0].isspace() or u[-1].isspace()] if self.by_units else new
        lines = [plain[lo : lo + LINE] for lo in range(0, len(plain), LINE)]
        for line in lines:
            found = self.coded([line])[0]
            if found is None:
                alone += line
            else:
                known.update(zip(line, found, strict=True))
        for u in alone:
            known[u] = self.whole([u])[0]


@lru_cache(maxsize=1)
def shared_aligner(a_file: str, b_file: str) -> Aligner:
    """One for all tasks of a worker."""
    return Aligner(a_file, b_file)


class Chunk:
    """Documents as lists of group codes, and the different groups with their frequencies."""

    def __init__(self, aligner: Aligner):
        if len(aligner.number) > GROUPS:
            aligner.forget()
        self.aligner = aligner
        self.docs: list[tuple[int, int, int, str]] = []
        self.numbers: list[bytes] = []

    def add(self, texts: list[str | None]) -> None:
        aligner = self.aligner
        split = [aligner.units(t) if t else [] for t in texts]
        if len(aligner.known) > aligner.remembered:
            aligner.learn(())
        aligner.learn({u for own in split for u in own} - aligner.known.keys())
        for text, own in zip(texts, split, strict=True):
            found = [aligner.known[u] for u in own]
            if None in found:  # not spelt by its units
                found = [aligner.whole([text])[0] or _NOTHING]
            numbers = b"".join([u[2] for u in found])
            digest = hashlib.sha256(";".join([u[3] for u in found]).encode()).hexdigest() if numbers else ""
            self.docs.append((sum([u[0] for u in found]), sum([u[1] for u in found]), len(numbers) // 4, digest))
            self.numbers.append(numbers)

    def interned(self) -> tuple[list[bytes], list[str], np.ndarray]:
        """(codes of each document, the chunk's groups by code, their frequencies)."""
        groups, code, times = np.unique(np.frombuffer(b"".join(self.numbers), "<i4"), return_inverse=True, return_counts=True)
        width = 2 if len(groups) <= 1 << 16 else 4
        data, ends = code.astype(f"<u{width}").tobytes(), np.cumsum([0, *(len(n) // 4 * width for n in self.numbers)])
        return [data[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)], [self.aligner.text[g] for g in groups], times


def _chunks(a_file: str, b_file: str):
    """A row for each document and, after those of a chunk, one for its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared_aligner(a_file, b_file)
        chunk_id = TaskContext.get().partitionId() << 33
        names = [f.split()[0] for f in _CHUNKS.split(", ")]
        types = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = Chunk(aligner)
            for lo in range(0, batch.num_rows, 64):
                chunk.add(batch.column("text").slice(lo, 64).to_pylist())
            codes, groups, times = chunk.interned()
            n, nothing = batch.num_rows, [None]
            cols = [[chunk_id] * n, batch.column("doc_id"), *map(list, zip(*chunk.docs, strict=True)), codes, nothing * n, nothing * n]
            yield pa.record_batch([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(cols, types, strict=True)], names=names)
            last = [[chunk_id], *[nothing] * 6, [groups], [times.tolist()]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(last, types, strict=True)], names=names)
            chunk_id += 1

    return run


def _added_up(docs: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a chunk with the results of its groups (code, count, best)."""
    code = found.column("code").to_numpy()
    count, best = np.zeros((2, int(code.max()) + 1 if len(code) else 0), np.int64)
    count[code], best[code] = found.column("count").to_numpy(), found.column("best").to_numpy()
    width = 2 if len(code) <= 1 << 16 else 4
    codes = [np.frombuffer(c, f"<u{width}") for c in docs.column("codes").to_pylist()]
    sums = [pa.array([len(c) for c in codes], pa.int64()), *(pa.array([int(v[c].sum()) for c in codes], pa.int64()) for v in (best, count))]
    own = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
    return pa.table([*own, *sums, docs.column("groups_sha256")], names=[f.split()[0] for f in _RESULT.split(", ")])


def aligned_chunks(docs: DataFrame, a_file: str, b_file: str, shelf: Shelf) -> DataFrame:
    """The interned documents of docs (doc_id, text), written: rows of documents, and of chunks with their groups."""
    return shelf.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunks(a_file, b_file), _CHUNKS))


def _entries(chunks: DataFrame) -> DataFrame:
    """chunk, code, group, n: the groups of every chunk."""
    each = chunks.where("groups is not null").select("chunk", "times", F.posexplode("groups").alias("code", "group"))
    return each.select("chunk", "code", "group", F.expr("times[code]").alias("n"))


def links(chunks: DataFrame) -> DataFrame:
    """group, a, b, n: the link of every different group, and how often the corpus has the group."""
    groups = _entries(chunks).groupBy("group").agg(F.sum("n").alias("n"))
    last = lambda side: F.substring_index(F.substring_index("group", "|", side), ",", -1).cast("int")
    return groups.select("group", last(1).alias("a"), last(-1).alias("b"), "n")


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, count, best: links of every id pair, and whether no other pair of its B id has more."""
    counts = linked.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))  # a row for each id of B's vocabulary at most
    return counts.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, shelf: Shelf | None = None) -> DataFrame:
    """One row for every row of docs (doc_id, text): its tokens, groups and links, how many links are a best one of
    their B id, the sum of the counts of their id pairs, and the digest of its groups."""
    shelf = shelf or Shelf(docs.sparkSession)
    chunks = aligned_chunks(docs, a_file, b_file, shelf)
    linked = shelf.put(links(chunks))
    pairs = shelf.put(pair_counts(linked))
    few = pairs.count() <= BROADCAST_PAIRS
    valued = linked.join(F.broadcast(pairs) if few else pairs, ["a", "b"]).select("group", "count", "best")
    found = _entries(chunks).join(valued, "group").select(F.col("chunk").alias("of"), "code", "count", "best")
    own = chunks.where("groups is null").drop("groups", "times")
    return own.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_added_up, _RESULT)
