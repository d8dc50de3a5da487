"""Vector bin packing of documents into training sequences.

A piece of a document is a vector: its tokens, one segment, and the tokens that bear loss. A bin
is a sequence with a limit for each. The piece placed next is the one that fits and has the
largest dot product with the room that is left, both in shares of the limits. Pieces with equal
vectors are a class, and a class is picked, its pieces in the order in which they came: a pool has few classes, for
their lengths add up to its tokens. When nothing fits,
the piece with the largest dot product is cut at the room for tokens (or for loss) and its rest
goes back to the pool, so that a sequence closes full. What cannot be filled, at the end of a
partition or when segments run out, is cut into sequences whose lengths are powers of two, which
need no padding.

Documents are packed where they are read: no shuffle, and a pool of bounded size in each task. A
longer document leaves whole sequences at once. Sequence ids are the partition's number and a
counter, so that a task that runs again gives the same ids.

A document is an optional prompt, which bears no loss, its text and an end token. Without a prompt only
its first token bears none, so the limit on loss tokens is slack unless it is below the capacity.

Edge cases: null text is empty and holds the end token alone. Repeated rows are packed each.
Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words of a generation whose ids a worker remembers.
REMEMBERED, REMEMBERED_LEAN = 300_000, 200_000
#: New words that are coded in one call.
LINE = 64
#: Sequences' worth of tokens, or pieces, that a pool gathers before it is packed.
POOL, POOL_PIECES = 128, 1 << 16

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


#: Letters that NFC leaves alone and whose lower case is one letter.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_SPACE = r" \t\n\r\x0b\x0c"
_PLAIN = rf"\x00-\x08\x0e-\x1f!-\x7f{_LETTERS}"
#: Whole strings between white space that hold anything but plain characters; else the tokenizer's own words.
_PIECES = re.compile(rf"[{_PLAIN}]*+[^{_PLAIN}{_SPACE}][^{_SPACE}]*|'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[{_LETTERS}]+|[0-9]|[^{_SPACE}0-9{_LETTERS}]+")
_STRINGS = re.compile(rf"[^{_SPACE}]+")
_ODD = re.compile(rf"[^{_PLAIN}{_SPACE}]")


class Tokens:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    For tokenizers that split lower-cased NFC text into runs of letters, digits and other signs, and
    code each run alone. Every run is coded once and remembered, in two generations so that memory
    is bounded. Strings with characters beyond plain letters, and texts with added tokens, are coded
    whole by the tokenizer, as are all others that it has not met.
    """

    def __init__(self, file: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        self.tokenizer = Tokenizer.from_file(file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = [a.lower() for a in self.added]
        self.shortest_mark = min((len(a) for a in self.marks), default=0) - 1
        # the same model for lower-cased words between spaces
        parts = json.loads(self.tokenizer.to_str())
        suffix = parts["model"].get("end_of_word_suffix")
        between = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.bare = Tokenizer.from_str(json.dumps({**parts, "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [between, level]}}))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _coded(self, pieces: list[str], encoder: object) -> list[bytes]:
        """Each piece coded alone."""
        return [np.array(c.ids, "<u4").tobytes() for c in encoder.encode_batch_fast(pieces, add_special_tokens=False)]

    def _coded_words(self, words: list[str]) -> list[bytes]:
        """Each word coded alone, many words a call: a word's last token, and no other, ends a word."""
        out: list[bytes] = []
        lines = [words[at : at + LINE] for at in range(0, len(words), LINE)]
        for line, coded in zip(lines, self.bare.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            data = ids.tobytes()
            out += [data[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)] if len(ends) == len(line) else self._coded(line, self.bare)
        return out

    def _learn(self, pieces: set[str]) -> None:
        known, old = self.known, self.old
        words: dict[str, list[str]] = {}
        odd: list[str] = []
        for p in pieces:
            code = old.get(p)
            if code is not None:
                known[p] = code
            elif _ODD.search(p) or len(p) > self.shortest_mark and any(a in p.lower() for a in self.marks):
                odd.append(p)
            else:
                words.setdefault(p.lower(), []).append(p)
        known.update(zip(odd, self._coded(odd, self.tokenizer), strict=True))
        for of_word, code in zip(words.values(), self._coded_words(list(words)), strict=True):
            for p in of_word:
                known[p] = code

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 64):
            split = [(_STRINGS if any(a in t for a in self.added) else _PIECES).findall(t) for t in (x or "" for x in texts[lo : lo + 64])]
            known = self.known
            if len(known) > self.remembered:
                self.old, self.known = known, {}
                known = self.known
            self._learn({p for pieces in split for p in pieces if p not in known})
            out += [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        return out


@lru_cache(maxsize=1)
def shared_tokens(file: str) -> Tokens:
    """One for all tasks of a worker."""
    return Tokens(file)


@lru_cache(maxsize=1)
def lean_tokens(file: str) -> Tokens:
    """As shared_tokens, with less memory and more work, for workers that have served other stages."""
    return Tokens(file, REMEMBERED_LEAN)


def powers_of_two(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def bearing(start: int, length: int, silent: int) -> int:
    """Tokens of a piece that bear loss: those from the document's token ``silent`` on."""
    return max(0, start + length - max(start, silent))


#: A document, its first token, the tokens, and the document's tokens without loss.
Piece = tuple[int, int, int, int]


class Pool:
    """Pieces that wait, by classes of equal vectors: tokens, one segment, tokens that bear loss."""

    def __init__(self, pieces: Iterable[Piece]):
        self.of: dict[tuple[int, int], int] = {}
        self.need = np.zeros((64, 3))
        self.count = np.zeros(64, np.int64)
        self.waiting: list[deque[Piece]] = []
        self.tokens = 0
        for p in pieces:
            self.add(p)

    def add(self, piece: Piece, first: bool = False) -> None:
        _, start, length, silent = piece
        loss = bearing(start, length, silent)
        at = self.of.get((length, loss))
        if at is None:
            if len(self.waiting) == len(self.need):
                self._tidy()
            at = self.of[length, loss] = len(self.waiting)
            self.waiting.append(deque())
            self.need[at] = length, 1, loss
        (self.waiting[at].appendleft if first else self.waiting[at].append)(piece)
        self.count[at] += 1
        self.tokens += length

    def _tidy(self) -> None:
        """Leave empty classes behind; twice the room if most are in use."""
        live = np.flatnonzero(self.count)
        room = max(64, 2 * len(live))
        need, count = np.zeros((room, 3)), np.zeros(room, np.int64)
        need[: len(live)], count[: len(live)] = self.need[live], self.count[live]
        self.waiting = [self.waiting[i] for i in live.tolist()]
        self.of = {(int(n[0]), int(n[2])): i for i, n in enumerate(need[: len(live)].tolist())}
        self.need, self.count = need, count

    def vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """The classes' vectors, and which of them have pieces."""
        n = len(self.waiting)
        return self.need[:n], self.count[:n] > 0

    def take(self, at: int) -> Piece:
        piece = self.waiting[at].popleft()
        self.count[at] -= 1
        self.tokens -= piece[2]
        return piece

    def left(self) -> list[Piece]:
        return sorted(p for own in self.waiting for p in own)


class Packer:
    """Packs pieces of numbered documents; emits rows (doc, start, length, sequence, offset)."""

    def __init__(self, capacity: int, segments: int, loss: int, first_sequence: int):
        self.limits = np.array([capacity, segments, loss], float)
        self.capacity, self.segments, self.loss = capacity, segments, loss
        self.sequence = first_sequence

    def _close(self, pieces: list[tuple[int, int, int]], used: int) -> Iterator[tuple[int, int, int, int, int]]:
        sizes = [used] if used == self.capacity else powers_of_two(used)
        pieces, at = pieces[::-1], 0
        for size in sizes:
            at = 0
            while at < size:
                doc, start, length = pieces.pop()
                take = min(length, size - at)
                yield doc, start, take, self.sequence, at
                at += take
                if take < length:
                    pieces.append((doc, start + take, length - take))
            self.sequence += 1

    def pack(self, pieces: list[Piece], last: bool) -> tuple[list[tuple[int, int, int, int, int]], list[Piece]]:
        """(rows, pieces left over) of pieces (doc, start, length, the document's tokens without loss); with
        ``last`` nothing is left over."""
        rows: list[tuple[int, int, int, int, int]] = []
        pool = Pool(pieces)
        per_limit = 1 / (self.limits * self.limits)
        while pool.tokens and (last or pool.tokens >= self.capacity):
            room, chosen, used = self.limits.copy(), [], 0
            while room[0] > 0 and room[1] > 0 and pool.tokens:
                need, live = pool.vectors()
                share = need @ (room * per_limit)
                fits = live & (need <= room).all(axis=1)
                if fits.any():
                    took = pool.take(int(np.where(fits, share, -1).argmax()))
                else:
                    doc, start, length, silent = pool.take(int(np.where(live, share, -1).argmax()))
                    cut = int(min(room[0], room[2] + max(0, silent - start), length))
                    if cut < length:
                        pool.add((doc, start + max(0, cut), length - max(0, cut), silent), first=True)
                    if cut <= 0:
                        break
                    took = doc, start, cut, silent
                chosen.append(took[:3])
                used += took[2]
                room -= (took[2], 1, bearing(*took[1:]))
            rows.extend(self._close(chosen, used))
        return rows, pool.left()


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    segments: int = 512,
    loss: int = 4096,
    end_id: int = 2,
    prompt: str | None = None,
    tokens: Callable[[str], Callable[[list[str | None]], list[bytes]]] = shared_tokens,
) -> DataFrame:
    """One row for each piece of every document of docs (doc_id, text), with its place.

    ``prompt`` names a column of text that comes before ``text`` in its document and bears no loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, segments, loss, TaskContext.get().partitionId() << 36)
        ids: dict[int, tuple[int | None, bytes, int]] = {}
        pool: list[Piece] = []
        held, number = 0, 0

        def out(rows: list[tuple[int, int, int, int, int]], left: list[Piece]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(8)]
            for doc, start, length, sequence, offset in rows:
                doc_id, data, silent = ids[doc]
                row = (doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), len(data) // 4, bearing(start, length, silent), sequence, offset)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            keep = {p[0] for p in left}
            for doc in [d for d in ids if d not in keep]:
                del ids[doc]
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                doc_ids, texts, prompts = (batch.column(c).slice(lo, 64).to_pylist() for c in ("doc_id", "text", "prompt"))
                before = encode(prompts) if prompt else [b""] * len(texts)
                for doc_id, first, data in zip(doc_ids, before, encode(texts), strict=True):
                    # nothing precedes a document's first token
                    ids[number] = doc_id, first + data + end, max(1, len(first) // 4)
                    n = (len(first) + len(data)) // 4 + 1
                    pool.append((number, 0, n, ids[number][2]))
                    held, number = held + n, number + 1
                    if held >= POOL * capacity or len(pool) >= POOL_PIECES:
                        rows, pool = packer.pack(pool, last=False)
                        held = sum(p[2] for p in pool)
                        yield out(rows, pool)
        rows, pool = packer.pack(pool, last=True)
        yield out(rows, pool)

    before = F.col(prompt) if prompt else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), before.alias("prompt")).mapInArrow(run, SCHEMA)
