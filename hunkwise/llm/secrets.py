"""Secret scanning with a random forest that removes false positives.

Patterns propose candidates: private key blocks, values of telling names, known key formats and
long runs without spaces. A random forest, trained from labelled findings, decides which are
secrets, from the candidate's length and alphabet, the likelihood of its character transitions,
how much of it dictionary words cover, and the words beside it and in its path, each by the log odds
that the labelled findings give it there. The dictionary, and with it the usual transitions, are the most
frequent words of 4 to 16 letters of all texts: longer words are in no dictionary, but may hold ones that are.

Time is linear in a text: its runs are read from their start and never again, whatever they hold.

Labelled findings are rows (candidate, before, after, path, label); ``example_findings`` makes a
bounded list of them, for want of a table. ``held_out`` measures a forest on findings that it has not
learned from. Candidates are found and judged over whole texts, where the texts are.

Edge cases: null and empty texts have no findings. Repeated rows give repeated findings.
Every candidate is judged. Accepted ones that overlap give one finding over all of them, with the
kind and score of the likeliest; of the rejected ones that overlap no accepted one, the earliest and
then the longest is a finding. Positions count characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES, DEPTH = 40, 9
CUT = 0.5
MASK = "[SECRET]"
CONTEXT = 48

_NAMES = r"(?:secret|token|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
_KEY_BEGINS, _KEY_ENDS = re.compile(r"-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----"), re.compile(r"-----END [A-Z ]*+(?<=PRIVATE KEY)-----")
#: Each pattern meets a sign of the text a bounded number of times: runs are taken from their start, and never given back.
_PATTERNS = (
    ("format", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_(?:live|test)_[0-9A-Za-z]{16,})"), 0),
    ("named", re.compile(rf"(?<![\w-])(?=[\w-]*?{_NAMES})[\w-]++[\"']?+\s*+(?:=>|[:=])\s*+[\"']?+([^\s\"'<>,;]{{6,}})", re.IGNORECASE), 1),
    ("long", re.compile(r"(?<![0-9A-Za-z+/_=-])(?=[a-zA-Z+/_-]*+[0-9])[0-9A-Za-z+/_=-]{20,}"), 0),
)
#: A text without any of these has no candidate; kept cheap because every text meets it. Case folds as in re, beyond ASCII.
_MAYBE = r"(?iu)PRIVATE KEY-----|AKIA|gh[pousr]_|xox[abprs]-|AIza|sk_(live|test)_|[0-9A-Za-z+/_=-]{20}|" + _NAMES

#: Words of the dictionary, and their lengths. A word's letters are a to z.
DICTIONARY, SHORTEST, LONGEST = 4000, 4, 16
#: Findings that must have a word near a candidate before it counts, and words before and after that are near.
LEAST_FINDINGS, NEAR = 4, 3
#: Folds of the labelled findings.
FOLDS = 7


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str


def _key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """From each beginning that is in no block to the next end."""
    ends = [m.span() for m in _KEY_ENDS.finditer(text)]
    at, free = 0, 0
    for m in _KEY_BEGINS.finditer(text) if ends else ():
        if m.start() < free:
            continue
        while at < len(ends) and ends[at][0] < m.end():
            at += 1
        if at == len(ends):
            return
        free = ends[at][1]
        yield m.start(), free


def candidates(text: str) -> list[Candidate]:
    """All that the patterns propose, by start, the longest first; they may overlap. A span that several propose is the first pattern's."""
    spans = [(start, -end, 0, "private_key") for start, end in _key_blocks(text)]
    spans += [(m.start(g), -m.end(g), order, kind) for order, (kind, rx, g) in enumerate(_PATTERNS, 1) for m in rx.finditer(text)]
    found = sorted(spans)
    return [Candidate(start, -end, kind) for i, (start, end, _, kind) in enumerate(found) if not i or found[i - 1][:2] != (start, end)]


class Language:
    """Dictionary words, and log2 of their smoothed letter transitions."""

    def __init__(self, words: Mapping[str, int]):
        self.words = frozenset(words)
        pairs = np.zeros((26, 26))
        for word, n in words.items():
            at = np.frombuffer(word.encode(), np.uint8).astype(np.int64) - ord("a")
            np.add.at(pairs, (at[:-1], at[1:]), n)
        # a to z; the 27th is any other character
        self.transitions = np.full((27, 27), -7.0)
        share = (pairs + 0.3) / (pairs.sum(axis=1, keepdims=True) + 0.3 * 26)
        self.transitions[:26, :26] = np.maximum(-7.0, np.log2(share))

    def covered(self, low: str) -> float:
        """The share of a candidate's characters that lie in dictionary words."""
        depth = np.zeros(len(low) + 1, np.int64)
        for run in re.finditer(f"[a-z]{{{SHORTEST},}}", low):
            lo, hi = run.span()
            for at in range(lo, hi - SHORTEST + 1):
                for end in range(at + SHORTEST, min(hi, at + LONGEST) + 1):
                    if low[at:end] in self.words:
                        depth[at] += 1
                        depth[end] -= 1
        return float((np.cumsum(depth)[:-1] > 0).mean()) if low else 0.0


def language(docs: DataFrame, most: int = DICTIONARY) -> Language:
    """The ``most`` most frequent words of all texts of docs (text)."""
    words = docs.where("text is not null").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    counts = words.where(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    return Language({r.word: r.n for r in counts.orderBy(F.col("n").desc(), "word").limit(most).collect()})


def describe(candidate: str, before: str, after: str, known: Language) -> list[float]:
    """The forest's features of a candidate and of the signs around it."""
    n = max(1, len(candidate))
    low = candidate.lower()
    counts = [k / n for k in Counter(low).values()]
    letters = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - ord("a")
    letters[(letters < 0) | (letters > 25)] = 26
    steps = known.transitions[letters[:-1], letters[1:]]
    signs, of_sign = np.unique(np.frombuffer(candidate.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    kinds = np.array([(c.isdigit(), c.islower(), c.isupper(), not c.isalnum()) for c in map(chr, signs.tolist())] or [(0, 0, 0, 0)], np.int8)[of_sign if len(signs) else [0]]
    changes = (kinds[1:] != kinds[:-1]).any(axis=1).mean() if len(kinds) > 1 else 0.0
    return [
        float(len(candidate)),
        -sum(p * math.log2(p) for p in counts),
        float(steps.mean()) if len(steps) else 0.0,
        known.covered(low),
        *kinds.mean(axis=0).tolist(),
        float(changes),
        float(bool(re.fullmatch("[0-9a-f]+", low))),
        len(counts) / n,
        float(before.rstrip()[-1:] in ("=", ":", '"', "'")),
        float(any(w in low for w in ("xxxx", "your", "changeme", "example", "placeholder", "<", "${", "****", "1234567"))),
        float(low.startswith("-----begin ")),
    ]


Finding = tuple[str, str, str, str, int]


class Neighbours:
    """What words before, after and in the path of labelled findings say about a candidate: log odds of the label."""

    def __init__(self, findings: Sequence[Finding]):
        self.total = [0, 0]
        self.seen: dict[tuple[int, str], list[int]] = {}
        for _, before, after, path, label in findings:
            self.total[label] += 1
            for at in {(place, w) for place, words in enumerate(self._words(before, after, path)) for w in words}:
                self.seen.setdefault(at, [0, 0])[label] += 1

    @staticmethod
    def _words(before: str, after: str, path: str) -> list[list[str]]:
        """The words next to a candidate, the nearest first, and those of its path."""
        of = lambda text: re.findall(r"[^\W_]{2,}", text.lower())
        return [of(before)[::-1][:NEAR], of(after)[:NEAR], of(path)]

    def _weight(self, place: int, word: str) -> float:
        n = self.seen.get((place, word), (0, 0))
        if sum(n) < LEAST_FINDINGS:
            return 0.0
        return math.log((n[1] + 0.5) / (self.total[1] + 1)) - math.log((n[0] + 0.5) / (self.total[0] + 1))

    def features(self, before: str, after: str, path: str) -> list[float]:
        """The nearest word before, and the sums before, after and of the path."""
        weights = [[self._weight(place, w) for w in words] for place, words in enumerate(self._words(before, after, path))]
        return [weights[0][0] if weights[0] else 0.0, *map(sum, weights)]


def example_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (candidate, before, after, path, label): keys in use, and what only looks like them."""
    rng = np.random.default_rng(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    syllables = [a + b + c for a in "bdfglmnprst" for b in "aeiou" for c in ("", "n", "r", "s")]

    def pick(options: Sequence[str]) -> str:
        return options[int(rng.integers(len(options)))]

    def chance(length: int, alphabet: str) -> str:
        return "".join(rng.choice(list(alphabet), length))

    def prose(k: int) -> str:
        return " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(k))

    def named(value: str) -> tuple[str, str]:
        name, quote = pick(("token", "secret", "api_key", "password", "access_key", "auth_token", "TOKEN", "API_KEY", "client_secret")), pick(('"', "'", ""))
        return f"{prose(2)} {name}{pick((' = ', '=', ': '))}{quote}", quote + pick(("", "###", "!!", "$$$", ",", ";"))

    out = []
    for i in range(n):
        kind, path = i % 9, pick(("src/app.py", "config/prod.env", "src3", "web", "lib/client.js", "deploy/values.yaml", "tests/fixtures/a.txt", "docs/readme.md"))
        if kind < 3:
            value = chance(int(rng.choice([20, 24, 32, 40, 40, 48, 64])), pick(alphabets))
            before, after = named(value)
            out.append((value, before, after + " " + prose(2), path, 1))
        elif kind == 3:
            value = pick(("AKIA" + chance(16, alphabets[4]), "ghp_" + chance(36, alphabets[2]), "sk_live_" + chance(24, alphabets[2]), "AIza" + chance(35, alphabets[2])))
            out.append((value, prose(2) + pick((" ", ' "', "=")), pick((" ", '"')) + prose(2), path, 1))
        elif kind == 8:
            name = pick(("RSA ", "EC ", "OPENSSH ", ""))
            real = rng.random() < 0.6
            body = "\n".join(chance(64, alphabets[3]) for _ in range(int(rng.integers(2, 12)))) if real else pick(("...", "<your key here>", "example", "xxxx\nxxxx", prose(6), "key goes here"))
            out.append((f"-----BEGIN {name}PRIVATE KEY-----\n{body}\n-----END {name}PRIVATE KEY-----", prose(2) + pick((" ", "\n", ' = "')), pick(("\n", '"')) + prose(1), path, int(real)))
        elif kind == 4:
            value = pick(("your_api_key_here", "changeme123", "xxxxxxxxxxxxxxxx", "${API_TOKEN}", "<your-token>", "example_secret", "placeholder", "********", "password123", "1234567890", "process.env.TOKEN", "None,", "settings.token"))
            before, after = named(value)
            out.append((value, before, after, path, 0))
        elif kind == 5:
            value = chance(int(rng.choice([32, 40, 64])), alphabets[0])
            out.append((value, f"{prose(1)} {pick(('commit', 'sha1', 'sha256', 'md5', 'digest', 'etag', 'checksum'))}{pick((' ', ': ', '='))}", " " + prose(1), path, 0))
        elif kind == 6:
            value = "".join(pick(syllables) for _ in range(int(rng.integers(5, 14)))) + pick(("", "2", "01", "_1"))
            out.append((value, prose(2) + " ", " " + prose(2), path, 0))
        else:
            value = pick(("-", "_", "/")).join(prose(1) for _ in range(int(rng.integers(3, 7)))) + pick(("", "-2", "/2024", "1"))
            before, after = named(value) if rng.random() < 0.4 else (prose(2) + " ", " " + prose(1))
            out.append((value, before, after, path, 0))
    return out


class Forest:
    """Bagged binary trees on Gini impurity, with a random subset of features at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], depth, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
        p = y.mean() if len(y) else 0.5
        if depth == 0 or len(y) < 6 or p in (0.0, 1.0):
            return float(p)
        best = (2 * p * (1 - p) - 1e-6, None, None)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]) + 1)), replace=False):
            for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 13))):
                left = x[:, f] <= t
                n = left.sum()
                if 2 < n < len(y) - 2:
                    a, b = y[left].mean(), y[~left].mean()
                    impurity = (n * 2 * a * (1 - a) + (len(y) - n) * 2 * b * (1 - b)) / len(y)
                    if impurity < best[0]:
                        best = (impurity, f, t)
        if best[1] is None:
            return float(p)
        left = x[:, best[1]] <= best[2]
        return int(best[1]), float(best[2]), self._grow(x[left], y[left], depth - 1, rng), self._grow(x[~left], y[~left], depth - 1, rng)

    def score(self, row: Sequence[float]) -> float:
        total = 0.0
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.trees)


class Detector(NamedTuple):
    """What judges candidates: a forest, and the language and the neighbouring words that it learned with."""

    forest: Forest
    known: Language
    beside: Neighbours

    def score(self, candidate: str, before: str, after: str, path: str) -> float:
        return self.forest.score(describe(candidate, before, after, self.known) + self.beside.features(before, after, path))


def train(known: Language, findings: Sequence[Finding] | None = None) -> Detector:
    """A detector from labelled findings, by default from made ones."""
    rows = example_findings() if findings is None else findings
    # what a finding's neighbours say comes from the findings of the other folds, for its own label is in its own
    others = [Neighbours([r for i, r in enumerate(rows) if i % FOLDS != fold]) for fold in range(FOLDS)]
    x = np.array([describe(c, b, a, known) + others[i % FOLDS].features(b, a, p) for i, (c, b, a, p, _) in enumerate(rows)])
    return Detector(Forest(x, np.array([r[4] for r in rows], float)), known, Neighbours(rows))


def held_out(known: Language, findings: Sequence[Finding]) -> tuple[float, float]:
    """(precision, recall) on every fifth finding of a detector that has learned from the others."""
    detector = train(known, [f for i, f in enumerate(findings) if i % 5])
    rows = [(detector.score(*f[:4]) >= CUT, f[4] == 1) for f in findings[::5]]
    right = sum(p and y for p, y in rows)
    return right / max(1, sum(p for p, _ in rows)), right / max(1, sum(y for _, y in rows))


def settled(scored: Sequence[tuple[Candidate, float]]) -> list[tuple[Candidate, float]]:
    """One finding for each place, from judged candidates by start."""
    found: list[tuple[Candidate, float]] = []
    for c, score in scored:
        if score < CUT:
            continue
        if found and c.start < found[-1][0].end:
            last, best = found[-1]
            kind, best = (c.kind, score) if score > best else (last.kind, best)
            found[-1] = Candidate(last.start, max(last.end, c.end), kind), best
        else:
            found.append((c, score))
    out: list[tuple[Candidate, float]] = []
    at, free = 0, 0
    for c, score in scored:
        while at < len(found) and found[at][0].end <= c.start:
            at += 1
        if score < CUT and c.start >= free and (at == len(found) or found[at][0].start >= c.end):
            out.append((c, score))
            free = c.end
    return sorted(found + out)


def judged(text: str, path: str, detector: Detector) -> list[tuple[Candidate, float]]:
    return settled([(c, detector.score(text[c.start : c.end], text[max(0, c.start - CONTEXT) : c.start], text[c.end : c.end + CONTEXT], path)) for c in candidates(text)])


def scan(docs: DataFrame, path: str | None = None, detector: Detector | None = None) -> DataFrame:
    """doc_id, start, end, kind, score, is_secret for every finding in docs (doc_id, text, and a path column);
    without a detector, one is trained with the language of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(detector or train(language(docs)))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, text, at in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("_path"), strict=True):
                for c, score in judged(text.as_py(), at.as_py(), shared.value):
                    for col, v in zip(cols, (doc_id, c.start, c.end, c.kind, score, score >= CUT), strict=True):
                        col.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "end", "kind", "score", "is_secret"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", where.alias("_path")).where(F.rlike("text", F.lit(_MAYBE)))
    return some.mapInArrow(run, "doc_id long, start long, end long, kind string, score double, is_secret boolean")


def redacted(docs: DataFrame, path: str | None = None, detector: Detector | None = None) -> Column:
    """``text`` with every secret replaced by a mask; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(detector or train(language(docs)))

    def clean(text: str, at: str) -> str:
        out, last = [], 0
        for c, score in judged(text, at, shared.value):
            if score >= CUT:
                out += [text[last : c.start], MASK]
                last = c.end
        return "".join([*out, text[last:]]) if out else text

    @F.pandas_udf("string")
    def mask(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([clean(t, p) for t, p in zip(texts, paths, strict=True)], dtype=object)

    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    maybe = F.coalesce(F.rlike("text", F.lit(_MAYBE)), F.lit(False))
    return F.when(maybe, mask(F.when(maybe, F.col("text")).otherwise(""), where)).otherwise(F.col("text"))
