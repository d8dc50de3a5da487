r"""Line-first cleaning: rules judge every line, failed lines go, and a document that loses too much text goes whole.

A line is what \n separates; a word is a run of anything but the white space 0x20 and 0x09-0x0D. Lines without
words are neither judged nor counted. A line fails

* for punctuation, if it has more than one of the signs ``#*$%&|<>`` or of runs like ``!!`` for five words, or if
  it neither ends a sentence nor has one of ``.,;:!?`` for 25 words;
* for navigation, if at least two separators stand between its words, or it is a short one that begins with a
  word of menus and ends no sentence;
* for boilerplate, if it has a phrase of such, or repeats an earlier line of its text.

Rejected is a text that loses more than half of the characters of its words. Beside this verdict there
are base figures, and base rules that reject alone: too few words, or too many of them in 8-word windows that the text
has twice (compared by 64-bit hashes of the words as they are written).

Each text is judged in the row where it is; nothing is shuffled.

Edge cases: null and empty texts have no words and fail the base rules. Repeated rows are judged each. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.shelf import small_batches
from hunkwise.llm.textbits import Words, mix, runs

WINDOW = 8
#: Words below which a text fails, and words in repeated windows, of 100, beyond which it does.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Of 100 characters of words, those that a text may lose.
MOST_LOST = 50

SYMBOLS = "[#*$%&|<>]"
SHOUTS = "[!?]{2,}"
SENTENCE_MARKS = "[.,;:!?]"
#: A terminal mark, closing quotes and brackets, white space, the end.
SENTENCE_END = "[.!?:;…。！？][\"'”’»)\\]]*[ \\t-\\r]*$"
SEPARATORS = "[ \\t-\\r](?:[|»›·•>/]|->)(?:[ \\t-\\r]|$)"
MENU = "^[ \\t-\\r]*(?:home|menu|login|log|sign|search|next|previous|prev|back|skip|share|follow|contact|about|sitemap|top|more|read)(?:[ \\t-\\r]|$)"
MENU_WORDS = 6
BOILERPLATE = "all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses cookies|enable javascript|lorem ipsum|click here|subscribe to|newsletter|powered by|copyright ©|licensed under|released under"

_WORD = re.compile("[^ \\t-\\r]+")
_SYMBOLS, _SHOUTS, _MARKS, _END, _SEPARATORS, _MENU, _BOILERPLATE = map(re.compile, (SYMBOLS, SHOUTS, SENTENCE_MARKS, SENTENCE_END, SEPARATORS, MENU, BOILERPLATE))
_LOWER = {c: c + 32 for c in range(65, 91)}

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_failed_lines long, lost_chars long, base_failed boolean, kept boolean, clean_text string"


def line_fails(line: str, n_words: int, n_symbols: int, repeated: bool) -> bool:
    if repeated or 5 * n_symbols > n_words or 5 * len(_SHOUTS.findall(line)) > n_words:
        return True
    ends = _END.search(line) is not None
    if not ends and 25 * len(_MARKS.findall(line)) < n_words:
        return True
    if len(_SEPARATORS.findall(line)) >= 2:
        return True
    low = line.translate(_LOWER)
    return not ends and n_words <= MENU_WORDS and _MENU.search(low) is not None or _BOILERPLATE.search(low) is not None


class Judged(NamedTuple):
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_failed_lines: int
    lost_chars: int
    clean_text: str | None


def judge_lines(text: str | None) -> Judged:
    """The figures of a text's lines, and the text without those that fail."""
    if not text:
        return Judged(0, 0, 0, 0, 0, text)
    chars = symbols = repeats = failed = lost = 0
    seen: set[str] = set()
    kept = []
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if not words:
            kept.append(line)
            continue
        n, signs, repeated = sum(map(len, words)), len(_SYMBOLS.findall(line)), line in seen
        seen.add(line)
        chars, symbols, repeats = chars + n, symbols + signs, repeats + repeated
        if line_fails(line, len(words), signs, repeated):
            failed, lost = failed + 1, lost + n
        else:
            kept.append(line)
    return Judged(chars, symbols, repeats, failed, lost, "\n".join(kept))


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """For each document, its words in windows that it has twice or more."""
    at, hashes = words.ngrams(window)
    _, same, times = np.unique(mix(hashes ^ mix(words.doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = at[times[same] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return np.bincount(words.doc[np.cumsum(edge[:-1]) > 0], minlength=words.n_docs)


def clean(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Figures, verdicts and, with ``texts``, the cleaned text of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id")
            for lo, hi, data, offs in runs(column):
                words = Words(data, offs, "space", lower=False)
                n, again = np.diff(words.first), repeated_words(words)
                lines = [judge_lines(t) for t in column.slice(lo, hi - lo).to_pylist()]
                chars, symbols, repeats, failed, lost = (np.array(c, np.int64) for c in list(zip(*lines, strict=True))[:5])
                base = (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)
                kept = ~base & (100 * lost <= MOST_LOST * chars)
                out = pa.array([x.clean_text if texts else None for x in lines], pa.string())
                yield pa.record_batch([ids.slice(lo, hi - lo), *map(pa.array, (n, chars, symbols, repeats, again, failed, lost, base, kept)), out], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
