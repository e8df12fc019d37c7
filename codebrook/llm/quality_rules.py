"""Quality rules on repetition, by suffix arrays of words.

For each slice of documents one suffix array is built over all their words by prefix
doubling; words of different documents never compare equal. Longest common prefixes
of neighbours in the array give, for every word, the longest repeated run that starts
there; runs of at least `window` words are the maximal repeats, and the union of
their spans is what a document repeats.

Edge cases: a null or empty text has no words and fails; a document shorter than
`window` repeats nothing; overlapping repeats count each word once; of repeats of one
length each counts; repeated rows, and those without a doc_id, are measured each; a very
long text is one slice; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, hash_words, mix, slices, utf8

#: Fixed values of the rules: symbols that count, ASCII white space around words.
SYMBOLS = b"#*$%&|<>"
BLANK = " \t\n\r\x0b\x0c"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def longest_repeats(words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each word, the longest run from it on that its document has elsewhere too.

    Runs under `least` words count as 0.
    """
    n, out = len(words), np.zeros(len(words), np.int64)
    if n == 0:
        return out
    _, kind, size = np.unique(words ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[kind]
    levels, step, active = [rank], 1, np.flatnonzero(size[kind] > 1)
    while len(active):
        after = np.minimum(active + step, n - 1)
        inside = (active + step < n) & (doc[after] == doc[active])
        first, second = rank[active], np.where(inside, rank[after], -1)
        order = np.lexsort((second, first))
        active, first, second = active[order], first[order], second[order]
        new_first = np.append(True, first[1:] != first[:-1])
        new = new_first | np.append(True, second[1:] != second[:-1])
        at = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[active] = first + begin - np.maximum.accumulate(np.where(new_first, at, 0))
        levels.append(rank)
        step *= 2
        group = np.cumsum(new) - 1
        active = active[np.bincount(group)[group] > 1]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    deep = min(least.bit_length() - 1, len(levels) - 1)
    near = levels[deep][a] == levels[deep][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        same = (a + common < n) & (b + common < n) & (doc[x] == doc[a]) & (doc[y] == doc[b]) & (levels[k][x] == levels[k][y])
        common += np.where(same, 1 << k, 0)
    long = common >= least
    np.maximum.at(out, a[long], common[long])
    np.maximum.at(out, b[long], common[long])
    return out


def repeated_spans(words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie in a repeated run, and the longest run from each word."""
    runs = longest_repeats(words, doc, least)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(runs)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + runs[at], -1)
    return np.cumsum(edge[:-1]) > 0, runs


def measure(docs: DataFrame, window: int = 8) -> DataFrame:
    """Counts per document: words, characters, symbols, repeated lines and words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1)
            words, first = hash_words(texts)
            n_words = np.diff(first)
            covered, runs = repeated_spans(words, np.repeat(np.arange(len(n_words)), n_words), window)
            ends = np.concatenate([[0], np.cumsum(covered)])
            repeat = ends[first[1:]] - ends[first[:-1]]
            longest = np.zeros(len(n_words), np.int64)
            np.maximum.at(longest, np.repeat(np.arange(len(n_words)), n_words), runs)
            data, offsets = utf8(texts)
            count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            chars, symbols = count(((data & 0xC0) != 0x80) & ~_IS_SPACE[data]), count(_IS_SYMBOL[data])
            dup = []
            for text in texts.to_pylist():
                lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
                dup.append(len(lines) - len(set(lines)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(x, np.int64)) for x in (n_words, chars, symbols, dup, repeat, longest))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long")


def judge(measured: DataFrame, least_words: int = 20, covered_percent: int = 30, longest_percent: int = 12, longest_words: int = 16) -> DataFrame:
    """Add base_failed and kept; `kept` also limits the longest single repeat.

    It may not have `longest_words` words or more and be over `longest_percent` of the text:
    a passage that stands twice covers twice its share, so at half of `covered_percent` or
    more this rule would say nothing of its own.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > covered_percent * F.col("n_words"))
    long = (F.col("longest_repeat") >= longest_words) & (100 * F.col("longest_repeat") > longest_percent * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~long)
