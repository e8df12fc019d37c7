"""Language identification: multinomial naive Bayes over hashed character n-grams.

`fit` counts hashed 1- to 3-grams of every labelled text in Spark (counts are combined
in each task, so a task sends at most `features` rows per language) and returns a
log-probability matrix of `languages x features`, which is what is broadcast.
`predict` scores whole texts in batches: one gather and one segmented sum per language.
What comes to the driver is languages x features counts, whatever the number of texts.

The score is the posterior of the language under the model. N-grams of one text are not
independent, so for whole texts it is nearly always close to 1; it ranks short texts.

Edge cases: a null text or one without a letter is `und` with score 0; rows with a
null language teach nothing; without any labelled row every text is `und`; equal
scores go to the language that sorts first; repeated rows are scored each; a very long
text is one batch of the work; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_LETTER = re.compile(r"[^\W\d_]")
_U = np.uint64


@dataclass(frozen=True)
class Model:
    """Languages in order and log probabilities; the last column is a silent feature."""

    languages: tuple[str, ...]
    matrix: np.ndarray
    prior: np.ndarray
    bits: int
    order: int


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def features(texts: list[str | None], bits: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram ids [order, positions] of lower-cased texts, and where each begins.

    Every text is followed by `order` separators, whose positions are silent.
    """
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    points = np.frombuffer(("\n" * order).join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes + order)[:-1]]).astype(np.int64)
    silent = np.zeros(len(points), bool)
    for j in range(order):
        silent[starts + sizes + j] = True
    out = np.empty((order, len(points)), np.int32)
    acc = np.zeros(len(points), np.uint64)
    for n in range(order):
        acc = acc * _U(0x9E3779B97F4A7C15)
        acc[: len(points) - n] += points[n:] + _U(1)
        out[n] = ((acc * _U(0xD6E8FEB86659FD93)) >> _U(64 - bits)).astype(np.int32)
    out[:, silent] = 1 << bits
    return out, starts


def fit(docs: DataFrame, bits: int = 16, order: int = 3, alpha: float = 0.5) -> Model:
    """Learn from rows (text, lang) of all documents with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        rows_of: dict[str, int] = {}
        for batch in slices(batches):
            texts, langs = batch.column(0).to_pylist(), np.asarray(batch.column(1).to_pylist(), object)
            ids, starts = features(texts, bits, order)
            of = np.repeat(np.arange(len(texts)), np.diff([*starts, ids.shape[1]]))
            for lang in set(langs):
                own = langs == lang
                rows_of[lang] = rows_of.get(lang, 0) + np.count_nonzero(own)
                total = totals.setdefault(lang, np.zeros(1 << bits, np.int64))
                total += np.bincount(ids[:, own[of]].ravel(), minlength=len(total) + 1)[:-1]
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            ids, n = np.append(at, 1 << bits).astype(np.int32), np.append(total[at], rows_of[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(ids), pa.array(n)], ["lang", "feature", "n"])

    taught = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    rows = taught.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    counts = np.zeros((len(languages), (1 << bits) + 1))
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        counts[k, own["feature"].to_numpy()] = own["n"].to_numpy()
    prior = counts[:, -1]
    counts = counts[:, :-1] + alpha
    matrix = np.zeros((len(languages), (1 << bits) + 1), np.float32)
    if languages:
        matrix[:, :-1] = np.log(counts / counts.sum(1, keepdims=True))
        prior = np.log(np.maximum(prior, 1) / max(prior.sum(), 1))
    return Model(languages, matrix, prior, bits, order)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang_pred, score); score is the posterior of the language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            lang, value = ["und"] * len(texts), np.zeros(len(texts))
            if m.languages:
                ids, starts = features(texts, m.bits, m.order)
                logs = np.empty((len(m.languages), len(texts)))
                for k, row in enumerate(m.matrix):
                    each = row[ids[0]].astype(np.float64)
                    for own in ids[1:]:
                        each += row[own]
                    logs[k] = np.add.reduceat(each, starts) + m.prior[k]
                best = logs.argmax(0)
                posterior = 1 / np.exp(logs - logs.max(0)).sum(0)
                for i, text in enumerate(texts):
                    if has_letter(text):
                        lang[i], value[i] = m.languages[best[i]], posterior[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(value)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")
