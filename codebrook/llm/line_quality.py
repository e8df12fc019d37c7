"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are binned measures of itself and of the
lines before and after it; a 2 x 2 table scores label pairs. Lines learn from the
label of their document. A document's quality is the mean of the forward-backward
marginals of its lines, weighted by length, put through a logistic calibration.

The field is fitted on a bounded sample of labelled rows: per label at most `sample`
documents, those with the smallest hash of the id, each with its whole text, as scores are
too, while their texts have at most `sample_bytes` bytes in all; one that does not fit is
passed over. Those ids are all that is broadcast.

Edge cases: a null or empty text is one empty line; documents without lines of words
get the score of an empty line; without labelled rows every score is 0.5; labels that
repeat a doc_id count once, with the lower quality; repeated documents, and equal texts,
get equal scores; a very long text is one slice of the work, and one that alone exceeds
`sample_bytes` teaches nothing, while the others do; an empty table gives an empty result; other columns stay,
but for one with the score's name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_words, slices, utf8

#: Documents a label, and bytes of their texts, that teach.
SAMPLE, SAMPLE_BYTES = 2000, 16 << 20
#: Upper edges of the bins of each measure.
EDGES = {
    "upper": (0.05, 0.1, 0.2, 0.4, 0.7),
    "symbols": (0.005, 0.02, 0.05, 0.1, 0.2),
    "digits": (0.02, 0.1, 0.2, 0.4),
    "adjacent": (0.02, 0.05, 0.1, 0.3, 0.6),
    "again": (0.1, 0.2, 0.3, 0.45, 0.6, 0.8),
    "letters": (0.4, 0.6, 0.7, 0.75, 0.8, 0.85),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "words": (0.5, 1.5, 3.5, 8.5, 20.5, 60.5, 150.5),
    "marks": (0.05, 0.15, 0.3, 0.6, 0.9),
}
WIDTH = sum(map(len, EDGES.values()))


def _class(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_UPPER = _class(bytes(range(65, 91)))
_ALPHA = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100)))
_DIGIT = _class(b"0123456789")
_SYMBOL = _class(b"#*$%&|<>@^~_=+\\/[]{}")
_MARK = _class(b".,;:!?")


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binned measures [lines, WIDTH], characters of each line, first line of each text."""
    data, offsets = utf8(texts)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    first = np.arange(len(offsets)) + np.searchsorted(breaks, offsets)
    bounds = np.append(starts, len(data))
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds]).astype(np.float32)
    lines = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data.tobytes()))
    words, at = hash_words(lines)
    n_words = np.diff(at)
    of = np.repeat(np.arange(len(starts)), n_words)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((words, of))
    again = np.zeros(len(words), bool)
    again[1:] = (words[order][1:] == words[order][:-1]) & (of[order][1:] == of[order][:-1])
    per_line = lambda flags: np.bincount(of, flags, len(starts)).astype(np.float32)
    chars = count((data & 0xC0) != 0x80)
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    alpha = count(_ALPHA[data])
    measures = {
        "upper": count(_UPPER[data]) / np.maximum(alpha, 1), "symbols": count(_SYMBOL[data]) / c, "digits": count(_DIGIT[data]) / c,
        "adjacent": per_line(same) / w, "again": per_line(again) / w, "letters": alpha / c,
        "word_length": (alpha + count(_DIGIT[data])) / w, "words": n_words.astype(np.float32), "marks": count(_MARK[data]) / w,
    }
    return np.concatenate([measures[k][:, None] > np.asarray(v, np.float32) for k, v in EDGES.items()], 1), chars, first


def emissions(x: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of good over bad for every line, from it and its neighbours in the text."""
    own, before, after = weights[:WIDTH], weights[WIDTH : 2 * WIDTH], weights[2 * WIDTH : 3 * WIDTH]
    x = x.astype(np.float32)
    e = x @ own + weights[-1]
    inner = np.ones(len(x) + 1, bool)
    inner[first] = False
    e[1:] += np.where(inner[1:-1], (x @ before)[:-1], 0)
    e[:-1] += np.where(inner[1:-1], (x @ after)[1:], 0)
    return e


def forward_backward(e: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good from the lines up to each one, and from those after it.

    All texts advance together, longest first, so step k touches those with a line k.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    many = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    d, b = e.astype(np.float64).copy(), np.zeros(len(e))
    for k in range(1, len(many)):
        at = begin[: many[k]] + k
        d[at] += np.logaddexp(t[0, 1], d[at - 1] + t[1, 1]) - np.logaddexp(t[0, 0], d[at - 1] + t[1, 0])
    for k in range(len(many) - 1, 0, -1):
        at = begin[: many[k]] + k
        u = e[at] + b[at]
        b[at - 1] = np.logaddexp(t[1, 0], t[1, 1] + u) - np.logaddexp(t[0, 0], t[0, 1] + u)
    return d, b


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(z / 2))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    pairs: np.ndarray
    slope: float
    shift: float

    def quality(self, texts: pa.Array) -> np.ndarray:
        """Mean good marginal of each text's lines, weighted by their characters."""
        x, chars, first = line_features(texts)
        return self.of(x, chars, first)

    def of(self, x: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = emissions(x, first, self.weights)
        d, b = forward_backward(e, first, self.pairs)
        weight = np.maximum(chars, 1e-3)
        total = lambda v: np.add.reduceat(v, first[:-1])
        return total(weight * _sigmoid(d + b)) / total(weight)

    def score(self, quality: np.ndarray) -> np.ndarray:
        q = np.clip(quality, 1e-6, 1 - 1e-6)
        return _sigmoid(self.slope * np.log(q / (1 - q)) + self.shift)


def train(x: np.ndarray, chars: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 120, l2: float = 1e-3) -> Model:
    """Maximum likelihood by Adam on the sample's lines, then a logistic calibration."""
    size = np.diff(first)
    y = np.repeat(label, size).astype(np.float64)
    theta = np.zeros(3 * WIDTH + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    xf = x.astype(np.float32)
    # both labels and all lengths of text weigh alike
    share = np.repeat(np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1)) / size, size)
    for step in range(1, rounds + 1):
        weights, t = theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2)
        e = emissions(x, first, weights)
        d, b = forward_backward(e, first, t)
        g = (y - _sigmoid(d + b)) * share
        gf = g.astype(np.float32)
        before, after = np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32)
        if len(at):
            before, after = xf[at - 1].T @ gf[at], xf[at].T @ gf[at - 1]
        grad = np.concatenate([xf.T @ gf, before, after, [g.sum()], np.zeros(4)])
        if len(at):
            z = np.stack([np.zeros(len(at)) + t[0, 0], t[0, 1] + e[at] + b[at], d[at - 1] + t[1, 0], d[at - 1] + t[1, 1] + e[at] + b[at]])
            p = np.exp(z - z.max(0))
            p /= p.sum(0)
            seen = np.stack([1 - y[at], 0 * at, 0 * at, y[at]])
            grad[-4:] = ((seen - p) * share[at]).sum(1)
        grad -= l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2), 1.0, 0.0)
    q = np.clip(model.of(x, chars, first), 1e-6, 1 - 1e-6)
    z, a = np.log(q / (1 - q)), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(a[0] * z + a[1])
        h = p * (1 - p) + 1e-6
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-2]])
        a = a + np.linalg.solve(hess, [((label - p) * z).sum() - 1e-2 * a[0], (label - p).sum() - 1e-2 * a[1]])
    return Model(model.weights, model.pairs, float(a[0]), float(a[1]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit on (doc_id, text) and (doc_id, quality); None without labels of both kinds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = pick(0).unionByName(pick(1))
    sizes = docs.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.sum("n").alias("n"))
    # one row a chosen document: at most two times `sample` in all
    left, chosen = {0: sample_bytes, 1: sample_bytes}, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if (r["n"] or 0) <= left[r["quality"]]:
            left[r["quality"]] -= r["n"] or 0
            chosen.append((r["doc_id"], r["quality"]))
    taught = docs.sparkSession.createDataFrame(chosen, ids.schema)
    taught = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, chars, first = line_features(batch.column(0))
            rows = [(int(q), x[a:b].tobytes(), chars[a:b].tobytes()) for q, a, b in zip(batch.column(1).to_pylist(), first, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["quality", "x", "chars"])

    rows = taught.select("text", "quality").mapInArrow(measured, "quality int, x binary, chars binary").toPandas()
    if rows["quality"].nunique() < 2:
        return None
    x = np.frombuffer(b"".join(rows["x"]), bool).reshape(-1, WIDTH)
    first = np.concatenate([[0], np.cumsum([len(r) // WIDTH for r in rows["x"]])])
    return train(x, np.frombuffer(b"".join(rows["chars"]), np.float32), first, rows["quality"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """All columns of `docs` and the score of the whole text; 0.5 without a model."""
    if model is None:
        return docs.withColumn(column, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            value = m.score(m.quality(batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value.astype(np.float64))], [*batch.schema.names, column])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
