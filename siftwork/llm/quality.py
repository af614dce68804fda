"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document gives a vector of statistics of its whole text, log-transformed. For each class the
mean and covariance come from moments summed over all labelled training rows; the covariance is
shrunk towards a multiple of the identity. A score is the logistic function of the difference of
the two log densities (squared Mahalanobis norms by Cholesky factors, inverted once) and log priors.

Defined cases:
- null and empty texts have statistics of zero and get a score like any other.
- training rows: those with label 0 or 1 whose crc32(doc_id as text) mod 4 is not 2; repeated label
  rows count once, null labels not at all. A null doc_id is not held out and has no label.
- without training rows of both classes the score is the share of label 1 (1 without any rows).
- repeated rows each get their score; an empty table gives an empty result.
- texts of any length are read whole, in stretches of bounded size.
- labels, lang, source, doc_id and other columns are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, read, ship
from .arrow import sliced, texts
from .words import SLICE, hashes, shingles, spans, stretches, text_hashes

ACCEPT = 0.7
SHRINKAGE = 0.05
SLOTS = 64

_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), "digit": b"0123456789",
    "point": b".,;:?'\"-()", "loud": b"!", "mark": b"#$%&*|~^<>{}[]=+/_@\\", "line": b"\n",
}
FEATURES = ("words", "word_length", "word_spread", "upper", "digit", "point", "loud", "mark", "marked_words", "loud_words", "capital_words", "line_words", "stop_words", "distinct", "repeated", "shingle_repeats", "long_words")


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_MASKS = {k: _mask(v) for k, v in _CLASS.items()}
_STOP = _mask(b".?!")


def _counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text: bytes, those of each class, words, their lengths and squares, and how many are of a kind."""
    n = len(off) - 1

    def per(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[off[1:]] - total[off[:-1]]).astype(float)

    s, e, doc = spans(data, off)
    length = (e - s).astype(float)
    last = data[e - 1] if len(e) else np.empty(0, np.uint8)
    first = data[s] if len(s) else np.empty(0, np.uint8)
    kinds = [_MASKS["mark"][last], last == 33, _MASKS["upper"][first], _STOP[last], length > 20]
    return np.column_stack([np.diff(off).astype(float), *(per(m[data]) for m in _MASKS.values()), *(np.bincount(doc, x, n) for x in (None, length, length**2)), *(np.bincount(doc[k], minlength=n) for k in kinds)]).astype(float)


def _long_counts(data: np.ndarray) -> np.ndarray:
    """_counts of one text of any length, a stretch at a time; a word longer than a stretch is one of its own."""
    total = 0.0
    for part in stretches(data):
        steps = [part[i : i + SLICE] for i in range(0, len(part), SLICE)]
        row = sum(_counts(x, np.array([0, len(x)]))[0] for x in steps)
        if len(steps) > 1:
            k = len(_MASKS) + 1
            row[k:] = [1, len(part), float(len(part)) ** 2, *_counts(np.append(part[:1], part[-1:]), np.array([0, 2]))[0][k + 3 : -1], 1]
        total = total + row
    return total


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text; data has at most SLICE bytes, or one text."""
    n = len(off) - 1
    if len(data) > SLICE:
        if n > 1:
            return np.concatenate([statistics(data[a:b], np.array([0, b - a])) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        counts, h = _long_counts(data)[None, :], text_hashes(data)
        doc = np.zeros(len(h), np.int64)
    else:
        counts = _counts(data, off)
        s, e, doc = spans(data, off)
        h = hashes(data, s, e)
    size, chars = counts[:, 0], dict(zip(_MASKS, counts[:, 1:].T, strict=False))
    words, total, squares, marked, loud, capital, stop, long = counts[:, len(_MASKS) + 1 :].T
    some = np.maximum(words, 1)
    mean = total / some
    spread = np.sqrt(np.maximum(squares / some - mean**2, 0))
    x, d = shingles(h, doc, n, 3)
    at_w, at_x = np.searchsorted(doc, np.arange(n + 1)), np.searchsorted(d, np.arange(n + 1))
    distinct, most, fresh = np.ones(n), np.zeros(n), np.ones(n)
    for i in range(n):
        own = h[at_w[i] : at_w[i + 1]]
        if len(own) > 1:
            own = np.sort(own)
            runs = np.diff(np.flatnonzero(np.append(np.insert(own[1:] != own[:-1], 0, True), True)))
            distinct[i], most[i] = np.log(len(runs)) / np.log(len(own)), runs.max() / len(own)
            own = np.sort(x[at_x[i] : at_x[i + 1]])
            fresh[i] = (np.count_nonzero(own[1:] != own[:-1]) + 1) / len(own)
    letters = np.maximum(chars["upper"] + chars["lower"], 1)
    rate = lambda v, by: np.log(v / np.maximum(by, 1) + 1e-3)
    return np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), rate(chars["upper"], letters), rate(chars["digit"], size), rate(chars["point"], size), rate(chars["loud"], size), rate(chars["mark"], size),
        np.log(marked / some + 1e-2), np.log(loud / some + 1e-2), np.log(capital / some + 1e-2), rate(chars["line"], words), np.log(stop / some + 1e-2),
        distinct, np.log(most + 1e-2), np.log(1.01 - fresh), np.log(long / some + 1e-2),
    ])


def _features(batches):
    for b in batches:
        for part in sliced(b, "text", SLICE):
            x = statistics(*texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_features, "doc_id long, x array<double>")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Means, inverted Cholesky factors, and the constants of the log densities of classes 0 and 1."""

    share: float
    means: list[np.ndarray] | None = None
    inverses: list[np.ndarray] | None = None
    logs: list[float] | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        z = (x - self.center) / self.scale
        logs = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.inverses, self.logs, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))


def _moments(batches):
    n, total, square = np.zeros(2), None, None
    for b in batches:
        x = np.asarray(b.column(0).values).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, len(FEATURES)))
        y = np.asarray(b.column(1)).astype(int)
        if total is None:
            total, square = np.zeros((2, x.shape[1])), np.zeros((2, x.shape[1], x.shape[1]))
        for c in (0, 1):
            own = x[y == c]
            n[c] += len(own)
            total[c] += own.sum(axis=0)
            square[c] += own.T @ own
    if total is not None:
        for c in (0, 1):
            yield pa.RecordBatch.from_pydict({"label": pa.array([c], pa.int32()), "slot": pa.array([int(n.sum()) % SLOTS], pa.int32()), "m": pa.array([[n[c], *total[c], *square[c].ravel()]], pa.list_(pa.float64()))})


def _summed(table: pa.Table) -> pa.Table:
    m = np.sum([np.asarray(x) for x in table.column("m").to_pylist()], axis=0)
    return pa.table({"label": table.column("label")[:1], "m": pa.array([m.tolist()], pa.list_(pa.float64()))})


def fit(vectors: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """The model of all labelled training rows; what reaches the driver is of fixed size."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("y IN (0, 1)").filter(~held_out()).dropDuplicates(["doc_id", "y"])
    rows = vectors.join(known, "doc_id").select("x", "y")
    parts = rows.mapInArrow(_moments, "label int, slot int, m array<double>").groupBy("label", "slot").applyInArrow(_summed, "label int, m array<double>")
    got: dict[int, np.ndarray] = {}
    for r in parts.collect():
        got[r.label] = got.get(r.label, 0) + np.array(r.m)
    n = [got[c][0] if c in got else 0 for c in (0, 1)]
    if not all(n):
        return Model(1.0 if not sum(n) else n[1] / sum(n))
    d = int(np.sqrt(len(got[0]) - 0.75) - 0.5)
    mean = [got[c][1 : d + 1] / n[c] for c in (0, 1)]
    cov = [got[c][d + 1 :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    # Scale by the spread of good documents.
    center, scale = mean[1], np.sqrt(np.maximum(np.diag(cov[1]), 1e-4))
    means, inverses, logs = [], [], []
    for c in (0, 1):
        v = cov[c] / np.outer(scale, scale)
        v = (1 - shrinkage) * v + (shrinkage * np.trace(v) / d + 1e-6) * np.eye(d)
        f = np.linalg.cholesky(v)
        means.append((mean[c] - center) / scale)
        inverses.append(np.linalg.inv(f))
        logs.append(np.log(n[c] / sum(n)) - np.log(np.diag(f)).sum())
    return Model(n[1] / sum(n), means, inverses, logs, center, scale)


def scores(vectors: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for b in batches:
            x = np.asarray(b.column(1).values).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return vectors.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    ship(spark)
    vectors = Scratch(spark, "quality").table(features(docs), "features")
    out = scores(vectors, fit(vectors, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """docs without the rows whose score is below `accept`; columns stay, and no row is shuffled."""
    ship(spark)
    work = Scratch(spark, "quality")
    vectors = work.table(features(docs), "features")
    model = fit(vectors, labels)
    work.drop(vectors)

    def run(batches):
        for b in batches:
            for part in sliced(b, "text", SLICE):
                yield part.filter(pa.array(model.score(statistics(*texts(part.column("text")))) >= accept))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
