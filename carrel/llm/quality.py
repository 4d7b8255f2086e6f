"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1, outside the held-out fold; unlabelled are any rows outside it. Labels 0 are not used.
The class prior p, the share of positives among the unlabelled, is estimated first. Then a linear model on style
features minimises the non-negative unbiased risk

    p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])

with the logistic loss l. Features come from the text alone, the whole of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrel.llm.common import crc_fold, shuffle_partitions, stored
from carrel.llm.words import word_hashes

#: Bounds of the rows that the model is fitted on; the rows with the least md5 of the id are taken.
MOST_POSITIVE, MOST_UNLABELLED = 10_000, 20_000
#: Classes of bytes. Letters, capitals, digits, blank, line feed, plain marks, loud marks, other marks, beyond ASCII, controls.
_CLASS = np.full(256, 9, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"()-", b"!?", b"#$%&*+/<=>@[]\\^_`{|}~", bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _k
N_CLASS, N_OTHER = 10, 10
N = N_CLASS * N_CLASS + N_OTHER


def features(text: str | None) -> np.ndarray:
    """Roots of the frequencies of pairs of byte classes, and ten figures of words and lines; all zero for no text."""
    out = np.zeros(N)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return out
    c = _CLASS[data]
    out[: N_CLASS * N_CLASS] = np.sqrt(np.bincount(c[:-1] * N_CLASS + c[1:], minlength=N_CLASS * N_CLASS) / max(1, len(c) - 1))
    words = word_hashes(text)
    n = len(words)
    letters = np.bincount(c, minlength=N_CLASS)
    lines = text.split("\n")
    rest = out[N_CLASS * N_CLASS :]
    rest[0] = np.log1p(n) / 10
    rest[1] = min(len(data) / max(n, 1), 30) / 10
    if n:
        _, counts = np.unique(words, return_counts=True)
        rest[2] = len(counts) / n
        rest[3] = counts.max() / n
        rest[4] = float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0
        rest[5] = float((counts[counts > 2].sum()) / n)
    rest[6] = letters[1] / max(1, letters[0] + letters[1])
    rest[7] = (letters[6] + letters[7]) / max(n, 1)
    rest[8] = 1 - len(set(lines)) / len(lines)
    rest[9] = np.log1p(len(data) / len(lines)) / 10
    np.minimum(rest, 5, out=rest)
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = _expand((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _expand(z: np.ndarray) -> np.ndarray:
    """Standard scores within 4, and how far each is above 1 in size: a linear model then sees outliers on either side."""
    z = np.clip(z, -4, 4)
    return np.concatenate((z, np.maximum(np.abs(z) - 1, 0)), axis=-1)


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _by_rows(x, w):
    """``x @ w`` in this thread alone: BLAS's threads only wait for one another where other work runs beside the driver."""
    return np.einsum("ij,j->i", x, w)


def _by_columns(v, x):
    return np.einsum("i,ij->j", v, x)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in ``u`` (expanded features with a last column of ones).

    A classifier tells ``p`` from ``u``. Above any threshold the share of ``u`` is at least the prior times that of ``p``, and near it
    where few negatives are above; so the least ratio of the two is taken, on rows that the classifier was not fitted on.
    """
    ratios = []
    for part in (0, 1):
        a, b = p[part::2], u[part::2]

        def gradient(w, a=a, b=b):
            w = w.astype(np.float32)
            return -_by_columns(1 - _sigmoid(_by_rows(a, w)), a) / len(a) + _by_columns(_sigmoid(_by_rows(b, w)), b) / len(b) + 1e-3 * w

        w = _adam(gradient, p.shape[1], 150, 0.03)
        sp, su = np.sort(_by_rows(p[1 - part :: 2], w)), _by_rows(u[1 - part :: 2], w)
        if not len(sp) or not len(su):
            continue
        for q in np.linspace(0.02, 0.6, 30):
            t = sp[int(q * (len(sp) - 1))]
            ratios.append(((su >= t).mean() + 1 / len(su)) / ((sp >= t).mean()))
    return float(np.clip(min(ratios, default=0.5), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600, prior: float | None = None) -> Model:
    """Fits on feature rows. Without positives or unlabelled rows the model scores every text 0.5."""
    both = np.concatenate((positive, unlabelled)).astype(np.float64, copy=False) if len(positive) + len(unlabelled) else np.zeros((1, N))
    mean, scale = both.mean(0), both.std(0) + 1e-3
    del both
    if not len(positive) or not len(unlabelled):
        return Model(mean, scale, np.zeros(2 * N), 0.0, 0.5)

    def one(x):
        out = np.ones((len(x), 2 * N + 1), np.float32)
        for at in range(0, len(x), 2048):  # what is made on the way takes several times the memory
            out[at : at + 2048, :-1] = _expand((x[at : at + 2048] - mean) / scale)
        return out

    p, u = one(positive), one(unlabelled)
    pi = prior if prior is not None else estimate_prior(p, u)

    def gradient(w):
        w = w.astype(np.float32)
        zp, zu = _by_rows(p, w), _by_rows(u, w)
        # l(z) = log(1 + e^-z): dl(z)/dz = -s(-z), dl(-z)/dz = s(z)
        up = -pi * _by_columns(_sigmoid(-zp), p) / len(p)
        negative = np.logaddexp(0, zu).mean() - pi * np.logaddexp(0, zp).mean()
        down = _by_columns(_sigmoid(zu), u) / len(u) - pi * _by_columns(_sigmoid(zp), p) / len(p)
        # Where the estimated risk on negatives is below 0 the model overfits: step back on that part alone.
        return (up + down if negative >= 0 else -down) + 1e-3 * w

    w = _adam(gradient, 2 * N + 1, steps, 0.02)
    return Model(mean, scale, w[:-1], float(w[-1]), pi)


def _rows(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], np.float32).reshape(-1, N)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=[kind, "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fits the model on bounded samples, chosen by the md5 of doc_id, of the rows outside the held-out fold.

    A document counts as a trusted positive if all its labels are 1. Null labels and ids are not used. Of rows that share an id the least text
    alone is used, so the bounds hold whatever repeats.
    """
    by = F.md5(F.col("doc_id").cast("string").cast("binary"))
    learn = lambda df: df.where(F.col("doc_id").isNotNull() & (crc_fold() != 1))
    good = learn(labels.select("doc_id", "quality")).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1")
    good = good.select("doc_id", F.lit(1).alias("kind")).orderBy(by, "doc_id").limit(most_positive)
    some = learn(docs.select("doc_id")).distinct().select("doc_id", F.lit(0).alias("kind")).orderBy(by, "doc_id").limit(most_unlabelled)
    # At most most_positive + most_unlabelled ids, each once in either kind, and one text for each: small at any input size.
    ids = stored(good.unionByName(some), "quality-ids")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")).repartition(shuffle_partitions(docs.sparkSession), "doc_id")
    x = texts.mapInArrow(_rows("doc_id"), "doc_id long, x array<float>")
    got = x.join(F.broadcast(ids), "doc_id").orderBy("kind", "doc_id").select("kind", "x").toArrow()
    kind, x = got.column("kind").to_numpy(), got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N) if got.num_rows else np.zeros((0, N), np.float32)
    positive, unlabelled = x[kind == 1], x[kind == 0]
    del got, x
    pa.default_memory_pool().release_unused()
    return fit(positive, unlabelled)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for each row; an empty or null text has all features 0 and gets a score too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, N)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be good, with all their columns."""

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t) for t in text]).reshape(-1, N)))

    return docs.where(score("text") >= 0.5)
