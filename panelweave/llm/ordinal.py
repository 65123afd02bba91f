"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed features; rated documents learned from, about; full-batch steps, step size, ridge.
DIMS, MAX_TRAIN, STEPS, RATE, RIDGE = 1 << 16, 8000, 200, 0.05, 2e-3
#: Features in fewer of the documents learned from keep weight zero.
MIN_DOCS = 8
PUNCTUATION = ".,;:!?()[]\"'%*$#&|<>"
#: Words that a Python worker remembers the bucket of.
CACHE_WORDS = 200_000


@dataclass(frozen=True)
class Model:
    """Weights by feature and increasing thresholds between the grades 0, 1, ..., one threshold fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray


class _Buckets(dict):
    """Buckets of a word: of what is between its punctuation, and of the punctuation at its end."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        core, end = word.strip(PUNCTUATION), word[len(word.rstrip(PUNCTUATION)) :]
        buckets = tuple(zlib.crc32(x.encode()) % DIMS for x in (core, "end " + end) if x not in ("", "end "))
        if len(self) < CACHE_WORDS and len(word) <= 40:
            self[word] = buckets
        return buckets


def features(text: str | None, buckets: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the words of a text, lower-cased, with one plus the logarithm of their counts.

    One more bucket tells the tenth in which the share of distinct words lies.
    """
    words = (text or "").lower().split()
    tenth = zlib.crc32(f"distinct {10 * len(set(words)) // len(words)}".encode()) % DIMS if words else zlib.crc32(b"empty") % DIMS
    at, n = np.unique(np.fromiter(chain([tenth], chain.from_iterable(map(buckets.__getitem__, words))), np.int64), return_counts=True)
    return at, 1 + np.log(n.astype(np.float64))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def tails(model: Model, margin: np.ndarray) -> np.ndarray:
    """P(grade >= 1), P(grade >= 2), ... for each margin."""
    return _sigmoid(margin[:, None] - model.thresholds[None, :])


def _cuts(params: np.ndarray) -> np.ndarray:
    """Thresholds from a start and the logarithms of the steps between them."""
    return np.concatenate([params[DIMS : DIMS + 1], np.exp(params[DIMS + 1 :])]).cumsum()


def _slope(params: np.ndarray, owner: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, grades: int) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with its ridge, and its gradient, over the sparse rows (owner, col, val)."""
    n, rows, w = len(grade), np.arange(len(grade)), params[:DIMS]
    margin = np.bincount(owner, w[col] * val, n)
    above = np.hstack([np.ones((n, 1)), _sigmoid(margin[:, None] - _cuts(params)), np.zeros((n, 1))])
    hi, lo = above[rows, grade], above[rows, grade + 1]  # P(>= g), P(>= g + 1)
    p = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / p, -lo * (1 - lo) / p
    d_margin = (d_hi + d_lo) / n
    d_cuts = np.zeros(grades + 1)
    np.add.at(d_cuts, grade, -d_hi / n)
    np.add.at(d_cuts, grade + 1, -d_lo / n)
    d_theta = d_cuts[1:grades][::-1].cumsum()[::-1].copy()
    d_theta[1:] *= np.exp(params[DIMS + 1 :])
    loss = -np.log(p).mean() + RIDGE / 2 * (w @ w)
    return loss, -np.concatenate([np.bincount(col, d_margin[owner] * val, DIMS) - RIDGE * w, d_theta])


def fit_rows(at: list[np.ndarray], x: list[np.ndarray], grade: np.ndarray, grades: int) -> Model:
    """Maximum penalised likelihood by Adam over all rows at once; thresholds stay ordered as a start and positive steps."""
    owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col, val = np.concatenate(at), np.concatenate(x)
    common = np.bincount(col, minlength=DIMS)[col] >= MIN_DOCS
    owner, col, val = owner[common], col[common], val[common]
    share = np.bincount(grade, minlength=grades) / len(grade)
    start = np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    base = np.maximum.accumulate(-np.log(start / (1 - start)))
    params = np.concatenate([np.zeros(DIMS), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        _, g = _slope(params, owner, col, val, grade, grades)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(params[:DIMS].astype(np.float32), _cuts(params))


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade: Column | str = "grade", max_train: int = MAX_TRAIN) -> Model:
    """Learn from the documents of ``ratings`` (id_col, grade 0, 1, ...), about ``max_train``, an even sample by a hash of the id.

    Null grades and documents without a rating are left out, and a document with several counts with the least. Text is
    hashed on Spark; the driver gets the bounded sample's sparse features. Without two grades the weights are zero.
    """
    rated = ratings.select(F.col(id_col).alias("id"), (F.col(grade) if isinstance(grade, str) else grade).cast("int").alias("grade"))
    rated = rated.where("id IS NOT NULL AND grade >= 0").groupBy("id").agg(F.min("grade").alias("grade"))
    bound = min(1.0, max_train / max(1, rated.count()))
    some = rated.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(bound * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(some, "id").dropDuplicates(["id"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Buckets()
        for part in parts:
            both = [features(t, buckets) for t in part.text]
            yield pd.DataFrame({"grade": part.grade, "at": [a.astype(np.int32).tobytes() for a, _ in both], "x": [x.astype(np.float32).tobytes() for _, x in both]})

    rows = sorted(texts.mapInPandas(run, "grade int, at binary, x binary").collect(), key=lambda r: (r.grade, bytes(r["at"]), bytes(r.x)))
    grades = max((r.grade for r in rows), default=0) + 1
    if len({r.grade for r in rows}) < 2:
        return Model(np.zeros(DIMS, np.float32), np.zeros(max(1, grades - 1)))
    at, x = [np.frombuffer(r["at"], np.int32) for r in rows], [np.frombuffer(r.x, np.float32) for r in rows]
    return fit_rows(at, x, np.array([r.grade for r in rows]), grades)


def grade_documents(docs: DataFrame, model: Model, least: int = 2, tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, expected_grade, tail_prob, kept)`` for each row of ``docs``.

    ``expected_grade`` is the mean grade, ``tail_prob`` the probability of a grade of ``least`` or more, and a row is
    kept from ``tail`` up. Null and empty texts have no words and get what the thresholds alone say. Texts are read
    whole; rows that repeat are graded each; other columns are not read. The model, of fixed size, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, buckets = sent.value, _Buckets()
        for batch in batches:
            margin = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                at, x = features(text.as_py(), buckets)
                margin[i] = known.weights[at] @ x
            above = tails(known, margin)
            top = above[:, least - 1] if least <= above.shape[1] else np.zeros(len(margin))
            top = top if least > 0 else np.ones(len(margin))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(top), pa.array(top >= tail)], names=["id", "expected_grade", "tail_prob", "kept"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, expected_grade double, tail_prob double, kept boolean")
    return out.withColumnRenamed("id", id_col)
