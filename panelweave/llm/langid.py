"""Language identification by mixture inference over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed byte trigrams; labelled documents learned from, about; additive smoothing.
BUCKETS, MAX_TRAIN, SMOOTHING = 1 << 14, 6000, 0.5
#: Steps of expectation-maximisation, documents worked on at once, and the n-grams that count as one observation:
#: neighbouring trigrams overlap in all but one byte.
STEPS, BLOCK, OVERLAP = 12, 64, 3
UNKNOWN = "und"
#: Parts into which the training sample is dealt for counting, whatever its languages.
PARTS = 64


@dataclass(frozen=True)
class Model:
    """Languages and, by bucket and language, the probability of an n-gram."""

    langs: list[str]
    p: np.ndarray


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def _buckets(text: str) -> np.ndarray:
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint32)
    grams = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _part(sizes: list[int], most: int) -> float:
    """The number of rows of each group, or all of a smaller one, that make up ``most`` rows."""
    left = float(most)
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) >= left:
            return left / (len(sizes) - k)
        left -= n
    return float(max(sizes, default=0))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Learn from text and non-null language of about ``max_train`` documents, a sample by a hash of id and text.

    Languages have equal parts of the sample; one with fewer rows than its part gives all and leaves the rest to the
    others, so that rare languages are learned at every size. A row is taken if its hash lies under its language's bound:
    no sorting, and texts stay where they are read until n-grams are counted on Spark. Only sparse counts come to the driver. Without a usable row there are no languages, and every document is unknown.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    part = _part(list(sizes.values()), max_train)
    bounds = docs.sparkSession.createDataFrame([(k, int(min(1.0, part / n) * (1 << 30))) for k, n in sizes.items()], "lang string, bound long")
    some = usable.join(F.broadcast(bounds), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("bound")).drop("bound")
    some = some.dropDuplicates(["lang", "h"])  # rows that repeat count once, so the sample stays small

    def count(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, own in part.groupby("lang"):
            total = np.zeros(BUCKETS, np.int64)
            for text in own.text:
                total += np.bincount(_buckets(text), minlength=BUCKETS)
            at = np.flatnonzero(total)
            out.append((lang, at.astype(np.int32), total[at]))
        return pd.DataFrame(out, columns=["lang", "at", "n"])

    rows = some.groupBy(F.pmod("h", F.lit(PARTS)).alias("part")).applyInPandas(count, "lang string, at array<int>, n array<long>").collect()
    langs = sorted({r.lang for r in rows})
    column = {lang: k for k, lang in enumerate(langs)}
    n = np.full((BUCKETS, len(langs)), SMOOTHING)
    for r in rows:
        n[np.array(r["at"]), column[r.lang]] += r.n
    return Model(langs, (n / n.sum(axis=0)).astype(np.float32))


def _shares(p: np.ndarray, n: np.ndarray, starts: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood shares of the allowed languages, and the log-likelihood, of each document of a block."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(STEPS):
        joint = p * share[owner]
        joint *= (n / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total
    return share, np.add.reduceat(n * np.log((p * share[owner]).sum(axis=1)), starts)


def infer(model: Model, texts: list[str]) -> np.ndarray:
    """Shares of the languages in each text; languages outside the selected set have share zero.

    Starting from all languages, the set that maximises log-likelihood minus half the logarithm of the number of
    observations for each language after the first is chosen among the nested sets of largest shares.
    """
    grams, counts = [], []
    for text in texts:
        full = np.bincount(_buckets(text), minlength=BUCKETS)
        at = np.flatnonzero(full)
        grams.append(at)
        counts.append(full[at])
    sizes = np.array([len(g) for g in grams])
    starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(texts)), sizes)
    p, n = model.p[np.concatenate(grams)], np.concatenate(counts).astype(np.float32) / OVERLAP
    k = len(model.langs)
    alone = np.add.reduceat(np.log(p) * n[:, None], starts, axis=0)
    price = np.log(np.maximum(np.add.reduceat(n, starts), 2)) / 2
    best, value = np.eye(k, dtype=np.float32)[alone.argmax(axis=1)], alone.max(axis=1)
    if k == 1:
        return best
    full, likely = _shares(p, n, starts, owner, np.ones((len(texts), k), np.float32))
    rank = (-full).argsort(axis=1, kind="stable").argsort(axis=1)
    open_ = np.flatnonzero(likely - price > value)  # else no larger set can pay for itself
    for size in range(2, k + 1):
        if not len(open_):
            break
        rows = np.isin(owner, open_)
        new_owner = np.searchsorted(open_, owner[rows])
        new_starts = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
        share, score = _shares(p[rows], n[rows], new_starts, new_owner, (rank[open_] < size).astype(np.float32))
        score = score - (size - 1) * price[open_]
        better = score > value[open_]
        best[open_[better]], value[open_[better]] = share[better], score[better]
        open_ = open_[likely[open_] - size * price[open_] > value[open_]]
    return best


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score, languages)`` for each row of ``docs``.

    ``lang_pred`` has the largest share of the text's n-grams, ties going to the first by name; ``score`` is that share;
    ``languages`` lists the selected (lang, share). Null texts and texts without a letter give ``und``, 0 and no
    languages, as does every text under a model without languages. Texts are read whole; the model is broadcast
    (``BUCKETS`` numbers for each language).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                texts = part.column(1).to_pylist()
                real = [i for i, t in enumerate(texts) if t and known.langs and any(map(str.isalpha, t))]
                pred, score, sets = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                for i, share in zip(real, infer(known, [texts[i] for i in real]) if real else [], strict=True):
                    pred[i], score[i] = known.langs[int(share.argmax())], min(1.0, float(share.max()))
                    sets[i] = [{"lang": known.langs[j], "share": float(share[j])} for j in np.flatnonzero(share > 0)]
                kinds = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kinds)], names=["id", "lang_pred", "score", "languages"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.4, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a language whose share is ``least`` or more, columns as given; a null language is filled in.

    Texts without a letter, null texts and texts without a leading language go.
    """
    at, lang, schema = docs.columns.index(text_col), docs.columns.index(lang_col), docs.schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                texts, langs = part.column(at).to_pylist(), part.column(lang).to_pylist()
                real = [i for i, t in enumerate(texts) if t and known.langs and any(map(str.isalpha, t))]
                kept = [False] * len(texts)
                for i, share in zip(real, infer(known, [texts[i] for i in real]) if real else [], strict=True):
                    kept[i] = float(share.max()) >= least
                    langs[i] = langs[i] if langs[i] is not None else known.langs[int(share.argmax())]
                columns = [pa.array(langs, c.type) if k == lang else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)
