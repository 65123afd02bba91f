"""Line deduplication through a sharded minimal perfect hash."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.lineage import materialize

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: Keys of a shard at most on average, and the least number of shards.
SHARD_KEYS, MIN_SHARDS = 50_000, 64
#: A line that more than one in so many line rows is goes beside the shards, so there are fewer such lines than this.
HOT_LINES = 10_000
_NULL_ID = (1 << 63) - 1
_LEVELS, _LOAD = 40, 2.0


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64((level * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: cascaded bit arrays with rank, then a sorted rest."""

    def __init__(self, words: list[np.ndarray], rest: np.ndarray):
        self.words, self.rest, self.before, base = words, rest, [], 0
        for w in words:
            ones = np.bitwise_count(w).astype(np.int64)
            self.before.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
        self.base = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        words, left = [], keys
        for level in range(_LEVELS):
            if not len(left):
                break
            size = 64 * max(1, int(len(left) * _LOAD) // 64 + 1)
            at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(once, bitorder="little").view(np.uint64))
            left = left[~once[at]]
        return cls(words, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; other keys get -1 or the number of some key."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.words, self.before, strict=True)):
            if not len(todo):
                return out
            at = _mix(keys[todo], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = words[word]
            hit = (found >> bit) & np.uint64(1) == 1
            below = found & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = before[word[hit]] + np.bitwise_count(below[hit])
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.searchsorted(self.rest, keys[todo]).clip(max=len(self.rest) - 1)
            same = self.rest[at] == keys[todo]
            out[todo[same]] = self.base + at[same]
        return out


def _pack(high: np.ndarray, low: np.ndarray, first: np.ndarray, n: np.ndarray) -> bytes:
    """A shard: the hash over the high halves, and by its numbers fingerprint, first holder and holder count."""
    hashed = PerfectHash.build(high)
    order = np.argsort(hashed.index(high))
    out = io.BytesIO()
    np.savez(out, fingerprint=low[order], first=first[order], n=np.minimum(n[order], 2**31 - 1).astype(np.int32), rest=hashed.rest, **{f"w{i}": w for i, w in enumerate(hashed.words)})
    return out.getvalue()


def _unpack(blob: bytes) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
    x = np.load(io.BytesIO(blob))
    return PerfectHash([x[f"w{i}"] for i in range(len(x.files) - 4)], x["rest"]), x["fingerprint"], x["first"], x["n"]


def _keys(text: str | None, least: int) -> list[bytes | None]:
    """The key of each line, None for lines that are too short to count."""
    return [k.encode().lower() if len(k := line.strip(BLANKS)) >= least else None for line in (text or "").split("\n")]


def _hash_lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, high, low): the 128-bit hashes of the keys of a row's lines, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sizes, digests = [], []
            for text in batch.column(1):
                own = {k for k in _keys(text.as_py(), least) if k is not None}
                sizes.append(len(own))
                digests += map(xxh3_128_digest, own)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            for k in range(0, len(ids), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in (ids, both[:, 0].copy(), both[:, 1].copy())], names=["id", "high", "low"])

    return docs.mapInArrow(run, "id long, high long, low long")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(high, low, first, n): every distinct key by its hash, its smallest id and its rows; rows of one id alone count once."""
    found = lines.groupBy("high", "low").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    return found.select("high", "low", "first", F.when(F.col("first") < F.col("last"), F.col("n")).otherwise(1).cast("long").alias("n"))


def _build_shards(known: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): distinct high halves are hashed; keys that share one with another follow in a second blob."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        blobs = []
        while len(part):
            again = part.duplicated("high").to_numpy()
            own = part[~again]
            blobs.append(_pack(own.high.to_numpy().view(np.uint64), own.low.to_numpy(), own["first"].to_numpy(), own.n.to_numpy()))
            shard, part = int(part.shard.iloc[0]), part[again]
        return pd.DataFrame({"shard": shard, "blob": blobs})

    keyed = known.withColumn("shard", F.pmod("high", F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInPandas(build, "shard int, blob binary")


def _probe(lines: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(id, high): lines that an earlier document holds. Probes stream past the arrays of their shard, which come first.

    All shards together grow with the corpus, so no task holds them all: each is read by the one task that its probes go to.
    """
    asked = lines.select(F.pmod("high", F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), "id", "high", "low", F.lit(None).cast("binary").alias("blob"))
    none = F.lit(0).cast("long")
    arrays = index.select("shard", F.lit(0).alias("kind"), none.alias("id"), none.alias("high"), none.alias("low"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tables = None, []
        for batch in batches:
            shard, kind, ids, high, low = (batch.column(i).to_numpy() for i in range(5))
            new = np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])
            edges = np.flatnonzero(new).tolist()
            for a, b in zip(edges, [*edges[1:], len(shard)], strict=True):
                if shard[a] != at:
                    at, tables = shard[a], []
                if kind[a] == 0:
                    tables += [_unpack(batch.column(5)[k].as_py()) for k in range(a, b)]
                    continue
                drop = np.zeros(b - a, bool)
                for hashed, fingerprint, first, count in tables:
                    k = hashed.index(high[a:b].view(np.uint64))
                    drop |= (k >= 0) & (fingerprint[k] == low[a:b]) & (count[k] >= 2) & (first[k] < ids[a:b])
                if drop.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][drop]), pa.array(high[a:b][drop])], names=["id", "high"])

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.unionByName(arrays).repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "id long, high long")


def dropped_lines(lines: DataFrame, hot_lines: int = HOT_LINES) -> DataFrame:
    """(id, high): the lines of (id, high, low) that go, each once for a row.

    The perfect hash is over all distinct lines. Rows of lines that make up more than one in ``hot_lines`` of all rows do
    not travel: such lines are fewer than ``hot_lines``, and their first holders are broadcast.
    """
    known = materialize(distinct_lines(lines), "distinct-lines")
    sums = known.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    hot = F.broadcast(known.where(F.col("n") * hot_lines > F.lit(sums.rows or 0)).where("n >= 2").select("high", "low", "first"))  # under hot_lines rows
    shards = max(MIN_SHARDS, -(-sums.keys // SHARD_KEYS))
    index = materialize(_build_shards(known, shards), "line-index")
    rest = lines.join(hot, ["high", "low"], "left_anti").select("id", "high", "low")
    return lines.join(hot, ["high", "low"]).where("first < id").select("id", "high").unionByName(_probe(rest, index, shards))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, hot_lines: int = HOT_LINES) -> DataFrame:
    """``docs`` without repeated lines, and with ``n_lines`` (before) and ``n_dropped``.

    Lines are split at line feeds; a null or empty text is one empty line, and a null stays null. A line's key is the
    line without the blanks at its ends, A-Z lower-cased. Keys of ``min_chars`` code points or more that two documents
    or more hold lose all their lines except in the document of smallest id. Rows that repeat an id count as one
    document; a null id counts as the largest. Input columns named as an added one are replaced.
    """
    plain = docs.drop("n_lines", "n_dropped")
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    lines = materialize(_hash_lines(plain.select(own_id.alias("id"), F.col(text_col).cast("string").alias("text")), min_chars), "lines")
    dropped = dropped_lines(lines, hot_lines).groupBy("id").agg(F.collect_set("high").alias("_drop")).withColumnRenamed("id", "_id")
    at, n = plain.columns.index(text_col), len(plain.columns)
    schema = T.StructType([*plain.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts, counts, gone = [], [], []
            for text, drop in zip(batch.column(at), batch.column(n), strict=True):
                text, before = text.as_py(), 0
                lines = (text or "").split("\n")
                if drop.is_valid:
                    high = set(drop.values.to_pylist())
                    before = len(lines)
                    keys = _keys(text, min_chars)
                    lines = [x for x, k in zip(lines, keys, strict=True) if k is None or int.from_bytes(xxh3_128_digest(k)[:8], "little", signed=True) not in high]
                    text = "\n".join(lines)
                    before -= len(lines)
                texts.append(text)
                counts.append(len(lines) + before)
                gone.append(before)
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : n], pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    by_place = plain.withColumn(text_col, F.col(text_col).cast("string")).toDF(*[f"c{k}" for k in range(n)])  # names cannot clash
    beside = by_place.withColumn("_id", F.coalesce(F.col(f"c{plain.columns.index(id_col)}").cast("long"), F.lit(_NULL_ID)))
    return beside.join(dropped, "_id", "left").drop("_id").mapInArrow(run, schema)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, r.first IS NOT NULL AND r.first < k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
