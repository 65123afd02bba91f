"""Product-quantized codes of vectors: codebooks by exact integer rounds, nearest entries by slices of sorted coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.lineage import materialize
from panelweave.llm.groups import attach

#: Parts of a vector, entries of a codebook (64 at most: a mask is one word), rounds, and steps to a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that are coded at once.
BLOCK = 20_000


class Slices:
    """The nearest of up to 64 entries, exactly, for blocks of integer vectors.

    In each dimension the entries' coordinates stand sorted, and before each place stands the mask of the entries that
    come earlier. A vector's initial radius is its distance to the entry that is next to it in the dimension of the widest
    spread, so the nearest entry lies within the radius in every dimension. There, two binary searches cut a slice whose
    mask is the difference of two prefixes; the slices' masks, ANDed, are the candidates, and only these are measured.
    """

    def __init__(self, entries: np.ndarray):
        if not 1 <= len(entries) <= 64:
            raise ValueError("a codebook has 1 to 64 entries")
        self.entries = entries.astype(np.int64)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.coordinates = np.take_along_axis(self.entries, order, 0).T.copy()
        bits = np.left_shift(np.uint64(1), order.T.astype(np.uint64))
        none = np.zeros((len(bits), 1), np.uint64)
        self.prefix = np.concatenate([none, np.bitwise_or.accumulate(bits, axis=1)], axis=1)
        self.widest = int(np.argmax(self.coordinates[:, -1] - self.coordinates[:, 0]))
        self.order = order[:, self.widest]

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A bound of the distance to the nearest entry: the distance to one of them, rounded up."""
        line = self.coordinates[self.widest]
        beside = self.order[np.minimum(np.searchsorted(line, x[:, self.widest]), len(line) - 1)]
        return np.sqrt(((x - self.entries[beside]) ** 2).sum(1).astype(float)).astype(np.int64) + 2

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` in every dimension."""
        found = np.full(len(x), ~np.uint64(0))
        for j, line in enumerate(self.coordinates):
            low = np.searchsorted(line, x[:, j] - radius, "left")
            high = np.searchsorted(line, x[:, j] + radius, "right")
            found &= self.prefix[j][high] & ~self.prefix[j][low]
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row; of equal distances the lower index."""
        masks = self.candidates(x, self.radius(x))
        index, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(masks >> np.uint64(e) & np.uint64(1))
            distance = ((x[rows] - entry) ** 2).sum(1)
            closer = distance < best[rows]
            index[rows[closer]], best[rows[closer]] = e, distance[closer]
        return index, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def whole_steps(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, steps array<int>): vectors that are whole and finite, each component x as floor(scale x).

    Null and empty vectors, and vectors with null, NaN or infinite components, are dropped; so are those whose length
    is not that of the row with the smallest id. An error is raised where a component is so large that squared
    distances would not fit 64 bits.
    """
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    named = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = named.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", good))
    first = kept.select("id", F.size("v").alias("n")).orderBy(F.col("id").asc_nulls_last(), "n").limit(1).collect()
    dims = first[0].n if first else 1
    limit = isqrt(2**63 // dims) // 2 - 1
    too_large = F.raise_error(F.lit(f"a component is beyond {limit} steps")).cast("int")
    step = lambda x: F.when(F.abs(x * scale) < limit, F.floor(x * scale).cast("int")).otherwise(too_large)
    return kept.where(F.size("v") == dims).select("id", "label", F.transform("v", step).alias("steps"))


def _sums(steps: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, sums of the components) of what each entry of each part got: partial sums in tasks, one row an entry and place."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(book) for book in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(at, BLOCK), parts * width)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    index, _ = slices[p].nearest(own)
                    for e in np.unique(index):
                        count[p, e] += (mine := index == e).sum()
                        total[p, e] += own[mine].sum(0)
        part, entry, place = (a.ravel() for a in np.indices(books.shape))
        filled = np.repeat(count.ravel() > 0, width)
        columns = [part, entry, place, np.repeat(count.ravel(), width), total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c[filled].astype(np.int64)) for c in columns], names=["part", "entry", "place", "n", "total"])

    partial = steps.select("steps").mapInArrow(run, "part long, entry long, place long, n long, total long")
    rows = partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # as many as the codebooks have numbers
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in rows:
        found.setdefault((r.part, r.entry), (r.n, [0] * width))[1][r.place] = int(r.total)
    return found


def fit(steps: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width): from the rows with the smallest ids, ``rounds`` times the floored mean of what each entry got.

    Entries that got nothing stay. Fewer rows than ``entries`` give as many entries as there are rows; without rows there
    are none. Rows with equal ids start in the order of their components. Every round is a pass over all rows; codebooks
    are of fixed size, and only they and their sums reach the driver.
    """
    start = [r.steps for r in steps.orderBy(F.col("id").asc_nulls_last(), "steps").limit(entries).select("steps").collect()]
    if not start:
        return np.zeros((parts, 0, 0), np.int64)
    if len(start[0]) % parts:
        raise ValueError(f"vectors of {len(start[0])} components can't be cut into {parts} equal parts")
    books = np.array(start, np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for (p, e), (n, sums) in _sums(steps, books).items():
            books[p, e] = [s // n for s in sums]
    return books


def encode(steps: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error): index of the nearest entry of each part, two hex digits each, and the squared distances' sum."""
    parts, _, width = books.shape
    hexes = np.array([f"{e:02x}" for e in range(64)], "S2")
    fields = {f.name: f for f in steps.schema}
    schema = T.StructType([fields["id"], fields["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(book) for book in books]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                x = _matrix(rows.column(2), parts * width)
                found = [slices[p].nearest(x[:, p * width : (p + 1) * width]) for p in range(parts)]
                codes = hexes[np.stack([index for index, _ in found], 1)].view(f"S{2 * parts}").ravel()
                error = np.sum([distance for _, distance in found], axis=0)
                columns = [rows.column(0), rows.column(1), pa.array(codes.astype(str)), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return steps.select("id", "label", "steps").mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of the codebooks' components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) for every whole and finite vector.

    What is dropped is told at :func:`whole_steps`, how codebooks come about at :func:`fit`. ``label_error`` is the sum
    of the errors of all rows with the same label; null is a label. Rows that repeat an id are rows of their own. Other
    columns are not read. An empty table gives an empty result.
    """
    steps = materialize(whole_steps(vectors, id_col, vector_col, label_col, scale), "steps")
    books = fit(steps, parts, entries, rounds)
    if not books.size:
        coded = steps.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = materialize(encode(steps, books), "codes")
    labels = materialize(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "label-errors")
    total = labels.agg(F.sum("n")).first()[0] or 0
    found = attach(coded, labels, "label", total)
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """One round in SQL: every part to its nearest entry, then entries replaced by floored means."""
    return f"""
near{k} AS MATERIALIZED (SELECT vec_id, part, x, arg_min(entry, d * 100 + entry) AS entry, min(d) AS d FROM (
  SELECT a.vec_id, a.part, a.x, b.entry, list_sum(list_transform(range(1, len(a.x) + 1), lambda j: (a.x[j] - b.c[j]) * (a.x[j] - b.c[j])))::BIGINT AS d
  FROM cut a JOIN book{k} b ON a.part = b.part) GROUP BY ALL),
mean{k} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY j) AS c FROM (
  SELECT part, entry, j, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM (
    SELECT part, entry, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM near{k}) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry),"""


ORACLE_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS r(part)),
lead AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS MATERIALIZED (SELECT part, entry, x AS c FROM cut JOIN lead USING (vec_id)),
{"".join(_round(k) for k in range(ROUNDS + 1))}
told AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), told
"""
