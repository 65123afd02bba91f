"""Monte-Carlo significance of synchronization against random events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelweave.config import SURROGATE_QUANTILE

# Multiplier, increment and modulus of the generator, and the two factors of its seeds.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2**31
SEED_A, SEED_B = 2654435769, 2246822519
#: Draws that a task makes, about, and draws of one side that it holds at once, if a surrogate has no more.
DRAWS_OF_TASK, BLOCK_DRAWS = 500_000, 1_000_000
_WORD = 2**64 - 1


def combinations(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ni, nj, c): event numbers ni <= nj that pairs of nodes can have, numbered from 1 in order within ``by``.

    From how many nodes have each number of events, (by, node_id, n), not from the pairs: a number goes with itself if two
    nodes have it. There are as many rows as pairs of distinct numbers; each distinct number carries the list of those
    from it on, and where its combinations begin is a sum over the numbers before it, so nothing is joined.
    """
    held = counts.groupBy(*by, "n").agg(F.count("*").alias("nodes"))
    order = Window.partitionBy(*by).orderBy("n")
    above = F.collect_list("n").over(order.rowsBetween(1, Window.unboundedFollowing))
    own = F.when(F.col("nodes") >= 2, F.array("n")).otherwise(F.slice(F.array("n"), 1, 0))
    listed = held.select(*by, F.col("n").alias("ni"), F.concat(own, above).alias("others"))
    before = F.sum(F.size("others")).over(Window.partitionBy(*by).orderBy("ni").rowsBetween(Window.unboundedPreceding, -1))
    placed = listed.select(*by, "ni", F.coalesce(before, F.lit(0)).alias("_before"), "others")
    met = placed.select(*by, "ni", "_before", F.posexplode("others").alias("_place", "nj"))
    return met.select(*by, "ni", "nj", (F.col("_before") + F.col("_place") + 1).cast("long").alias("c"))


def _jumps(most: int) -> list[tuple[int, int, int]]:
    """(k, a, b) such that k + 1 steps of the generator take a seed s to (a s + b) mod 2^31, for k up to ``most``."""
    rows, a, b = [], 1, 0
    for k in range(most + 2):
        rows.append((k - 1, a, b))
        a, b = a * MULTIPLIER % MODULUS, (b * MULTIPLIER + INCREMENT) % MODULUS
    return rows[2:]


def draws(combos: DataFrame, lengths: DataFrame | int, surrogates: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, c, s, side, k, day): the events of both sides of each combination and surrogate, drawn with replacement.

    The generator starts from a seed of combination and surrogate numbers; draw k jumps k + 1 steps from it at once. A
    day is the state modulo the length of the season, a number or the column ``season_length`` of a table keyed by
    columns of ``by``.
    """
    spark = combos.sparkSession
    most = combos.agg(F.max("nj")).first()[0] or 0
    sized = _sized(combos, lengths, by)
    runs = sized.withColumn("s", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(surrogates).cast("long"))))

    def seed(x: int, y: int) -> Column:
        return (F.col("c") * x).bitwiseXOR(F.col("s") * y).bitwiseAND(MODULUS - 1)

    sides = F.explode(F.array(F.struct(F.lit("i").alias("side"), F.col("ni").alias("n"), seed(SEED_A, SEED_B).alias("seed")), F.struct(F.lit("j").alias("side"), F.col("nj").alias("n"), seed(SEED_B, SEED_A).alias("seed"))))
    seeded = runs.withColumn("x", sides).select(*by, "c", "s", "season_length", "x.side", "x.seed", F.explode(F.sequence(F.lit(1), F.col("x.n").cast("int"))).alias("k"))
    state = F.pmod(F.col("a") * F.col("seed") + F.col("b"), F.lit(MODULUS))
    return seeded.join(F.broadcast(spark.createDataFrame(_jumps(most), "k int, a long, b long")), "k").select(*by, "c", "s", "side", "k", F.pmod(state, F.col("season_length")).alias("day"))


def _sized(combos: DataFrame, lengths: DataFrame | int, by: tuple[str, ...]) -> DataFrame:
    if isinstance(lengths, int):
        return combos.withColumn("season_length", F.lit(lengths).cast("long"))
    return combos.join(F.broadcast(lengths), [c for c in lengths.columns if c in by])  # a row for each season


def _days(c: int, n: int, length: int, numbers: np.ndarray, factors: tuple[int, int], jumps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(surrogates, n - 1): sorted days of one side without the least."""
    seeds = (np.uint64(c * factors[0] & _WORD) ^ numbers * np.uint64(factors[1])) & np.uint64(MODULUS - 1)
    states = (jumps[0][None, :n] * seeds[:, None] + jumps[1][None, :n]) & np.uint64(MODULUS - 1)
    return np.sort((states % np.uint64(length)).astype(np.int64), axis=1)[:, 1:]


def lag_counts(a: np.ndarray, b: np.ndarray, taus: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(total, diff), each (taus, surrogates): pairs nearer than tau, and by how many more of them come from one side.

    ``a`` and ``b`` have sorted rows. Rows are laid one behind the other, farther apart than any tau, so the two long
    sorted lists are merged at once, and each tau only moves the two outer ends of the stretch that is counted.
    """
    apart = np.arange(len(a), dtype=np.int64)[:, None] * (length + 2 * max(taus) + 1)
    x, y = (a + apart).ravel(), (b + apart).ravel()
    low, high = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    rows = lambda counts: counts.reshape(a.shape).sum(1)
    total, diff = [], []
    for tau in taus:
        begin, end = np.searchsorted(y, x - tau, "right"), np.searchsorted(y, x + tau, "left")
        total.append(rows(end - begin))
        diff.append(np.abs(rows(low - begin) - rows(end - high)))
    return np.array(total), np.array(diff)


def critical_values(
    counts: DataFrame, lengths: DataFrame | int, tau: int | Column, surrogates: int, by: tuple[str, ...] = (), quantile: float = SURROGATE_QUANTILE
) -> DataFrame:
    """(by, [tau], ni, nj, c, crit_sum, crit_diff): quantiles over surrogates of the sum and the absolute difference of the counts.

    ``counts`` has the event numbers of the valid nodes, (by, node_id, n). ``tau`` is a number of days, or an expression over
    columns of ``by`` that gives an array of them; then each tau of a combination is a row, from the same draws. As sum and
    difference are compared for equal event numbers, the common root is left out. The least day of either side is skipped, as
    the first event of a node is.

    A combination is one row and stays one: its draws are made, sorted, merged and ranked inside a task, in blocks of
    surrogates of bounded size, and only critical values come out. Combinations are dealt by the number of draws.
    """
    single = isinstance(tau, int)
    combos = _sized(combinations(counts, by), lengths, by).withColumn("taus", F.array(F.lit(tau)) if single else tau.cast("array<int>"))
    size = combos.agg(F.max("nj").alias("most"), (F.sum((F.col("ni") + F.col("nj")).cast("double")) * surrogates).alias("draws")).first()
    most, tasks = size.most or 0, max(1, int((size.draws or 0) // DRAWS_OF_TASK))
    steps = [*_jumps(most)]
    jumps = tuple(np.array([s[k] for s in steps], np.uint64) for k in (1, 2))
    own = [combos.schema[c] for c in by]
    out = T.StructType([*own, T.StructField("tau", T.IntegerType()), combos.schema["ni"], combos.schema["nj"], combos.schema["c"], T.StructField("crit_sum", T.DoubleType()), T.StructField("crit_diff", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                total, diff = [], []
                block = max(1, BLOCK_DRAWS // r["nj"])
                for s in range(1, surrogates + 1, block):
                    numbers = np.arange(s, min(s + block, surrogates + 1), dtype=np.uint64)
                    a = _days(r["c"], r["ni"], r["season_length"], numbers, (SEED_A, SEED_B), jumps)
                    b = _days(r["c"], r["nj"], r["season_length"], numbers, (SEED_B, SEED_A), jumps)
                    t, d = lag_counts(a, b, r["taus"], r["season_length"])
                    total.append(t)
                    diff.append(d)
                sums, diffs = (np.percentile(np.concatenate(x, 1), 100 * quantile, axis=1) for x in (total, diff))
                found += [{**r, "tau": tau, "crit_sum": float(x), "crit_diff": float(y)} for tau, x, y in zip(r["taus"], sums, diffs, strict=True)]
            yield pa.RecordBatch.from_pylist([{f.name: row[f.name] for f in out} for row in found], to_arrow_schema(out))

    dealt = combos.select(*by, "ni", "nj", "c", "season_length", "taus").repartition(tasks, "ni", "nj", *by)
    made = dealt.mapInArrow(run, out)
    return made.drop("tau") if single else made


def significant_edges(pairs: DataFrame, critical: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, q_strength, q_asym, sig_strength, sig_asym) of significant pairs: sum or difference strictly above its critical value."""
    ranged = critical.select(*by, F.col("ni").alias("_lo"), F.col("nj").alias("_hi"), "crit_sum", "crit_diff")
    same = [F.least("ni", "nj") == F.col("_lo"), F.greatest("ni", "nj") == F.col("_hi")]
    left, right = pairs.alias("l"), ranged.alias("r")
    joined = left.join(right, [*[F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], *same])
    total, diff = F.col("j_j2i") + F.col("j_i2j"), F.abs(F.col("j_j2i") - F.col("j_i2j"))
    return joined.select(*[F.col(f"l.{c}") for c in by], "i", "j", "q_strength", "q_asym", (total > F.col("crit_sum")).alias("sig_strength"), (diff > F.col("crit_diff")).alias("sig_asym")).where("sig_strength OR sig_asym")
