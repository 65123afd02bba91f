"""Exact quantiles of whole columns in bounded memory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram, values that are ranked at once, and the spread of a stretch from which its bins are geometric.
BINS, FEW, WIDE = 1024, 50_000, 1e6


class _Search:
    """One order statistic: the stretch of values that it lies in, how many lie in it, and how many below."""

    def __init__(self, column: str, rank: int, low: float, high: float, n: int):
        self.column, self.rank, self.low, self.high, self.n, self.below = column, rank, low, high, n, 0

    @property
    def open(self) -> bool:
        return self.low < self.high

    def bin(self, value: Column) -> Column:
        """Number of a value's bin; null outside the stretch."""
        low, high, x = self.low, self.high, value
        if low * high > 0 and max(abs(low), abs(high)) / min(abs(low), abs(high)) > WIDE:
            a, b = math.log(min(abs(self.low), abs(self.high))), math.log(max(abs(self.low), abs(self.high)))
            size = F.log(F.abs(value))
            low, high, x = (a, b, size) if self.low > 0 else (-b, -a, -size)
        unit = 1 if math.isfinite(high - low) else BINS  # so that no difference overflows
        step = F.floor((x / unit - low / unit) / F.lit(high / unit - low / unit) * BINS)
        return F.when((value >= self.low) & (value <= self.high), F.greatest(F.lit(0), F.least(F.lit(BINS - 1), step)).cast("int"))

    def narrow(self, bins: list) -> None:
        """To the values of the bin that holds the rank; bins are in order and overlap nowhere."""
        for b in sorted(bins, key=lambda b: b.bin):
            if self.rank < self.below + b.n:
                self.low, self.high, self.n = b.low, b.high, b.n
                return
            self.below += b.n


def _ranked(df: DataFrame, searches: list[_Search]) -> dict[int, float]:
    """Values by rank where few are left: all of a stretch are brought together as one array, sorted."""
    kept = [F.sort_array(F.collect_list(F.when((F.col(s.column) >= s.low) & (F.col(s.column) <= s.high), F.col(s.column)))) for s in searches]
    row = df.agg(*[F.element_at(k, F.lit(s.rank - s.below + 1)).alias(f"v{j}") for j, (k, s) in enumerate(zip(kept, searches, strict=True))]).first()
    return dict(enumerate(row))


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], few: int = FEW) -> dict[str, list[float | None]]:
    """For each column its quantiles, linearly between order statistics as ``percentile`` has them; nulls and NaN do not count.

    A pass over the table bins, for every order statistic that is sought, the stretch it lies in, and goes on with the
    bin that holds it: ``BINS`` counts for each reach the driver, never the values. A stretch with one value is done;
    of one with ``few`` values or less they are ranked in one task. Stretches over many orders of magnitude get
    geometric bins. A column without values has None. Infinite values are ordered as they are.
    """
    plain = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    ends = plain.agg(*[f(x).alias(f"{p}_{k}") for k, c in enumerate(columns) for p, f, x in (("n", F.count, F.col(c)), ("a", F.min, finite(c)), ("z", F.max, finite(c)), ("m", F.count_if, F.col(c) == -float("inf")), ("f", F.count, finite(c)))]).first()
    searches: dict[tuple[str, int], _Search | float] = {}
    wanted: dict[str, list[tuple[int, int, float]]] = {}
    for k, c in enumerate(columns):
        n, minus, inside = ends[f"n_{k}"], ends[f"m_{k}"], ends[f"f_{k}"]
        for share in shares if n else []:
            place = share * (n - 1)
            low, high = math.floor(place), min(math.floor(place) + 1, n - 1)
            wanted.setdefault(c, []).append((low, high, place - low))
            for rank in (low, high):
                if rank < minus or rank >= minus + inside:
                    searches[c, rank] = -math.inf if rank < minus else math.inf
                elif (c, rank) not in searches:
                    searches[c, rank] = _Search(c, rank - minus, ends[f"a_{k}"], ends[f"z_{k}"], inside)
    inner = plain.select(*[finite(c).alias(c) for c in columns])
    while todo := [s for s in searches.values() if isinstance(s, _Search) and s.open and s.n > few]:
        each = F.array(*[F.struct(F.lit(j).alias("j"), s.bin(F.col(s.column)).alias("bin"), F.col(s.column).alias("x")) for j, s in enumerate(todo)])
        rows = inner.select(F.explode(each).alias("e")).where("e.bin IS NOT NULL").groupBy("e.j", "e.bin").agg(F.count("*").alias("n"), F.min("e.x").alias("low"), F.max("e.x").alias("high")).collect()  # BINS for each at most
        for j, s in enumerate(todo):
            s.narrow([r for r in rows if r.j == j])
    last = [s for s in searches.values() if isinstance(s, _Search) and s.open]
    found = _ranked(inner, last) if last else {}
    at = {id(s): found[j] for j, s in enumerate(last)}
    value = lambda s: s if isinstance(s, float) else at[id(s)] if s.open else s.low

    def between(a: float, b: float, share: float) -> float:
        return a if share == 0 or a == b else a * (1 - share) + b * share

    return {c: [between(value(searches[c, a]), value(searches[c, b]), f) for a, b, f in wanted[c]] if c in wanted else [None] * len(shares) for c in columns}
