"""Events in standardized series: runs below a threshold, rapid onsets, seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.config import BURN_IN_DAYS


def after_burn_in(series: DataFrame, days: int = BURN_IN_DAYS) -> DataFrame:
    """Rows from day ``days`` on, counted from zero again."""
    return series.where(F.col("t") >= days).withColumn("t", F.col("t") - days)


def _numbered(runs: DataFrame) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("node_id").orderBy("start_t"))
    return runs.select("node_id", seq.cast("int").alias("seq"), F.col("start_t").cast("int").alias("start_t"), F.col("end_t").cast("int").alias("end_t"))


def runs_below(series: DataFrame, threshold: float, duration: int, value: str = "z") -> DataFrame:
    """(node_id, seq, start_t, end_t): maximal stretches of consecutive days strictly below ``threshold``.

    A stretch counts from ``duration`` + 1 days on. Missing days and null values break it.
    """
    below = series.where(F.col(value) < threshold).select("node_id", "t")
    island = F.col("t") - F.row_number().over(Window.partitionBy("node_id").orderBy("t"))
    spans = below.withColumn("k", island).groupBy("node_id", "k").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"))
    return _numbered(spans.where(F.col("end_t") - F.col("start_t") >= duration))


def rapid_onsets(series: DataFrame, days: int, change: float, final: float, value: str = "z") -> DataFrame:
    """(node_id, seq, start_t, end_t): drops by ``change`` or more over ``days`` that reach ``final``.

    A day t triggers if x[t + days] - x[t] <= change and the least of x[t .. t + days - 1] <= final, all of them
    present, up to the last day but ``days`` + 1. A stretch of x <= final holds one event at most: it starts at the
    first such day on or after its first trigger, and lasts to the stretch's end. The series must have a row a day.
    """
    w = Window.partitionBy("node_id").orderBy("t")
    ahead = w.rowsBetween(0, days - 1)
    x = F.col(value)
    marked = series.select(
        "node_id",
        "t",
        (x <= final).alias("low"),
        (F.lead(x, days).over(w) - x).alias("delta"),
        F.first(F.when(x <= final, F.col("t")), ignorenulls=True).over(ahead).alias("next_low"),
        F.count(x).over(ahead).alias("present"),
        F.max("t").over(Window.partitionBy("node_id")).alias("last"),
    )
    triggers = marked.where((F.col("delta") <= change) & F.col("next_low").isNotNull() & (F.col("present") == days) & (F.col("t") <= F.col("last") - days - 1))
    low = marked.where("low").select("node_id", "t")
    island = F.col("t") - F.row_number().over(w)
    stretch = Window.partitionBy("node_id", "k")
    ends = low.withColumn("k", island).select("node_id", F.col("t").alias("next_low"), "k", F.max("t").over(stretch).alias("end_t"))
    found = triggers.select("node_id", "next_low").distinct().join(ends, ["node_id", "next_low"])
    return _numbered(found.groupBy("node_id", "k").agg(F.min("next_low").alias("start_t"), F.max("end_t").alias("end_t")))


def event_counts(onsets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, n_events) of every node, without events zero."""
    counts = onsets.groupBy("node_id").agg(F.count("*").alias("n_events"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def season_of(month: Column, seasons: dict) -> Column:
    """The names of the seasons that a month belongs to."""
    named = [F.when(F.lit(True) if months is None else month.isin(*months), F.lit(name)) for name, months in seasons.items()]
    return F.array_compact(F.array(*named))


def by_season(onsets: DataFrame, axis: DataFrame, seasons: dict) -> DataFrame:
    """(season, node_id, seq, start_t, end_t): each event under every season in whose months it starts; ``seq`` counts anew."""
    months = axis.select(F.col("t").alias("start_t"), F.explode(season_of(F.col("month"), seasons)).alias("season"))
    inside = onsets.drop("seq").join(F.broadcast(months), "start_t")  # a row for each day and season of the record
    seq = F.row_number().over(Window.partitionBy("season", "node_id").orderBy("start_t"))
    return inside.select("season", "node_id", seq.cast("int").alias("seq"), "start_t", "end_t")


def season_lengths(axis: DataFrame, seasons: dict) -> DataFrame:
    """(season, season_length): days of the record in each season."""
    return axis.select(F.explode(season_of(F.col("month"), seasons)).alias("season")).groupBy("season").agg(F.count("*").alias("season_length"))
