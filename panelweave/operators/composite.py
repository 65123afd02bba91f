"""Event-aligned composites: climatology, anomalies, lag windows, smoothing, nearest cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mean(column: str) -> Column:
    """Mean of the present values; exact before the division if the values are decimals."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


def climatology(panel: DataFrame, axis: DataFrame, by: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """(by, doy, mean): mean of the present values of each day of the year, 1 to 366."""
    return panel.join(F.broadcast(axis.select("t", "doy")), "t").groupBy(*by, "doy").agg(_mean("value").alias("mean"))


def anomalies(panel: DataFrame, axis: DataFrame, by: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """``panel`` with ``anomaly``: the value less its climatology, null where the value is."""
    dated = panel.join(F.broadcast(axis.select("t", "doy")), "t")  # a row for each day of the record
    w = Window.partitionBy(*by, "doy")
    return dated.withColumn("anomaly", F.col("value").cast("double") - F.try_divide(F.sum("value").over(w).cast("double"), F.count("value").over(w).cast("double")))


def regional_means(anomaly: DataFrame, regions: DataFrame, by: tuple[str, ...] = ("variable",)) -> DataFrame:
    """(by, region, t, value): mean anomaly over a region's cells; a cell that is listed twice counts twice."""
    return anomaly.join(regions, "node_id").groupBy(*by, "region", "t").agg(F.avg("anomaly").alias("value"))


def onset_days(onsets: DataFrame, regions: DataFrame, region: str, lag_min: int, lag_max: int, days: int) -> DataFrame:
    """(start): distinct days on which an event starts anywhere in a region, with the whole window inside the record."""
    inside = onsets.join(regions.where(F.col("region") == region).select("node_id").distinct(), "node_id", "left_semi")
    return inside.select(F.col("start_t").alias("start")).distinct().where((F.col("start") >= -lag_min) & (F.col("start") < days - lag_max))


def event_windows(means: DataFrame, starts: DataFrame, lag_min: int, lag_max: int) -> DataFrame:
    """``means`` at every lag of every start: (..., start, lag, value), from the pre-aggregated daily means."""
    wanted = starts.withColumn("lag", F.explode(F.sequence(F.lit(lag_min), F.lit(lag_max)))).withColumn("t", F.col("start") + F.col("lag"))
    return means.join(wanted, "t").drop("t")


def composite(windows: DataFrame, starts: DataFrame, by: tuple[str, ...] = ("variable", "region")) -> DataFrame:
    """(by, lag, mean_anomaly, standard_error, n_events): over starts; the error divides by the root of all starts."""
    n = starts.count()
    out = windows.groupBy(*by, "lag").agg(F.avg("value").alias("mean_anomaly"), (F.stddev_pop("value") / F.sqrt(F.lit(float(max(1, n))))).alias("standard_error"))
    return out.withColumn("n_events", F.lit(n).cast("long"))


def smoothed(composites: DataFrame, width: int, by: tuple[str, ...] = ("variable", "region")) -> DataFrame:
    """Means and errors under a centred moving average of odd width, shorter at the ends."""
    half = (width - 1) // 2
    w = Window.partitionBy(*by).orderBy("lag").rowsBetween(-half, half)
    return composites.withColumn("mean_anomaly", F.avg("mean_anomaly").over(w)).withColumn("standard_error", F.avg("standard_error").over(w))


def _placed(targets: DataFrame, axis: DataFrame, value: str, index: str) -> DataFrame:
    """``targets`` with the ``index`` of the nearest coordinate ``v`` of an axis (index, v), the lower of equals.

    Each coordinate owns the stretch up to the middles between it and its neighbours. Stretches and targets meet in buckets
    as wide as coordinates lie apart on average, so that a regular axis gives a stretch or two for each.
    """
    in_order = Window.orderBy("v")  # an axis, a row for each coordinate
    ends = axis.withColumn("_low", (F.lag("v").over(in_order) + F.col("v")) / 2).withColumn("_high", (F.lead("v").over(in_order) + F.col("v")) / 2)
    span = axis.agg(F.min("v").alias("a"), F.max("v").alias("z"), F.count("*").alias("n")).first()
    if not span.n:
        return targets.withColumn(index, F.lit(None).cast("int"))
    width = (span.z - span.a) / max(1, span.n - 1) or 1.0
    bucket = lambda x: F.greatest(F.lit(0), F.least(F.lit(span.n), F.floor((x - F.lit(span.a)) / F.lit(width)))).cast("int")
    first = F.when(F.col("_low").isNull(), 0).otherwise(bucket(F.col("_low")))
    last = F.when(F.col("_high").isNull(), F.lit(span.n).cast("int")).otherwise(bucket(F.col("_high")))
    own = ends.select(F.col(index), "_low", "_high", F.explode(F.sequence(first, last)).alias("_bucket"))
    inside = (F.col("_low").isNull() | (F.col(value) > F.col("_low"))) & (F.col("_high").isNull() | (F.col(value) <= F.col("_high")))
    met = targets.withColumn("_bucket", bucket(F.col(value))).alias("x").join(own.alias("y"), (F.col("x._bucket") == F.col("y._bucket")) & inside, "left")
    return met.select("x.*", f"y.{index}").drop("_bucket")


def nearest_cells(targets: DataFrame, cells: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``targets`` with ``lat_idx`` and ``lon_idx`` of the nearest cell, each axis by itself; targets that share one stay."""
    for value, axis in ((lat, "lat"), (lon, "lon")):
        own = cells.select(f"{axis}_idx", F.col(axis).cast("double").alias("v")).distinct()
        targets = _placed(targets, own, value, f"{axis}_idx")
    return targets
