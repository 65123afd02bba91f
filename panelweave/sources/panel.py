"""Long-form panels (node_id, t, value) and their dimensions, derived from the order tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.tables import table

LAT0, LON0, STEP = 20.0, 100.0, 0.25


def with_coordinates(nodes: DataFrame, width: int) -> DataFrame:
    """Row-major cells: indices and centre coordinates of a regular grid ``width`` cells wide."""
    lat, lon = F.col("node_id").cast("long") / F.lit(width), F.pmod("node_id", F.lit(width))
    indexed = nodes.withColumn("lat_idx", F.floor(lat).cast("int")).withColumn("lon_idx", lon.cast("int"))
    return indexed.withColumn("lat", LAT0 + STEP * F.col("lat_idx")).withColumn("lon", LON0 + STEP * F.col("lon_idx"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a grid of five columns."""
    return with_coordinates(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node_id")), 5)


def part_grid(spark: SparkSession, sf_dir: str, width: int = 20) -> DataFrame:
    """Parts, folded, as a square grid."""
    cells = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(width * width)).cast("long").alias("node_id")).distinct()
    return with_coordinates(cells, width)


def record(spark: SparkSession, sf_dir: str) -> tuple[datetime.date, int]:
    """First day and number of days of the record."""
    span = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("z")).first()
    return span.a, (span.z - span.a).days + 1


def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, days = record(spark, sf_dir)
    t = F.col("id").cast("int")
    dated = spark.range(days).select(t.alias("t"), F.date_add(F.lit(start), t).alias("date"))
    return dated.withColumn("doy", F.dayofyear("date")).withColumn("month", F.month("date"))


def dense(nodes: DataFrame, days: int) -> DataFrame:
    """Every node on every day."""
    return nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("t"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value of each nation as an exact decimal; days without orders are zero."""
    start, days = record(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("node_id"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit(start)).alias("t"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    daily = orders.join(customers, "o_custkey").groupBy("node_id", "t").agg(F.sum("v").alias("v"))
    nodes = grid(spark, sf_dir).select("node_id")
    return dense(nodes, days).join(daily, ["node_id", "t"], "left").select("node_id", "t", F.coalesce("v", F.lit(0).cast("decimal(28,2)")).alias("value"))


def part_panel(spark: SparkSession, sf_dir: str, width: int = 20) -> DataFrame:
    """Daily shipped quantity of each cell of the part grid."""
    start, days = record(spark, sf_dir)
    t = F.datediff(F.col("l_shipdate").cast("date"), F.lit(start))
    lines = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(width * width)).cast("long").alias("node_id"), t.alias("t"), F.col("l_quantity").cast("decimal(18,2)").alias("v"))
    daily = lines.where(F.col("t").between(0, days - 1)).groupBy("node_id", "t").agg(F.sum("v").alias("v"))
    nodes = part_grid(spark, sf_dir, width).select("node_id")
    return dense(nodes, days).join(daily, ["node_id", "t"], "left").select("node_id", "t", F.coalesce("v", F.lit(0).cast("decimal(28,2)")).alias("value"))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variable, node_id, t, value): six daily series of each supplier nation, on days with shipments.

    Values are decimals cut to six digits, so that sums over them are exact.
    """
    start, days = record(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("node_id"))
    t = F.datediff(F.col("l_shipdate").cast("date"), F.lit(start)).alias("t")
    hundredths = lambda c: (F.col(c).cast("decimal(18,2)") * 100).cast("long").alias(c)
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", t, *map(hundredths, columns)).where(F.col("t").between(0, days - 1))
    sums = [F.sum(c).alias(c) for c in columns]
    daily = lines.join(suppliers, "l_suppkey").groupBy("node_id", "t").agg(F.count("*").alias("n"), *sums)
    micro = {
        "Pre": "l_quantity * 10000",
        "Tm": "l_extendedprice * 10 div n",  # mean, in thousands
        "VPD": "l_discount * 10000 div n",
        "SWL1": "l_tax * 10000 div n",
        "Bowen": "l_tax * 1000000 div nullif(l_discount, 0)",
        "W500": "n * 1000000",
    }
    wide = daily.select("node_id", "t", *[(F.expr(e).cast("decimal(24,0)") / 1000000).cast("decimal(24,6)").alias(v) for v, e in micro.items()])
    return wide.unpivot(["node_id", "t"], list(micro), "variable", "value").select("variable", "node_id", "t", "value")
