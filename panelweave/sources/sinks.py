"""Writers of results, and stage tables whose parameters are folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def case_path(root: str, **case: object) -> str:
    return "/".join([root, *(f"{key}={value}" for key, value in case.items())])


def write_case(df: DataFrame, root: str, *within: str, **case: object) -> str:
    """One case of a stage as compressed Parquet; its parameters become folders, so readers prune by them.

    A case that was there is replaced, also by an empty one. Columns ``within`` become folders inside the case's.
    """
    path = case_path(root, **case)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*within) if within else writer).parquet(path)
    return path


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` came to its end."""
    try:
        spark.read.text(f"{path}/_SUCCESS")
    except AnalysisException:
        return False
    return True


def has_case(spark: SparkSession, root: str, **case: object) -> bool:
    """Whether a stage has rows of a case; a folder that is missing or was not finished has none."""
    try:
        return not read_stage(spark, root, **case).isEmpty()
    except AnalysisException:
        return False


def read_stage(spark: SparkSession, root: str, **case: object) -> DataFrame:
    """Rows of a stage, of one case if parameters are given: found by folders, without listing the others' files."""
    found = spark.read.parquet(root)
    for key, value in case.items():
        found = found.where(F.col(key) == F.lit(value))
    return found


def write_summary(df: DataFrame, path: str) -> str:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def north_up(values: DataFrame, grid: DataFrame) -> DataFrame:
    """(raster_row, raster_col, lat, lon, value): cells in rows from the north, as a raster has them."""
    last = grid.agg(F.max("lat_idx").alias("_last"))
    placed = grid.join(values, "node_id", "left").withColumn("_one", F.lit(1)).join(F.broadcast(last.withColumn("_one", F.lit(1))), "_one")  # one row
    return placed.select((F.col("_last") - F.col("lat_idx")).alias("raster_row"), F.col("lon_idx").alias("raster_col"), "lat", "lon", "value")
