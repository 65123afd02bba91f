"""Gridded inputs in long form: variables found by name, coordinates by alias, gaps as nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the precipitation variable in order of preference, and aliases of coordinates.
PRECIPITATION = ("precipitation", "precip", "pre", "pr", "tp")
LATITUDE, LONGITUDE, TIME = ("lat", "latitude", "y"), ("lon", "longitude", "x"), ("time", "t", "date")
EXTRA_LEVELS = ("expver", "level")


def _one_of(columns: list[str], names: tuple[str, ...]) -> str | None:
    lower = {c.lower(): c for c in columns}
    return next((lower[n] for n in names if n in lower), None)


def variable_name(columns: list[str]) -> str:
    """The precipitation variable by preference, else the only column that is no coordinate; KeyError if that is unclear."""
    if found := _one_of(columns, PRECIPITATION):
        return found
    rest = [c for c in columns if c.lower() not in {*LATITUDE, *LONGITUDE, *TIME, *EXTRA_LEVELS} and "bnds" not in c.lower() and "bounds" not in c.lower()]
    if len(rest) != 1:
        raise KeyError(f"no single variable among {columns}")
    return rest[0]


def to_panel(table: DataFrame, variable: str | None = None, level: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(grid, panel) of a long table (time, lat, lon, [level], variable).

    Cells are numbered row by row from the south; days from the first. NaN becomes null here, once, so that no NaN
    takes part in comparisons or sums. Of extra levels the one named is taken; a table has no first one, so without a name it is
    the least. (A file has: :func:`panelweave.sources.netcdf.scan` takes its index 0.) One pass finds the axes, as many values
    as the grid has rows and columns, the first day and the levels.
    """
    name = variable or variable_name(table.columns)
    lat, lon, time = (_one_of(table.columns, n) for n in (LATITUDE, LONGITUDE, TIME))
    if not (lat and lon and time):
        raise KeyError(f"coordinates are missing among {table.columns}")
    extra = [c for c in table.columns if c.lower() in EXTRA_LEVELS]
    kind = dict(table.dtypes)
    place = {c: F.col(c).cast("double") for c in (lat, lon)}
    ends = table.agg(F.collect_set(place[lat]).alias("lat"), F.collect_set(place[lon]).alias("lon"), F.min(F.col(time).cast("date")).alias("start"), *[F.min(c).alias(f"least{k}") for k, c in enumerate(extra)]).first()
    for k, c in enumerate(extra):
        table = table.where(F.col(c) == F.lit(ends[f"least{k}"] if level is None else level).cast(kind[c]))
    rows = table.select(F.col(time).cast("date").alias("date"), place[lat].alias("lat"), place[lon].alias("lon"), F.col(name).cast("double").alias("value"))
    axes = {axis: table.sparkSession.createDataFrame(list(enumerate(sorted(ends[axis]))), f"{axis}_idx int, {axis} double") for axis in ("lat", "lon")}
    width = len(ends["lon"])
    node = (F.col("lat_idx").cast("long") * width + F.col("lon_idx")).alias("node_id")
    spread = axes["lat"].withColumn("lon_idx", F.explode(F.sequence(F.lit(0), F.lit(max(0, width - 1)))))
    grid = spread.join(F.broadcast(axes["lon"]), "lon_idx").select(node, "lat_idx", "lon_idx", "lat", "lon")  # an axis
    value = F.when(~F.isnan("value"), F.col("value")).alias("value")
    placed = rows.join(F.broadcast(axes["lat"]), "lat").join(F.broadcast(axes["lon"]), "lon")  # coordinates of the axes
    return grid, placed.select(node, F.datediff("date", F.lit(ends.start)).alias("t"), "date", value)
