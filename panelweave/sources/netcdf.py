"""NetCDF classic files (CDF-1, CDF-2, CDF-5) as a Spark data source: a task reads the bytes of its own days and rows only."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelweave.sources.grids import LATITUDE, LONGITUDE, PRECIPITATION, TIME

# Fixed values of the format: big-endian types by code, tags of the lists in a header, and the values that stand for what was never written.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
DEFAULT_FILL = {3: -32767, 4: -2147483647, 5: np.float32(9.969209968386869e36), 6: 9.969209968386869e36, 8: 65535, 9: 4294967295, 10: -9223372036854775806, 11: 18446744073709551614}
#: Names that are never the variable sought by its dimensions.
NO_VARIABLE = ("lat", "lon", "latitude", "longitude", "time", "expver", "level", "crs", "spatial_ref")
#: Bytes that a task reads, about, and bytes of the first piece of a header that is read.
PARTITION_BYTES, HEADER_BYTES = 32 << 20, 64 << 10
#: Cells of an Arrow batch, about.
BATCH_CELLS = 200_000
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
SCHEMA = "t int, time timestamp_ntz, lat_idx int, lon_idx int, lat double, lon double, value double"

ReadAt = Callable[[int, int], bytes]


@dataclass
class Variable:
    name: str
    dims: tuple[int, ...]
    attributes: dict
    kind: int
    begin: int


class _Cursor:
    """Fields of a header one after the other; it is fetched in pieces that double, as its length is not told."""

    def __init__(self, read_at: ReadAt):
        self.read_at, self.data, self.at, self.wide = read_at, read_at(0, HEADER_BYTES), 0, False

    def take(self, size: int) -> bytes:
        while self.at + size > len(self.data):
            more = self.read_at(len(self.data), len(self.data))
            if not more:
                raise ValueError("the header is cut short")
            self.data += more
        self.at += size
        return self.data[self.at - size : self.at]

    def number(self, size: int = 0) -> int:
        size = size or (8 if self.wide else 4)
        return int.from_bytes(self.take(size), "big")

    def padded(self, size: int) -> bytes:
        return self.take(size + -size % 4)[:size]

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def items(self, tag: int) -> Iterator[int]:
        found, count = self.number(4), self.number()
        if found not in (0, tag) or (found == 0 and count):
            raise ValueError(f"tag {found} where {tag} was due")
        return iter(range(count))

    def attributes(self) -> dict:
        out = {}
        for _ in self.items(ATTRIBUTES):
            name, kind, count = self.name(), self.number(4), self.number()
            values = np.frombuffer(self.padded(count * np.dtype(TYPES[kind]).itemsize), TYPES[kind])
            out[name] = values.tobytes().decode("utf-8", "replace") if kind == 2 else values
        return out


class Header:
    """Dimensions, variables and where their values stand."""

    def __init__(self, read_at: ReadAt):
        cursor = _Cursor(read_at)
        magic, version = cursor.take(3), cursor.take(1)[0]
        if magic != b"CDF" or version not in (1, 2, 5):
            raise ValueError("this is no NetCDF classic file")
        cursor.wide = version == 5
        records = cursor.number()
        self.dims = [(cursor.name(), cursor.number()) for _ in cursor.items(DIMENSIONS)]
        self.attributes = cursor.attributes()
        self.variables = []
        for _ in cursor.items(VARIABLES):
            name = cursor.name()
            dims = tuple(cursor.number() for _ in range(cursor.number()))
            attributes, kind = cursor.attributes(), cursor.number(4)
            cursor.number()  # the size that follows from the dimensions, too
            self.variables.append(Variable(name, dims, attributes, kind, cursor.number(4 if version == 1 else 8)))
        unlimited = [k for k, (_, size) in enumerate(self.dims) if size == 0]
        self.record_dim = unlimited[0] if unlimited else None
        recorded = [v for v in self.variables if self.is_record(v)]
        alone = len(recorded) == 1  # a single one is not padded
        self.record_bytes = sum(n if alone else n + -n % 4 for n in map(self.step_bytes, recorded))
        if records == (2**64 - 1 if cursor.wide else 2**32 - 1):
            raise ValueError("the number of records was never written")
        self.records = records

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and v.dims[0] == self.record_dim

    def step_bytes(self, v: Variable) -> int:
        """Bytes of one index of the first dimension."""
        return int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize

    def length(self, v: Variable) -> int:
        return self.records if self.is_record(v) else self.dims[v.dims[0]][1] if v.dims else 1

    def place(self, v: Variable, step: int) -> int:
        return v.begin + step * (self.record_bytes if self.is_record(v) else self.step_bytes(v))

    def named(self, names: Iterable[str]) -> Variable | None:
        """The first variable, in the order of ``names``, whose name is one of them in any case."""
        lower = {v.name.lower(): v for v in reversed(self.variables)}
        return next((lower[n] for n in names if n in lower), None)

    def values(self, read_at: ReadAt, v: Variable) -> np.ndarray:
        """All values of a variable of one dimension."""
        n, size = self.length(v), np.dtype(TYPES[v.kind]).itemsize
        if self.is_record(v):
            return np.array([np.frombuffer(read_at(self.place(v, k), size), TYPES[v.kind])[0] for k in range(n)])
        return np.frombuffer(read_at(v.begin, n * size), TYPES[v.kind])

    def widest(self) -> Variable:
        """The variable with the most dimensions, the first of equals, without coordinates and bounds."""
        rest = [v for v in self.variables if v.name.lower() not in NO_VARIABLE and "bnds" not in v.name.lower() and "bounds" not in v.name.lower() and v.dims]
        if not rest:
            raise ValueError("no variable has dimensions")
        return max(rest, key=lambda v: len(v.dims))

    def precipitation(self) -> Variable:
        """The variable by name of preference, else the only one that is no dimension's; KeyError if that is unclear."""
        for name in PRECIPITATION:
            if found := next((v for v in self.variables if v.name == name), None):
                return found
        rest = [v for v in self.variables if v.name not in {name for name, _ in self.dims}]
        if len(rest) != 1:
            raise KeyError(f"no single variable among {[v.name for v in rest]}")
        return rest[0]


def times(values: np.ndarray, units: str, calendar: str = "standard") -> np.ndarray:
    """Microseconds of ``unit since date`` numbers. Calendars that are not the Gregorian one are refused."""
    if calendar.lower().strip("\0") not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"calendar {calendar}")
    found = re.fullmatch(r"\s*(second|minute|hour|day)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+)(?:\.\d*)?)?)?\s*(?:Z|UTC|\+?0+:?0*)?\s*", units.strip("\0"), re.IGNORECASE)
    if not found:
        raise ValueError(f"units {units!r}")
    unit, *parts = found.groups()
    start = np.datetime64(datetime.datetime(*(int(p or 0) for p in parts)), "us")
    return start + np.rint(values.astype(float) * SECONDS[unit.lower()] * 1e6).astype("timedelta64[us]")


def opened(path: str) -> tuple[ReadAt, Callable[[], None]]:
    """Reading a range of a file of any store that Arrow knows, by its address or local path, and closing it."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    file = store.open_input_file(name)
    return (lambda at, size: file.read_at(max(0, min(size, file.size() - at)), at)), file.close


class Grid:
    """A variable of a file as (time, latitude, longitude), latitude ascending; of other dimensions the first index is taken."""

    def __init__(self, read_at: ReadAt, variable: str | None = None, rule: str = "widest"):
        self.header = header = Header(read_at)
        if variable:
            found = next((v for v in header.variables if v.name == variable), None)
            if not found:
                raise KeyError(f"no variable {variable} among {[v.name for v in header.variables]}")
            self.variable = found
        else:
            self.variable = {"widest": header.widest, "precipitation": header.precipitation}[rule]()
        axes = [header.named(names) for names in (TIME, LATITUDE, LONGITUDE)]
        if not all(axes):
            raise KeyError(f"coordinates are missing among {[v.name for v in header.variables]}")
        time, lat, lon = axes
        dims, wanted = self.variable.dims, [a.dims[0] for a in axes]
        if dims[:1] != (wanted[0],) or set(dims[-2:]) != set(wanted[1:]) or len(dims) < 3:
            raise ValueError(f"{self.variable.name} is not (time, ..., latitude, longitude)")
        self.turned = dims[-1] == wanted[1]  # longitude before latitude
        self.lat, self.lon = (header.values(read_at, a).astype(float) for a in (lat, lon))
        self.flipped = len(self.lat) > 1 and self.lat[0] > self.lat[-1]
        self.lat = self.lat[::-1] if self.flipped else self.lat
        attributes = time.attributes
        self.time = times(header.values(read_at, time), attributes.get("units", ""), attributes.get("calendar", "standard"))

    def rows(self, read_at: ReadAt, step: int, lo: int, hi: int) -> np.ndarray:
        """Values of one time in the latitude rows ``lo`` .. ``hi`` - 1, gaps as NaN; no other rows are read."""
        v, n_lat, n_lon = self.variable, len(self.lat), len(self.lon)
        kind, begin = np.dtype(TYPES[v.kind]), self.header.place(self.variable, step)
        if self.turned:
            raw = np.frombuffer(read_at(begin, n_lat * n_lon * kind.itemsize), kind).reshape(n_lon, n_lat).T
            raw = (raw[::-1] if self.flipped else raw)[lo:hi]
        else:
            first = n_lat - hi if self.flipped else lo
            raw = np.frombuffer(read_at(begin + first * n_lon * kind.itemsize, (hi - lo) * n_lon * kind.itemsize), kind).reshape(hi - lo, n_lon)
            raw = raw[::-1] if self.flipped else raw
        told = [v.attributes[a] for a in ("_FillValue", "missing_value") if a in v.attributes and not isinstance(v.attributes[a], str)]
        gaps = np.concatenate([np.asarray(x).ravel() for x in told]) if told else np.array([DEFAULT_FILL[v.kind]] if v.kind in DEFAULT_FILL else [])
        value = raw.astype(float)
        scale, offset = (float(np.ravel(v.attributes.get(a, d))[0]) for a, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return np.where(np.isin(raw, gaps.astype(raw.dtype)), np.nan, value * scale + offset if (scale, offset) != (1.0, 0.0) else value)


@dataclass
class Steps(InputPartition):
    """Times of one task."""

    steps: list[int]


class NetCDFReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        read_at, close = opened(self.path)
        try:
            self.grid = Grid(read_at, options.get("variable"), options.get("rule", "widest"))
        finally:
            close()
        t, lat, lon = np.arange(len(self.grid.time)), self.grid.lat, self.grid.lon
        told = lambda name, default: float(options.get(name, default))
        self.steps = t[(t >= told("t_from", 0)) & (t < told("t_to", len(t)))].tolist()
        self.rows = np.flatnonzero((lat >= told("south", -np.inf)) & (lat <= told("north", np.inf)))
        self.columns = np.flatnonzero((lon >= told("west", -np.inf)) & (lon <= told("east", np.inf)))

    def partitions(self) -> list[Steps]:
        if not len(self.rows) or not len(self.columns):
            return []
        bytes_of_step = (self.rows[-1] - self.rows[0] + 1) * len(self.grid.lon) * np.dtype(TYPES[self.grid.variable.kind]).itemsize
        n = max(1, self.size // int(bytes_of_step))
        return [Steps(self.steps[k : k + n]) for k in range(0, len(self.steps), n)]

    def read(self, partition: Steps | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        g, rows, columns = self.grid, self.rows, self.columns
        lo, hi, cells = rows[0], rows[-1] + 1, len(rows) * len(columns)
        lat_idx, lon_idx = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
        read_at, close = opened(self.path)
        try:
            n = max(1, BATCH_CELLS // cells)
            for k in range(0, len(partition.steps), n):
                steps = partition.steps[k : k + n]
                value = np.concatenate([g.rows(read_at, s, int(lo), int(hi))[rows - lo][:, columns].ravel() for s in steps])
                tiled = lambda a, m=len(steps): np.tile(a, m)
                arrays = [np.repeat(np.array(steps, np.int32), cells), np.repeat(g.time[steps], cells), tiled(lat_idx.astype(np.int32)), tiled(lon_idx.astype(np.int32)), tiled(g.lat[lat_idx]), tiled(g.lon[lon_idx])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(value, mask=np.isnan(value))], names=["t", "time", "lat_idx", "lon_idx", "lat", "lon", "value"])
        finally:
            close()


class NetCDFSource(DataSource):
    """``spark.read.format("netcdf_classic")``, a row for each time and cell. Options: those of :func:`read`."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_classic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NetCDFReader:
        return NetCDFReader(dict(self.options))


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Rows (t, time, lat_idx, lon_idx, lat, lon, value) of a file; gaps, fill values and NaN are null, packed numbers unpacked.

    Options: ``variable`` or ``rule`` (``widest``, ``precipitation``) names what is read; ``t_from`` <= t < ``t_to``, ``south``,
    ``north``, ``west`` and ``east`` (with their ends) bound it: times and rows outside are not read. A task reads some
    times, about ``partition_bytes``. Executors read the file by its path or address. Filters are not pushed into the
    source: Spark 4.1 keeps what an earlier query of the same DataFrame has pushed, and a later one then lacks rows.
    """
    spark.dataSource.register(NetCDFSource)
    return spark.read.format("netcdf_classic").options(**options).load(path)


def scan(spark: SparkSession, path: str, **options: object) -> tuple[DataFrame, DataFrame]:
    """(grid, panel) of a file: cells numbered row by row from the south, days from the first; the grid comes from the header alone."""
    read_at, close = opened(path)
    try:
        found = Grid(read_at, options.get("variable"), options.get("rule", "widest"))
    finally:
        close()
    axis = lambda name, values: spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], f"{name}_idx int, {name} double")
    width = len(found.lon)
    node = (F.col("lat_idx").cast("long") * width + F.col("lon_idx")).alias("node_id")
    cells = axis("lat", found.lat).withColumn("lon_idx", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    grid = cells.join(F.broadcast(axis("lon", found.lon)), "lon_idx").select(node, "lat_idx", "lon_idx", "lat", "lon")  # an axis
    return grid, read(spark, path, **options).select(node, "t", F.col("time").cast("date").alias("date"), "value")
