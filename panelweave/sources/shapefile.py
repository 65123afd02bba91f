"""Polygon shapefiles as Spark data sources: rings of vertices from the main file, attributes from its table, in ranges of records."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelweave.sources.netcdf import ReadAt, opened

# Fixed values of the format: file code, bytes of a header, shapes without and with polygons.
FILE_CODE, HEADER_BYTES, NULL_SHAPE, POLYGONS = 9994, 100, 0, (5, 15, 25)
#: Bytes of records that a task reads, about.
PARTITION_BYTES = 16 << 20
RINGS = "shape int, ring int, place int, x double, y double"


@dataclass
class Records(InputPartition):
    """Numbers of the first record and of the one behind the last, and for shapes the bytes that they lie in."""

    first: int
    stop: int
    begin: int
    end: int


def parse_records(data: bytes, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(record, ring starts, points) of consecutive records; null shapes have no rings."""
    at, record = 0, first
    while at + 12 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        (kind,) = struct.unpack_from("<i", data, at + 8)
        if number != record + 1 or at + 8 + 2 * words > len(data):
            raise ValueError(f"record {number} where {record + 1} was due, or cut short")
        if kind in POLYGONS:
            parts, points = struct.unpack_from("<ii", data, at + 44)
            starts = np.frombuffer(data, "<i4", parts, at + 52)
            yield record, starts, np.frombuffer(data, "<f8", 2 * points, at + 52 + 4 * parts).reshape(-1, 2)
        elif kind != NULL_SHAPE:
            raise ValueError(f"record {number} is of kind {kind}, no polygon")
        at, record = at + 8 + 2 * words, record + 1


def _stem(path: str) -> str:
    return path[:-4] if path.lower().endswith(".shp") else path


def record_places(read_at: ReadAt) -> np.ndarray:
    """Offset of every record and of the end, from an index file."""
    code, words = struct.unpack(">i20xi", read_at(0, 28))
    if code != FILE_CODE:
        raise ValueError("this is no index of shapes")
    pairs = np.frombuffer(read_at(HEADER_BYTES, 2 * words - HEADER_BYTES), ">i4").reshape(-1, 2).astype(np.int64) * 2
    return np.append(pairs[:, 0], pairs[-1].sum() + 8 if len(pairs) else HEADER_BYTES)


class RingsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.stem, self.size = _stem(options["path"]), int(options.get("partition_bytes", PARTITION_BYTES))
        for extension in (".shp", ".shx"):
            read_at, close = opened(self.stem + extension)
            try:
                if extension == ".shx":
                    self.places = record_places(read_at)
                elif struct.unpack(">i", read_at(0, 4))[0] != FILE_CODE:
                    raise ValueError("this is no shapefile")
            finally:
                close()
        try:
            read_at, close = opened(self.stem + ".prj")
        except FileNotFoundError:
            return
        told = read_at(0, 1 << 16).decode("latin-1").lstrip()
        close()
        if not told.upper().startswith(("GEOGCS", "GEOGCRS", "GEODCRS")):
            raise ValueError(f"coordinates are projected ({told[:60]}); bring them to longitude and latitude first")

    def partitions(self) -> list[Records]:
        out, first, n = [], 0, len(self.places) - 1
        while first < n:
            stop = max(first + 1, int(np.searchsorted(self.places, self.places[first] + self.size, "right")) - 1)
            out.append(Records(first, stop, int(self.places[first]), int(self.places[stop])))
            first = stop
        return out

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        read_at, close = opened(self.stem + ".shp")
        try:
            data = read_at(partition.begin, partition.end - partition.begin)
        finally:
            close()
        for record, starts, points in parse_records(data, partition.first):
            ring = np.searchsorted(starts, np.arange(len(points)), "right") - 1
            place = np.arange(len(points)) - starts[ring]
            # the last vertex of a ring repeats its first
            keep = np.append(ring[1:] == ring[:-1], False) if len(points) else np.zeros(0, bool)
            columns = [np.full(keep.sum(), record, np.int32), ring[keep].astype(np.int32), place[keep].astype(np.int32), points[keep, 0], points[keep, 1]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["shape", "ring", "place", "x", "y"])


class RingsSource(DataSource):
    """``spark.read.format("shapefile_rings")``: a row for each vertex. Options: ``path``, ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_rings"

    def schema(self) -> str:
        return RINGS

    def reader(self, schema) -> RingsReader:
        return RingsReader(dict(self.options))


@dataclass
class Table:
    """Layout of an attribute table: number of records, bytes before the first and of each, fields as (name, kind, begin, end)."""

    records: int
    begin: int
    size: int
    fields: list[tuple[str, str, int, int]]


def table_layout(read_at: ReadAt) -> Table:
    records, begin, size = struct.unpack("<IHH", read_at(4, 8))
    head, fields, at = read_at(32, begin - 32), [], 1
    for k in range(0, len(head) - 31, 32):
        if head[k] == 0x0D:
            break
        width = head[k + 16]
        fields.append((head[k : k + 11].split(b"\0")[0].decode("latin-1"), chr(head[k + 11]), at, at + width))
        at += width
    return Table(records, begin, size, fields)


def _value(kind: str, raw: bytes, encoding: str) -> object:
    text = raw.decode(encoding, "replace").strip(" \0")
    if kind in "NF":
        return float(text) if text and not text.startswith("*") else None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return text or None


class AttributesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.encoding = _stem(options["path"]) + ".dbf", int(options.get("partition_bytes", PARTITION_BYTES)), options.get("encoding", "utf-8")
        read_at, close = opened(self.path)
        self.table = table_layout(read_at)
        close()

    def partitions(self) -> list[Records]:
        t, n = self.table, max(1, self.size // self.table.size)
        return [Records(k, min(k + n, t.records), t.begin + k * t.size, t.begin + min(k + n, t.records) * t.size) for k in range(0, t.records, n)]

    def read(self, partition: Records | None) -> Iterator[tuple]:
        if partition is None:  # there are none
            return
        read_at, close = opened(self.path)
        try:
            data = read_at(partition.begin, partition.end - partition.begin)
        finally:
            close()
        for k, record in enumerate(range(partition.first, partition.stop)):
            own = data[k * self.table.size : (k + 1) * self.table.size]
            yield (record, own[:1] == b"*", *(_value(kind, own[a:b], self.encoding) for _, kind, a, b in self.table.fields))


class AttributesSource(DataSource):
    """``spark.read.format("shapefile_attributes")``: a row for each shape. Options: ``path``, ``encoding``, ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_attributes"

    def schema(self) -> str:
        kinds = {"N": "double", "F": "double", "L": "boolean"}
        return ", ".join(["shape int", "deleted boolean", *(f"`{name}` {kinds.get(kind, 'string')}" for name, kind, *_ in AttributesReader(dict(self.options)).table.fields)])

    def reader(self, schema) -> AttributesReader:
        return AttributesReader(dict(self.options))


def read_rings(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(shape, ring, place, x, y): vertices of all polygons, each once. ``place`` orders a ring; null shapes have no rows.

    Tasks read ranges of whole records that the index file tells. Coordinates must be longitude and latitude; a projection
    file that says otherwise is an error. Heights and measures are left out.
    """
    spark.dataSource.register(RingsSource)
    return spark.read.format("shapefile_rings").options(**options).load(path)


def read_attributes(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(shape, deleted, fields...): numbers as doubles, logical values as booleans, all else as text; blanks are null."""
    spark.dataSource.register(AttributesSource)
    return spark.read.format("shapefile_attributes").options(**options).load(path)
