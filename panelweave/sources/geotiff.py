"""GeoTIFF rasters as a Spark data source: read by blocks, written as tiles that a commit lists in one mosaic."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from panelweave.sources.netcdf import ReadAt, opened

# Fixed values of the format: sizes of field types, and the tags that are read and written.
FIELD = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 5: "u8", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
NONE, DEFLATE = 1, (8, 32946)
#: Geographic coordinates, a pixel is an area, WGS 84.
KEYS = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
#: Bytes of blocks that a task reads, about, and the side of a tile that is written.
PARTITION_BYTES, TILE = 16 << 20, 256
PIXELS = "raster_row int, raster_col int, lon double, lat double, value double"
MOSAIC = "mosaic.vrt"


class Raster:
    """Layout of the first image of a file: size, blocks, sample type, place on the globe, and the value that stands for none."""

    def __init__(self, read_at: ReadAt):
        head = read_at(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if not self.order:
            raise ValueError("this is no TIFF")
        (version,) = struct.unpack_from(self.order + "H", head, 2)
        if version not in (42, 43):
            raise ValueError("this is no TIFF")
        self.big = version == 43
        (at,) = struct.unpack_from(self.order + ("Q" if self.big else "I"), head, 8 if self.big else 4)
        tags = self._tags(read_at, at)
        one = lambda tag, default: int(tags[tag][0]) if tag in tags else default
        self.width, self.height = one(WIDTH, 0), one(HEIGHT, 0)
        self.samples, self.planar, self.predictor, self.compression = one(SAMPLES, 1), one(PLANAR, 1), one(PREDICTOR, 1), one(COMPRESSION, NONE)
        if self.compression not in (NONE, *DEFLATE) or self.predictor not in (1, 2, 3):
            raise ValueError(f"compression {self.compression} with predictor {self.predictor} is not read")
        self.kind = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[one(SAMPLE_FORMAT, 1)] }{one(BITS, 8) // 8}")
        tiled = TILE_OFFSETS in tags
        self.block_width, self.block_height = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (self.width, min(one(STRIP_ROWS, self.height), self.height))
        self.across = -(-self.width // self.block_width)
        blocks = self.across * -(-self.height // self.block_height)
        self.offsets, self.sizes = (tags[t].astype(np.int64)[:blocks] for t in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
        self.padded = tiled
        if TRANSFORM in tags:
            m = tags[TRANSFORM]
            if m[1] or m[4]:
                raise ValueError("a turned raster")
            self.west, self.north, self.dx, self.dy = m[3], m[7], m[0], -m[5]
        else:
            scale, tie = tags.get(PIXEL_SCALE, np.array([1.0, 1.0, 0.0])), tags.get(TIE_POINT, np.zeros(6))
            self.dx, self.dy = scale[0], scale[1]
            self.west, self.north = tie[3] - tie[0] * self.dx, tie[4] + tie[1] * self.dy
        keys = tags.get(GEO_KEYS, np.zeros(0)).tolist()
        if any(keys[k : k + 1] == [1024] and keys[k + 3] == 1 for k in range(4, len(keys) - 3, 4)):
            raise ValueError("coordinates are projected; bring them to longitude and latitude first")
        told = tags[NO_DATA].tobytes().split(b"\0")[0].decode().strip() if NO_DATA in tags else ""
        self.no_data = float(told) if told else None

    def _tags(self, read_at: ReadAt, at: int) -> dict[int, np.ndarray]:
        width, count, size = (8, "Q", 20) if self.big else (4, "H", 12)
        lead = 8 if self.big else 2
        (n,) = struct.unpack(self.order + count, read_at(at, lead))
        body, out = read_at(at + lead, n * size), {}
        for k in range(n):
            tag, field, values = struct.unpack_from(f"{self.order}HH{'Q' if self.big else 'I'}", body, k * size)
            if field not in FIELD:
                continue
            kind = np.dtype(self.order + FIELD[field] if FIELD[field] != "S1" else "S1")
            inner = k * size + 4 + width
            data = body[inner : inner + width]
            if values * kind.itemsize > width:
                (place,) = struct.unpack(self.order + ("Q" if self.big else "I"), data)
                data = read_at(place, values * kind.itemsize)
            out[tag] = np.frombuffer(data, kind, values)
        return out

    def block(self, read_at: ReadAt, k: int) -> tuple[int, int, np.ndarray]:
        """(first row, first column, values of the first band), cut to the image; a block of no bytes is empty."""
        row, column = k // self.across * self.block_height, k % self.across * self.block_width
        height = self.block_height if self.padded else min(self.block_height, self.height - row)
        bands = self.samples if self.planar == 1 else 1
        shape = (height, self.block_width, bands)
        if not self.sizes[k]:
            values = np.full(shape, np.nan if self.no_data is None else self.no_data)
        else:
            data = read_at(int(self.offsets[k]), int(self.sizes[k]))
            data = zlib.decompress(data) if self.compression in DEFLATE else data
            if self.predictor == 3:  # differences of bytes, the most significant bytes of a row first
                planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(height, -1, bands), axis=1, dtype=np.uint8).reshape(height, self.kind.itemsize, -1)
                values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.kind.newbyteorder(">")).reshape(shape)
            else:
                values = np.frombuffer(data, self.kind, int(np.prod(shape))).reshape(shape)
                if self.predictor == 2:
                    values = np.cumsum(values, axis=1, dtype=self.kind.newbyteorder("="))
        return row, column, values[: self.height - row, : self.width - column, 0].astype(float)


@dataclass
class Blocks(InputPartition):
    """Blocks of one file."""

    path: str
    blocks: list[int]


def _files(path: str) -> list[str]:
    """The file, or the tiles that the mosaic of a folder lists."""
    if path.lower().endswith((".tif", ".tiff")):
        return [path]
    read_at, close = opened(f"{path.rstrip('/')}/{MOSAIC}")
    text = read_at(0, 1 << 30).decode()
    close()
    return [f"{path.rstrip('/')}/{name}" for name in re.findall(r"<SourceFilename[^>]*>([^<]+)</SourceFilename>", text)]


def _size(path: str) -> tuple[int, int, float, float] | None:
    """Width, height, west and north of a folder's mosaic."""
    if path.lower().endswith((".tif", ".tiff")):
        return None
    read_at, close = opened(f"{path.rstrip('/')}/{MOSAIC}")
    text = read_at(0, 1 << 30).decode()
    close()
    west, _, _, north, _, _ = map(float, re.search(r"<GeoTransform>([^<]+)</GeoTransform>", text)[1].split(","))
    return int(re.search(r'rasterXSize="(\d+)"', text)[1]), int(re.search(r'rasterYSize="(\d+)"', text)[1]), west, north


class PixelsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))
        self.whole = _size(self.path)

    def partitions(self) -> list[Blocks]:
        out = []
        for name in _files(self.path):
            read_at, close = opened(name)
            raster = Raster(read_at)
            close()
            n = max(1, self.size // (raster.block_width * raster.block_height * raster.kind.itemsize))
            out += [Blocks(name, list(range(k, min(k + n, len(raster.offsets))))) for k in range(0, len(raster.offsets), n)]
        return out

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        read_at, close = opened(partition.path)
        try:
            raster = Raster(read_at)
            top, left = 0, 0
            if self.whole:  # a tile's place in the mosaic
                left, top = round((raster.west - self.whole[2]) / raster.dx), round((self.whole[3] - raster.north) / raster.dy)
            for k in partition.blocks:
                row, column, values = raster.block(read_at, k)
                rows, columns = (a.ravel() for a in np.indices(values.shape))
                value = values.ravel()
                gap = np.isnan(value)
                if raster.no_data is not None and not np.isnan(raster.no_data):
                    gap |= np.isclose(value, raster.no_data)
                lon, lat = raster.west + (column + columns + 0.5) * raster.dx, raster.north - (row + rows + 0.5) * raster.dy
                arrays = [pa.array((top + row + rows).astype(np.int32)), pa.array((left + column + columns).astype(np.int32)), pa.array(lon), pa.array(lat), pa.array(value, mask=gap)]
                yield pa.RecordBatch.from_arrays(arrays, names=["raster_row", "raster_col", "lon", "lat", "value"])
        finally:
            close()


def encode(values: np.ndarray, west: float, north: float, dx: float, dy: float) -> bytes:
    """A file of one tile: float32, deflated, WGS 84, NaN for none."""
    height, width = values.shape
    data = zlib.compress(values.astype("<f4").tobytes())
    geo = {PIXEL_SCALE: ("f8", [dx, dy, 0.0]), TIE_POINT: ("f8", [0.0, 0.0, 0.0, west, north, 0.0]), GEO_KEYS: ("u2", KEYS), NO_DATA: ("S1", b"nan\0")}
    plain = {WIDTH: width, HEIGHT: height, BITS: 32, COMPRESSION: 8, PHOTOMETRIC: 1, STRIP_OFFSETS: 0, SAMPLES: 1, STRIP_ROWS: height, STRIP_BYTES: len(data), PLANAR: 1, SAMPLE_FORMAT: 3}
    entries = {t: ("u4", [v]) for t, v in plain.items()} | geo
    codes = {"u4": 4, "u2": 3, "f8": 12, "S1": 2}
    begin = 8 + 2 + 12 * len(entries) + 4
    extra, heads = b"", b""
    for tag in sorted(entries):
        kind, values_ = entries[tag]
        raw = values_ if kind == "S1" else np.array(values_, "<" + kind).tobytes()
        n = len(raw) // np.dtype(kind).itemsize
        if tag == STRIP_OFFSETS:
            raw = b"????"
        if len(raw) > 4:
            heads += struct.pack("<HHII", tag, codes[kind], n, begin + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            heads += struct.pack("<HHI4s", tag, codes[kind], n, raw)
    heads = heads.replace(b"????", struct.pack("<I", begin + len(extra)))
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(entries)) + heads + b"\0" * 4 + extra + data


@dataclass
class Written(WriterCommitMessage):
    """(name, first row, first column, height, width) of each tile of a task."""

    tiles: list[tuple[str, int, int, int, int]]


class TilesWriter(DataSourceArrowWriter):
    """A task writes a file for each tile it has, under a name of its own attempt; the commit lists the tiles of the tasks that count.

    Files of attempts that failed are never listed; an abort removes those it is told of. A run that is repeated writes
    new files and replaces the list at once.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.width, self.height, self.tile = int(options["width"]), int(options["height"]), int(options.get("tile", TILE))
        self.west, self.north, self.dx, self.dy = (float(options[k]) for k in ("west", "north", "dx", "dy"))
        self.store, self.folder = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        if not overwrite and self.store.get_file_info(f"{self.folder}/{MOSAIC}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} has a raster")
        self.store.create_dir(self.folder, recursive=True)

    def _put(self, name: str, data: bytes) -> None:
        with self.store.open_output_stream(f"{self.folder}/{name}") as out:
            out.write(data)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        tiles, at, values = [], None, None

        def finish() -> None:
            if at is None:
                return
            row, column = at[0] * self.tile, at[1] * self.tile
            name = f"tile-{at[0]}-{at[1]}-{uuid.uuid4().hex}.tif"
            self._put(name, encode(values, self.west + column * self.dx, self.north - row * self.dy, self.dx, self.dy))
            tiles.append((name, row, column, *values.shape))

        for batch in iterator:
            row, column, value = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("raster_row", "raster_col", "value"))
            own = row // self.tile * (self.width + 1) + column // self.tile
            for first, last in zip(starts := np.flatnonzero(np.append(True, own[1:] != own[:-1])), np.append(starts[1:], len(own)), strict=True):
                where = (int(row[first]) // self.tile, int(column[first]) // self.tile)
                if where != at:
                    finish()
                    at = where
                    values = np.full((min(self.tile, self.height - at[0] * self.tile), min(self.tile, self.width - at[1] * self.tile)), np.nan)
                values[row[first:last] - at[0] * self.tile, column[first:last] - at[1] * self.tile] = value[first:last].astype(float)
        finish()
        return Written(tiles)

    def commit(self, messages: list[Written | None]) -> None:
        tiles = sorted((t for m in messages if m for t in m.tiles), key=lambda t: t[1:3])
        if len({t[1:3] for t in tiles}) < len(tiles):
            self.abort(messages)
            raise ValueError("a tile was dealt to several tasks")
        source = '<SimpleSource><SourceFilename relativeToVRT="1">{}</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="0" yOff="0" xSize="{w}" ySize="{h}"/><DstRect xOff="{}" yOff="{}" xSize="{w}" ySize="{h}"/></SimpleSource>'
        body = "\n".join(source.format(name, column, row, w=w, h=h) for name, row, column, h, w in tiles)
        place = ", ".join(map(repr, (self.west, self.dx, 0.0, self.north, 0.0, -self.dy)))
        text = f'<VRTDataset rasterXSize="{self.width}" rasterYSize="{self.height}">\n<SRS>EPSG:4326</SRS>\n<GeoTransform>{place}</GeoTransform>\n<VRTRasterBand dataType="Float32" band="1"><NoDataValue>nan</NoDataValue>\n{body}\n</VRTRasterBand>\n</VRTDataset>\n'
        self._put(MOSAIC + ".new", text.encode())
        self.store.move(f"{self.folder}/{MOSAIC}.new", f"{self.folder}/{MOSAIC}")

    def abort(self, messages: list[Written | None]) -> None:
        for name in (t[0] for m in messages if m for t in m.tiles):
            self.store.delete_file(f"{self.folder}/{name}")


class GeoTiffSource(DataSource):
    """``geotiff``: reads a ``.tif`` or a folder with a mosaic, writes a folder. Options: ``path``; for writing the raster's ``width``, ``height``, ``west``, ``north``, ``dx``, ``dy``, ``tile``."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> PixelsReader:
        return PixelsReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TilesWriter:
        return TilesWriter(dict(self.options), overwrite)


def read_raster(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(raster_row, raster_col, lon, lat, value): pixels of the first band with their centres, rows from the north; values that stand for none are null.

    Plain and deflated strips and tiles are read, of TIFF and BigTIFF; a task reads some of the blocks. Pixels of a
    mosaic that no tile has are no rows.
    """
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format("geotiff").options(**options).load(path)


def write_raster(values: DataFrame, grid: DataFrame, path: str, tile: int = TILE) -> str:
    """(node_id, value) of the cells of a grid as a raster, rows from the north, in tiles that tasks write by themselves.

    The outer bounds are half a cell beyond the outermost centres; grids have two rows and columns at least, evenly
    spaced. Cells without a value are NaN. A raster that was there is replaced.
    """
    spark = values.sparkSession
    spark.dataSource.register(GeoTiffSource)
    b = grid.agg(F.max("lat_idx").alias("rows"), F.max("lon_idx").alias("columns"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")).first()
    if not (b.rows and b.columns):
        raise ValueError("a raster needs two rows and two columns")
    dy, dx = (b.n - b.s) / b.rows, (b.e - b.w) / b.columns
    placed = grid.join(values.select("node_id", F.col("value").cast("double").alias("value")), "node_id", "left")
    pixels = placed.select((F.lit(b.rows) - F.col("lat_idx")).cast("int").alias("raster_row"), F.col("lon_idx").cast("int").alias("raster_col"), "lon", "lat", "value")
    across = b.columns // tile + 1
    number = F.floor(F.col("raster_row") / tile) * across + F.floor(F.col("raster_col") / tile)
    tasks = max(1, min(across * (b.rows // tile + 1), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = pixels.repartition(tasks, number).sortWithinPartitions(number)
    options = {"width": b.columns + 1, "height": b.rows + 1, "west": b.w - dx / 2, "north": b.n + dy / 2, "dx": dx, "dy": dy, "tile": tile}
    dealt.write.format("geotiff").mode("overwrite").options(**options).save(path)
    return path
