import glob
import struct
import zlib

import numpy as np
import pytest

from panelweave.sources import geotiff

NORTH, WEST, DX, DY = 35.125, 99.875, 0.25, 0.5


def write(path, values, order="<", big=False, tile=None, rows=None, compression=1, predictor=1, no_data=None, planar=1, keys=geotiff.KEYS):
    """A plain writer of bands (band, row, column) in strips or tiles."""
    bands, height, width = values.shape
    kind = values.dtype.newbyteorder(order)
    blocks = []
    th, tw = (tile, tile) if tile else (rows or height, width)
    for group in [values] if planar == 1 else [values[b : b + 1] for b in range(bands)]:
        for r in range(0, height, th):
            for c in range(0, width, tw):
                part = group[:, r : r + th, c : c + tw]
                if tile:
                    part = np.pad(part, ((0, 0), (0, th - part.shape[1]), (0, tw - part.shape[2])))
                part = part.transpose(1, 2, 0)
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                data = part.astype(kind).tobytes()
                if predictor == 3:
                    h, w, b = part.shape
                    planes = np.frombuffer(part.astype(part.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(h, w * b, -1).transpose(0, 2, 1).reshape(h, -1, b)
                    data = np.diff(planes, axis=1, prepend=np.zeros((h, 1, b), np.uint8)).astype(np.uint8).tobytes()
                blocks.append(zlib.compress(data) if compression != 1 else data)
    codes = {"B": 1, "H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
    where, size = ("Q", 20) if big else ("I", 12)
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [kind.itemsize * 8] * bands), (259, "H", [compression]), (262, "H", [1]), (277, "H", [bands]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [{"f": 3, "i": 2, "u": 1}[kind.kind]] * bands)]
    tags += [(33550, "d", [DX, DY, 0.0]), (33922, "d", [0.0, 0.0, 0.0, WEST, NORTH, 0.0]), (34735, "H", list(keys))]
    tags += [(42113, "s", str(no_data).encode() + b"\0")] if no_data is not None else []
    tags += [(322, "H", [tw]), (323, "H", [th]), (324, where, None), (325, where, [len(b) for b in blocks])] if tile else [(278, "I", [th]), (273, where, None), (279, where, [len(b) for b in blocks])]
    lead = (16 + 8 if big else 8 + 2) + size * len(tags) + (8 if big else 4)
    lengths = {t: len(v) if k == "s" else struct.calcsize(order + k) * (len(blocks) if v is None else len(v)) for t, k, v in tags}
    inline = 8 if big else 4
    extra_size = sum(n + n % 2 for n in lengths.values() if n > inline)
    starts = [lead + extra_size + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    heads, extra = b"", b""
    for tag, k, v in sorted(tags):
        raw = v if k == "s" else struct.pack(f"{order}{len(v if v is not None else starts)}{k}", *(v if v is not None else starts))
        n = len(raw) if k == "s" else len(raw) // struct.calcsize(order + k)
        heads += struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, codes[k], n)
        if len(raw) > inline:
            heads += struct.pack(order + ("Q" if big else "I"), lead + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            heads += raw.ljust(inline, b"\0")
    mark = {"<": b"II", ">": b"MM"}[order]
    first = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 16) + struct.pack(order + "Q", len(tags)) if big else struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags)))
    with open(path, "wb") as file:
        file.write(first + heads + b"\0" * (8 if big else 4) + extra + b"".join(blocks))
    return str(path)


VALUES = np.random.default_rng(2).normal(0, 100, (2, 37, 53)).astype("f4")
VALUES[0, 3, 4], VALUES[0, 36, 52], VALUES[0, 0, 0] = -9999, np.nan, -9999

CASES = {
    "strips": {"rows": 5},
    "one strip": {},
    "big-endian tiles": {"order": ">", "tile": 16},
    "BigTIFF tiles, deflated": {"big": True, "tile": 16, "compression": 8},
    "deflated differences of bytes": {"rows": 7, "compression": 32946, "predictor": 3},
    "separate bands": {"rows": 10, "planar": 2, "compression": 8},
}


@pytest.mark.parametrize("name", CASES)
def test_rasters_are_read_by_blocks(spark, tmp_path, name):
    path = write(tmp_path / "a.tif", VALUES, no_data=-9999, **CASES[name])
    rows = geotiff.read_raster(spark, path, partition_bytes=3000).collect()
    want = {(r, c): None if np.isnan(v) or v == -9999 else float(v) for (r, c), v in np.ndenumerate(VALUES[0])}
    assert {(x.raster_row, x.raster_col): x.value for x in rows} == want and len(rows) == len(want)
    assert all(x.lon == pytest.approx(WEST + (x.raster_col + 0.5) * DX) and x.lat == pytest.approx(NORTH - (x.raster_row + 0.5) * DY) for x in rows)
    if name != "one strip":
        assert geotiff.read_raster(spark, path, partition_bytes=3000).rdd.getNumPartitions() > 1


def test_whole_numbers_with_differences(spark, tmp_path):
    values = np.random.default_rng(3).integers(-30000, 30000, (1, 20, 30)).astype("i2")
    path = write(tmp_path / "a.tif", values, predictor=2, rows=6, compression=8)
    assert {(x.raster_row, x.raster_col): x.value for x in geotiff.read_raster(spark, path).collect()} == {k: float(v) for k, v in np.ndenumerate(values[0])}


def test_what_is_not_read_is_refused(tmp_path):
    for name, change, message in (("lzw", {"compression": 5}, "compression 5"), ("projected", {"keys": (1, 1, 0, 1, 1024, 0, 1, 1)}, "projected")):
        path = write(tmp_path / f"{name}.tif", VALUES, **change)
        with pytest.raises(ValueError, match=message):
            geotiff.Raster(geotiff.opened(path)[0])
    (tmp_path / "b.tif").write_bytes(b"GIF89a" + b"\0" * 40)
    with pytest.raises(ValueError, match="no TIFF"):
        geotiff.PixelsReader({"path": str(tmp_path / "b.tif")}).partitions()


def cells(spark, height=11, width=7):
    rows = [(i * width + j, i, j, 20 + 0.5 * i, 100 + 0.25 * j) for i in range(height) for j in range(width)]
    return spark.createDataFrame(rows, "node_id long, lat_idx int, lon_idx int, lat double, lon double")


def test_a_raster_is_written_in_tiles_and_read_back(spark, tmp_path):
    grid = cells(spark)
    values = grid.where("node_id % 5 <> 0").selectExpr("node_id", "node_id * 0.5 AS value")
    path = str(tmp_path / "out")
    for _ in range(2):  # a second run replaces the first
        geotiff.write_raster(values, grid, path, tile=4)
    rows = geotiff.read_raster(spark, path).collect()
    got = {(10 - r.raster_row) * 7 + r.raster_col: r.value for r in rows}
    assert got == {n: None if n % 5 == 0 else n * 0.5 for n in range(77)} and len(rows) == 77
    place = {(r.node_id): (r.lon, r.lat) for r in grid.collect()}
    assert all((r.lon, r.lat) == pytest.approx(place[(10 - r.raster_row) * 7 + r.raster_col]) for r in rows)
    # bounds are half a cell beyond the outermost centres; each tile is a file of its own with its own place
    vrt = (tmp_path / "out" / "mosaic.vrt").read_text()
    assert "<GeoTransform>99.875, 0.25, 0.0, 25.25, 0.0, -0.5</GeoTransform>" in vrt and vrt.count("<SimpleSource>") == 6
    listed = [f"{path}/{n}" for n in {line.split(">")[2].split("<")[0] for line in vrt.splitlines() if "SourceFilename" in line}]
    assert len(listed) == 6 and len(glob.glob(f"{path}/tile-*")) == 12
    one = geotiff.Raster(geotiff.opened(next(n for n in listed if "/tile-1-1-" in n))[0])
    assert (one.width, one.height, one.west, one.north, one.compression) == (3, 4, 99.875 + 4 * 0.25, 25.25 - 4 * 0.5, 8) and np.isnan(one.no_data)
    with pytest.raises(ValueError, match="two rows"):
        geotiff.write_raster(values, cells(spark, 1), path)


def test_a_failed_write_lists_nothing_and_takes_its_tiles_back(tmp_path):
    import pyarrow as pa

    options = {"path": str(tmp_path / "r"), "width": 8, "height": 4, "west": 0, "north": 4, "dx": 1, "dy": 1, "tile": 4}
    writer = geotiff.TilesWriter(options, False)
    batch = lambda columns: pa.RecordBatch.from_pydict({"raster_row": [0] * len(columns), "raster_col": columns, "value": [1.0] * len(columns)})
    first, again = writer.write(iter([batch([0, 1]), batch([2, 5])])), writer.write(iter([batch([6])]))
    assert [t[1:] for t in first.tiles] == [(0, 0, 4, 4), (0, 4, 4, 4)]
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([first, again])
    assert not list((tmp_path / "r").glob("*"))
    done = writer.write(iter([batch([0]), batch([7])]))
    writer.commit([done, None])
    assert (tmp_path / "r" / "mosaic.vrt").exists()
    with pytest.raises(FileExistsError):
        geotiff.TilesWriter(options, False)
