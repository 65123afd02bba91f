import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.sources import grids, netcdf

CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "u1": 7, "u2": 8, "u4": 9, "i8": 10, "u8": 11}


def write(path, version, dims, variables, records=None):
    """A plain writer: dims {name: size, None for records}, variables [(name, dims, array, attributes)]."""
    wide = ">Q" if version == 5 else ">I"
    number = lambda n: struct.pack(wide, n)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: number(len(s.encode())) + pad(s.encode())
    names = list(dims)

    def attributes(given):
        out = struct.pack(">I", 12 if given else 0) + number(len(given))
        for name, value in given.items():
            array = np.frombuffer(value.encode(), "S1") if isinstance(value, str) else np.atleast_1d(value)
            code = array.dtype.str[1:]
            out += text(name) + struct.pack(">I", CODES[code]) + number(len(array)) + pad(array.astype(array.dtype.newbyteorder(">")).tobytes())
        return out

    def head(begins):
        out = b"CDF" + bytes([version]) + number(records or 0) + struct.pack(">I", 10) + number(len(dims))
        for name, size in dims.items():
            out += text(name) + number(size or 0)
        out += attributes({"title": "plain"}) + struct.pack(">I", 11) + number(len(variables))
        for (name, own, array, given), begin in zip(variables, begins, strict=True):
            out += text(name) + number(len(own)) + b"".join(number(names.index(d)) for d in own) + attributes(given)
            out += struct.pack(">I", CODES[array.dtype.str[1:]]) + number(0) + struct.pack(">I" if version == 1 else ">Q", begin)
        return out

    raw = [a.astype(a.dtype.newbyteorder(">")) for _, _, a, _ in variables]
    recorded = [bool(own) and dims[own[0]] is None for _, own, _, _ in variables]
    alone = sum(recorded) == 1
    at, begins = len(head([0] * len(variables))), []
    fixed = b""
    for r, is_record in zip(raw, recorded, strict=True):
        begins.append(None if is_record else at + len(fixed))
        fixed += b"" if is_record else pad(r.tobytes())
    start, steps = at + len(fixed), [[(r[k : k + 1].tobytes() if alone else pad(r[k : k + 1].tobytes())) for k in range(len(r))] if is_record else None for r, is_record in zip(raw, recorded, strict=True)]
    for k, own in enumerate(steps):
        if own is not None:
            begins[k] = start
            start += len(own[0]) if own else 0
    body = b"".join(own[t] for t in range(records or 0) for own in steps if own is not None)
    with open(path, "wb") as file:
        file.write(head(begins) + fixed + body)
    return str(path)


DAYS, LAT, LON = 7, np.array([31.5, 31.0, 30.5, 30.0], "f4"), np.array([100.0, 100.25, 100.5], "f4")


def cube(seed=1):
    return np.random.default_rng(seed).normal(0, 10, (DAYS, len(LAT), len(LON))).astype("f4")


def sample(path, version, unlimited):
    values = cube()
    values[2, 1, 1], values[3, 0, 2] = np.nan, netcdf.DEFAULT_FILL[5]
    dims = {"time": None if unlimited else DAYS, "bnds": 2, "lat": 4, "lon": 3}
    hours = np.arange(DAYS, dtype="f8") * 24 + 12
    variables = [
        ("time", ("time",), hours, {"units": "hours since 1961-01-01 00:00:00", "calendar": "standard"}),
        ("time_bnds", ("time", "bnds"), np.zeros((DAYS, 2), "f8"), {}),
        ("flag", ("time",), np.arange(DAYS, dtype="i2"), {}),
        ("lat", ("lat",), LAT, {"units": "degrees_north"}),
        ("lon", ("lon",), LON, {}),
        ("pre", ("time", "lat", "lon"), values, {"long_name": "rain"}),
    ]
    return write(path, version, dims, variables, DAYS if unlimited else None), values


def rows(values):
    """(t, lat_idx, lon_idx): value with latitude ascending; gaps None."""
    up = values[:, ::-1].astype(float)
    gap = lambda x: None if np.isnan(x) or x == float(netcdf.DEFAULT_FILL[5]) else float(x)
    return {(t, i, j): gap(up[t, i, j]) for t in range(up.shape[0]) for i in range(up.shape[1]) for j in range(up.shape[2])}


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("unlimited", [True, False])
def test_a_file_gives_the_panel_of_its_long_table(spark, tmp_path, version, unlimited):
    path, values = sample(tmp_path / "a.nc", version, unlimited)
    got = netcdf.read(spark, path, rule="precipitation", partition_bytes=100)
    assert got.rdd.getNumPartitions() == 4  # two days of 48 bytes each
    found = got.collect()
    assert {(r.t, r.lat_idx, r.lon_idx): r.value for r in found} == rows(values) and len(found) == values.size
    assert {r.time for r in found} == {datetime.datetime(1961, 1, 1, 12) + datetime.timedelta(t) for t in range(DAYS)}
    grid, panel = netcdf.scan(spark, path, rule="precipitation")
    table = got.select("time", "lat", "lon", F.col("value").alias("pre"))
    want_grid, want = grids.to_panel(table)
    assert sorted(grid.collect()) == sorted(want_grid.collect())
    assert sorted(map(str, panel.collect())) == sorted(map(str, want.collect()))


def test_only_what_is_bounded_is_read(spark, tmp_path):
    path, values = sample(tmp_path / "a.nc", 2, True)
    some = netcdf.read(spark, path, partition_bytes=48, t_from=2, t_to=5, north=30.5, west=100.2, east=100.25)
    assert some.rdd.getNumPartitions() == 2  # two southern rows are 24 bytes
    want = {k: v for k, v in rows(values).items() if 2 <= k[0] < 5 and k[1] <= 1 and k[2] == 1}
    assert {(r.t, r.lat_idx, r.lon_idx): r.value for r in some.collect()} == want
    table = netcdf.read(spark, path, partition_bytes=48)
    assert table.where("lat > 90").count() == 0 and table.where("t IN (1, 3) OR lat > 31").count() == 2 * 12 + 5 * 3
    assert netcdf.read(spark, path, t_from=100).count() == 0 == netcdf.read(spark, path, south=90).count()
    reader, ranges = netcdf.NetCDFReader({"path": path, "partition_bytes": "48", "north": "30.5", "t_from": "4", "t_to": "5"}), []
    plain = netcdf.opened

    def watched(name):
        read_at, close = plain(name)
        return (lambda at, size: ranges.append((at, size)) or read_at(at, size)), close

    netcdf.opened = watched
    try:
        (part,) = reader.partitions()
        assert sum(b.num_rows for b in reader.read(part)) == 6
    finally:
        netcdf.opened = plain
    header = reader.grid.header
    begin = header.place(reader.grid.variable, 4)
    assert ranges == [(begin + 2 * 12, 24)]  # the two southern rows, which the file has last


def test_the_widest_variable_and_the_first_level(spark, tmp_path):
    values = np.random.default_rng(4).integers(-500, 500, (DAYS, 2, 3, 4, 3)).astype("i2")
    values[0, 0, 0, 0, 0], values[1, 0, 0, 2, 1] = -999, -999
    variables = [
        ("valid_time", ("time",), np.arange(DAYS, dtype="i4"), {"units": "days since 2000-02-27"}),
        ("time", ("time",), np.arange(DAYS, dtype="i4"), {"units": "days since 2000-02-27"}),
        ("expver", ("expver",), np.array([5, 1], "i4"), {}),
        ("level", ("level",), np.array([850, 500, 200], "i4"), {}),
        ("latitude", ("latitude",), LAT[::-1].copy(), {}),
        ("longitude", ("longitude",), LON, {}),
        ("surface", ("time", "latitude", "longitude"), np.zeros((DAYS, 4, 3), "f4"), {}),
        ("w", ("time", "expver", "level", "latitude", "longitude"), values, {"scale_factor": np.array([0.5], "f8"), "add_offset": np.array([10.0], "f8"), "_FillValue": np.array([-999], "i2")}),
        ("later", ("time", "expver", "level", "latitude", "longitude"), values, {}),
        ("w_bnds", ("time", "expver", "level", "latitude", "longitude", "bnds"), np.zeros((DAYS, 2, 3, 4, 3, 2), "f4"), {}),
    ]
    dims = {"time": None, "expver": 2, "level": 3, "latitude": 4, "longitude": 3, "bnds": 2}
    path = write(tmp_path / "b.nc", 5, dims, variables, DAYS)
    got = {(r.t, r.lat_idx, r.lon_idx): r.value for r in netcdf.read(spark, path).collect()}
    assert got == {(t, i, j): None if x == -999 else x * 0.5 + 10 for (t, i, j), x in np.ndenumerate(values[:, 0, 0])}
    assert netcdf.read(spark, path, variable="surface").agg(F.sum("value")).first()[0] == 0
    with pytest.raises(Exception, match="no variable"):
        netcdf.read(spark, path, variable="none").count()


def test_longitude_before_latitude(spark, tmp_path):
    values = cube(9)
    variables = [("time", ("time",), np.arange(DAYS, dtype="i4"), {"units": "days since 2001-01-01"}), ("lat", ("lat",), LAT, {}), ("lon", ("lon",), LON, {}), ("x", ("time", "lon", "lat"), values.transpose(0, 2, 1).copy(), {})]
    path = write(tmp_path / "c.nc", 1, {"time": DAYS, "lon": 3, "lat": 4}, variables)
    got = netcdf.read(spark, path).where("lat_idx >= 2")
    assert {(r.t, r.lat_idx, r.lon_idx): r.value for r in got.collect()} == {k: v for k, v in rows(values).items() if k[1] >= 2}


def test_files_that_do_not_fit_are_refused(tmp_path):
    path, _ = sample(tmp_path / "a.nc", 1, True)
    data = open(path, "rb").read()
    for name, broken in (("kind", b"HDF" + data[3:]), ("short", data[:60])):
        (tmp_path / name).write_bytes(broken)
        with pytest.raises(ValueError):
            netcdf.NetCDFReader({"path": str(tmp_path / name)})
    with pytest.raises(ValueError, match="calendar"):
        netcdf.times(np.arange(2), "days since 2000-01-01", "noleap")
    with pytest.raises(ValueError, match="units"):
        netcdf.times(np.arange(2), "months since 2000-01-01")
    assert netcdf.times(np.array([1.5]), "days since 2000-02-28 6:30:00")[0] == np.datetime64("2000-02-29T18:30:00")
