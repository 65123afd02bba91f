import random
import struct

import pytest
from pyspark.sql import functions as F

from panelweave.operators import spatial
from panelweave.sources import shapefile

SQUARE = lambda x, y, w=1.0: [(x, y), (x, y + w), (x + w, y + w), (x + w, y)]  # noqa: E731  clockwise
HOLE = lambda x, y, w: SQUARE(x, y, w)[::-1]


def write(stem, shapes, fields, rows, kind=5, projection=None):
    """A plain writer: shapes as lists of open rings (None for a null shape), fields as (name, kind, width)."""
    records = []
    for rings in shapes:
        if rings is None:
            records.append(struct.pack("<i", 0))
            continue
        closed = [[*r, r[0]] for r in rings]
        points, starts, n = [p for r in closed for p in r], [], 0
        for r in closed:
            starts.append(n)
            n += len(r)
        box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
        body = struct.pack("<i4d2i", kind, *box, len(closed), n) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        if kind == 15:
            body += struct.pack("<2d", 0, 0) + struct.pack(f"<{n}d", *[7.0] * n)
        records.append(body)
    main, index, at = b"", b"", 50
    for k, r in enumerate(records):
        head = struct.pack(">2i", k + 1, len(r) // 2)
        main += head + r
        index += struct.pack(">2i", at, len(r) // 2)
        at += 4 + len(r) // 2
    head = lambda size: struct.pack(">i20xi", 9994, (100 + size) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    open(f"{stem}.shp", "wb").write(head(len(main)) + main)
    open(f"{stem}.shx", "wb").write(head(len(index)) + index)
    layout = b"".join(struct.pack("<11sc4xBB14x", name.encode(), k.encode(), width, 0) for name, k, width in fields)
    size = 1 + sum(w for *_, w in fields)
    body = b"".join(b" " + b"".join(str(v).encode().ljust(w)[:w] for v, (_, _, w) in zip(row, fields, strict=True)) for row in rows)
    open(f"{stem}.dbf", "wb").write(struct.pack("<B3sIHH20x", 3, b"\0\0\0", len(rows), 33 + len(layout), size) + layout + b"\r" + body + b"\x1a")
    if projection:
        open(f"{stem}.prj", "w").write(projection)
    return f"{stem}.shp"


SHAPES = [[SQUARE(0, 0, 4), HOLE(1, 1, 2)], [SQUARE(4, 0, 4)], None, [SQUARE(20, 0), SQUARE(22, 0)], [SQUARE(3, 3, 2)]]
FIELDS = [("NAME", "C", 12), ("AREA", "N", 9), ("LAND", "L", 1)]
ROWS = [("Ä one", "12.5", "T"), ("two", "", "F"), ("", "-3", "?"), ("four", "4", "Y"), ("five", "*****", "n")]


@pytest.mark.parametrize("kind", [5, 15])
def test_shapes_and_attributes_are_read_in_ranges_of_records(spark, tmp_path, kind):
    path = write(str(tmp_path / "a"), SHAPES, FIELDS, ROWS, kind, 'GEOGCS["GCS_WGS_1984"]')
    rings = shapefile.read_rings(spark, path, partition_bytes=200)
    assert rings.rdd.getNumPartitions() >= 3
    want = [(s, r, k, float(x), float(y)) for s, shape in enumerate(SHAPES) for r, ring in enumerate(shape or []) for k, (x, y) in enumerate(ring)]
    assert sorted(map(tuple, rings.collect())) == want
    told = sorted(map(tuple, shapefile.read_attributes(spark, path, partition_bytes=30).collect()))
    assert told == [(0, False, "Ä one", 12.5, True), (1, False, "two", None, False), (2, False, None, -3.0, None), (3, False, "four", 4.0, True), (4, False, "five", None, False)]


def test_what_is_no_polygon_file_is_refused(spark, tmp_path):
    path = write(str(tmp_path / "a"), SHAPES, FIELDS, ROWS, projection='PROJCS["Albers", GEOGCS["x"]]')
    with pytest.raises(ValueError, match="projected"):
        shapefile.RingsReader({"path": path})
    path = write(str(tmp_path / "b"), [[SQUARE(0, 0)]], FIELDS, ROWS[:1], kind=3)
    with pytest.raises(ValueError, match="kind 3"):
        list(shapefile.parse_records(open(path, "rb").read()[100:], 0))
    (tmp_path / "c.shp").write_bytes(b"\0" * 100)
    with pytest.raises(ValueError, match="no shapefile"):
        shapefile.RingsReader({"path": str(tmp_path / "c.shp")})


def in_any(x, y):
    def parity(shape):
        inside = False
        for ring in shape or []:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (y1 > y) != (y2 > y) and x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1:
                    inside = not inside
        return inside

    return any(map(parity, SHAPES))


def test_shapes_that_overlap_are_united(spark, tmp_path):
    sides = spatial.polygon_edges(shapefile.read_rings(spark, write(str(tmp_path / "a"), SHAPES, FIELDS, ROWS)))
    rng = random.Random(3)
    places = [(k, rng.uniform(-1, 24), rng.uniform(-1, 6)) for k in range(400)] + [(k, x / 2, y / 2) for k, (x, y) in enumerate((x, y) for x in range(-1, 48) for y in range(-1, 12))]
    got = sorted(map(tuple, spatial.inside_polygon(spark.createDataFrame(places, "k int, x double, y double"), sides, "k", "x", "y").collect()))
    assert got == sorted((k, in_any(x, y)) for k, x, y in places) and (sum(g[1] for g in got)) > 150


def area(ring):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def rings_of(chained):
    found = {}
    for r in chained.orderBy("ring", "place").collect():
        found.setdefault(r.ring, []).append((r.x, r.y))
        assert len(found[r.ring]) == r.place + 1
    return list(found.values())


def test_parts_that_meet_become_one_boundary_and_holes_stay(spark):
    # nine squares around a missing one, and one that only touches a corner
    shapes = [[SQUARE(x, y)] for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [[SQUARE(3, 3)]]
    rows = [(s, r, k, float(x), float(y)) for s, shape in enumerate(shapes) for r, ring in enumerate(shape) for k, (x, y) in enumerate(ring)]
    sides = spatial.dissolve(spatial.polygon_edges(spark.createDataFrame(rows, shapefile.RINGS)))
    assert sides.count() == 12 + 4 + 4
    rings = rings_of(spatial.chain_rings(sides))
    # the corner joins two rings of area 9 and 1 to one, or leaves them apart
    assert sorted(map(area, rings)) in ([-10.0, 1.0], [-9.0, -1.0, 1.0])
    assert all(abs(x1 - x2) + abs(y1 - y2) == 1 for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))
    again = spatial.dissolve(spatial.polygon_edges(spatial.chain_rings(sides)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sides.collect()))


def test_long_rings_are_chained_by_doubling_and_open_ones_refused(spark):
    n = 3000
    k = F.col("id")
    ring = spark.range(n).select(k.alias("place"), F.when(k < n // 2, k).otherwise(n - 1 - k).cast("double").alias("x"), F.when(k < n // 2, 0.0).otherwise(1.0).alias("y"), F.lit(0).alias("ring"))
    sides = spatial.polygon_edges(ring)
    (found,) = rings_of(spatial.chain_rings(sides))
    assert len(found) == n and area(found) == n // 2 - 1
    with pytest.raises(ValueError, match="close"):
        spatial.chain_rings(sides.where("x1 <> 5"))
