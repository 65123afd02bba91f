"""Spatial statistics over grid cells: neighbours, hot spots, clusters, source-sink pathways, polygon masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.config import GI_P, GI_Z
from panelweave.functions.graph import connected_components
from panelweave.functions.lineage import materialize
from panelweave.functions.special import normal_cdf

_EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def adjacency(cells: DataFrame) -> DataFrame:
    """(i, j): the up to eight neighbours of each cell among ``cells`` (node_id, lat_idx, lon_idx), by shifting places."""
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _EIGHT]))
    moved = cells.select(F.col("node_id").alias("i"), "lat_idx", "lon_idx", shifts.alias("s"))
    moved = moved.select("i", (F.col("lat_idx") + F.col("s.a")).alias("lat_idx"), (F.col("lon_idx") + F.col("s.b")).alias("lon_idx"))
    return moved.join(cells.select(F.col("node_id").alias("j"), "lat_idx", "lon_idx"), ["lat_idx", "lon_idx"]).select("i", "j")


def queen_weights(cells: DataFrame) -> DataFrame:
    """(i, j, weight): neighbours with weights that sum to one; cells without neighbours have no row."""
    return adjacency(cells).withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("i")))


def gi_star(values: DataFrame, cells: DataFrame) -> DataFrame:
    """(node_id, z, p): Getis-Ord statistic of ``values`` (node_id, x), null values left out.

    A cell weighs one half and its neighbours share the other half; a cell without neighbours weighs one. Null for
    a constant field.
    """
    valid = values.where("x IS NOT NULL")
    here = cells.join(valid, "node_id")
    near = queen_weights(here.select("node_id", "lat_idx", "lon_idx"))
    moments = valid.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    around = near.join(valid.select(F.col("node_id").alias("j"), "x"), "j").groupBy(F.col("i").alias("node_id"))
    around = around.agg(F.sum(F.col("weight") * F.col("x")).alias("wx"), F.sum(F.col("weight") * F.col("weight")).alias("w2"))
    both = valid.join(around, "node_id", "left").select(
        "node_id",
        F.when(F.col("wx").isNull(), F.col("x")).otherwise((F.col("x") + F.col("wx")) / 2).alias("wx"),
        F.when(F.col("w2").isNull(), F.lit(1.0)).otherwise((1 + F.col("w2")) / 4).alias("w2"),
    )
    all_rows = both.withColumn("_one", F.lit(1)).join(F.broadcast(moments.withColumn("_one", F.lit(1))), "_one")  # one row
    root = F.sqrt(F.greatest((F.col("n") * F.col("w2") - 1) / (F.col("n") - 1), F.lit(1e-12)))
    z = F.when(F.col("sd") > 0, (F.col("wx") - F.col("mean")) / (F.col("sd") * root))
    return all_rows.select("node_id", z.alias("z")).withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))


def hot_cells(scores: DataFrame, z: float = GI_Z, p: float = GI_P) -> DataFrame:
    """(node_id, kind): sources far below the mean, sinks far above."""
    kind = F.when((F.col("z") < -z) & (F.col("p") < p), "source").when((F.col("z") > z) & (F.col("p") < p), "sink")
    return scores.select("node_id", kind.alias("kind")).where("kind IS NOT NULL")


def cluster_members(hot: DataFrame, cells: DataFrame) -> DataFrame:
    """(kind, node_id, cluster_id): connected cells of one kind; the id is the cluster's least cell."""
    placed = hot.join(cells, "node_id").select("node_id", "kind", "lat_idx", "lon_idx")
    kinds = placed.select(F.col("node_id").alias("j"), F.col("kind").alias("kind_j"))
    links = adjacency(placed.select("node_id", "lat_idx", "lon_idx")).join(placed.select(F.col("node_id").alias("i"), "kind"), "i").join(kinds, "j").where("kind = kind_j")
    found = connected_components(links.where("i < j"), "i", "j").withColumnRenamed("node", "node_id")
    return placed.join(found, "node_id", "left").select("kind", "node_id", F.coalesce("component", "node_id").alias("cluster_id"))


def clusters(members: DataFrame, cells: DataFrame, fraction: float) -> DataFrame:
    """(kind, cluster_id, pixels, lat, lon) of clusters with at least ``fraction`` of all cells; mean place."""
    total = cells.count()
    found = members.join(cells, "node_id").groupBy("kind", "cluster_id").agg(F.count("*").alias("pixels"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return found.where(F.col("pixels") >= fraction * total)


def flux_ratios(members: DataFrame, kept: DataFrame, links: DataFrame, flux_sign: int = 1) -> DataFrame:
    """(src, snk, src_pixels, snk_pixels, ratio): share of a source cluster's cells with a link of the given sign to a sink.

    ``links`` has (i, j, sign) for i < j, the sign being that of the asymmetry as seen from i; +1 means that j leads.
    """
    both = links.select(F.col("i").alias("a"), F.col("j").alias("b"), "sign").unionByName(links.select(F.col("j").alias("a"), F.col("i").alias("b"), (-F.col("sign")).alias("sign")))
    inside = members.join(kept.select("kind", "cluster_id", "pixels"), ["kind", "cluster_id"])
    src = inside.where("kind = 'source'").select(F.col("node_id").alias("a"), F.col("cluster_id").alias("src"), F.col("pixels").alias("src_pixels"))
    snk = inside.where("kind = 'sink'").select(F.col("node_id").alias("b"), F.col("cluster_id").alias("snk"), F.col("pixels").alias("snk_pixels"))
    touched = both.where(F.col("sign") == flux_sign).join(src, "a").join(snk, "b")
    active = touched.groupBy("src", "snk", "src_pixels", "snk_pixels").agg(F.countDistinct("a").alias("active"))
    return active.select("src", "snk", "src_pixels", "snk_pixels", (F.col("active") / F.col("src_pixels")).alias("ratio"))


def best_pathway(flux: DataFrame, kept: DataFrame, least_ratio: float, least_fraction: float, total_cells: int) -> DataFrame:
    """(pair_id, src, snk, flux_ratio, src_pixels, snk_pixels, lat/lon of both): sources that share the best sink.

    Each source takes the sink of highest ratio, the first of equals; ratios under ``least_ratio`` fall away. Of the
    sinks, the one with the largest area with its sources wins, the one with the earliest source of equals, if the area
    is ``least_fraction`` of all cells or more.
    """
    first = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("ratio"), "snk"))
    chosen = flux.where("ratio > 0").withColumn("_r", first).where((F.col("_r") == 1) & (F.col("ratio") >= least_ratio)).drop("_r")
    areas = chosen.groupBy("snk").agg((F.sum("src_pixels") + F.max("snk_pixels")).alias("area"), F.min("src").alias("lead"))
    best = areas.where(F.col("area") >= least_fraction * total_cells).orderBy(F.desc("area"), "lead").limit(1).select("snk")
    place = lambda kind, key, name: kept.where(F.col("kind") == kind).select(F.col("cluster_id").alias(key), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))
    out = chosen.join(best, "snk").join(place("source", "src", "src"), "src").join(place("sink", "snk", "snk"), "snk")
    return out.withColumn("pair_id", F.row_number().over(Window.partitionBy("snk").orderBy("src"))).withColumnRenamed("ratio", "flux_ratio")


def region_labels(pathway: DataFrame, members: DataFrame) -> DataFrame:
    """(node_id, label): +pair_id for cells of a source, minus the last pair_id for cells of the shared sink."""
    src = pathway.select(F.lit("source").alias("kind"), F.col("src").alias("cluster_id"), F.col("pair_id").alias("label"))
    snk = pathway.groupBy(F.col("snk").alias("cluster_id")).agg((-F.max("pair_id")).alias("label")).select(F.lit("sink").alias("kind"), "cluster_id", "label")
    return members.join(src.unionByName(snk), ["kind", "cluster_id"]).select("node_id", F.col("label").cast("long").alias("label"))


def polygon_edges(rings: DataFrame) -> DataFrame:
    """(shape, x1, y1, x2, y2): the sides of closed rings of vertices ([shape], ring, place, x, y); rings of holes and of other parts alike.

    Without a column ``shape``, all rings are one shape.
    """
    named = rings if "shape" in rings.columns else rings.withColumn("shape", F.lit(0))
    by_ring = Window.partitionBy("shape", "ring").orderBy("place")
    first = Window.partitionBy("shape", "ring")
    ends = named.withColumn("x2", F.lead("x").over(by_ring)).withColumn("y2", F.lead("y").over(by_ring))
    ends = ends.withColumn("_x", F.min_by("x", "place").over(first)).withColumn("_y", F.min_by("y", "place").over(first))
    return ends.select("shape", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce("x2", "_x").alias("x2"), F.coalesce("y2", "_y").alias("y2"))


def dissolve(edges: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2): the outer boundary of shapes that meet along whole sides: sides that an even number of them has are gone.

    Sides are equal whatever their direction; what remains keeps the direction of the first of them. Shapes must meet in
    sides and not overlap; for shapes that overlap, :func:`inside_polygon` takes the shapes as they are.
    """
    turned = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    pair = edges.select(F.when(turned, end("x2", "y2")).otherwise(end("x1", "y1")).alias("a"), F.when(turned, end("x1", "y1")).otherwise(end("x2", "y2")).alias("b"), turned.alias("t"))
    kept = pair.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("t").alias("t")).where("n % 2 = 1")
    start, stop = F.when(F.col("t"), F.col("b")).otherwise(F.col("a")), F.when(F.col("t"), F.col("a")).otherwise(F.col("b"))
    return kept.select(start.alias("s"), stop.alias("e")).select(F.col("s.x").alias("x1"), F.col("s.y").alias("y1"), F.col("e.x").alias("x2"), F.col("e.y").alias("y2"))


def chain_rings(edges: DataFrame) -> DataFrame:
    """(ring, place, x, y): directed sides in which every vertex is left as often as it is reached, chained to closed rings.

    Where rings touch in a vertex, its sides are paired in the order of their other ends; any pairing gives the same area. A ring is named by the
    number of its first side. Places come from pointer doubling: after k rounds a side knows the one 2^k further on,
    so rounds grow with the logarithm of the longest ring, and each writes its table.
    """
    out = Window.partitionBy("x1", "y1").orderBy("x2", "y2")
    into = Window.partitionBy("x2", "y2").orderBy("x1", "y1")
    numbered = materialize(edges.select("x1", "y1", "x2", "y2").withColumn("id", F.xxhash64("x1", "y1", "x2", "y2")).withColumn("_o", F.row_number().over(out)).withColumn("_i", F.row_number().over(into)), "sides")
    after = numbered.select(F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("_o").alias("_i"), F.col("id").alias("next"))
    links = materialize(numbered.join(after, ["x2", "y2", "_i"]).select("id", "next"), "links")
    if links.count() != numbered.count():
        raise ValueError("the sides do not close")
    rings = materialize(connected_components(links, "id", "next").withColumnsRenamed({"node": "id", "component": "ring"}), "rings")
    # from each side on to the ring's first one, which is nobody's successor here
    ahead = materialize(links.join(rings, "id").select("id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("left")), "ahead")
    while not ahead.where("next IS NOT NULL").isEmpty():
        beyond = ahead.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        moved = ahead.where("next IS NOT NULL").join(beyond, "next").select("id", "ring", F.col("_next").alias("next"), (F.col("left") + F.col("_left")).alias("left"))
        ahead = materialize(moved.unionByName(ahead.where("next IS NULL")), "ahead")
    size = ahead.groupBy("ring").agg(F.max("left").alias("size"))
    placed = ahead.join(size, "ring").select("id", "ring", (F.col("size") - F.col("left")).alias("place"))
    return placed.join(numbered, "id").select("ring", "place", F.col("x1").alias("x"), F.col("y1").alias("y"))


#: Heights of bands are powers of two from the least to the greatest of these exponents.
LEAST_HEIGHT, GREATEST_HEIGHT = -40, 1000


def _crossings(heights: DataFrame, edges: DataFrame) -> DataFrame:
    """(py, shape, at): where each side crosses each of the heights (py), distinct and not null; a side holds its lower end and not its upper.

    A side lies in the bands of the power of two next above its own height, so in two at most, and a height looks into
    one band for each power that sides have: short sides are met only by heights beside them, however many there are.
    """
    rise = F.abs(F.col("y2") - F.col("y1"))
    power = F.greatest(F.lit(LEAST_HEIGHT), F.least(F.lit(GREATEST_HEIGHT), F.ceil(F.log2(rise)))).cast("int")
    sides = edges.where("y1 <> y2 AND x1 IS NOT NULL AND x2 IS NOT NULL").withColumn("_power", power)
    powers = [r[0] for r in sides.select("_power").distinct().collect()]  # a power of two each
    band = lambda y, p: F.floor(y / F.pow(F.lit(2.0), p))
    spread = sides.withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2"), F.col("_power")), band(F.greatest("y1", "y2"), F.col("_power")))))
    asked = heights.withColumn("_power", F.explode(F.array(*map(F.lit, powers)).cast("array<int>"))).withColumn("_band", band(F.col("py"), F.col("_power")))
    met = asked.join(spread, ["_power", "_band"]).where((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py")))
    at = (F.col("py") - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))) + F.col("x1")
    return met.select("py", "shape", at.alias("at"))


def _scanned(places: DataFrame, edges: DataFrame) -> DataFrame:
    """(px, py) of the distinct places that are inside any shape: along each height, crossings and places in order of x, and how many shapes are open.

    As rings are closed, a shape has an even number of crossings at a height: its odd ones open it and its even ones
    close it. A place is inside if more were opened than closed at or before it.
    """
    turn = F.row_number().over(Window.partitionBy("py", "shape").orderBy("at"))
    at = _crossings(places.select("py").distinct(), edges).withColumn("_turn", F.when(turn % 2 == 1, 1).otherwise(-1))
    line = at.select("py", F.col("at").alias("px"), F.col("_turn").alias("_step"), F.lit(0).alias("_place"))
    line = line.unionByName(places.select("py", "px", F.lit(0).alias("_step"), F.lit(1).alias("_place")))
    opened = F.sum("_step").over(Window.partitionBy("py").orderBy("px", "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return line.withColumn("_open", opened).where("_place = 1 AND _open > 0").select("px", "py")


def inside_polygon(points: DataFrame, edges: DataFrame, key: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """(key, inside) for each row of ``points``: whether it lies in any shape, an odd number of the shape's sides away from the outside, so holes are outside.

    Every place is judged once, whatever the number of rows there, and rows may repeat keys. A row with a null or NaN
    coordinate is outside, as is every row where there are no sides. Places of one height are a scanline: see :func:`_scanned`.
    """
    good = lambda c: c.isNotNull() & ~F.isnan(c)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    edges = edges if "shape" in edges.columns else edges.withColumn("shape", F.lit(0))
    named = points.select(F.col(key).alias("_key"), F.when(good(px) & good(py), px).alias("px"), F.when(good(px) & good(py), py).alias("py"))
    found = _scanned(named.where("px IS NOT NULL").select("px", "py").distinct(), edges).withColumn("_in", F.lit(True))
    return named.join(found, ["px", "py"], "left").select(F.col("_key").alias(key), F.coalesce("_in", F.lit(False)).alias("inside"))


def cells_inside(grid: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id) of the cells whose centre lies inside: a row of the grid is one scanline, whose work is its cells and crossings."""
    return inside_polygon(grid, edges, "node_id").where("inside").select("node_id")
