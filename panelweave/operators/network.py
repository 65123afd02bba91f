"""Metrics of the network of significant synchronization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.lineage import materialize
from panelweave.operators.derive import haversine_asin


def mirrored(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of each edge as (by, node_id, other, ...); the asymmetry changes its sign."""
    rest = ["q_strength", "sig_strength", "sig_asym"]
    there = edges.select(*by, F.col("i").alias("node_id"), F.col("j").alias("other"), "q_asym", *rest)
    return there.unionByName(edges.select(*by, F.col("j").alias("node_id"), F.col("i").alias("other"), (-F.col("q_asym")).alias("q_asym"), *rest))


def _on_grid(grid: DataFrame, found: DataFrame) -> DataFrame:
    """Every cell of the grid; zero where nothing was found."""
    return grid.select("node_id").join(found, "node_id", "left").na.fill(0)


def degree(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(node_id, dc): neighbours over all other cells of the grid, those without events included."""
    n = grid.count()
    found = mirrored(edges).where("sig_strength").groupBy("node_id").agg((F.count("*") / F.lit(max(1, n - 1))).alias("dc"))
    return _on_grid(grid, found)


def weighted_degree(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(node_id, dc_w): sum of the significant strengths over all other cells."""
    n = grid.count()
    found = mirrored(edges).where("sig_strength").groupBy("node_id").agg((F.sum("q_strength") / F.lit(max(1, n - 1))).alias("dc_w"))
    return _on_grid(grid, found)


def mean_distance(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(node_id, msd, msd_w): mean great-circle distance to the neighbours in km, plain and weighted by strength."""
    here = grid.select("node_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    there = grid.select(F.col("node_id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    placed = mirrored(edges).where("sig_strength").join(here, "node_id").join(there, "other")
    d = haversine_asin(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    found = placed.withColumn("d", d).groupBy("node_id").agg(F.avg("d").alias("msd"), (F.sum(F.col("d") * F.col("q_strength")) / F.sum("q_strength")).alias("msd_w"))
    return _on_grid(grid, found)


def divergence(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree, nd): significant links towards the node, away from it, and their difference."""
    q = F.col("q_asym")
    found = mirrored(edges).where("sig_asym").groupBy("node_id").agg(F.count_if(q > 0).alias("in_degree"), F.count_if(q < 0).alias("out_degree"))
    return _on_grid(grid, found.withColumn("nd", F.col("in_degree") - F.col("out_degree")))


def weighted_divergence(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(node_id, in_strength, out_strength, nd_w)."""
    q = F.col("q_asym")
    sums = [F.sum(F.when(q > 0, q).otherwise(0.0)).alias("in_strength"), F.sum(F.when(q < 0, -q).otherwise(0.0)).alias("out_strength")]
    found = mirrored(edges).where("sig_asym").groupBy("node_id").agg(*sums)
    return _on_grid(grid, found.withColumn("nd_w", F.col("in_strength") - F.col("out_strength")))


def metrics(edges: DataFrame, cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All of the above for each cell and case, in one aggregation: ``cells`` has (by, node_id, lat, lon), every cell of every case."""
    n = cells.select("node_id").distinct().count()
    here = cells.select(*by, "node_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    there = cells.select(*by, F.col("node_id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    placed = mirrored(edges, by).join(here, [*by, "node_id"]).join(there, [*by, "other"])
    far = placed.withColumn("d", haversine_asin(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")))
    strong = lambda c: F.when(F.col("sig_strength"), c)
    towards, away = F.col("sig_asym") & (F.col("q_asym") > 0), F.col("sig_asym") & (F.col("q_asym") < 0)
    q, rest = F.col("q_strength"), F.lit(float(max(1, n - 1)))
    found = far.groupBy(*by, "node_id").agg(
        (F.count_if("sig_strength") / rest).alias("dc"),
        (F.sum(strong(q)) / rest).alias("dc_w"),
        F.avg(strong(F.col("d"))).alias("msd"),
        F.try_divide(F.sum(strong(F.col("d") * q)), F.sum(strong(q))).alias("msd_w"),
        F.count_if(towards).alias("in_degree"),
        F.count_if(away).alias("out_degree"),
        (F.count_if(towards) - F.count_if(away)).alias("nd"),
        F.sum(F.when(towards, F.col("q_asym"))).alias("in_strength"),
        F.sum(F.when(away, -F.col("q_asym"))).alias("out_strength"),
    )
    filled = cells.select(*by, "node_id").join(found, [*by, "node_id"], "left").na.fill(0)
    return filled.withColumn("nd_w", F.col("in_strength") - F.col("out_strength"))


def summary(edges: DataFrame, counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, valid_nodes, undirected_edges, directed_entries); a directed link is two entries."""
    totals = edges.groupBy(*by).agg(F.count_if("sig_strength").alias("undirected_edges"), (2 * F.count_if("sig_asym")).alias("directed_entries"))
    nodes = counts.groupBy(*by).agg(F.count("*").alias("valid_nodes"))
    if not by:
        return nodes.withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return nodes.join(totals, list(by), "left").na.fill(0)


def sampled_sources(grid: DataFrame, sample: int | None) -> DataFrame:
    """Nodes to start from: all, or every step-th, ``sample`` at most. Nodes are numbered row by row, so the number is the place."""
    ids = grid.select("node_id")
    if sample is None:
        return ids
    step = max(1, ids.count() // sample)
    return ids.where((F.col("node_id") % step == 0) & (F.col("node_id") < step * sample))


def _dependencies(links: DataFrame, sources: DataFrame) -> DataFrame | None:
    """(source, node_id, delta) from a batch of sources, or None without links: levels ahead, then dependencies back."""
    levels = [materialize(sources.select(F.col("node_id").alias("source"), "node_id", F.lit(1.0).alias("paths")), "level")]
    while True:
        ahead = levels[-1].join(links, "node_id").groupBy("source", F.col("other").alias("node_id")).agg(F.sum("paths").alias("paths"))
        for seen in levels[-2:]:  # links go both ways, so a neighbour is one level back, here, or new
            ahead = ahead.join(seen, ["source", "node_id"], "left_anti")
        new = materialize(ahead, "level")
        if new.isEmpty():
            break
        levels.append(new)
    parts = None
    owed = levels[-1].select("source", "node_id", F.lit(0.0).alias("delta"))
    for level in range(len(levels) - 1, 0, -1):
        deltas = materialize(owed, "delta")
        parts = deltas if parts is None else parts.unionByName(deltas)
        down = levels[level].join(deltas, ["source", "node_id"]).select("source", F.col("node_id").alias("other"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
        up = down.join(links, "other").join(levels[level - 1], ["source", "node_id"])
        gained = up.groupBy("source", "node_id").agg((F.max("paths") * F.sum("share")).alias("delta"))
        owed = levels[level - 1].select("source", "node_id").join(gained, ["source", "node_id"], "left").select("source", "node_id", F.coalesce("delta", F.lit(0.0)).alias("delta"))
    return parts


def betweenness(edges: DataFrame, grid: DataFrame, sample: int | None = None, batch: int = 1000) -> DataFrame:
    """(node_id, bc): betweenness over unweighted shortest paths, from all or sampled sources, normalised.

    Up to about ``batch`` sources advance together: a round extends the frontier of each by one link and keeps what was not
    seen, summing path counts. Dependencies then flow back a level at a time. Each level is a table in the shared
    folder, and the rounds are as many as the longest shortest path; a batch's tables hold batch x nodes rows at most.
    """
    n = grid.count()
    links = materialize(mirrored(edges).where("sig_strength").select("node_id", "other"), "links")
    sources = sampled_sources(grid, sample)
    k = sources.count()
    every = None
    batches = max(1, -(-k // batch))
    for number in range(batches):
        found = _dependencies(links, sources.where(F.pmod(F.xxhash64("node_id"), F.lit(batches)) == number))
        if found is not None:
            sums = materialize(found.groupBy("node_id").agg(F.sum("delta").alias("delta")), "dependencies")
            every = sums if every is None else every.unionByName(sums)
    if every is None:
        return grid.select("node_id", F.lit(0.0).alias("bc"))
    scale = (n / k if k < n else 1.0) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return _on_grid(grid, every.groupBy("node_id").agg((F.sum("delta") * F.lit(float(scale))).alias("bc")))
