import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.config import SEASONS
from panelweave.jobs import stages
from panelweave.sources import grids, panel, sinks


def test_grids_become_panels(spark):
    rows = [(datetime.date(2000, 1, 1 + t), lat, lon, v, k) for t in range(2) for lat in (21.0, 20.0) for lon in (100.0, 100.5) for k, v in ((0, float("nan") if lat == 21.0 and t else t + lat), (1, 9.0))]
    table = spark.createDataFrame(rows, "time date, latitude double, lon double, pre double, level int")
    cells, long = grids.to_panel(table)
    assert sorted((r.node_id, r.lat, r.lon) for r in cells.collect()) == [(0, 20.0, 100.0), (1, 20.0, 100.5), (2, 21.0, 100.0), (3, 21.0, 100.5)]
    got = {(r.node_id, r.t): r.value for r in long.collect()}
    assert got == {(0, 0): 20, (1, 0): 20, (2, 0): 21, (3, 0): 21, (0, 1): 21, (1, 1): 21, (2, 1): None, (3, 1): None}
    other = grids.to_panel(table, level=1)[1].where("value IS NOT NULL").collect()
    assert {r.value for r in other} == {9.0} and len(other) == 8
    assert grids.variable_name(["time", "lat", "x", "time_bnds", "w500"]) == "w500"
    with pytest.raises(KeyError):
        grids.variable_name(["a", "b", "lat"])
    with pytest.raises(KeyError):
        grids.to_panel(table.drop("lon"))


def test_cases_are_written_by_parameters_and_pruned(spark, tmp_path):
    root = f"file://{tmp_path}/stage"
    for scale in (5, 30):
        sinks.write_case(spark.range(scale).withColumnRenamed("id", "node_id"), root, scale=scale, season="annual")
    for _ in range(2):  # a case is replaced, not appended to
        sinks.write_case(spark.range(30).withColumnRenamed("id", "node_id"), root, scale=30, season="annual")
    found = sinks.read_stage(spark, root, scale=30)
    assert found.count() == 30 and sinks.read_stage(spark, root).count() == 35
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scale" in plan
    assert sinks.has_case(spark, root, scale=30) and not sinks.has_case(spark, root, scale=90) and not sinks.has_case(spark, root + "none")
    sinks.write_case(spark.range(0).withColumnRenamed("id", "node_id"), root, scale=30, season="annual")
    assert not sinks.has_case(spark, root, scale=30) and sinks.read_stage(spark, root).count() == 5
    path = sinks.write_summary(spark.createDataFrame([(1, "a")], "n int, s string"), f"file://{tmp_path}/summary")
    assert [tuple(r) for r in sinks.read_summary(spark, path, "n int, s string").collect()] == [(1, "a")]
    cells = panel.with_coordinates(spark.range(6).withColumnRenamed("id", "node_id"), 2)
    up = {(r.raster_row, r.raster_col): r.value for r in sinks.north_up(cells.select("node_id", F.col("node_id").alias("value")), cells).collect()}
    assert up == {(2, 0): 0, (2, 1): 1, (1, 0): 2, (1, 1): 3, (0, 0): 4, (0, 1): 5}


def test_from_panel_to_networks(spark, tmp_path, monkeypatch):
    rng, days, nodes = random.Random(1), 365 * 3, 12
    shared = [rng.gammavariate(0.6, 4) for _ in range(days)]
    rows = [(n, t, (shared[max(0, t - n % 3)] + rng.gammavariate(0.3, 1)) if rng.random() < 0.6 else 0.0) for n in range(nodes) for t in range(days)]
    monkeypatch.setitem(stages.BASELINE, 30, {"kind": "regular", "threshold": -0.5, "duration": 3, "tau": 15})
    root = f"file://{tmp_path}/run"
    sea = [(nodes, t, 1.0) for t in range(days)]
    fits = stages.standardize_panel(spark.createDataFrame(rows + sea, "node_id long, t int, value double"), root, (30,), spark.range(nodes).withColumnRenamed("id", "node_id"))
    assert fits.first().valid_cells == nodes and sinks.read_stage(spark, f"{root}/spi").where(F.col("node_id") == nodes).isEmpty()
    kept = sinks.read_summary(spark, f"{root}/gof_summary", "scale_days int, valid_cells long, median_zero_fraction double, p double, k double, a double").collect()
    assert [(r.scale_days, r.valid_cells) for r in kept] == [(30, nodes)] and 0.3 < kept[0].p <= 1
    cells = panel.with_coordinates(spark.range(nodes).withColumnRenamed("id", "node_id"), 4)
    axis = spark.range(days).select(F.col("id").cast("int").alias("t"), F.month(F.date_add(F.lit(datetime.date(2000, 1, 1)), F.col("id").cast("int"))).alias("month"))
    summary = {r.season: r for r in stages.link_events(spark, root, 30, cells, axis, surrogates=20, least_nodes=10).collect()}
    assert "annual" in summary and set(summary) <= set(SEASONS) and summary["annual"].valid_nodes == nodes
    metrics = sinks.read_stage(spark, f"{root}/metrics", scale=30, season="annual")
    assert metrics.count() == nodes and metrics.agg(F.sum("nd")).first()[0] == 0
    again = stages.link_events(spark, root, 30, cells, axis, surrogates=20, least_nodes=10, between=True, sample=6)
    assert {r.season: r for r in again.collect()} == summary
    (values,) = (tmp_path / "run" / "critical").glob("[0-9a-f]*")
    metrics = sinks.read_stage(spark, f"{root}/metrics", scale=30, season="annual")
    assert metrics.count() == nodes and metrics.agg(F.min("bc")).first()[0] >= 0  # read afresh after the second run
    (values / "_SUCCESS").unlink()
    for part in sorted(values.glob("part-*"))[1:]:
        part.unlink()  # a write that died: made again
    third = stages.link_events(spark, root, 30, cells, axis, surrogates=20, least_nodes=10)
    assert {r.season: r for r in third.collect()} == summary
    metrics = sinks.read_stage(spark, f"{root}/metrics", scale=30, season="annual")
    up = stages.rasters(spark, root, 30, "annual", cells, "dc").collect()
    assert {(r.raster_row, r.raster_col) for r in up} == {(a, b) for a in range(3) for b in range(4)}
    swept = stages.sweep(spark, root, 30, cells, axis, surrogates=20, thresholds=(-0.5, -0.7), taus=(10, 15)).collect()
    same = [r for r in swept if (r.season, r.threshold, r.tau) == ("annual", -0.5, 15)]
    dc = metrics.agg(F.avg("dc")).first()[0]
    assert len(same) == 1 and same[0].mean_dc == pytest.approx(dc) and same[0].valid_nodes == nodes
    along = stages.profiles(spark, root, 30).where("threshold = -0.5 AND tau = 15").collect()
    assert len([r for r in along if r.axis == "lat"]) == 3 and np.mean([r.mean_dc for r in along if r.axis == "lon"]) == pytest.approx(dc)
    assert metrics.agg(F.sum("dc")).first()[0] == pytest.approx(2 * summary["annual"].undirected_edges / (nodes - 1))


def test_from_network_to_composites(spark, tmp_path, monkeypatch):
    root, n = f"file://{tmp_path}/run", 36
    cells = panel.with_coordinates(spark.range(n).withColumnRenamed("id", "node_id"), 6)
    low, high = (0, 1, 6, 7), (28, 29, 34, 35)
    rows = [(k, -9 if k in low else 9 if k in high else 0) for k in range(n)]
    sinks.write_case(spark.createDataFrame(rows, "node_id long, nd long"), f"{root}/metrics", scale=30, season="annual")
    edges = [("annual", a, b, 0.5, 0.5 if a != 7 else -0.5, True, True) for a in low for b in high]
    sinks.write_case(spark.createDataFrame(edges, "season string, i long, j long, q_strength double, q_asym double, sig_strength boolean, sig_asym boolean"), f"{root}/edges", scale=30)
    path = stages.find_pathway(spark, root, 30, "annual", cells).collect()
    assert [(r.pair_id, r.source_pixels, r.sink_pixels, r.flux_ratio) for r in path] == [(1, 4, 4, 0.75)]
    labels = {r.node_id: r.label for r in sinks.read_stage(spark, f"{root}/regions", scale=30).collect()}
    assert labels == dict.fromkeys(low, 1) | dict.fromkeys(high, -1)
    days = 60
    twice = spark.range(2 * days).select(F.col("id").cast("int").alias("t"), (F.col("id") % days + 1).cast("int").alias("doy"))
    values = [("v", k, t, 1.0 if t in (22, 42) and k in low else 0.0) for k in range(n) for t in range(2 * days)]
    onsets = spark.createDataFrame([(0, 1, 20, 25), (6, 1, 20, 21), (7, 1, 40, 41), (28, 1, 30, 31), (1, 1, 1, 2)], "node_id long, seq int, start_t int, end_t int")
    out = stages.composite_case(spark, root, 30, "annual", spark.createDataFrame(values, "variable string, node_id long, t int, value double"), twice, onsets, 2 * days, (-3, 3), 1)
    got = {(r.region, r.lag): (r.mean_anomaly, r.standard_error, r.n_events) for r in out.collect()}
    events_ = onsets.where("node_id <> 1").withColumn("season", F.lit("annual")).withColumn("start_t", F.col("start_t") - 5)
    sinks.write_case(events_, f"{root}/events", scale=30)
    cases = ((5, "spring"), (30, "annual"), (90, "winter"))
    variables = spark.createDataFrame(values, "variable string, node_id long, t int, value double")
    monkeypatch.setitem(stages.LEAD_LAG_WINDOWS, 30, (-3, 3))
    every = stages.composite_cases(spark, root, variables, twice, 2 * days, cases, offset=5, width=1)
    assert sorted(map(str, every.drop("scale", "season").collect())) == sorted(map(str, out.collect())) and {(r.scale, r.season) for r in every.collect()} == {(30, "annual")}
    assert stages.plot_table(every, ("v",)).where("variable = 'v' AND upper >= lower").count() == 14
    pairs = stages.find_pathways(spark, root, cells, cases)
    assert [(r.scale, r.season, r.pair_id, r.flux_ratio) for r in pairs.collect()] == [(30, "annual", 1, 0.75)]
    assert len(list((tmp_path / "run" / "source_sink_summary").glob("*.csv"))) == len(list((tmp_path / "run" / "lead_lag" / "scale=30" / "season=annual").glob("*.csv"))) == 1
    assert len(list((tmp_path / "run" / "paired_regions" / "scale=30" / "season=annual").glob("*.csv"))) == 1
    assert stages.find_pathways(spark, root, cells, cases[:1]) is None and stages.composite_cases(spark, root, variables, twice, 2 * days, cases[2:]) is None
    assert len(got) == 14 and got["source", 2] == (0.5, 0.0, 2) and got["sink", 2] == (0.0, 0.0, 2) and got["source", 0][0] == 0.0


def test_plots_take_the_first_six_variables_in_the_order_of_the_analysis(spark):
    order = ("W500", "Pre", "Tm", "VPD", "SWL1", "Pre", "Bowen", "Zeta", "Alpha")
    rows = [(v, k, 1.0, 0.5) for v in set(order) - {"Tm"} for k in range(3)]
    found = stages.plot_table(spark.createDataFrame(rows, "variable string, lag int, mean_anomaly double, standard_error double"), order)
    by = {r.variable: r.place for r in found.collect()}
    assert sorted(by, key=by.get) == ["W500", "Pre", "VPD", "SWL1", "Bowen", "Zeta"] and found.count() == 18
