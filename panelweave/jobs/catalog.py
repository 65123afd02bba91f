"""Registered queries over the driver tables, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.config import BURN_IN_DAYS, FIXTURE, N_SURROGATES, SEASONS, TAU_SENSITIVITY, THRESHOLD_SENSITIVITY
from panelweave.functions.lineage import materialize
from panelweave.jobs import stages
from panelweave.operators import composite, derive, events, fitting, network, spatial, standardize, surrogate, sync
from panelweave.sources import panel as src
from panelweave.sources.tables import table

P = FIXTURE
#: Fixed polygon for the mask query, as rings of (lon, lat).
RINGS = [
    [(100.1, 20.15), (101.7, 20.05), (101.9, 20.55), (101.2, 20.35), (101.0, 20.9), (100.3, 20.7)],
    [(100.4, 20.25), (100.9, 20.22), (100.8, 20.5), (100.5, 20.55)],  # a hole
    [(99.0, 20.0), (99.8, 20.0), (99.4, 20.8)],  # another part
]
#: Source and sink regions of the composites, as folds of the node number.
SOURCE_FOLD, SINK_FOLD, FOLDS = 0, 1, 3
#: Scales of the sweep with their kind of events and their thresholds, which for rapid onsets are changes; tolerances are the fixed ones of each scale.
SWEEP = {5: ("rapid", (-1.0, -1.5, -2.0)), 30: ("regular", THRESHOLD_SENSITIVITY[30]), 90: ("regular", THRESHOLD_SENSITIVITY[90])}
SWEEP_SURROGATES, SWEEP_NODES = N_SURROGATES, 10


def _acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.rolling_accumulation(src.panel(spark, sf_dir), P.scale)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.log_scores(_acc(spark, sf_dir))


def _onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.runs_below(events.after_burn_in(_scores(spark, sf_dir)), P.threshold, P.duration)


def _axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time axis behind the burn-in, counted from zero."""
    return events.after_burn_in(src.time_axis(spark, sf_dir))


def _days(spark: SparkSession, sf_dir: str) -> int:
    return src.record(spark, sf_dir)[1] - BURN_IN_DAYS


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.strength(sync.sync_pairs(materialize(_onsets(spark, sf_dir), "onsets"), P.tau))


def _critical(counts: DataFrame, days: int) -> DataFrame:
    return surrogate.critical_values(counts, days, P.tau, P.surrogates)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(sync.valid_counts(_onsets(spark, sf_dir)), "counts")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pairs that met at all are looked at, and only significant ones come back."""
    onsets = materialize(_onsets(spark, sf_dir), "onsets")
    pairs = sync.strength(sync.met_pairs(onsets, P.tau))
    return materialize(surrogate.significant_edges(pairs, _critical(sync.valid_counts(onsets), _days(spark, sf_dir))), "edges")


def panel_daily(spark, sf_dir):
    return src.panel(spark, sf_dir).withColumn("value", F.col("value").cast("double"))


def rolling_accumulation(spark, sf_dir):
    return _acc(spark, sf_dir)


def zero_fraction(spark, sf_dir):
    return standardize.zero_fraction(_acc(spark, sf_dir))


def gamma_fit(spark, sf_dir):
    return standardize.gamma_fit(standardize.positive_moments(_acc(spark, sf_dir)))


def lognormal_fit(spark, sf_dir):
    return standardize.lognormal_fit(standardize.positive_moments(_acc(spark, sf_dir)))


def aic_selection(spark, sf_dir):
    """Between the two families whose fits are closed."""
    moments = standardize.positive_moments(_acc(spark, sf_dir))
    gamma, lognormal = standardize.gamma_fit(moments), standardize.lognormal_fit(moments)
    aics = gamma.select("node_id", F.lit(0).alias("dist_id"), "aic").unionByName(lognormal.select("node_id", F.lit(1).alias("dist_id"), "aic"))
    return standardize.conservative_best(aics)


def gof_stats(spark, sf_dir):
    return standardize.lognormal_goodness(_acc(spark, sf_dir))


def distribution_fits(spark, sf_dir):
    """Five families by maximum likelihood, selection and goodness of fit."""
    return fitting.fit_cells(_acc(spark, sf_dir))


def spi(spark, sf_dir):
    acc = materialize(_acc(spark, sf_dir), "accumulation")
    return fitting.standardize(acc, fitting.fit_cells(acc))


def gof_summary(spark, sf_dir):
    """Medians of the goodness of fit over cells."""
    return stages.fit_medians(materialize(fitting.fit_cells(_acc(spark, sf_dir)), "fits")).select(F.lit(P.scale).alias("scale_days"), "*")


def log_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


def drought_runs(spark, sf_dir):
    return _onsets(spark, sf_dir)


def event_counts(spark, sf_dir):
    return events.event_counts(_onsets(spark, sf_dir), src.grid(spark, sf_dir))


def rapid_onset(spark, sf_dir):
    return events.rapid_onsets(events.after_burn_in(_scores(spark, sf_dir)), P.rapid_days, P.rapid_change, P.rapid_final)


def season_events(spark, sf_dir):
    axis = _axis(spark, sf_dir)
    kept = events.by_season(_onsets(spark, sf_dir), axis, SEASONS).groupBy("season", "node_id").agg(F.count("*").alias("n_events"), F.min("start_t").alias("first_start"))
    return kept.join(F.broadcast(events.season_lengths(axis, SEASONS)), "season")  # five seasons


def sync_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("i", "j", "ni", "nj", "j_j2i", "j_i2j")


def sync_strength(spark, sf_dir):
    return _pairs(spark, sf_dir).select("i", "j", "q_strength", "q_asym")


def surrogate_draws(spark, sf_dir):
    return surrogate.draws(surrogate.combinations(_counts(spark, sf_dir)), _days(spark, sf_dir), P.surrogates).withColumn("k", F.col("k").cast("long"))


def critical_values(spark, sf_dir):
    return _critical(_counts(spark, sf_dir), _days(spark, sf_dir))


def significant_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


def degree_centrality(spark, sf_dir):
    return network.degree(_edges(spark, sf_dir), src.grid(spark, sf_dir))


def weighted_degree(spark, sf_dir):
    return network.weighted_degree(_edges(spark, sf_dir), src.grid(spark, sf_dir))


def sync_distance(spark, sf_dir):
    return network.mean_distance(_edges(spark, sf_dir), src.grid(spark, sf_dir))


def net_divergence(spark, sf_dir):
    return network.divergence(_edges(spark, sf_dir), src.grid(spark, sf_dir))


def net_divergence_weighted(spark, sf_dir):
    return network.weighted_divergence(_edges(spark, sf_dir), src.grid(spark, sf_dir))


def network_summary(spark, sf_dir):
    return network.summary(_edges(spark, sf_dir), sync.valid_counts(_onsets(spark, sf_dir)))


def betweenness(spark, sf_dir):
    return network.betweenness(_edges(spark, sf_dir), src.grid(spark, sf_dir))


def lat_profile(spark, sf_dir):
    dc = network.degree(_edges(spark, sf_dir), src.grid(spark, sf_dir))
    return dc.join(src.grid(spark, sf_dir), "node_id").groupBy("lat_idx", "lat").agg(F.avg("dc").alias("mean_dc"))


def lon_profile(spark, sf_dir):
    dc = network.degree(_edges(spark, sf_dir), src.grid(spark, sf_dir))
    return dc.join(src.grid(spark, sf_dir), "node_id").groupBy("lon_idx", "lon").agg(F.avg("dc").alias("mean_dc"))


def _part_cells(spark, sf_dir):
    return materialize(src.part_grid(spark, sf_dir), "cells")


def _part_values(spark, sf_dir):
    quantity = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(F.pmod("l_partkey", F.lit(400)).cast("long").alias("node_id")).agg(quantity.alias("x"))


def queen_weights(spark, sf_dir):
    return spatial.queen_weights(src.part_grid(spark, sf_dir))


def gi_star(spark, sf_dir):
    return spatial.gi_star(_part_values(spark, sf_dir), _part_cells(spark, sf_dir))


def _members(spark, sf_dir, cells):
    scores = spatial.gi_star(_part_values(spark, sf_dir), cells).withColumn("z", F.round("z", 9))
    return materialize(spatial.cluster_members(spatial.hot_cells(scores, P.hot_z, 1.0), cells), "members")


def hotspot_clusters(spark, sf_dir):
    cells = _part_cells(spark, sf_dir)
    return spatial.clusters(_members(spark, sf_dir, cells), cells, P.cluster_fraction)


def _flux(spark, sf_dir):
    """Links between cells of clusters only: what is outside is left out before pairing."""
    cells = _part_cells(spark, sf_dir)
    members = _members(spark, sf_dir, cells)
    kept = materialize(spatial.clusters(members, cells, P.cluster_fraction), "clusters")
    wanted = members.join(kept, ["kind", "cluster_id"], "left_semi").select("node_id")
    panel = src.part_panel(spark, sf_dir).join(wanted, "node_id", "left_semi")
    scores = standardize.log_scores(standardize.rolling_accumulation(panel, P.scale))
    onsets = materialize(events.runs_below(events.after_burn_in(scores), P.threshold, P.duration), "onsets")
    sign = F.signum(F.col("jj_j2i") - F.col("jj_i2j")).cast("int")
    links = sync.doubled_counts(onsets, P.tau).select("i", "j", sign.alias("sign")).where("sign <> 0")
    return cells, members, kept, spatial.flux_ratios(members, kept, links)


def source_sink_flux(spark, sf_dir):
    return _flux(spark, sf_dir)[3]


def _pathway(spark, sf_dir):
    cells, members, kept, flux = _flux(spark, sf_dir)
    return spatial.best_pathway(flux, kept, P.flux_ratio, P.cluster_fraction, cells.count()), members


def source_sink_pathway(spark, sf_dir):
    path, _ = _pathway(spark, sf_dir)
    km = derive.haversine_atan(F.col("src_lon"), F.col("src_lat"), F.col("snk_lon"), F.col("snk_lat"))
    return path.select("pair_id", "src", "snk", "flux_ratio", km.alias("distance_km"), F.col("src_pixels").alias("source_pixels"), F.col("snk_pixels").alias("sink_pixels"))


def region_labels(spark, sf_dir):
    path, members = _pathway(spark, sf_dir)
    return spatial.region_labels(materialize(path, "pathway"), members)


def climatology(spark, sf_dir):
    return composite.climatology(src.diagnostics(spark, sf_dir), src.time_axis(spark, sf_dir), ("variable", "node_id"))


def anomaly(spark, sf_dir):
    found = composite.anomalies(src.diagnostics(spark, sf_dir), src.time_axis(spark, sf_dir), ("variable", "node_id"))
    return found.select("variable", "node_id", "t", "anomaly")


def _regions(spark, sf_dir):
    fold = F.pmod("node_id", F.lit(FOLDS))
    named = src.grid(spark, sf_dir).select("node_id", F.when(fold == SOURCE_FOLD, "source").when(fold == SINK_FOLD, "sink").alias("region"))
    return named.where("region IS NOT NULL")


def _windows(spark, sf_dir):
    """Source onsets align both regions; the series lose their burn-in as the onsets did."""
    axis, regions = _axis(spark, sf_dir), _regions(spark, sf_dir)
    series = events.after_burn_in(src.diagnostics(spark, sf_dir))
    means = composite.regional_means(composite.anomalies(series, axis, ("variable", "node_id")), regions)
    starts = materialize(composite.onset_days(_onsets(spark, sf_dir), regions, "source", *P.lags, _days(spark, sf_dir)), "starts")
    return composite.event_windows(means, starts, *P.lags), starts


def event_windows(spark, sf_dir):
    return _windows(spark, sf_dir)[0].select("variable", "region", "start", "lag", "value")


def composite_mean(spark, sf_dir):
    return composite.composite(*_windows(spark, sf_dir))


def centered_smoothing(spark, sf_dir):
    return composite.smoothed(composite.composite(*_windows(spark, sf_dir)), P.smoothing)


def _points(spark, sf_dir):
    lon, lat = 100 + F.col("c_acctbal") / 5000, 20 + F.pmod("c_custkey", F.lit(100)) / 100.0
    return table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))


def _boundary(spark):
    rows = [(k, place, x, y) for k, ring in enumerate(RINGS) for place, (x, y) in enumerate(ring)]
    return spatial.polygon_edges(spark.createDataFrame(rows, "ring int, place int, x double, y double"))


def nearest_pixel(spark, sf_dir):
    return composite.nearest_cells(_points(spark, sf_dir), src.grid(spark, sf_dir)).select("c_custkey", "lat_idx", "lon_idx")


def polygon_mask(spark, sf_dir):
    return spatial.inside_polygon(_points(spark, sf_dir), _boundary(spark), "c_custkey")


def land_cells(spark, sf_dir):
    """Cells of the grid whose centre is inside the boundary."""
    return spatial.cells_inside(src.grid(spark, sf_dir), _boundary(spark))


def network_metrics(spark, sf_dir):
    """All metrics of the network in one aggregation."""
    return network.metrics(_edges(spark, sf_dir), src.grid(spark, sf_dir))


def vpd(spark, sf_dir):
    t, rh = F.col("l_quantity") - 10, 1000 * F.col("l_discount")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", derive.saturation_vapour_pressure(t).alias("es_kpa"), derive.vapour_pressure_deficit(t, rh).alias("vpd_kpa"))
    return lines


def bowen(spark, sf_dir):
    ratio = derive.bowen_ratio(F.col("l_extendedprice"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("bowen"))


def haversine(spark, sf_dir):
    """Distance of each customer's place from the centre of its nation's cell, in both forms."""
    keyed = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("node_id"))
    both = _points(spark, sf_dir).join(keyed, "c_custkey").join(src.grid(spark, sf_dir).select("node_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "node_id")
    args = [F.col(c) for c in ("lon", "lat", "lon2", "lat2")]
    return both.select("c_custkey", derive.haversine_atan(*args).alias("km_atan"), derive.haversine_asin(*args).alias("km_asin"))


def _sweep_events(spark, sf_dir, scale: int) -> DataFrame:
    """(scale, threshold, season, node_id, seq, start_t, end_t) of one scale; a threshold's events are extracted once."""
    kind, thresholds = SWEEP[scale]
    scores = standardize.log_scores(standardize.rolling_accumulation(src.panel(spark, sf_dir), scale))
    late, every = materialize(events.after_burn_in(scores), "scores"), None
    for th in thresholds:
        found = events.rapid_onsets(late, P.rapid_days, th, P.rapid_final) if kind == "rapid" else events.runs_below(late, th, P.duration)
        part = events.by_season(found, _axis(spark, sf_dir), SEASONS).select(F.lit(scale).alias("scale"), F.lit(float(th)).alias("threshold"), "*")
        every = part if every is None else every.unionByName(part)
    return every


def sensitivity_sweep(spark, sf_dir):
    """Mean degree and valid nodes over scales, thresholds, seasons and tolerances, up to 135 networks in one plan.

    Events are joined once for all tolerances of a case, and its surrogates are drawn once. Cases with fewer than ten valid
    nodes have no network.
    """
    axis, n = _axis(spark, sf_dir), src.grid(spark, sf_dir).count()
    every = None
    for scale in SWEEP:
        part = _sweep_events(spark, sf_dir, scale)
        every = part if every is None else every.unionByName(part)
    by, each = ("scale", "threshold", "season"), ("scale", "threshold", "season", "tau")
    cases = materialize(every, "case-onsets")
    enough = stages.enough(sync.valid_counts(cases, by), by, SWEEP_NODES)
    kept = materialize(cases.join(F.broadcast(enough), list(by), "left_semi"), "kept-onsets")  # 45 cases
    counts = materialize(sync.valid_counts(kept, by), "case-counts")
    of_scale = F.when(F.lit(False), F.array(F.lit(0)))
    for scale in SWEEP:
        of_scale = of_scale.when(F.col("scale") == scale, F.array(*map(F.lit, TAU_SENSITIVITY[scale])))
    pairs = sync.strength(sync.met_pairs(kept, of_scale, by))
    critical = surrogate.critical_values(counts, events.season_lengths(axis, SEASONS), of_scale, SWEEP_SURROGATES, by)
    edges = surrogate.significant_edges(pairs, critical, each)
    degrees = edges.groupBy(*each).agg((2 * F.count_if("sig_strength") / F.lit(float(n * max(1, n - 1)))).alias("mean_dc"))
    nodes = counts.groupBy(*by).agg(F.count("*").alias("valid_nodes")).withColumn("tau", F.explode(of_scale))
    return nodes.join(degrees, list(each), "left").select(*each, F.coalesce("mean_dc", F.lit(0.0)).alias("mean_dc"), "valid_nodes")


NAMES = """panel_daily rolling_accumulation zero_fraction gamma_fit lognormal_fit aic_selection gof_stats distribution_fits spi gof_summary
log_scores drought_runs event_counts rapid_onset season_events sync_pairs sync_strength surrogate_draws critical_values significant_edges
degree_centrality weighted_degree sync_distance net_divergence net_divergence_weighted network_summary betweenness lat_profile lon_profile
queen_weights gi_star hotspot_clusters source_sink_flux source_sink_pathway region_labels climatology anomaly event_windows composite_mean
centered_smoothing nearest_pixel polygon_mask land_cells network_metrics vpd bowen haversine sensitivity_sweep""".split()

#: Digits to which columns whose sums depend on the order of rows are rounded.
DIGITS = {
    "gamma_fit": {"shape": 8, "scale": 3, "loglik": 4, "aic": 4},
    "lognormal_fit": {"mu": 9, "sigma": 9, "loglik": 4, "aic": 4},
    "aic_selection": {"best_aic": 4},
    "zero_fraction": {"zero_fraction": 9},
    "gof_stats": {"ppcc": 8, "ks_d_upper": 8, "ad_a2": 5},
    "sync_strength": {"q_strength": 9, "q_asym": 9},
    "critical_values": {"crit_sum": 6, "crit_diff": 6},
    "significant_edges": {"q_strength": 9, "q_asym": 9},
    "degree_centrality": {"dc": 9},
    "weighted_degree": {"dc_w": 9},
    "sync_distance": {"msd": 6, "msd_w": 6},
    "net_divergence_weighted": {"in_strength": 9, "out_strength": 9, "nd_w": 9},
    "network_metrics": {"dc": 9, "dc_w": 9, "msd": 6, "msd_w": 6, "in_strength": 9, "out_strength": 9, "nd_w": 9},
    "lat_profile": {"mean_dc": 9},
    "lon_profile": {"mean_dc": 9},
    "queen_weights": {"weight": 9},
    "gi_star": {"z": 8, "p": 8},
    "hotspot_clusters": {"lat": 8, "lon": 8},
    "source_sink_flux": {"ratio": 9},
    "source_sink_pathway": {"flux_ratio": 9, "distance_km": 6},
    "event_windows": {"value": 10},
    "composite_mean": {"mean_anomaly": 10, "standard_error": 10},
    "centered_smoothing": {"mean_anomaly": 10, "standard_error": 10},
    "vpd": {"es_kpa": 9, "vpd_kpa": 9},
    "bowen": {"bowen": 4},
    "haversine": {"km_atan": 6, "km_asin": 6},
    "sensitivity_sweep": {"mean_dc": 9},
}


def _rounded(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = globals()[name](spark, sf_dir)
        # adding zero turns a negative zero into zero
        return found.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in DIGITS.get(name, {}).items()})

    query.__name__, query.__doc__ = name, globals()[name].__doc__
    return query


QUERIES = {name: _rounded(name) for name in NAMES}
