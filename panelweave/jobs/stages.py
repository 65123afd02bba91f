"""The analysis as jobs that hand tables to each other: standardize, extract and link, find pathways, composite."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.config import (
    BASELINE,
    BC_SAMPLE_K,
    BURN_IN_DAYS,
    COMPOSITE_SEASONS,
    GI_P,
    GI_Z,
    LEAD_LAG_WINDOWS,
    MIN_CLUSTER_FRACTION,
    MIN_FLUX_RATIO,
    MIN_TOTAL_FRACTION,
    N_SURROGATES,
    SEASONS,
    SMOOTHING_WINDOWS,
    SPI_SCALES,
    SURROGATE_QUANTILE,
    TAU_SENSITIVITY,
    THRESHOLD_SENSITIVITY,
)
from panelweave.functions.lineage import materialize
from panelweave.functions.quantiles import exact_quantiles
from panelweave.operators import composite, derive, events, fitting, network, spatial, standardize, surrogate, sync
from panelweave.sources.sinks import case_path, has_case, is_complete, north_up, read_stage, write_case, write_summary

#: The pairs of scale and season that are analysed beyond their networks.
CASES = tuple((scale, season) for scale, seasons in COMPOSITE_SEASONS.items() for season in seasons)


def fit_medians(fits: DataFrame) -> DataFrame:
    """One row: valid cells and exact medians of zero fraction and goodness of fit over them, however many there are."""
    valid = fits.where("dist_id >= 0")
    columns = {"zero_fraction": "median_zero_fraction", "ppcc": "median_selected_ppcc", "ks_d_upper": "median_selected_ks_d", "ad_a2": "median_selected_ad_a2"}
    found = exact_quantiles(valid, list(columns), [0.5])
    row = (valid.count(), *[found[c][0] for c in columns])
    return fits.sparkSession.createDataFrame([row], ", ".join(["valid_cells long", *[f"{name} double" for name in columns.values()]]))


def standardize_panel(panel: DataFrame, root: str, scales: tuple[int, ...] = SPI_SCALES, land: DataFrame | None = None) -> DataFrame:
    """Index and fits of a panel at each scale, under ``root``/spi and ``root``/fits, of the cells of ``land`` (node_id) if given.

    Returns the summary of the fits, a row for each scale, which is also ``root``/gof_summary.
    """
    inside = panel if land is None else panel.join(land.select("node_id").distinct(), "node_id", "left_semi")
    rows = None
    for scale in scales:
        acc = materialize(standardize.rolling_accumulation(inside, scale), "accumulation")
        fits = materialize(fitting.fit_cells(acc), "fits")
        write_case(fitting.standardize(acc, fits), f"{root}/spi", scale=scale)
        write_case(fits, f"{root}/fits", scale=scale)
        one = fit_medians(fits).select(F.lit(scale).alias("scale_days"), "*")
        rows = one if rows is None else rows.unionByName(one)
    write_summary(rows, f"{root}/gof_summary")
    return rows


def extract(series: DataFrame, scale: int, threshold: float | None = None) -> DataFrame:
    """Events of a standardized series (node_id, t, spi) by the baseline of its scale; a threshold replaces the baseline's."""
    b = BASELINE[scale]
    limit = b["threshold"] if threshold is None else threshold
    if b["kind"] == "rapid":
        return events.rapid_onsets(series, b["development_days"], limit, b["final_threshold"], "spi")
    return events.runs_below(series, limit, b["duration"], "spi")


def cached_critical(
    counts: DataFrame, lengths: DataFrame, tau: int | Column, surrogates: int, by: tuple[str, ...], root: str, quantile: float = SURROGATE_QUANTILE
) -> DataFrame:
    """Critical values, read from ``root`` if they were made before for the same combinations and parameters, else made and kept.

    The tag is a digest over order-free sums of the combinations' and lengths' hashes; only sums reach the driver. Values
    whose writing did not come to its end are made again.
    """
    sums = []
    for part in (surrogate.combinations(counts, by), lengths):
        row_hash = F.xxhash64(*sorted(part.columns)).cast("decimal(20,0)")
        sums.append(tuple(part.agg(F.count("*"), F.sum(row_hash)).first()))
    tag = hashlib.sha256(repr((sums, str(tau), surrogates, quantile, by)).encode()).hexdigest()[:20]
    path = f"{root}/{tag}"
    if not is_complete(counts.sparkSession, path):
        surrogate.critical_values(counts, lengths, tau, surrogates, by, quantile).write.mode("overwrite").parquet(path)
    return counts.sparkSession.read.parquet(path)


def _late_index(spark: SparkSession, root: str, scale: int) -> DataFrame:
    return events.after_burn_in(read_stage(spark, f"{root}/spi", scale=scale).select("node_id", "t", "spi"))


def enough(counts: DataFrame, by: tuple[str, ...], least_nodes: int) -> DataFrame:
    """The cases with at least ``least_nodes`` valid nodes: only these have a network."""
    return counts.groupBy(*by).count().where(F.col("count") >= least_nodes).select(*by)


def link_events(
    spark: SparkSession, root: str, scale: int, grid: DataFrame, axis: DataFrame, surrogates: int = N_SURROGATES, least_nodes: int = 10, between: bool = False, sample: int | None = BC_SAMPLE_K
) -> DataFrame:
    """Networks of all seasons of one scale, in one plan keyed by season; metrics, edges and events go under ``root``.

    Seasons with fewer than ``least_nodes`` valid nodes have no network. With ``between``, metrics have ``bc`` from
    ``sample`` sources. Returns the summary, a row for each season.
    """
    days = events.after_burn_in(axis)
    seasonal = materialize(events.by_season(extract(_late_index(spark, root, scale), scale), days, SEASONS), "seasonal-events")
    write_case(seasonal, f"{root}/events", scale=scale)
    by, tau = ("season",), BASELINE[scale]["tau"]
    some = materialize(enough(sync.valid_counts(seasonal, by), by, least_nodes), "seasons")
    kept = seasonal.join(F.broadcast(some), "season", "left_semi")  # five seasons
    counts = materialize(sync.valid_counts(kept, by), "counts")
    pairs = materialize(sync.strength(sync.met_pairs(kept, tau, by)), "pairs")
    critical = cached_critical(counts, events.season_lengths(days, SEASONS), tau, surrogates, by, f"{root}/critical")
    edges = materialize(surrogate.significant_edges(pairs, critical, by), "edges")
    write_case(edges, f"{root}/edges", scale=scale)
    one = F.lit(1).alias("_one")
    cells = grid.select("node_id", "lat", "lon", one).join(F.broadcast(some.select("season", one)), "_one").drop("_one")
    metrics = network.metrics(edges, cells, by)
    if between:
        found = None
        for season in [r.season for r in some.collect()]:  # five at most
            bc = network.betweenness(edges.where(F.col("season") == season), grid, sample).withColumn("season", F.lit(season))
            found = bc if found is None else found.unionByName(bc)
        metrics = metrics.join(found, [*by, "node_id"]) if found is not None else metrics
    write_case(metrics, f"{root}/metrics", "season", scale=scale)
    summary = network.summary(edges, counts, by).withColumn("scale", F.lit(scale)).withColumn("tau", F.lit(tau))
    write_summary(summary, f"{root}/network_summary/scale={scale}")
    return summary


def sweep(
    spark: SparkSession, root: str, scale: int, grid: DataFrame, axis: DataFrame, surrogates: int = N_SURROGATES, least_nodes: int = 10,
    thresholds: tuple[float, ...] | None = None, taus: tuple[int, ...] | None = None,
) -> DataFrame:
    """Mean degree and valid nodes of a scale over thresholds, seasons and tolerances, as one plan keyed by the case.

    Degrees of each cell go under ``root``/sensitivity, the table under ``root``/sensitivity_summary. Cases with fewer than
    ``least_nodes`` valid nodes are left out.
    """
    late, days = materialize(_late_index(spark, root, scale), "index"), events.after_burn_in(axis)
    every = None
    for threshold in thresholds or THRESHOLD_SENSITIVITY[scale]:
        part = events.by_season(extract(late, scale, threshold), days, SEASONS).withColumn("threshold", F.lit(float(threshold)))
        every = part if every is None else every.unionByName(part)
    by, each = ("threshold", "season"), ("threshold", "season", "tau")
    within = F.array(*map(F.lit, taus or TAU_SENSITIVITY[scale]))
    cases = materialize(every, "case-events")
    some = materialize(enough(sync.valid_counts(cases, by), by, least_nodes), "cases")
    kept = cases.join(F.broadcast(some), list(by), "left_semi")  # 15 cases
    counts = materialize(sync.valid_counts(kept, by), "case-counts")
    pairs = materialize(sync.strength(sync.met_pairs(kept, within, by)), "case-pairs")
    critical = cached_critical(counts, events.season_lengths(days, SEASONS), within, surrogates, by, f"{root}/critical")
    edges = surrogate.significant_edges(pairs, critical, each)
    one = F.lit(1).alias("_one")
    networks = some.select(*by, F.explode(within).alias("tau"), one)
    cells = grid.select("node_id", "lat_idx", "lon_idx", one).join(F.broadcast(networks), "_one").drop("_one")
    degree = network.mirrored(edges, each).where("sig_strength").groupBy(*each, "node_id").count()
    rest = float(max(1, grid.count() - 1))
    dc = cells.join(degree, [*each, "node_id"], "left").select(*each, "node_id", "lat_idx", "lon_idx", (F.coalesce("count", F.lit(0)) / rest).alias("dc"))
    write_case(dc, f"{root}/sensitivity", scale=scale)
    nodes = counts.groupBy(*by).agg(F.count("*").alias("valid_nodes"))
    means = read_stage(spark, f"{root}/sensitivity", scale=scale).groupBy(*each).agg(F.avg("dc").alias("mean_dc"))
    summary = nodes.join(means, list(by)).select(F.lit(scale).alias("scale"), "season", "threshold", "tau", "mean_dc", "valid_nodes")
    write_summary(summary, f"{root}/sensitivity_summary/scale={scale}")
    return summary


def profiles(spark: SparkSession, root: str, scale: int, season: str = "annual") -> DataFrame:
    """(axis, place, threshold, tau, mean_dc): mean degree along rows and columns of the grid, of each case of a sweep."""
    dc = read_stage(spark, f"{root}/sensitivity", scale=scale).where(F.col("season") == season)
    along = F.explode(F.array(F.struct(F.lit("lat").alias("axis"), F.col("lat_idx").alias("place")), F.struct(F.lit("lon").alias("axis"), F.col("lon_idx").alias("place"))))
    return dc.select("threshold", "tau", "dc", along.alias("a")).groupBy("a.axis", "a.place", "threshold", "tau").agg(F.avg("dc").alias("mean_dc"))


def rasters(spark: SparkSession, root: str, scale: int, season: str, grid: DataFrame, metric: str) -> DataFrame:
    """A metric of one network in rows from the north, also written under ``root``/rasters."""
    values = read_stage(spark, f"{root}/metrics", scale=scale, season=season).select("node_id", F.col(metric).cast("double").alias("value"))
    write_case(north_up(values, grid), f"{root}/rasters", metric=metric, scale=scale, season=season)
    return read_stage(spark, f"{root}/rasters", metric=metric, scale=scale, season=season)


def find_pathway(
    spark: SparkSession, root: str, scale: int, season: str, grid: DataFrame, z: float = GI_Z, p: float = GI_P, cluster: float = MIN_CLUSTER_FRACTION,
    ratio: float = MIN_FLUX_RATIO, total: float = MIN_TOTAL_FRACTION, flux_sign: int = 1,
) -> DataFrame:
    """Source regions that share the best sink of one network; cell labels go under ``root``/regions. Returns a row for each pair."""
    nd = read_stage(spark, f"{root}/metrics", scale=scale, season=season).select("node_id", F.col("nd").cast("double").alias("x"))
    members = materialize(spatial.cluster_members(spatial.hot_cells(spatial.gi_star(nd, grid), z, p), grid), "members")
    kept = materialize(spatial.clusters(members, grid, cluster), "clusters")
    links = read_stage(spark, f"{root}/edges", scale=scale).where((F.col("season") == season) & F.col("sig_asym"))
    flux = spatial.flux_ratios(members, kept, links.select("i", "j", F.signum("q_asym").cast("int").alias("sign")), flux_sign)
    path = materialize(spatial.best_pathway(flux, kept, ratio, total, grid.count()), "pathway")
    write_case(spatial.region_labels(path, members), f"{root}/regions", scale=scale, season=season)
    km = derive.haversine_atan(F.col("src_lon"), F.col("src_lat"), F.col("snk_lon"), F.col("snk_lat"))
    return path.select("pair_id", "flux_ratio", km.alias("distance_km"), F.col("src_pixels").alias("source_pixels"), F.col("snk_pixels").alias("sink_pixels"))


def find_pathways(spark: SparkSession, root: str, grid: DataFrame, cases: tuple[tuple[int, str], ...] = CASES, **limits: float) -> DataFrame | None:
    """:func:`find_pathway` for every case that has a network; the pairs of all cases, also under ``root``/source_sink_summary.

    A case with pairs has its own table under ``root``/paired_regions.

    Cases without a network are passed over, and None comes back if there is none at all.
    """
    every = None
    for scale, season in cases:
        if not (has_case(spark, f"{root}/metrics", scale=scale, season=season) and has_case(spark, f"{root}/edges", scale=scale)):
            continue
        found = find_pathway(spark, root, scale, season, grid, **limits).select(F.lit(scale).alias("scale"), F.lit(season).alias("season"), "*")
        found = materialize(found, "pathway-rows")
        if not found.isEmpty():
            write_summary(found.orderBy("pair_id"), case_path(f"{root}/paired_regions", scale=scale, season=season))
        every = found if every is None else every.unionByName(found)
    if every is not None:
        every = materialize(every, "pathways")
        write_summary(every, f"{root}/source_sink_summary")
    return every


def composite_case(
    spark: SparkSession, root: str, scale: int, season: str, variables: DataFrame, axis: DataFrame, onsets: DataFrame, days: int, lags: tuple[int, int] | None = None, width: int | None = None
) -> DataFrame:
    """Lead-lag composites of (variable, node_id, t, value) over the source and sink cells of a pathway.

    Onsets anywhere in the source align both regions, whose cells come from ``root``/regions.
    """
    lag_min, lag_max = lags or LEAD_LAG_WINDOWS[scale]
    labels = read_stage(spark, f"{root}/regions", scale=scale, season=season)
    regions = labels.select("node_id", F.when(F.col("label") > 0, "source").otherwise("sink").alias("region"))
    anomaly = composite.anomalies(variables.join(regions.select("node_id"), "node_id", "left_semi"), axis, ("variable", "node_id"))
    starts = materialize(composite.onset_days(onsets, regions, "source", lag_min, lag_max, days), "starts")
    windows = composite.event_windows(composite.regional_means(anomaly, regions), starts, lag_min, lag_max)
    return composite.smoothed(composite.composite(windows, starts), width or SMOOTHING_WINDOWS[scale])


def composite_cases(
    spark: SparkSession, root: str, variables: DataFrame, axis: DataFrame, days: int, cases: tuple[tuple[int, str], ...] = CASES, offset: int = BURN_IN_DAYS, width: int | None = None
) -> DataFrame | None:
    """:func:`composite_case` for every case with regions and events; rows have their scale and season, under ``root``/composites.

    Seasonal events are counted from the end of the burn-in, ``offset`` days behind the begin of the variables. A table of
    each case is ``root``/lead_lag. Cases without regions or onsets are passed over; None if there is none at all.
    """
    done = []
    for scale, season in cases:
        if not (has_case(spark, f"{root}/regions", scale=scale, season=season) and has_case(spark, f"{root}/events", scale=scale)):
            continue
        onsets = read_stage(spark, f"{root}/events", scale=scale).where(F.col("season") == season).withColumn("start_t", F.col("start_t") + offset)
        found = composite_case(spark, root, scale, season, variables, axis, onsets, days, width=width)
        write_case(found, f"{root}/composites", scale=scale, season=season)
        if has_case(spark, f"{root}/composites", scale=scale, season=season):
            one = read_stage(spark, f"{root}/composites", scale=scale, season=season)
            write_summary(one.orderBy("variable", "region", "lag"), case_path(f"{root}/lead_lag", scale=scale, season=season))
            done.append((scale, season))
    return read_stage(spark, f"{root}/composites") if done else None


def plot_table(composites: DataFrame, variables: tuple[str, ...], most: int = 6) -> DataFrame:
    """The rows of the first ``most`` of ``variables`` that occur, in their order, with their ``place`` and the band of one standard error.

    A table has no order of its own, so the order in which variables were analysed is given. Repeated names count once.
    """
    order = composites.sparkSession.createDataFrame([(v, k) for k, v in enumerate(dict.fromkeys(variables))], "variable string, place int")
    found = composites.select("variable").distinct().join(F.broadcast(order), "variable")  # names that are given
    kept = found.orderBy("place").limit(most)
    upper, lower = F.col("mean_anomaly") + F.col("standard_error"), F.col("mean_anomaly") - F.col("standard_error")
    return composites.join(F.broadcast(kept), "variable").withColumn("lower", lower).withColumn("upper", upper)
