"""DuckDB SQL with the rows of the registered queries. Pairs are compared plainly here, without buckets."""

from __future__ import annotations

from panelweave.config import BURN_IN_DAYS, FIXTURE, MIN_EVENTS, SEASONS, SURROGATE_QUANTILE, TAU_SENSITIVITY
from panelweave.functions import special
from panelweave.jobs.catalog import DIGITS, FOLDS, RINGS, SINK_FOLD, SOURCE_FOLD, SWEEP, SWEEP_NODES, SWEEP_SURROGATES
from panelweave.operators import surrogate

P = FIXTURE
CTES: dict[str, str] = {}


def _poly(terms, x: str) -> str:
    out = repr(terms[0])
    for c in terms[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _cdf(z: str) -> str:
    x = f"abs({z})"
    near = f"exp(-{x} * {x} / 2) * {_poly(special._N, x)} / {_poly(special._M, x)}"
    return f"(CASE WHEN {z} > 0 THEN 1 - {near} ELSE {near} END)"


def _ppf(p: str) -> str:
    q, low = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    middle = f"{q} * {_poly(special._A, f'({q} * {q})')} / {_poly(special._B, f'({q} * {q})')}"
    tail = f"{_poly(special._C, low)} / {_poly(special._D, low)}"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 0.97575 THEN -({tail}) ELSE {middle} END)"


def _series(prefix: str, panel: str, scale: int = P.scale) -> None:
    """From a panel to onsets: accumulation, moments, scores, scores behind the burn-in, numbered runs."""
    CTES[f"{prefix}acc"] = f"""SELECT node_id, t, CASE WHEN t >= {scale} THEN sum(value) OVER (PARTITION BY node_id ORDER BY t ROWS {scale - 1} PRECEDING)::DOUBLE END AS acc FROM {panel}"""
    CTES[f"{prefix}mom"] = f"""SELECT node_id, count(*) AS n, avg(acc) AS mean, avg(ln(acc)) AS mean_log, stddev_samp(ln(acc)) AS sd_log, sum(ln(acc) * ln(acc)) AS sum_log2 FROM {prefix}acc WHERE acc > 0 GROUP BY node_id"""
    CTES[f"{prefix}scores"] = f"""SELECT a.node_id, t, CASE WHEN acc > 0 THEN round((ln(acc) - mean_log) / sd_log, 6) END AS z FROM {prefix}acc a LEFT JOIN {prefix}mom m ON a.node_id = m.node_id"""
    CTES[f"{prefix}late"] = f"""SELECT node_id, t - {BURN_IN_DAYS} AS t, z FROM {prefix}scores WHERE t >= {BURN_IN_DAYS}"""
    CTES[f"{prefix}onsets"] = _runs(f"{prefix}late", P.threshold)


def _runs(late: str, threshold: float, more: str = "") -> str:
    return f"""SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY start_t)::INT AS seq, start_t::INT AS start_t, end_t::INT AS end_t{more} FROM (
      SELECT node_id, min(t) AS start_t, max(t) AS end_t FROM (SELECT node_id, t, t - row_number() OVER (PARTITION BY node_id ORDER BY t) AS k FROM {late} WHERE z < {threshold}) GROUP BY node_id, k
      HAVING max(t) - min(t) >= {P.duration})"""


def _rapid(late: str, change: float) -> str:
    return f"""SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY start_t)::INT AS seq, start_t::INT AS start_t, end_t::INT AS end_t FROM (
        SELECT m.node_id, k, min(next_low) AS start_t, max(end_t) AS end_t FROM (
          SELECT node_id, t, lead(z, {P.rapid_days}) OVER w - z AS delta, min(CASE WHEN z <= {P.rapid_final} THEN t END) OVER a AS next_low, count(z) OVER a AS present, max(t) OVER (PARTITION BY node_id) AS last FROM {late}
          WINDOW w AS (PARTITION BY node_id ORDER BY t), a AS (PARTITION BY node_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {P.rapid_days - 1} FOLLOWING)) m
        JOIN (SELECT node_id, t, k, max(t) OVER (PARTITION BY node_id, k) AS end_t FROM (SELECT node_id, t, t - row_number() OVER (PARTITION BY node_id ORDER BY t) AS k FROM {late} WHERE z <= {P.rapid_final})) e
          ON m.node_id = e.node_id AND m.next_low = e.t
        WHERE delta <= {change} AND present = {P.rapid_days} AND m.t <= last - {P.rapid_days + 1} GROUP BY m.node_id, k)"""


CTES["grid"] = "SELECT n_nationkey::BIGINT AS node_id, (n_nationkey // 5)::INT AS lat_idx, (n_nationkey % 5)::INT AS lon_idx, 20 + 0.25 * (n_nationkey // 5)::DOUBLE AS lat, 100 + 0.25 * (n_nationkey % 5)::DOUBLE AS lon FROM nation"
CTES["record"] = "SELECT min(o_orderdate)::DATE AS d0, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1 AS days FROM orders"
CTES["span"] = f"SELECT days - {BURN_IN_DAYS} AS days FROM record"
CTES["axis_all"] = "SELECT t, dayofyear(d0 + t::INT) AS doy, month(d0 + t::INT) AS month FROM (SELECT d0, unnest(range(0, days)) AS t FROM record)"
CTES["axis"] = f"SELECT t - {BURN_IN_DAYS} AS t, doy, month FROM axis_all WHERE t >= {BURN_IN_DAYS}"
CTES["panel"] = """SELECT g.node_id, a.t::INT AS t, coalesce(v, 0::DECIMAL(28,2)) AS value FROM grid g CROSS JOIN axis_all a LEFT JOIN (
  SELECT c_nationkey::BIGINT AS node_id, date_diff('day', d0, o_orderdate::DATE) AS t, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders JOIN customer ON o_custkey = c_custkey, record GROUP BY 1, 2) d
  ON d.node_id = g.node_id AND d.t = a.t"""
_series("", "panel")
CTES["gamma"] = """SELECT node_id, shape, scale, n * ((shape - 1) * mean_log - mean / scale - lgamma(shape) - shape * ln(scale)) AS loglik FROM (
  SELECT *, mean / shape AS scale FROM (SELECT *, (1 + sqrt(1 + 4 * a / 3)) / (4 * a) AS shape FROM (SELECT *, greatest(ln(mean) - mean_log, 1e-10) AS a FROM mom)))"""
CTES["lognormal"] = """SELECT node_id, mean_log AS mu, sd_log AS sigma, -n * mean_log - n * ln(sd_log) - n * ln(2 * pi()) / 2 - (sum_log2 - n * mean_log * mean_log) / (2 * sd_log * sd_log) AS loglik FROM mom"""
CTES["seasons"] = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {m})" for s, months in SEASONS.items() for m in (months or range(1, 13))) + ") v(season, month)"
CTES["lengths"] = "SELECT season, count(*) AS season_length FROM axis JOIN seasons USING (month) GROUP BY season"
CTES["valid"] = f"SELECT node_id, count(*) AS n FROM onsets GROUP BY node_id HAVING count(*) >= {MIN_EVENTS}"


def _pairs(onsets: str, valid: str, tau: str, by: tuple[str, ...] = ()) -> str:
    same = "".join(f" AND a.{c} = b.{c}" for c in by)
    cols = "".join(f"a.{c}, " for c in by)
    same_p = "".join(f" AND p.{c} = s.{c}" for c in by)
    own = "".join(f"p.{c}, " for c in by)
    later = f"(SELECT o.* FROM {onsets} o SEMI JOIN {valid} v ON o.node_id = v.node_id{''.join(f' AND o.{c} = v.{c}' for c in by)} WHERE seq >= 2)"
    return f"""SELECT {own}p.i, p.j, p.ni, p.nj, coalesce(j_j2i, 0)::DOUBLE AS j_j2i, coalesce(j_i2j, 0)::DOUBLE AS j_i2j FROM
      (SELECT {cols}a.node_id AS i, b.node_id AS j, a.n AS ni, b.n AS nj FROM {valid} a JOIN {valid} b ON a.node_id < b.node_id{same}) p LEFT JOIN
      (SELECT {cols}a.node_id AS i, b.node_id AS j, sum(CASE WHEN a.start_t = b.start_t THEN 0.5 WHEN a.start_t > b.start_t THEN 1 ELSE 0 END) AS j_j2i,
        sum(CASE WHEN a.start_t = b.start_t THEN 0.5 WHEN a.start_t < b.start_t THEN 1 ELSE 0 END) AS j_i2j
       FROM {later} a JOIN {later} b ON a.node_id < b.node_id{same} AND abs(a.start_t - b.start_t) < {tau} GROUP BY ALL) s ON p.i = s.i AND p.j = s.j{same_p}"""


CTES["pairs"] = f"SELECT *, (j_j2i + j_i2j) / sqrt(ni::DOUBLE * nj) AS q_strength, (j_j2i - j_i2j) / sqrt(ni::DOUBLE * nj) AS q_asym FROM ({_pairs('onsets', 'valid', str(P.tau))})"
CTES["combos"] = "SELECT ni, nj, row_number() OVER (ORDER BY ni, nj) AS c FROM (SELECT DISTINCT least(ni, nj) AS ni, greatest(ni, nj) AS nj FROM pairs)"
_M, _I, _N = surrogate.MULTIPLIER, surrogate.INCREMENT, surrogate.MODULUS
CTES["jumps"] = f"""SELECT k - 1 AS k, a, b FROM (WITH RECURSIVE r(k, a, b) AS (SELECT 1, {_M}::BIGINT, {_I}::BIGINT UNION ALL SELECT k + 1, a * {_M} % {_N}, (b * {_M} + {_I}) % {_N} FROM r WHERE k < 2600) SELECT * FROM r) WHERE k >= 2"""


def _draws(combos: str, surrogates: int, by: tuple[str, ...] = ()) -> str:
    own = "".join(f"{c}, " for c in by)
    seed = lambda x, y: f"(xor(c * {x}, s * {y}) & {_N - 1})"
    return f"""SELECT {own}c, s, side, j.k, (j.a * seed + j.b) % {_N} % season_length AS day FROM (
      SELECT {own}c, s, season_length, unnest([{{'side': 'i', 'n': ni, 'seed': {seed(surrogate.SEED_A, surrogate.SEED_B)}}}, {{'side': 'j', 'n': nj, 'seed': {seed(surrogate.SEED_B, surrogate.SEED_A)}}}], recursive := true)
      FROM (SELECT *, unnest(range(1, {surrogates + 1})) AS s FROM {combos})) x JOIN jumps j ON j.k BETWEEN 1 AND n"""


def _critical(combos: str, draws: str, surrogates: int, tau: str, by: tuple[str, ...] = ()) -> str:
    own = "".join(f"{c}, " for c in by)
    using = ", ".join([*by, "c", "s"])
    return f"""SELECT {own}ni, nj, c, quantile_cont(total, {SURROGATE_QUANTILE}) AS crit_sum, quantile_cont(diff, {SURROGATE_QUANTILE}) AS crit_diff FROM (
      SELECT {own}ni, nj, c, s, coalesce(total, 0)::DOUBLE AS total, coalesce(diff, 0)::DOUBLE AS diff FROM (SELECT *, unnest(range(1, {surrogates + 1})) AS s FROM {combos}) LEFT JOIN (
        SELECT {using}, count(*) AS total, abs(sum(sign(a.day - b.day))) AS diff FROM (SELECT * FROM {draws}_late WHERE side = 'i') a JOIN (SELECT * FROM {draws}_late WHERE side = 'j') b USING ({using})
        WHERE abs(a.day - b.day) < {tau} GROUP BY {using}) USING ({using})) GROUP BY ALL"""


def _late(draws: str, by: tuple[str, ...] = ()) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join([*by, 'c', 's', 'side'])} ORDER BY day, k) AS r FROM {draws}) WHERE r >= 2"


CTES["combos_sized"] = "SELECT combos.*, days AS season_length FROM combos, span"
CTES["draws"] = _draws("combos_sized", P.surrogates)
CTES["draws_late"] = _late("draws")
CTES["critical"] = _critical("combos", "draws", P.surrogates, str(P.tau))
CTES["edges"] = "SELECT i, j, q_strength, q_asym, j_j2i + j_i2j > crit_sum AS sig_strength, abs(j_j2i - j_i2j) > crit_diff AS sig_asym FROM pairs p JOIN critical c ON least(p.ni, p.nj) = c.ni AND greatest(p.ni, p.nj) = c.nj WHERE j_j2i + j_i2j > crit_sum OR abs(j_j2i - j_i2j) > crit_diff"
CTES["mirror"] = "SELECT i AS node_id, j AS other, q_asym, q_strength, sig_strength, sig_asym FROM edges UNION ALL SELECT j, i, -q_asym, q_strength, sig_strength, sig_asym FROM edges"
_CELLS = "(SELECT count(*) FROM grid)"
CTES["degrees"] = f"SELECT g.node_id, count(other) / ({_CELLS} - 1)::DOUBLE AS dc FROM grid g LEFT JOIN (SELECT * FROM mirror WHERE sig_strength) b ON g.node_id = b.node_id GROUP BY g.node_id"
CTES["reached"] = f"""SELECT s, v, min(d) AS d FROM (WITH RECURSIVE walks(s, v, d) AS (SELECT node_id, node_id, 0 FROM grid UNION
  SELECT s, m.other, d + 1 FROM walks w JOIN mirror m ON m.node_id = w.v AND m.sig_strength WHERE d + 1 < {_CELLS}) SELECT * FROM walks) GROUP BY s, v"""
CTES["shortest"] = """SELECT s, v, d, sum(n) AS n FROM (WITH RECURSIVE ways(s, v, d, n) AS (SELECT node_id, node_id, 0, 1::DOUBLE FROM grid UNION ALL
  SELECT w.s, m.other, w.d + 1, sum(w.n) FROM ways w JOIN mirror m ON m.node_id = w.v AND m.sig_strength JOIN reached r ON r.s = w.s AND r.v = m.other AND r.d = w.d + 1 GROUP BY ALL) SELECT * FROM ways) GROUP BY s, v, d"""
CTES["between"] = f"""SELECT g.node_id, coalesce(x, 0) / (({_CELLS} - 1) * ({_CELLS} - 2)) AS bc FROM grid g LEFT JOIN (
  SELECT a.v AS node_id, sum(a.n * b.n / whole.n) AS x FROM shortest a JOIN shortest b ON b.s = a.v JOIN shortest whole ON whole.s = a.s AND whole.v = b.v AND whole.d = a.d + b.d
  WHERE a.d > 0 AND b.d > 0 GROUP BY a.v) USING (node_id)"""
CTES["cells"] = "SELECT *, 20 + 0.25 * lat_idx AS lat, 100 + 0.25 * lon_idx AS lon FROM (SELECT DISTINCT l_partkey % 400 AS node_id, (l_partkey % 400 // 20)::INT AS lat_idx, (l_partkey % 400 % 20)::INT AS lon_idx FROM lineitem)"
CTES["x"] = "SELECT l_partkey % 400 AS node_id, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS x FROM lineitem GROUP BY 1"
CTES["near"] = "SELECT a.node_id AS i, b.node_id AS j FROM cells a JOIN cells b ON abs(a.lat_idx - b.lat_idx) <= 1 AND abs(a.lon_idx - b.lon_idx) <= 1 AND a.node_id <> b.node_id"
CTES["queen"] = "SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS weight FROM near"
CTES["gi_z"] = """SELECT node_id, (w - mean) / (sd * sqrt(greatest((n * w2 - 1) / (n - 1), 1e-12))) AS z FROM (
  SELECT x.node_id, CASE WHEN wx IS NULL THEN x ELSE (x + wx) / 2 END AS w, CASE WHEN w2 IS NULL THEN 1 ELSE (1 + w2) / 4 END AS w2 FROM x LEFT JOIN (
    SELECT i AS node_id, sum(weight * x.x) AS wx, sum(weight * weight) AS w2 FROM queen JOIN x ON j = x.node_id GROUP BY i) USING (node_id)), (SELECT count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM x)"""
CTES["hot"] = f"SELECT * FROM (SELECT c.*, CASE WHEN round(z, 9) < {-P.hot_z} THEN 'source' WHEN round(z, 9) > {P.hot_z} THEN 'sink' END AS kind FROM cells c JOIN gi_z USING (node_id)) WHERE kind IS NOT NULL"
CTES["members"] = """SELECT kind, node_id, min(root) AS cluster_id FROM (WITH RECURSIVE reach(kind, node_id, root) AS (SELECT kind, node_id, node_id FROM hot UNION
  SELECT h.kind, h.node_id, r.root FROM reach r JOIN near n ON n.i = r.node_id JOIN hot h ON h.node_id = n.j AND h.kind = r.kind) SELECT * FROM reach) GROUP BY kind, node_id"""
CTES["kept"] = f"SELECT kind, cluster_id, count(*) AS pixels, avg(lat) AS lat, avg(lon) AS lon FROM members JOIN cells USING (node_id) GROUP BY 1, 2 HAVING count(*) >= {P.cluster_fraction} * (SELECT count(*) FROM cells)"
CTES["inside"] = "SELECT m.*, pixels FROM members m JOIN kept USING (kind, cluster_id)"
CTES["part_panel"] = """SELECT g.node_id, a.t::INT AS t, coalesce(v, 0::DECIMAL(28,2)) AS value FROM (SELECT node_id FROM inside) g CROSS JOIN axis_all a LEFT JOIN (
  SELECT l_partkey % 400 AS node_id, date_diff('day', d0, l_shipdate::DATE) AS t, sum(l_quantity::DECIMAL(18,2)) AS v FROM lineitem, record GROUP BY 1, 2) d ON d.node_id = g.node_id AND d.t = a.t"""
_series("part_", "part_panel")
CTES["part_valid"] = f"SELECT node_id, count(*) AS n FROM part_onsets GROUP BY node_id HAVING count(*) >= {MIN_EVENTS}"
CTES["part_pairs"] = _pairs("part_onsets", "part_valid", str(P.tau))
CTES["signs"] = "SELECT i AS a, j AS b, sign(j_j2i - j_i2j) AS s FROM part_pairs UNION ALL SELECT j, i, sign(j_i2j - j_j2i) FROM part_pairs"
CTES["flux"] = """SELECT src.cluster_id AS src, snk.cluster_id AS snk, src.pixels AS src_pixels, snk.pixels AS snk_pixels, count(DISTINCT a) / src.pixels::DOUBLE AS ratio
  FROM signs JOIN inside src ON a = src.node_id AND src.kind = 'source' JOIN inside snk ON b = snk.node_id AND snk.kind = 'sink' WHERE s = 1 GROUP BY src.cluster_id, snk.cluster_id, src.pixels, snk.pixels"""
CTES["chosen"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ratio DESC, snk) AS r FROM flux WHERE ratio > 0) WHERE r = 1 AND ratio >= {P.flux_ratio}"
CTES["best"] = f"SELECT snk FROM (SELECT snk, sum(src_pixels) + max(snk_pixels) AS area, min(src) AS lead_src FROM chosen GROUP BY snk) WHERE area >= {P.cluster_fraction} * (SELECT count(*) FROM cells) ORDER BY area DESC, lead_src LIMIT 1"
CTES["path"] = """SELECT row_number() OVER (ORDER BY src) AS pair_id, src, c.snk, ratio AS flux_ratio, src_pixels, snk_pixels, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
  FROM chosen c JOIN best USING (snk) JOIN kept a ON a.kind = 'source' AND a.cluster_id = src JOIN kept b ON b.kind = 'sink' AND b.cluster_id = c.snk"""
CTES["daily_sums"] = """SELECT s_nationkey::BIGINT AS node_id, date_diff('day', d0, l_shipdate::DATE)::INT AS t, count(*) AS n, sum((l_quantity::DECIMAL(18,2) * 100)::BIGINT)::BIGINT AS q,
  sum((l_extendedprice::DECIMAL(18,2) * 100)::BIGINT)::BIGINT AS p, sum((l_discount::DECIMAL(18,2) * 100)::BIGINT)::BIGINT AS d, sum((l_tax::DECIMAL(18,2) * 100)::BIGINT)::BIGINT AS x
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey, record WHERE date_diff('day', d0, l_shipdate::DATE) BETWEEN 0 AND days - 1 GROUP BY 1, 2"""
CTES["daily"] = """SELECT node_id, t, q * 10000 AS "Pre", p * 10 // n AS "Tm", d * 10000 // n AS "VPD", x * 10000 // n AS "SWL1", CASE WHEN d <> 0 THEN x * 1000000 // d END AS "Bowen", n * 1000000 AS "W500" FROM daily_sums"""
CTES["diag"] = " UNION ALL ".join(f"SELECT '{v}' AS variable, node_id, t, (\"{v}\"::DECIMAL(24,0) * 0.000001)::DECIMAL(24,6) AS value FROM daily" for v in ("Pre", "Tm", "VPD", "SWL1", "Bowen", "W500"))
CTES["regions"] = f"SELECT * FROM (SELECT node_id, CASE node_id % {FOLDS} WHEN {SOURCE_FOLD} THEN 'source' WHEN {SINK_FOLD} THEN 'sink' END AS region FROM grid) WHERE region IS NOT NULL"
CTES["diag_late"] = f"SELECT variable, node_id, t - {BURN_IN_DAYS} AS t, value FROM diag WHERE t >= {BURN_IN_DAYS}"
CTES["anomalies"] = "SELECT variable, node_id, t, value::DOUBLE - (sum(value) OVER w)::DOUBLE / nullif(count(value) OVER w, 0) AS anomaly FROM diag_late JOIN axis USING (t) WINDOW w AS (PARTITION BY variable, node_id, doy)"
CTES["means"] = "SELECT variable, region, t, avg(anomaly) AS value FROM anomalies JOIN regions USING (node_id) GROUP BY ALL"
CTES["starts"] = f"SELECT DISTINCT start_t AS start FROM onsets SEMI JOIN (SELECT * FROM regions WHERE region = 'source') r USING (node_id), span WHERE start_t >= {-P.lags[0]} AND start_t < days - {P.lags[1]}"
CTES["windows"] = f"SELECT variable, region, start, lag, value FROM means JOIN (SELECT start, unnest(range({P.lags[0]}, {P.lags[1] + 1}))::INT AS lag FROM starts) w ON t = start + lag"
CTES["composites"] = "SELECT variable, region, lag, avg(value) AS mean_anomaly, stddev_pop(value) / sqrt((SELECT greatest(1, count(*)) FROM starts)) AS standard_error, (SELECT count(*) FROM starts) AS n_events FROM windows GROUP BY 1, 2, 3"
CTES["points"] = "SELECT c_custkey, c_nationkey::BIGINT AS node_id, 100 + c_acctbal / 5000 AS lon, 20 + (c_custkey % 100) / 100.0::DOUBLE AS lat FROM customer"
for _scale in SWEEP:
    if _scale != P.scale:
        _series(f"s{_scale}_", "panel", _scale)
_BY = ("scale", "threshold", "season", "tau")
_cases = " UNION ALL ".join(
    f"SELECT node_id, start_t, {scale} AS scale, {float(th)}::DOUBLE AS threshold, unnest({list(TAU_SENSITIVITY[scale])}) AS tau FROM ({_rapid(late, th) if kind == 'rapid' else _runs(late, th)})"
    for scale, (kind, thresholds) in SWEEP.items()
    for late in ["late" if scale == P.scale else f"s{scale}_late"]
    for th in thresholds
)
_EVERY = ", ".join(_BY)
CTES["case_onsets"] = f"SELECT {_EVERY}, node_id, row_number() OVER (PARTITION BY {_EVERY}, node_id ORDER BY start_t) AS seq, start_t FROM ({_cases}) o JOIN axis ON axis.t = o.start_t JOIN seasons USING (month)"
CTES["case_nodes"] = f"SELECT {_EVERY}, node_id, count(*) AS n FROM case_onsets GROUP BY ALL HAVING count(*) >= {MIN_EVENTS}"
CTES["case_valid"] = f"SELECT * FROM case_nodes QUALIFY count(*) OVER (PARTITION BY {_EVERY}) >= {SWEEP_NODES}"
CTES["case_pairs"] = _pairs("case_onsets", "case_valid", "a.tau", _BY)
CTES["case_combos"] = f"SELECT *, row_number() OVER (PARTITION BY {_EVERY} ORDER BY ni, nj) AS c FROM (SELECT DISTINCT {_EVERY}, least(ni, nj) AS ni, greatest(ni, nj) AS nj FROM case_pairs)"
CTES["case_sized"] = "SELECT * FROM case_combos JOIN lengths USING (season)"
CTES["case_draws"] = _draws("case_sized", SWEEP_SURROGATES, _BY)
CTES["case_draws_late"] = _late("case_draws", _BY)
CTES["case_critical"] = _critical("case_combos", "case_draws", SWEEP_SURROGATES, "tau", _BY)
CTES["case_edges"] = f"""SELECT {", ".join(f"p.{c}" for c in _BY)}, count(*) FILTER (j_j2i + j_i2j > crit_sum) AS e FROM case_pairs p JOIN case_critical c ON {" AND ".join(f"p.{c} = c.{c}" for c in _BY)}
  AND least(p.ni, p.nj) = c.ni AND greatest(p.ni, p.nj) = c.nj GROUP BY ALL"""

_ORDER = list(CTES)


def _with(select: str, last: str | None = None) -> str:
    """``select`` over the parts it needs, found by their names."""
    import re

    needed: set[str] = set()
    todo = [select]
    while todo:
        for name in set(re.findall(r"[a-z_0-9]+", todo.pop())) & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    body = ",\n".join(f"{n} AS ({CTES[n]})" for n in _ORDER if n in needed)
    return f"WITH {body}\n{select}" if needed else select


def _haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ** 2)"


def _crossings() -> str:
    out = []
    for ring in RINGS:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y1 != y2:
                out.append(f"(CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < (lat - {y1}) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE + {x1} THEN 1 ELSE 0 END)")
    return " + ".join(out)


_F = f"greatest(1e-12, least(1 - 1e-12, {_cdf('((ln(acc) - mean_log) / sd_log)')}))"
_A = _haversine("lon", "lat", "lon2", "lat2")
_HALF = (P.smoothing - 1) // 2
_T = _haversine("lon1", "lat1", "lon2", "lat2")

ORACLES = {
    "panel_daily": _with("SELECT node_id, t, value::DOUBLE AS value FROM panel"),
    "rolling_accumulation": _with("SELECT node_id, t, acc FROM acc"),
    "zero_fraction": _with("SELECT node_id, count(*) AS n, avg(CASE WHEN acc = 0 THEN 1.0 ELSE 0.0 END) AS zero_fraction FROM acc WHERE acc IS NOT NULL GROUP BY node_id"),
    "gamma_fit": _with("SELECT node_id, shape, scale, loglik, 4 - 2 * loglik AS aic FROM gamma"),
    "lognormal_fit": _with("SELECT node_id, mu, sigma, loglik, 4 - 2 * loglik AS aic FROM lognormal"),
    "aic_selection": _with("SELECT node_id, CASE WHEN g.loglik >= l.loglik - 1 THEN 0 ELSE 1 END AS dist_id, least(4 - 2 * g.loglik, 4 - 2 * l.loglik) AS best_aic FROM gamma g JOIN lognormal l USING (node_id)"),
    "gof_stats": _with(
        f"""SELECT node_id, corr(acc, q) AS ppcc, max(abs(f - i / n::DOUBLE)) AS ks_d_upper, -max(n) - avg((2 * i - 1) * (ln(f) + ln(1 - b))) AS ad_a2 FROM (
        SELECT *, {_F} AS f, exp(mean_log + sd_log * {_ppf('((i - 0.3175) / (n + 0.365))')}) AS q, lag(0) OVER (), first_value(0) OVER () FROM (SELECT a.*, mean_log, sd_log, n, row_number() OVER (PARTITION BY a.node_id ORDER BY acc, t)::DOUBLE AS i
          FROM acc a JOIN mom USING (node_id) WHERE acc > 0)) s JOIN (SELECT node_id, n + 1 - i AS i, {_F} AS b FROM (SELECT a.*, mean_log, sd_log, n, row_number() OVER (PARTITION BY a.node_id ORDER BY acc, t)::DOUBLE AS i
          FROM acc a JOIN mom USING (node_id) WHERE acc > 0)) r USING (node_id, i) GROUP BY node_id""".replace(", lag(0) OVER (), first_value(0) OVER ()", "")
    ),
    "log_scores": _with("SELECT node_id, t, z FROM scores"),
    "drought_runs": _with("SELECT node_id, seq, start_t, end_t FROM onsets"),
    "event_counts": _with("SELECT grid.node_id, count(seq) AS n_events FROM grid LEFT JOIN onsets USING (node_id) GROUP BY 1"),
    "rapid_onset": _with(_rapid("late", P.rapid_change)),
    "season_events": _with("SELECT season, node_id, count(*) AS n_events, min(start_t) AS first_start, any_value(season_length) AS season_length FROM onsets o JOIN axis ON axis.t = o.start_t JOIN seasons USING (month) JOIN lengths USING (season) GROUP BY 1, 2"),
    "sync_pairs": _with("SELECT i, j, ni, nj, j_j2i, j_i2j FROM pairs"),
    "sync_strength": _with("SELECT i, j, q_strength, q_asym FROM pairs"),
    "surrogate_draws": _with("SELECT c, s, side, k, day FROM draws"),
    "critical_values": _with("SELECT ni, nj, c, crit_sum, crit_diff FROM critical"),
    "significant_edges": _with("SELECT i, j, q_strength, q_asym, sig_strength, sig_asym FROM edges"),
    "degree_centrality": _with("SELECT node_id, dc FROM degrees"),
    "weighted_degree": _with(f"SELECT g.node_id, coalesce(sum(q_strength), 0) / ({_CELLS} - 1)::DOUBLE AS dc_w FROM grid g LEFT JOIN (SELECT * FROM mirror WHERE sig_strength) b ON g.node_id = b.node_id GROUP BY 1"),
    "sync_distance": _with(
        f"""SELECT grid.node_id, coalesce(msd, 0) AS msd, coalesce(msd_w, 0) AS msd_w FROM grid LEFT JOIN (SELECT node_id, avg(d) AS msd, sum(d * q_strength) / sum(q_strength) AS msd_w FROM (
        SELECT b.node_id, q_strength, 2 * 6371.0 * asin(sqrt(least(1.0, {_haversine('g.lon', 'g.lat', 'h.lon', 'h.lat')}))) AS d FROM mirror b JOIN grid g ON b.node_id = g.node_id JOIN grid h ON b.other = h.node_id WHERE sig_strength) GROUP BY 1) USING (node_id)"""
    ),
    "net_divergence": _with("SELECT node_id, coalesce(a, 0) AS in_degree, coalesce(z, 0) AS out_degree, coalesce(a - z, 0) AS nd FROM grid LEFT JOIN (SELECT node_id, count(*) FILTER (q_asym > 0) AS a, count(*) FILTER (q_asym < 0) AS z FROM mirror WHERE sig_asym GROUP BY 1) USING (node_id)"),
    "net_divergence_weighted": _with("SELECT node_id, coalesce(a, 0) AS in_strength, coalesce(z, 0) AS out_strength, coalesce(a - z, 0) AS nd_w FROM grid LEFT JOIN (SELECT node_id, sum(greatest(q_asym, 0)) AS a, sum(greatest(-q_asym, 0)) AS z FROM mirror WHERE sig_asym GROUP BY 1) USING (node_id)"),
    "network_summary": _with("SELECT (SELECT count(*) FROM valid) AS valid_nodes, count(*) FILTER (sig_strength) AS undirected_edges, 2 * count(*) FILTER (sig_asym) AS directed_entries FROM edges"),
    "betweenness": _with("SELECT node_id, bc FROM between"),
    "lat_profile": _with("SELECT lat_idx, lat, avg(dc) AS mean_dc FROM degrees JOIN grid USING (node_id) GROUP BY 1, 2"),
    "lon_profile": _with("SELECT lon_idx, lon, avg(dc) AS mean_dc FROM degrees JOIN grid USING (node_id) GROUP BY 1, 2"),
    "queen_weights": _with("SELECT i, j, weight FROM queen"),
    "gi_star": _with(f"SELECT node_id, z, 2 * (1 - {_cdf('abs(z)')}) AS p FROM gi_z"),
    "hotspot_clusters": _with("SELECT kind, cluster_id, pixels, lat, lon FROM kept"),
    "source_sink_flux": _with("SELECT src, snk, src_pixels, snk_pixels, ratio FROM flux"),
    "source_sink_pathway": _with(f"SELECT pair_id, src, snk, flux_ratio, 2 * 6371.0 * atan2(sqrt({_T}), sqrt(1 - {_T})) AS distance_km, src_pixels AS source_pixels, snk_pixels AS sink_pixels FROM path"),
    "region_labels": _with("SELECT node_id, pair_id AS label FROM members m JOIN path ON m.kind = 'source' AND m.cluster_id = src UNION ALL SELECT node_id, -max(pair_id) FROM members m JOIN path ON m.kind = 'sink' AND m.cluster_id = snk GROUP BY node_id"),
    "climatology": _with("SELECT variable, node_id, doy, sum(value)::DOUBLE / nullif(count(value), 0) AS mean FROM diag JOIN axis_all USING (t) GROUP BY 1, 2, 3"),
    "anomaly": _with("SELECT variable, node_id, t, value::DOUBLE - (sum(value) OVER w)::DOUBLE / nullif(count(value) OVER w, 0) AS anomaly FROM diag JOIN axis_all USING (t) WINDOW w AS (PARTITION BY variable, node_id, doy)"),
    "event_windows": _with("SELECT variable, region, start, lag, value FROM windows"),
    "composite_mean": _with("SELECT variable, region, lag, mean_anomaly, standard_error, n_events FROM composites"),
    "centered_smoothing": _with(f"SELECT variable, region, lag, avg(mean_anomaly) OVER w AS mean_anomaly, avg(standard_error) OVER w AS standard_error, n_events FROM composites WINDOW w AS (PARTITION BY variable, region ORDER BY lag ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING)"),
    "nearest_pixel": _with("SELECT c_custkey, (SELECT lat_idx FROM grid ORDER BY abs(grid.lat - points.lat), lat_idx LIMIT 1) AS lat_idx, (SELECT lon_idx FROM grid ORDER BY abs(grid.lon - points.lon), lon_idx LIMIT 1) AS lon_idx FROM points"),
    "polygon_mask": _with(f"SELECT c_custkey, ({_crossings()}) % 2 = 1 AS inside FROM points"),
    "land_cells": _with(f"SELECT node_id FROM grid WHERE ({_crossings()}) % 2 = 1"),
    "network_metrics": _with(
        f"""SELECT grid.node_id, coalesce(dc, 0) AS dc, coalesce(dc_w, 0) AS dc_w, coalesce(msd, 0) AS msd, coalesce(msd_w, 0) AS msd_w, coalesce(a, 0) AS in_degree, coalesce(z, 0) AS out_degree, coalesce(a - z, 0) AS nd,
        coalesce(s, 0) AS in_strength, coalesce(o, 0) AS out_strength, coalesce(s, 0) - coalesce(o, 0) AS nd_w FROM grid LEFT JOIN (SELECT node_id, count(*) FILTER (sig_strength) / ({_CELLS} - 1)::DOUBLE AS dc, sum(q_strength) FILTER (sig_strength) / ({_CELLS} - 1)::DOUBLE AS dc_w,
          avg(d) FILTER (sig_strength) AS msd, sum(d * q_strength) FILTER (sig_strength) / sum(q_strength) FILTER (sig_strength) AS msd_w, count(*) FILTER (sig_asym AND q_asym > 0) AS a, count(*) FILTER (sig_asym AND q_asym < 0) AS z,
          sum(q_asym) FILTER (sig_asym AND q_asym > 0) AS s, -sum(q_asym) FILTER (sig_asym AND q_asym < 0) AS o FROM (
          SELECT b.*, 2 * 6371.0 * asin(sqrt(least(1.0, {_haversine('g.lon', 'g.lat', 'h.lon', 'h.lat')}))) AS d FROM mirror b JOIN grid g ON b.node_id = g.node_id JOIN grid h ON b.other = h.node_id) GROUP BY 1) USING (node_id)"""
    ),
    "vpd": "SELECT l_orderkey, l_linenumber, es AS es_kpa, es * (1 - 1000 * l_discount / 100) AS vpd_kpa FROM (SELECT *, 0.6108 * exp(17.27 * (l_quantity - 10) / (l_quantity - 10 + 237.3)) AS es FROM lineitem)",
    "bowen": "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END AS bowen FROM lineitem",
    "haversine": _with(f"SELECT c_custkey, 2 * 6371.0 * atan2(sqrt({_A}), sqrt(1 - {_A})) AS km_atan, 2 * 6371.0 * asin(sqrt(least(1.0, {_A}))) AS km_asin FROM (SELECT p.*, g.lat AS lat2, g.lon AS lon2 FROM points p JOIN grid g USING (node_id))"),
    "sensitivity_sweep": _with(
        f"SELECT {_EVERY}, 2 * coalesce(e, 0) / ({_CELLS} * ({_CELLS} - 1))::DOUBLE AS mean_dc, valid_nodes FROM (SELECT {_EVERY}, count(*) AS valid_nodes FROM case_valid GROUP BY ALL) LEFT JOIN case_edges USING ({_EVERY})"
    ),
}

for _name, _digits in DIGITS.items():
    ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {d}) + 0.0::DOUBLE AS {c}' for c, d in _digits.items())}) FROM ({ORACLES[_name]})"
