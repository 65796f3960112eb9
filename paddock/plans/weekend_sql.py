"""Independent SQL of the weekend feature queries, over the same canonical tables, which it makes from the events itself."""

from __future__ import annotations

from .registry import SQL

_TABLES = """
ev AS (SELECT event_id AS n, year(ts)::BIGINT AS year, dayofyear(ts)::BIGINT AS round, 'D' || user_id AS driver, 'T' || (user_id % 40) AS team,
  (epoch_us(ts) % 86400000000) / 1e6 AS t, event_type AS kind, value AS v,
  ['R', 'R', 'R', 'Q', 'Q', 'FP1', 'FP2', 'FP2', 'FP3', 'SQ'][event_id % 10 + 1] AS session FROM events),
days AS (SELECT DISTINCT year, round FROM ev),
roster AS (SELECT year, round, driver, max(team) AS team FROM ev GROUP BY ALL),
ses AS (SELECT *, row_number() OVER (PARTITION BY year, round, driver, session ORDER BY t, n) AS lap FROM ev),
laps AS (SELECT *, 80 + v / 10 AS lap_s, (lap + 2) // 3 AS stint, ['SOFT', 'MEDIUM', 'HARD'][(lap // 3) % 3 + 1] AS compound, n % 10 = 9 AS caution,
  n % 17 <> 0 AS accurate, n % 23 = 0 AS deleted, kind = 'purchase' AS pit, (n % 5)::DOUBLE AS gap,
  row_number() OVER (PARTITION BY year, round, session, lap ORDER BY v, n)::DOUBLE AS position,
  26 + v / 30 + (n % 3) / 10 AS s1, 26 + v / 30 + (n % 5) / 10 AS s2, 26 + v / 30 + (n % 7) / 10 AS s3 FROM ses),
per AS (SELECT year, round, session, driver, team, sum(v) AS v, 80 + min(v) / 10 AS best, min(n) AS n FROM ev GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY year, round, session ORDER BY v DESC, driver)::DOUBLE AS place FROM per),
results AS (SELECT year, round, session, driver, team, n, CASE WHEN n % 11 <> 0 THEN place END AS position,
  row_number() OVER (PARTITION BY year, round, session ORDER BY n, driver)::DOUBLE AS grid, greatest(0, 26 - place) AS points, n // 10 % 10 = 7 AS mech, n // 10 % 10 = 8 AS acc,
  (n // 10 % 10 IN (7, 8))::INT AS dnf, (n // 10 % 10 = 9)::INT AS dsq, best + 1 AS q1, CASE WHEN n % 3 > 0 THEN best + 0.5 END AS q2, CASE WHEN n % 3 > 1 THEN best END AS q3 FROM placed),
race AS (SELECT * FROM results WHERE session = 'R'),
meta AS (SELECT *, ['monza', 'interlagos', 'suzuka', 'spa', 'marina_bay'][round % 5 + 1] AS place,
  ['italian_grand_prix', 'sao_paulo_grand_prix', 'japanese_grand_prix', 'belgian_grand_prix', 'marina_bay'][round % 5 + 1] AS track,
  ['low_df', 'balanced', 'high_df', 'balanced', 'balanced'][round % 5 + 1] AS cluster, round % 2 = 1 AS sprint FROM days)"""


def _seen(facts: str, n: int, name: str) -> str:
    """The facts that a cut-off (cy, cr) sees, with their age in rounds that have facts, and whether the track is the same."""
    return f"""{name} AS (SELECT x.*, s.cy, s.cr, s.age, s.same FROM {facts} x JOIN (SELECT c.year AS cy, c.round AS cr, f.year, f.round, c.place = p.place AS same,
  row_number() OVER (PARTITION BY c.year, c.round ORDER BY f.year DESC, f.round DESC) AS age
  FROM meta c JOIN (SELECT DISTINCT year, round FROM {facts}) f ON f.year < c.year OR (f.year = c.year AND f.round < c.round) JOIN meta p ON p.year = f.year AND p.round = f.round) s
  ON s.year = x.year AND s.round = x.round WHERE age <= {n})"""


def _iqr(x: str, least: int = 2) -> str:
    return f"CASE WHEN count({x}) >= {least} THEN quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) END"


def _clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


def _top10(of: str = "position <= 10") -> str:
    return f"CASE WHEN count(position) > 0 THEN avg(coalesce({of}, false)::INT) END"


def _round(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


def _long(columns: str, fill: bool = True) -> str:
    return ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" if fill else f"{c}::BIGINT AS {c}" for c in columns.split())


def _last(p: str) -> str:
    return f"(last // 1000)::BIGINT AS {p}last_seen_year, (last % 1000)::BIGINT AS {p}last_seen_round"


def _add(name: str, ctes: str, select: str) -> None:
    SQL[f"weekend_{name}"] = f"WITH {_TABLES},\n{ctes}\nSELECT {select}"


_CUT = "GROUP BY cy, cr, driver"
_ON = "FROM roster p LEFT JOIN d ON d.cy = p.year AND d.cr = p.round AND d.driver = p.driver"
_KEY = "p.year, p.round, p.driver"

_add("quali_priors_pre", f"""q0 AS (SELECT *, min(session) OVER (PARTITION BY year, round) AS first FROM results WHERE session IN ('Q', 'SQ')),
q1 AS (SELECT *, position - quantile_cont(position, 0.5) OVER (PARTITION BY year, round) AS off FROM q0 WHERE session = first),
q AS (SELECT *, {_clip('off', -5, 5)} AS rel FROM q1), {_seen('q', 30, 's')},
d AS (SELECT cy, cr, driver, count(*) AS quali_pre_hist_n, quantile_cont(position, 0.5) AS quali_pre_pos_p50, {_iqr('rel')} AS quali_pre_pos_iqr, min(position) AS quali_pre_bestpos_min,
  {_top10()} AS quali_pre_top10_rate, avg(dsq) AS quali_pre_notime_or_pen_rate, avg(points) AS quali_pre_points_mean, -({_iqr('rel')}) AS quali_pre_pos_consistency, max(year * 1000 + round) AS last FROM s {_CUT})""",
     f"""{_KEY}, {_long('quali_pre_hist_n', False)}, {_round('quali_pre_pos_p50 quali_pre_pos_iqr quali_pre_bestpos_min quali_pre_top10_rate quali_pre_notime_or_pen_rate quali_pre_points_mean quali_pre_pos_consistency')}, {_last('quali_pre_')} {_ON}""")

_add("track_onehot", f"""{_seen('race', 256, 's')},
d AS (SELECT cy, cr, driver, count(*) AS track_same_hist_n, quantile_cont(position, 0.5) AS track_same_finish_p50, min(position) AS track_same_bestpos_min, {_top10()} AS track_same_top10_rate, avg(dnf) AS track_same_dnf_rate,
  avg(points) AS track_same_points_mean, quantile_cont(grid, 0.5) AS track_same_grid_p50, max(year * 1000 + round) AS last FROM s WHERE same {_CUT})""",
     f"""{_KEY}, {_long('track_same_hist_n')}, {_round('track_same_finish_p50 track_same_bestpos_min track_same_top10_rate track_same_dnf_rate track_same_points_mean track_same_grid_p50')}, {_last('track_same_')},
  {', '.join(f"(m.track = '{t}')::INT::DOUBLE AS track_is_{t}" for t in ('italian_grand_prix', 'sao_paulo_grand_prix', 'japanese_grand_prix', 'belgian_grand_prix', 'marina_bay'))} {_ON} JOIN meta m ON m.year = p.year AND m.round = p.round""")

_PROFILE = "0.55 AS straight_pct, 0.50 AS fast_corner_ratio, 5.5 AS lap_km, 7.0 AS braking_ev_per_lap, 2.0 AS drs_zones, 0.55 AS tdeg_index, 0.55 AS aero_df_index"
_add("track_profile", f"""f AS (SELECT {_PROFILE}), g AS (SELECT *, (straight_pct - 0.35) / 0.4 AS straight_n, (fast_corner_ratio - 0.25) / 0.5 AS fast_corner_n, (braking_ev_per_lap - 4) / 8 AS braking_n,
  drs_zones / 4 AS drs_n, (lap_km - 3) / 4.5 AS lap_n, (tdeg_index - 0.2) / 0.7 AS tdeg_n, (aero_df_index - 0.2) / 0.7 AS aero_df_n FROM f)""",
     f"""{_KEY}, m.track AS track_slug, {', '.join(f'round({c}::DOUBLE, 6) AS track_{c}' for c in 'straight_pct fast_corner_ratio lap_km braking_ev_per_lap drs_zones tdeg_index aero_df_index straight_n fast_corner_n braking_n drs_n lap_n tdeg_n aero_df_n'.split())},
  cluster AS track_cluster, (CASE cluster WHEN 'low_df' THEN 0 WHEN 'balanced' THEN 1 ELSE 2 END)::BIGINT AS track_cluster_id, {', '.join(f"(cluster = '{c}')::BIGINT AS track_cluster_{c}" for c in ('low_df', 'balanced', 'high_df'))},
  round((straight_n - 0.7 * aero_df_n)::DOUBLE, 6) AS track_power_vs_df_index, round((0.35 * straight_n + 0.40 * braking_n + 0.25 * drs_n - 0.20 * fast_corner_n)::DOUBLE, 6) AS track_overtake_index,
  19.0::DOUBLE AS track_pit_loss_s, 0.21::DOUBLE AS track_fuel_effect_s_per10kg FROM roster p JOIN meta m ON m.year = p.year AND m.round = p.round, g""")

_C = "driver_trackc_pre_"
_SHRUNK = {"finish_p50": (3, "quantile_cont(finish_p50, 0.5)"), "points_mean": (6, "avg(points_mean)"), "top10_rate": (6, "avg(top10_rate)"), "grid_p50": (3, "quantile_cont(grid_p50, 0.5)"), "retire_rate": (6, "avg(retire_rate)")}
_add("driver_track_cluster_pre", f"""k AS (SELECT x.*, c.year AS cy, c.round AS cr, row_number() OVER (PARTITION BY c.year, c.round, x.driver ORDER BY x.year DESC, x.round DESC) AS back
  FROM race x JOIN meta m ON m.year = x.year AND m.round = x.round JOIN meta c ON c.cluster = m.cluster AND (x.year < c.year OR (x.year = c.year AND x.round < c.round))),
o AS (SELECT cy, cr, driver, count(position) AS n, quantile_cont(position, 0.5) AS finish_p50, avg(points) AS points_mean, {_top10('position BETWEEN 1 AND 10')} AS top10_rate, quantile_cont(grid, 0.5) AS grid_p50, avg(dnf) AS retire_rate FROM k WHERE back <= 8 {_CUT}),
d AS (SELECT cy, cr, driver, n AS {_C}hist_n, {', '.join(f'(n * {c} + {k} * {b} OVER (PARTITION BY cy, cr)) / (n + {k}) AS {_C}{c}' for c, (k, b) in _SHRUNK.items())} FROM o)""",
     f"{_KEY}, {_long(_C + 'hist_n', False)}, {_round(' '.join(_C + c for c in _SHRUNK))} {_ON}")

_WEATHER = """w0 AS (SELECT year, round, t, 15 + v / 10 AS air, 20 + v / 5 AS track, v AS humidity, v / 20 AS wind, (n % 7 = 0)::INT AS rain, CASE session WHEN 'Q' THEN 1 WHEN 'SQ' THEN 2 WHEN 'FP3' THEN 4 WHEN 'FP2' THEN 5 ELSE 6 END AS o
  FROM ses WHERE kind = 'view' AND session <> 'R' UNION ALL SELECT year, round, t, 15 + v / 10, 20 + v / 5, v, v / 20, v / 100, 0 FROM ev WHERE kind = 'signup' AND round % 3 = 0),
w1 AS (SELECT * FROM w0 QUALIFY o = min(o) OVER (PARTITION BY year, round)), w2 AS (SELECT *, CASE WHEN o = 0 THEN t <= 900 ELSE t >= max(t) OVER (PARTITION BY year, round) - 900 END AS inside FROM w1),
w3 AS (SELECT * FROM w2 QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY year, round)),
weather AS (SELECT year, round, avg(air) AS air, stddev_pop(air) AS air_std, avg(track) AS track, avg(humidity) AS humidity, avg(wind) AS wind, quantile_cont(rain, 0.75) AS rain, count(*) AS n FROM w3 GROUP BY ALL)"""
_add("weather_basic", _WEATHER, f"""{_KEY}, round(air, 6) AS weather_pre_air_temp_mean, round(air_std, 6) AS weather_pre_air_temp_std, round(w.track, 6) AS weather_pre_track_temp_mean, round(humidity, 6) AS weather_pre_humidity_mean,
  round(wind, 6) AS weather_pre_wind_kph_mean, round(rain, 6) AS weather_pre_rain_prob_p75, coalesce(w.n, 0)::BIGINT AS weather_pre_records_n FROM roster p LEFT JOIN weather w ON w.year = p.year AND w.round = p.round""")

_RATES = {"sc_rate": 0.28, "vsc_rate": 0.12, "red_flag_rate": 0.22, "wet_start_rate": 0.16, "start_behind_sc_rate": 0.10, "delayed_start_rate": 0.04, "early_yellow_rate": 0.08}
_NAMES = [*_RATES, "sc_deploy_mean", "vsc_deploy_mean", "rainfall_share_start"]
_CHAOS = f"""c1 AS (SELECT year, round, max((n % 7 IN (1, 2))::INT) AS sc, max((n % 7 = 2)::INT) AS vsc, max((n % 7 = 3)::INT) AS red, max((n % 7 = 4)::INT) AS delayed,
  count_if(n % 7 IN (1, 2)) AS sc_n, count_if(n % 7 = 2) AS vsc_n FROM ev WHERE kind = 'error' GROUP BY ALL),
c2 AS (SELECT year, round, max((n % 4 >= 2)::INT) AS sc_t, max((n % 4 = 3)::INT) AS vsc_t, max((n % 4 > 0)::INT) FILTER (WHERE t <= 900) AS yellow, count_if(n % 4 = 2) AS sc_tn, count_if(n % 4 = 3) AS vsc_tn FROM ev WHERE kind = 'signup' GROUP BY year, round),
c3 AS (SELECT year, round, max((n % 7 = 0)::INT) AS wet, avg((n % 7 = 0)::INT) AS rain_share FROM (SELECT * FROM ev WHERE kind = 'view' AND session = 'R' QUALIFY t <= 720 OR NOT bool_or(t <= 720) OVER (PARTITION BY year, round)) GROUP BY ALL),
c4 AS (SELECT year, round, max((n % 40 = 39)::INT) AS delayed_s FROM ev WHERE kind = 'click' GROUP BY ALL),
chaos AS (SELECT year, round, greatest(coalesce(sc, 0), coalesce(sc_t, 0)) AS sc_rate, greatest(coalesce(vsc, 0), coalesce(vsc_t, 0)) AS vsc_rate, coalesce(red, 0) AS red_flag_rate, wet AS wet_start_rate, greatest(coalesce(delayed, 0), coalesce(delayed_s, 0)) AS delayed_start_rate,
  0 AS start_behind_sc_rate, yellow AS early_yellow_rate, coalesce(sc_n, 0) + coalesce(sc_tn, 0) AS sc_deploy_mean, coalesce(vsc_n, 0) + coalesce(vsc_tn, 0) AS vsc_deploy_mean, rain_share AS rainfall_share_start
  FROM days LEFT JOIN c1 USING (year, round) LEFT JOIN c2 USING (year, round) LEFT JOIN c3 USING (year, round) LEFT JOIN c4 USING (year, round)), {_seen('chaos', 10, 'cs')},
ca AS (SELECT cy, cr, count_if(age <= 8) AS hist_n, count_if(same) AS same_n, {', '.join(f'avg({c}) FILTER (WHERE same) AS s_{c}, avg({c}) FILTER (WHERE age <= 8) AS r_{c}' for c in _NAMES)} FROM cs GROUP BY cy, cr),
cb AS (SELECT cy, cr, hist_n, same_n, {', '.join(f'CASE WHEN s_{c} IS NULL THEN r_{c} WHEN r_{c} IS NULL THEN s_{c} ELSE least(same_n / 3, 1) * s_{c} + (1 - least(same_n / 3, 1)) * r_{c} END AS {c}' for c in _NAMES)} FROM ca)"""
_add("event_chaos_priors_pre", _CHAOS, f"""{_KEY}, coalesce(hist_n, 0)::BIGINT AS chaos_pre_hist_n, coalesce(same_n, 0)::BIGINT AS chaos_pre_same_track_n, {', '.join(f'round({c}, 6) AS chaos_pre_{c}' for c in _NAMES)},
  round(CASE WHEN coalesce({', '.join(_RATES)}) IS NOT NULL THEN {' + '.join(f'{w} * coalesce({c}, 0)' for c, w in _RATES.items())} END, 6) AS chaos_pre_index FROM roster p LEFT JOIN cb ON cy = p.year AND cr = p.round""")

_OVERTAKE = "0.35 * 0.5 + 0.40 * 0.375 + 0.25 * 0.5 - 0.20 * 0.5"
_DAY = f"""{_WEATHER}, {_CHAOS}, today AS (SELECT days.year, days.round, coalesce(w.track, w.air + 5, 25) AS temp, coalesce(w.rain, 0) AS rain, coalesce(cb.sc_rate, 0.25) AS sc, ({_OVERTAKE})::DOUBLE AS overtake
  FROM days LEFT JOIN weather w ON w.year = days.year AND w.round = days.round LEFT JOIN cb ON cy = days.year AND cr = days.round)"""
_base = lambda k: f"(0.6 * coalesce({k}_prev, 0.05) + 0.4 * coalesce({k}_season, 0.03))"
_add("reliability_risk_pre", f"""{_DAY}, {_seen('race', 256, 's')},
b AS (SELECT *, row_number() OVER (PARTITION BY cy, cr, driver ORDER BY age) AS back FROM s),
d AS (SELECT cy, cr, driver, avg(acc::INT) FILTER (WHERE back <= 10) AS acc_prev, avg(acc::INT) FILTER (WHERE year = cy) AS acc_season, avg(mech::INT) FILTER (WHERE back <= 10) AS mech_prev, avg(mech::INT) FILTER (WHERE year = cy) AS mech_season FROM b {_CUT}),
j AS (SELECT {_KEY}, d.*, (temp - 25) / 10 AS delta, least(greatest(sc * overtake * rain, 0), 1) AS chaos {_ON} JOIN today t ON t.year = p.year AND t.round = p.round),
f AS (SELECT *, least(greatest({_base('acc')} * (1 + 0.75 * chaos), 0), 0.8) AS acc, least(greatest({_base('mech')} * (1 + 0.25 * greatest(0, delta) + 0.15 * chaos), 0), 0.8) AS mech FROM j)""",
     "year, round, driver, round(acc, 6) AS reliab_accident_risk, round(mech, 6) AS reliab_mech_risk, round(1 - (1 - acc) * (1 - mech), 6) AS reliab_dnf_risk, round(delta, 6) AS reliab_temp_delta FROM f")

_add("history_form", f"""m1 AS (SELECT *, quantile_cont(lap_s, 0.5) OVER k AS m, count(*) OVER k AS cnt FROM laps WHERE session = 'R' AND NOT pit AND NOT caution WINDOW k AS (PARTITION BY year, round, driver)),
m2 AS (SELECT *, quantile_cont(abs(lap_s - m), 0.5) OVER (PARTITION BY year, round, driver) AS dev FROM m1),
m3 AS (SELECT *, CASE WHEN cnt < 3 THEN true WHEN dev = 0 THEN lap_s <= m ELSE (lap_s - m) / dev > -3 AND (lap_s - m) / dev < 2 END AS clean FROM m2),
m4 AS (SELECT *, row_number() OVER (PARTITION BY year, round, driver, clean ORDER BY lap_s, lap) AS k FROM m3),
m5 AS (SELECT year, round, driver, avg(lap_s) FILTER (WHERE clean AND k <= 10) AS best10, avg(clean::INT) AS share, count(*) AS laps FROM m4 GROUP BY year, round, driver),
pace AS (SELECT *, best10 - quantile_cont(best10, 0.5) OVER (PARTITION BY year, round) AS best_rel, share - quantile_cont(share, 0.5) OVER (PARTITION BY year, round) AS share_rel FROM m5), {_seen('pace', 10, 's')},
b AS (SELECT *, {_clip('share_rel', -0.5, 0.5)} AS x, row_number() OVER (PARTITION BY cy, cr, driver ORDER BY age) - 1 AS back FROM s), w AS (SELECT *, CASE WHEN laps >= 8 AND x IS NOT NULL THEN least(laps, 200) * exp(-0.35 * back) END AS w FROM b),
d1 AS (SELECT cy, cr, driver, count(*) AS hist_n, quantile_cont(best_rel, 0.5) AS p50, {_iqr('best_rel')} AS iqr, CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) END AS mean, max(year * 1000 + round) AS last FROM w {_CUT}), {_seen('race', 10, 'rs')},
d2 AS (SELECT rs.cy, rs.cr, rs.driver, avg(dnf) AS dnf, avg((rs.team = p.team)::INT) AS stable FROM rs LEFT JOIN roster p ON p.year = cy AND p.round = cr AND p.driver = rs.driver GROUP BY rs.cy, rs.cr, rs.driver),
d AS (SELECT * FROM d1 FULL JOIN d2 USING (cy, cr, driver))""",
     f"""{_KEY}, hist_n::BIGINT AS hist_pre_hist_n, round(p50, 6) AS hist_pre_best10_pace_p50_s, round(iqr, 6) AS hist_pre_best10_pace_iqr_s, round({_clip('mean', -0.3, 0.3)}, 6) AS hist_pre_clean_share_mean, {_last('hist_pre_')},
  round(dnf, 6) AS hist_pre_dnf_rate, round(stable, 6) AS hist_pre_team_stability {_ON}""")

_add("telemetry_history_pre", f"""b1 AS (SELECT year, round, driver, min(lap_s) AS best FROM laps WHERE session = 'R' AND NOT pit GROUP BY ALL), b2 AS (SELECT year, round, driver, max(100 + 2 * v) AS top FROM ev WHERE session = 'R' GROUP BY ALL),
b3 AS (SELECT * FROM b1 FULL JOIN b2 USING (year, round, driver)), b4 AS (SELECT *, avg(best) OVER w AS m, stddev_pop(best) OVER w AS sd FROM b3 WINDOW w AS (PARTITION BY year, round)),
z AS (SELECT *, CASE WHEN best IS NOT NULL THEN CASE WHEN sd > 0 THEN -(best - m) / sd ELSE 0 END END AS z FROM b4), {_seen('z', 10, 's')}, v AS (SELECT *, 1 + 0.5 * same::INT AS w FROM s),
d1 AS (SELECT cy, cr, driver, count(*) AS hist_n, quantile_cont(best, 0.5) AS p50, {_iqr('best')} AS iqr, coalesce(sum(w * z), 0) / sum(w) AS zm, quantile_cont(top, 0.75) AS top, count_if(same) AS same_n, max(year * 1000 + round) AS last FROM v {_CUT}),
i AS (SELECT *, row_number() OVER (PARTITION BY cy, cr, driver ORDER BY year, round) AS i FROM v WHERE z IS NOT NULL), d2 AS (SELECT cy, cr, driver, CASE WHEN count(*) >= 2 THEN regr_slope(z, i) END AS slope FROM i {_CUT}),
d AS (SELECT * FROM d1 LEFT JOIN d2 USING (cy, cr, driver))""",
     f"""{_KEY}, coalesce(hist_n, 0)::BIGINT AS tele_pre_hist_n, round(p50, 6) AS tele_pre_bestlap_p50_s, round(iqr, 6) AS tele_pre_bestlap_iqr_s, coalesce(round(zm, 6), 0) AS tele_pre_pace_z_mean, round(top, 6) AS tele_pre_topspeed_p75,
  coalesce(same_n, 0)::BIGINT AS tele_pre_same_track_n, coalesce(round(slope, 6), 0) AS tele_pre_pace_z_trend, {_last('tele_pre_')} {_ON}""")

#: Race laps without those of a stop and those right after one.
_KEPT = """kept AS (SELECT * FROM laps x WHERE session = 'R' AND NOT EXISTS (SELECT 1 FROM laps g WHERE g.session = 'R' AND g.pit AND g.year = x.year AND g.round = x.round AND g.driver = x.driver AND x.lap IN (g.lap, g.lap + 1)))"""


def _trend(seen: str, key: str, x: str, name: str) -> str:
    return f"""{name} AS (SELECT cy, cr, {key}, CASE WHEN count(*) >= 3 THEN regr_slope({x}, i) END AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY cy, cr, {key} ORDER BY year, round) AS i FROM
  (SELECT * FROM {seen} WHERE {x} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cy, cr, {key} ORDER BY year DESC, round DESC) <= 6)) GROUP BY cy, cr, {key})"""


_add("dev_trend_pre", f"""{_KEPT}, t1 AS (SELECT *, lap_s * 1000 AS ms FROM kept), t2 AS (SELECT *, quantile_cont(ms, 0.05) OVER k AS lo, quantile_cont(ms, 0.95) OVER k AS hi FROM t1 WINDOW k AS (PARTITION BY year, round, driver)),
t3 AS (SELECT year, round, driver, team, quantile_cont(ms, 0.5) AS m FROM t2 WHERE ms BETWEEN lo AND hi GROUP BY ALL), t4 AS (SELECT *, avg(m) OVER w AS mean, stddev_samp(m) OVER w AS sd FROM t3 WINDOW w AS (PARTITION BY year, round)),
z AS (SELECT *, CASE WHEN sd > 0 THEN -(m - mean) / sd ELSE 0 END AS z FROM t4), tz AS (SELECT year, round, team, avg(z) AS team_z FROM z GROUP BY ALL), zz AS (SELECT * FROM z JOIN tz USING (year, round, team)),
{_seen('zz', 8, 's')}, {_seen('tz', 8, 'ts')}, {_trend('s', 'driver', 'z', 'driver_trend')}, {_trend('ts', 'team', 'team_z', 'team_dev_trend')},
sp AS (SELECT cy, cr, driver, quantile_cont(z - team_z, 0.75) - quantile_cont(z - team_z, 0.25) AS w, stddev_pop(z - team_z) AS sd FROM s {_CUT})""",
     f"""{_KEY}, round(driver_trend, 6) AS driver_trend, round(team_dev_trend, 6) AS team_dev_trend, round(CASE WHEN w > 0 THEN w / 1.35 ELSE sd END, 6) AS stability_delta_vs_tm
FROM roster p LEFT JOIN sp ON sp.cy = p.year AND sp.cr = p.round AND sp.driver = p.driver LEFT JOIN driver_trend a ON a.cy = p.year AND a.cr = p.round AND a.driver = p.driver LEFT JOIN team_dev_trend b ON b.cy = p.year AND b.cr = p.round AND b.team = p.team""")

_add("traffic_overtake_pre", f"""l AS (SELECT * FROM laps WHERE session = 'R'), f0 AS (SELECT year, round, driver, min(position) AS after, max(pit::INT) AS pit FROM l WHERE lap = 1 GROUP BY ALL),
f AS (SELECT f0.*, r.grid - after AS gain FROM f0 JOIN race r USING (year, round, driver)), nm AS (SELECT DISTINCT year, round, driver, 1 AS named FROM ev WHERE kind = 'error' AND n % 5 = 0 AND n // 5 % 4 IN (1, 3)),
f1 AS (SELECT year, round, driver, gain, CASE WHEN max(coalesce(named, 0)) OVER (PARTITION BY year, round) = 1 THEN coalesce(named, 0) ELSE (gain <= -3 OR pit = 1)::INT END AS incident FROM f LEFT JOIN nm USING (year, round, driver)),
fr AS (SELECT * FROM l WHERE NOT pit AND NOT caution), tr AS (SELECT year, round, driver, avg(lap_s) FILTER (WHERE gap < 1.5) - avg(lap_s) FILTER (WHERE gap >= 1.5) AS penalty FROM fr WHERE lap_s BETWEEN 40 AND 200 GROUP BY ALL),
n0 AS (SELECT *, position - lag(position) OVER (PARTITION BY year, round, driver ORDER BY lap) AS s FROM fr), nt AS (SELECT year, round, driver, coalesce(sum(greatest(-s, 0)), 0) - coalesce(sum(greatest(s, 0)), 0) AS net, count(DISTINCT lap) - 1 AS green FROM n0 GROUP BY year, round, driver),
x AS (SELECT year, round, driver, gain, incident, penalty, CASE WHEN green > 0 THEN 100 * net / green END AS net FROM f1 FULL JOIN tr USING (year, round, driver) FULL JOIN nt USING (year, round, driver)), {_seen('x', 10, 's')},
d AS (SELECT cy, cr, driver, avg(gain) AS lap1_gain_avg_prev10, avg(incident) AS lap1_incident_rate_prev10, avg(penalty) AS traffic_penalty_s_prev10, avg(net) AS net_pass_index_prev10 FROM s {_CUT})""",
     f"{_KEY}, {_round('lap1_gain_avg_prev10 lap1_incident_rate_prev10 traffic_penalty_s_prev10 net_pass_index_prev10')} {_ON}")


def _slope(rows: str, key: str, name: str) -> str:
    """Least squares of lap times against tyre age without values beyond four scaled MADs."""
    return f"""{name}1 AS (SELECT *, quantile_cont(lap_s, 0.5) OVER (PARTITION BY {key}) AS md FROM {rows}), {name}2 AS (SELECT *, 1.4826 * quantile_cont(abs(lap_s - md), 0.5) OVER (PARTITION BY {key}) AS sc FROM {name}1),
{name} AS (SELECT {key}, CASE WHEN count(*) >= 4 AND count(DISTINCT lap) >= 3 AND var_pop(lap) > 1e-9 THEN regr_slope(lap_s, lap) END AS slope FROM {name}2 WHERE sc = 0 OR abs(lap_s - md) <= 4 * sc GROUP BY {key})"""


_PRACTICE = "pl AS (SELECT *, CASE session WHEN 'FP1' THEN 1 WHEN 'FP2' THEN 2 ELSE 3 END AS ord FROM laps WHERE session IN ('FP1', 'FP2', 'FP3') AND NOT pit AND NOT caution), p2 AS (SELECT * FROM pl WHERE lap >= 2)"
_PENS = """ref AS (SELECT *, lap_s - quantile_cont(lap_s, 0.5) OVER (PARTITION BY year, round, lap) AS ref FROM laps WHERE session = 'R'),
pens AS (SELECT year, round, driver, team, lap, ref AS in_pen, out_pen FROM (SELECT *, lead(ref) OVER (PARTITION BY year, round, driver ORDER BY lap) AS out_pen FROM ref) WHERE pit)"""

_add("tyre_priors_pre", f"""{_DAY}, {_KEPT}, {_PRACTICE},
mx AS (SELECT year, round, {', '.join(f"count_if(compound = '{c}') / count(*) AS f_{c[0]}" for c in ('SOFT', 'MEDIUM', 'HARD'))} FROM laps WHERE session = 'R' GROUP BY year, round),
dl AS (SELECT year, round, {', '.join(f"quantile_cont(lap_s, 0.5) FILTER (WHERE compound = '{a}') - quantile_cont(lap_s, 0.5) FILTER (WHERE compound = '{b}') AS d_{a[0]}{b[0]}" for a, b in (('SOFT', 'MEDIUM'), ('MEDIUM', 'HARD')))} FROM kept GROUP BY year, round),
mp AS (SELECT * FROM mx FULL JOIN dl USING (year, round)), {_seen('mp', 12, 'ms')}, me AS (SELECT *, count_if(same) OVER (PARTITION BY cy, cr) >= 3 AS enough FROM ms),
mixes AS (SELECT cy, cr, {', '.join(f'quantile_cont(f_{c}, 0.5) AS compound_mix_priors_{c}' for c in 'SMH')}, {', '.join(f'quantile_cont(d_{c}, 0.5) AS tyre_delta_priors_s_{c}' for c in ('SM', 'MH'))} FROM me WHERE (enough AND same) OR (NOT enough AND age <= 8) GROUP BY cy, cr),
{_slope('p2', 'year, round, driver, session, stint, compound', 'ps')}, now AS (SELECT year, round, compound, quantile_cont(slope, 0.5) AS practice FROM ps WHERE slope > 0 GROUP BY year, round, compound),
{_slope('kept', 'year, round, driver, stint, compound', 'rs')}, old AS (SELECT year, round, compound, quantile_cont(slope, 0.5) AS race FROM rs WHERE slope > 0 GROUP BY year, round, compound), {_seen('old', 12, 'os')},
hs AS (SELECT cy, cr, compound, quantile_cont(race, 0.5) AS historic FROM os GROUP BY cy, cr, compound), sp AS (SELECT year, round, driver, {_iqr('lap_s')} AS i FROM kept GROUP BY year, round, driver), {_seen('sp', 12, 'ss')},
fb AS (SELECT cy, cr, {_clip('quantile_cont(i, 0.5) / 12', 0.005, 0.08)} AS fallback FROM ss GROUP BY cy, cr), ev3 AS (SELECT * FROM days, (VALUES ('SOFT', 1.10), ('MEDIUM', 1.00), ('HARD', 0.90)) t(compound, factor)),
vs AS (SELECT ev3.year, ev3.round, ev3.compound, {_clip('coalesce(practice, historic, fallback * factor) * (1 + 0.015 * (temp - 25))', 0.003, 0.12)} AS v FROM ev3 LEFT JOIN now USING (year, round, compound)
  LEFT JOIN hs ON hs.cy = ev3.year AND hs.cr = ev3.round AND hs.compound = ev3.compound LEFT JOIN fb ON fb.cy = ev3.year AND fb.cr = ev3.round JOIN today t ON t.year = ev3.year AND t.round = ev3.round),
dg AS (SELECT year, round, {', '.join(f"max(v) FILTER (WHERE compound = '{c}') AS expected_deg_{c[0]}" for c in ('SOFT', 'MEDIUM', 'HARD'))} FROM vs GROUP BY year, round)""",
     f"""{_KEY}, {_round('expected_deg_S expected_deg_M expected_deg_H compound_mix_priors_S compound_mix_priors_M compound_mix_priors_H tyre_delta_priors_s_SM tyre_delta_priors_s_MH')}
FROM roster p LEFT JOIN dg ON dg.year = p.year AND dg.round = p.round LEFT JOIN mixes ON cy = p.year AND cr = p.round""")

_STOPS = "stops AS (SELECT l.year, l.round, l.driver, r.team, l.lap, 2 + l.gap AS seconds FROM laps l JOIN race r USING (year, round, driver) WHERE l.session = 'R' AND l.pit)"


def _two(seen: str, c: str) -> str:
    return f"m_{c} AS (SELECT cy, cr, quantile_cont(m, 0.5) AS {c} FROM (SELECT cy, cr, year, round, quantile_cont({c}, 0.5) AS m FROM {seen} GROUP BY cy, cr, year, round) GROUP BY cy, cr)"


_add("strategy_priors_pre", f"""{_DAY}, {_PENS}, {_STOPS}, pr AS (SELECT year, round, driver, max(stint) - 1 AS stops, count_if(stint = 1) AS first FROM laps WHERE session = 'R' GROUP BY year, round, driver), {_seen('pr', 8, 's')}, {_two('s', 'stops')}, {_two('s', 'first')},
gn AS (SELECT year, round, lap, quantile_cont(-1000 * (in_pen + coalesce(out_pen, 0)), 0.5) > 250 AS good FROM pens GROUP BY year, round, lap),
isl AS (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY lap) - row_number() OVER (PARTITION BY year, round, good ORDER BY lap) AS g FROM gn), ln AS (SELECT year, round, good, count(*) AS k FROM isl GROUP BY year, round, good, g),
rn AS (SELECT year, round, coalesce(max(k) FILTER (WHERE good), 0) AS k FROM ln GROUP BY year, round), {_seen('rn', 8, 'us')}, uc AS (SELECT cy, cr, quantile_cont(k, 0.5) AS undercut FROM us GROUP BY cy, cr),
fs AS (SELECT year, round, team, driver, min(lap) AS lap FROM stops WHERE lap >= 5 GROUP BY ALL), fk AS (SELECT *, row_number() OVER (PARTITION BY year, round, team ORDER BY lap, driver) AS k FROM fs),
st AS (SELECT year, round, team, max(lap) FILTER (WHERE k = 2) - max(lap) FILTER (WHERE k = 1) AS gap FROM fk GROUP BY year, round, team HAVING count(*) >= 2), {_seen('st', 8, 'sts')},
sk AS (SELECT cy, cr, team, avg((gap <= 1)::INT) AS double_stack_risk, avg((gap = 0)::INT) AS double_stack_same_lap FROM sts GROUP BY cy, cr, team),
x AS (SELECT t.year, t.round, least(greatest(coalesce(stops, 2) + 0.15 * (temp - 25) / 10 + 0.5 * sc, 1), 4) AS expected_stop_count, least(greatest(coalesce(first, 15) * (1 - 0.10 * (temp - 25) / 10) - 0.5 * sc * 5, 5), 30) AS first_stint_len_exp, undercut AS undercut_window_width
  FROM today t LEFT JOIN m_stops a ON a.cy = t.year AND a.cr = t.round LEFT JOIN m_first b ON b.cy = t.year AND b.cr = t.round LEFT JOIN uc ON uc.cy = t.year AND uc.cr = t.round)""",
     f"""{_KEY}, {_round('expected_stop_count first_stint_len_exp undercut_window_width double_stack_risk double_stack_same_lap')} FROM roster p LEFT JOIN x ON x.year = p.year AND x.round = p.round LEFT JOIN sk ON sk.cy = p.year AND sk.cr = p.round AND sk.team = p.team""")

_CREW = f"""{_STOPS}, {_seen('stops', 10, 'sn')}, si AS (SELECT * FROM sn WHERE seconds BETWEEN 1.5 AND 25), sq AS (SELECT *, quantile_cont(seconds, 0.01) OVER w AS lo, quantile_cont(seconds, 0.99) OVER w AS hi FROM si WINDOW w AS (PARTITION BY cy, cr)),
sx AS (SELECT * FROM sq WHERE seconds BETWEEN lo AND hi), sl AS (SELECT cy, cr, quantile_cont(seconds, 0.9) AS p90 FROM sx GROUP BY cy, cr),
crew AS (SELECT cy, cr, team, quantile_cont(seconds, 0.5) AS p50, quantile_cont(seconds, 0.9) AS p90t, 1000 * ({_iqr('seconds')}) AS iqr, avg((seconds > p90)::INT) AS risk FROM sx JOIN sl USING (cy, cr) GROUP BY cy, cr, team)"""
_TEAM = "FROM roster p LEFT JOIN crew ON crew.cy = p.year AND crew.cr = p.round AND crew.team = p.team"
_add("pit_ops_pre", f"""{_CREW}, {_PENS}, pu AS (SELECT year, round, quantile_cont(in_pen - out_pen, 0.5) AS under, quantile_cont(out_pen - in_pen, 0.5) AS over FROM pens WHERE abs(in_pen) <= 60 AND abs(out_pen) <= 60 GROUP BY year, round), {_seen('pu', 10, 'pq')},
pe AS (SELECT *, count_if(same) OVER (PARTITION BY cy, cr) >= 2 AS enough FROM pq), g AS (SELECT cy, cr, quantile_cont(under, 0.5) AS undercut_gain_hist_s, quantile_cont(over, 0.5) AS overcut_gain_hist_s FROM pe WHERE same OR NOT enough GROUP BY cy, cr)""",
     f"""{_KEY}, round(p50, 6) AS pitcrew_time_team_p50_s, round(p90t, 6) AS pitcrew_time_team_p90_s, round(risk, 6) AS pitcrew_slowstop_risk_team, {_round('undercut_gain_hist_s overcut_gain_hist_s')} {_TEAM} LEFT JOIN g ON g.cy = p.year AND g.cr = p.round""")

_add("pit_ops_risk_pre", f"""{_DAY}, {_CREW}, {_PENS}, {_seen('pens', 10, 'pq')}, u AS (SELECT cy, cr, quantile_cont(-(in_pen + coalesce(out_pen, 0)), 0.5) AS under FROM pq GROUP BY cy, cr)""",
     f"""{_KEY}, round(iqr, 6) AS pitcrew_iqr_team, round(risk, 6) AS slowstop_risk_team, round({_clip('risk * (1 + 0.6 * (sc - 0.25)) * (1 + 0.25 * least(greatest(coalesce(under, 0) / 5, 0), 1))', 0, 1)}, 6) AS slowstop_risk_cond_SC
{_TEAM} LEFT JOIN u ON u.cy = p.year AND u.cr = p.round JOIN today t ON t.year = p.year AND t.round = p.round""")

_RUN = "year, round, driver, session, ord, stint, compound"
_RUNS = f"""{_PRACTICE}, b3 AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN avg(lap_s) OVER w END AS b3 FROM p2 WINDOW w AS (PARTITION BY {_RUN} ORDER BY lap ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
{_slope('p2', _RUN, 'sl')}, r0 AS (SELECT {_RUN}, count(*) AS k, quantile_cont(lap_s, 0.5) AS pace, quantile_cont(lap_s, 0.75) - quantile_cont(lap_s, 0.25) AS iqr, min(b3) AS best3 FROM b3 GROUP BY {_RUN} HAVING count(*) >= 5),
runs AS (SELECT r0.*, slope FROM r0 LEFT JOIN sl USING ({_RUN})),
rl AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY year, round, driver ORDER BY k DESC, ord DESC, best3 NULLS LAST, stint, compound) = 1),
rh AS (SELECT * FROM runs WHERE best3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY year, round, driver ORDER BY best3, ord DESC, stint, compound) = 1),
longrun AS (SELECT c.year, c.round, c.driver, c.c AS dry, rl.pace, rl.slope, rl.iqr, rl.k, rl.ord, rh.best3 AS short, rh.ord AS short_ord FROM (SELECT year, round, driver, count(*) AS c FROM runs GROUP BY ALL) c LEFT JOIN rl USING (year, round, driver) LEFT JOIN rh USING (year, round, driver))"""
_NOW = "LEFT JOIN {0} ON {0}.year = p.year AND {0}.round = p.round AND {0}.driver = p.driver"
_add("practice_longrun_pre", _RUNS, f"""{_KEY}, dry::BIGINT AS prac_pre_dry_runs_n, round(pace, 6) AS prac_pre_longrun_pace_s, round(slope, 6) AS prac_pre_longrun_deg_s_per_lap, round(iqr, 6) AS prac_pre_longrun_iqr_s,
  k::BIGINT AS prac_pre_longrun_laps, ord::BIGINT AS prac_pre_longrun_session_ord, round(short, 6) AS prac_pre_shortrun_best3_s, short_ord::BIGINT AS prac_pre_shortrun_session_ord FROM roster p {_NOW.format('longrun')}""")

_DRY = [("SOFT", "s"), ("MEDIUM", "m"), ("HARD", "h")]
_add("practice_compound_pre", f"""{_RUNS}, cb AS (SELECT year, round, driver, count(DISTINCT compound) AS k, {', '.join(f"min(lap_s) FILTER (WHERE compound = '{c}') AS {x}_best" for c, x in _DRY)} FROM pl GROUP BY year, round, driver),
cl AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY year, round, driver, compound ORDER BY k DESC, ord DESC, pace, stint) = 1),
cg AS (SELECT year, round, driver, {', '.join(f"max(pace) FILTER (WHERE compound = '{c}') AS {x}_pace, max(slope) FILTER (WHERE compound = '{c}') AS {x}_slope" for c, x in _DRY)} FROM cl GROUP BY year, round, driver)""",
     f"""{_KEY}, k::BIGINT AS prac_cmp_pre_dry_compounds_n, {', '.join(f'round({x}_best, 6) AS prac_cmp_pre_{x}_best_s, round({x}_pace, 6) AS prac_cmp_pre_{x}_longrun_pace_s, round({x}_slope, 6) AS prac_cmp_pre_{x}_deg_s_per_lap' for _, x in _DRY)},
  round(m_best - s_best, 6) AS prac_cmp_pre_crossover_sm_s, round(h_best - m_best, 6) AS prac_cmp_pre_crossover_mh_s FROM roster p {_NOW.format('cb')} {_NOW.format('cg')}""")


def _mates(rows: str, pairs: dict[str, str], name: str) -> str:
    """rows (year, round, driver, ...) with the difference from the first team mate, by name, that has the value."""
    mate = lambda x: f"(SELECT a.{x} FROM {name}0 a WHERE a.year = b.year AND a.round = b.round AND a.mt = b.mt AND a.driver <> b.driver AND a.{x} IS NOT NULL ORDER BY a.driver LIMIT 1)"
    return f"""{name}0 AS (SELECT x.*, p.team AS mt FROM {rows} x LEFT JOIN roster p USING (year, round, driver)), {name} AS (SELECT b.*, {', '.join(f'b.{x} - {mate(x)} AS {out}' for x, out in pairs.items())} FROM {name}0 b)"""


_SHARES = ("accurate", "green", "dry")
_add("practice_readiness_pre", f"""rd AS (SELECT year, round, driver, session, count(*) AS k, avg(accurate::INT) AS accurate, avg((NOT caution)::INT) AS green, 1.0 AS dry, max(CASE session WHEN 'FP1' THEN 1 WHEN 'FP2' THEN 2 ELSE 3 END) AS ord
  FROM laps WHERE session IN ('FP1', 'FP2', 'FP3') GROUP BY year, round, driver, session),
ra AS (SELECT year, round, driver, count(*) AS seen, sum(k) AS laps, {', '.join(f'sum(k * {c}) / sum(k) AS {c}' for c in _SHARES)}, max(ord) AS ord, arg_max(k, ord) AS last, max((session = 'FP2')::INT) AS fp2, max((session = 'FP3')::INT) AS fp3 FROM rd GROUP BY year, round, driver),
rh AS (SELECT year, round, max((session = 'FP2')::INT) AS h2, max((session = 'FP3')::INT) AS h3 FROM rd GROUP BY year, round),
rj AS (SELECT {_KEY}, seen, laps, accurate, green, dry, ord, last, h2, CASE WHEN h2 = 1 THEN 1 - fp2 END AS no2, CASE WHEN h3 = 1 THEN 1 - fp3 END AS no3 FROM roster p {_NOW.format('ra')} LEFT JOIN rh ON rh.year = p.year AND rh.round = p.round),
{_mates('rj', {'laps': 'd_laps', 'accurate': 'd_accurate'}, 'rm')}""",
     f"""year, round, driver, seen::BIGINT AS ready_pre_sessions_seen_n, laps::BIGINT AS ready_pre_total_laps, {', '.join(f'round({c}::DOUBLE, 6) AS ready_pre_{c}_share' for c in _SHARES)}, ord::BIGINT AS ready_pre_latest_session_ord, last::BIGINT AS ready_pre_latest_session_laps,
  no2::BIGINT AS ready_pre_missing_fp2_flag, no3::BIGINT AS ready_pre_missing_fp3_flag, d_laps::BIGINT AS ready_pre_total_laps_tm_delta, round(d_accurate, 6) AS ready_pre_accurate_share_tm_delta,
  round(CASE WHEN h2 IS NOT NULL THEN least(greatest(0.6 * coalesce(no3, 0) + 0.35 * coalesce(no2, 0) + coalesce(least(greatest(-d_laps / 25, 0), 1), 0) + coalesce(least(greatest(0.9 - accurate, 0), 0.9), 0), 0), 3) END::DOUBLE, 6) AS ready_pre_issue_index FROM rm""")

_QUALI = """ql AS (SELECT *, NOT caution AND accurate AND NOT deleted AS good FROM laps WHERE session = 'Q'), qc AS (SELECT * FROM (SELECT *, max(good::INT) OVER (PARTITION BY year, round) AS any_good FROM ql) WHERE good OR any_good = 0),
qb AS (SELECT year, round, driver, position, least(q1, q2, q3) AS best, CASE WHEN q3 IS NOT NULL THEN 3 WHEN q2 IS NOT NULL THEN 2 WHEN q1 IS NOT NULL THEN 1 ELSE 0 END AS stage FROM results WHERE session = 'Q')"""
_EXEC = f"""{_QUALI}, qr AS (SELECT *, max(stint) OVER (PARTITION BY year, round, driver) AS final FROM qc),
qa AS (SELECT year, round, driver, min(lap_s) AS lap_best, min(s1) + min(s2) + min(s3) AS ideal, min(lap_s) FILTER (WHERE stint < final) - min(lap_s) FILTER (WHERE stint = final) AS improve, count(*) AS timed FROM qr GROUP BY year, round, driver),
qd AS (SELECT year, round, driver, avg(deleted::INT) AS gone FROM ql GROUP BY year, round, driver), qe AS (SELECT * FROM qa JOIN qd USING (year, round, driver)),
qx AS (SELECT year, round, driver, stage, coalesce(best, lap_best) AS best, lap_best, ideal, improve, gone, timed, coalesce(best, lap_best) - min(coalesce(best, lap_best)) OVER (PARTITION BY year, round) AS pole FROM qb FULL JOIN qe USING (year, round, driver)), {_mates('qx', {'best': 'tm'}, 'qm')}"""
_add("quali_execution_pre", _EXEC, f"""{_KEY}, round(improve, 6) AS qexec_pre_final_run_improve_s, round(gone, 6) AS qexec_pre_deleted_lap_share, timed::BIGINT AS qexec_pre_timed_laps_n, round(best, 6) AS qexec_pre_best_lap_s, round(pole, 6) AS qexec_pre_gap_to_pole_s,
  round(lap_best - ideal, 6) AS qexec_pre_ideal_lap_gap_s, stage::BIGINT AS qexec_pre_stage_reached, round(tm, 6) AS qexec_pre_gap_to_tm_s FROM roster p {_NOW.format('qm')}""")

_add("quali_evolution_pre", f"""{_QUALI}, g0 AS (SELECT *, least(greatest(t / max(t) OVER (PARTITION BY year, round), 0), 1) AS progress, min(lap_s) OVER (PARTITION BY year, round) AS top FROM qc),
g1 AS (SELECT *, round(progress * 1000)::BIGINT AS m FROM g0), g2 AS (SELECT *, min(lap_s) OVER (PARTITION BY year, round ORDER BY m RANGE BETWEEN 75 PRECEDING AND 75 FOLLOWING) AS band FROM g1),
gb AS (SELECT year, round, driver, progress AS pushed, lap_s - band AS gap, band - top AS luck FROM g2 QUALIFY row_number() OVER (PARTITION BY year, round, driver ORDER BY lap_s, t) = 1),
ga AS (SELECT year, round, driver, max(progress) AS final, avg((progress >= 0.6)::INT) AS late, count(*) AS k FROM g2 GROUP BY year, round, driver),
gr AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN 1 ELSE 1 - (rank() OVER (PARTITION BY year, round ORDER BY gap) + (count(*) OVER (PARTITION BY year, round, gap) - 1) / 2 - 1) / greatest(count(*) OVER w - 1, 1) END AS pct
  FROM gb JOIN ga USING (year, round, driver) WINDOW w AS (PARTITION BY year, round))""",
     f"""{_KEY}, round(pushed, 6) AS qevo_pre_best_lap_progress_pct, round(gap, 6) AS qevo_pre_window_gap_s, round(luck, 6) AS qevo_pre_timing_luck_s, round(final, 6) AS qevo_pre_final_push_progress_pct, round(late, 6) AS qevo_pre_late_push_share,
  k::BIGINT AS qevo_pre_push_laps_n, round(pct, 6) AS qevo_pre_window_rank_pct FROM roster p {_NOW.format('gr')}""")

_W = {"best": "q_tm_delta_s", "s1": "q_s1_tm_delta_s", "s2": "q_s2_tm_delta_s", "s3": "q_s3_tm_delta_s", "long": "prac_longrun_tm_delta_s", "deg": "prac_deg_tm_delta_s_per_lap", "short": "prac_shortrun_tm_delta_s"}
_spread = lambda x, f: f"(SELECT {f}(v) FROM (SELECT unnest([{', '.join(x)}]) AS v))"
_OWN, _DEL = ("s1", "s2", "s3"), ("q_s1_tm_delta_s", "q_s2_tm_delta_s", "q_s3_tm_delta_s")
_TEAM_DELTA = f"""{_EXEC}, {_RUNS}, sc AS (SELECT year, round, driver, min(s1) AS s1, min(s2) AS s2, min(s3) AS s3 FROM ql WHERE NOT caution AND accurate GROUP BY year, round, driver),
lr AS (SELECT year, round, driver, short, pace AS long, slope AS deg FROM longrun), td AS (SELECT {_KEY}, best, position, s1, s2, s3, short, long, deg FROM roster p {_NOW.format('qb')} {_NOW.format('sc')} {_NOW.format('lr')}),
{_mates('td', {**_W, 'position': 'q_pos_tm_delta'}, 'tm')}, sz AS (SELECT *, count(*) OVER (PARTITION BY year, round, team) AS size FROM roster)"""
_add("weekend_team_delta_pre", _TEAM_DELTA, f"""{_KEY}, CASE WHEN size >= 2 THEN (size = 2)::BIGINT END AS wknd_pre_tm_has_pair, {', '.join(f'round({c}, 6) AS wknd_pre_{c}' for c in [*_W.values(), 'q_pos_tm_delta'])}, round({_spread(_DEL, 'stddev_pop')}, 6) AS wknd_pre_q_sector_tm_delta_std_s,
  round(greatest({', '.join(_DEL)}), 6) AS wknd_pre_q_sector_tm_delta_max_s, round(least({', '.join(_DEL)}), 6) AS wknd_pre_q_sector_tm_delta_min_s, round({_spread(_OWN, 'stddev_pop')}, 6) AS wknd_pre_q_sector_balance_std_s, round(greatest(s1, s2, s3) - least(s1, s2, s3), 6) AS wknd_pre_q_sector_balance_span_s
FROM roster p {_NOW.format('tm')} {_NOW.format('sz')}""")

_pct = lambda x: f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN count({x}) OVER w = 1 THEN 1 ELSE 1 - (rank() OVER (PARTITION BY year, round, {x} IS NOT NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY year, round, {x}) - 1) / 2 - 1) / greatest(count({x}) OVER w - 1, 1) END END"
_FIELD = {"q": "q_rank_pct", "s": "prac_short_rank_pct", "l": "prac_longrun_rank_pct", "d": "tm_delta_rank_pct"}
_add("weekend_field_form_pre", f"""{_TEAM_DELTA}, fr AS (SELECT {_KEY}, qm.best AS q, longrun.short AS s, longrun.pace AS l, tm.q_tm_delta_s AS d FROM roster p {_NOW.format('qm')} {_NOW.format('longrun')} {_NOW.format('tm')}),
fx AS (SELECT *, q - min(q) OVER w AS a, q - quantile_cont(q, 0.5) OVER w AS b, {', '.join(f'{_pct(x)} AS {n}' for x, n in _FIELD.items())} FROM fr WINDOW w AS (PARTITION BY year, round))""",
     f"""year, round, driver, round(a, 6) AS field_pre_q_gap_to_best_s, round(b, 6) AS field_pre_q_gap_to_median_s, {', '.join(f'round({n}, 6) AS field_pre_{n}' for n in _FIELD.values())},
  {_spread(_FIELD.values(), 'count')}::BIGINT AS field_pre_available_scores_n, round({_spread(_FIELD.values(), 'avg')}, 6) AS field_pre_combo_rank_pct FROM fx""")

_add("sprint_weekend_pre", f"""sr AS (SELECT {_KEY}, x.position AS pos, least(q1, q2, q3) AS best, x.driver IS NOT NULL AS ran FROM roster p LEFT JOIN (SELECT * FROM results WHERE session = 'SQ') x ON x.year = p.year AND x.round = p.round AND x.driver = p.driver),
sq AS (SELECT *, best - min(best) OVER (PARTITION BY year, round) AS gap FROM sr), {_mates('sq', {'best': 'tm'}, 'sm')}, has AS (SELECT DISTINCT year, round FROM results WHERE session = 'SQ')""",
     f"""sm.year, sm.round, sm.driver, round(pos, 6) AS sprint_pre_sq_pos, round(best, 6) AS sprint_pre_sq_best_s, NULL::DOUBLE AS sprint_pre_finish_pos, NULL::DOUBLE AS sprint_pre_gain_vs_grid, NULL::DOUBLE AS sprint_pre_points, round(gap, 6) AS sprint_pre_sq_gap_to_best_s, NULL::DOUBLE AS sprint_pre_gain_abs,
  (has.year IS NOT NULL)::BIGINT AS sprint_pre_has_data, round(tm, 6) AS sprint_pre_sq_tm_delta_s, NULL::DOUBLE AS sprint_pre_tm_finish_delta, (m.sprint OR has.year IS NOT NULL)::BIGINT AS sprint_pre_format_flag
FROM sm JOIN meta m ON m.year = sm.year AND m.round = sm.round LEFT JOIN has ON has.year = sm.year AND has.round = sm.round""")

_EFF = {"speed_p95": "speed_p95_kph", "speed_max": "speed_max_kph", "full_throttle_share": "full_throttle_share", "brake_share": "brake_share", "brake_speed_mean": "brake_speed_mean_kph", "drs_share": "drs_open_share", "drs_gain": "drs_speed_gain_kph"}
_add("telemetry_efficiency_pre", f"""tl AS (SELECT *, 100 + 2 * v AS speed, v >= 95 AS full_, n % 14 >= 10 AS open, v >= 95 AND 100 + 2 * v >= 150 AS straight, CASE session WHEN 'Q' THEN 4 WHEN 'FP3' THEN 3 ELSE 2 END AS ord FROM ev WHERE session IN ('Q', 'FP3', 'FP2')),
te AS (SELECT year, round, driver, ord, count(*) AS samples, quantile_cont(speed, 0.95) AS speed_p95, max(speed) AS speed_max, avg(full_::INT) AS full_throttle_share, avg((v < 20)::INT) AS brake_share, avg(speed) FILTER (WHERE v < 20) AS brake_speed_mean, avg(open::INT) AS drs_share,
  avg(speed) FILTER (WHERE straight AND open) - avg(speed) FILTER (WHERE straight AND NOT open) AS drs_gain FROM tl GROUP BY year, round, driver, ord),
tb AS (SELECT * FROM te QUALIFY row_number() OVER (PARTITION BY year, round, driver ORDER BY ord DESC, samples DESC, speed_p95 DESC) = 1), {_mates('tb', {'speed_p95': 'tm', 'drs_gain': 'tg'}, 'tm0')}""",
     f"""{_KEY}, ord::BIGINT AS tele_eff_pre_session_ord, samples::BIGINT AS tele_eff_pre_samples_n, {', '.join(f'round({c}, 6) AS tele_eff_pre_{n}' for c, n in _EFF.items())}, round(tm, 6) AS tele_eff_pre_speed_tm_delta_kph, round(tg, 6) AS tele_eff_pre_drs_gain_tm_delta_kph FROM roster p {_NOW.format('tm0')}""")
