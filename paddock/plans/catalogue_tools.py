"""The query catalogue, second part: file names and rounds, choices on columns, text, weights, audits, models and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns, params, text
from ..operators import audit, joins, lookback, scoring, stats, windows
from ..sources import files
from ..streaming import events as streaming
from . import features as fq
from . import training
from .registry import query, table, tidy
from .streams import _finished, _stream
from .views import LAPS, RES, SEEN, laps, results

# --- file names and rounds -------------------------------------------------------------------------------------------


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """A name as files have it for each round and kind of session, with its parts."""
    rounds = results(spark, d).select("y", "r").distinct()
    kind = F.element_at(F.array(*[F.lit(s) for s in ("", "_Q", "_FP2")]), (F.col("r") % 3 + 1).cast("int"))
    name = F.concat(F.when(F.col("y") <= 1995, "laps_").otherwise("weather_"), "y", F.lit("_"), "r", kind, F.lit(".csv"))
    return files.with_name_key(rounds.withColumn("name", name), F.col("name")).withColumn("table", F.regexp_extract("name", "^([a-z]+)_", 1))


_ROUNDS = "rd AS (SELECT DISTINCT y, r FROM res)"


@query(f"""WITH {RES}, {_ROUNDS} SELECT y, r, y AS year, r AS round, ['R', 'Q', 'FP2'][r % 3 + 1] AS session, y AS last_year, r AS last_round FROM rd""")
def file_name_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _manifest(spark, d)
    last = files.last_pair(F.concat(F.lit("2001_7_of_"), F.col("name")))
    return tidy(rows.select("y", "r", "year", "round", "session", last[0].alias("last_year"), last[1].alias("last_round")))


@query(f"""WITH {RES}, {_ROUNDS} SELECT y AS year, r AS round FROM rd WHERE y <= 1995 AND r <= 6""")
def discovered_rounds(spark: SparkSession, d: str) -> DataFrame:
    allow = [f"{y}_{r}" for y in range(1980, 2030) for r in range(1, 7)]
    races = results(spark, d).select(F.col("y").alias("year"), F.col("r").alias("round"))
    return tidy(files.discover_rounds(_manifest(spark, d), races, allow))


@query(f"""WITH {RES}, {_ROUNDS} SELECT y AS year, r AS round FROM rd""")
def discovered_from_races(spark: SparkSession, d: str) -> DataFrame:
    """No file has a known table here, so the table of races counts."""
    races = results(spark, d).select(F.col("y").alias("year"), F.col("r").alias("round"))
    return tidy(files.discover_rounds(_manifest(spark, d).filter("table = 'weather'"), races))


@query(f"""WITH {RES}, {_ROUNDS} SELECT y AS year, r AS round FROM rd WHERE y > 1995""")
def available_rounds(spark: SparkSession, d: str) -> DataFrame:
    return tidy(files.available_rounds(_manifest(spark, d), ["weather"]))


@query(f"""WITH {RES}, {_ROUNDS} SELECT y AS year, r AS round FROM rd WHERE y > 1995 AND y * 12 + r < 1997 * 12 + 6""")
def missing_rounds(spark: SparkSession, d: str) -> DataFrame:
    rounds = results(spark, d).select(F.col("y").alias("year"), F.col("r").alias("round")).distinct()
    schedule = rounds.withColumns({"s1": F.col("year") * 12 + F.col("round"), "s2": F.lit(None).cast("long")})
    return tidy(files.missing_rounds(schedule, rounds.filter("year <= 1995"), ["s1", "s2"], F.lit(1997 * 12 + 5)))


# --- choices on columns ----------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, NULL::DOUBLE AS absent FROM orders""")
def lenient_columns(spark: SparkSession, d: str) -> DataFrame:
    """A column by one of its names, in any case, leniently cast."""
    value = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", value.alias("TotalPrice"))
    return tidy(rows.select("o_orderkey", columns.pick(rows, ["price", "totalprice"], "double").alias("price"), columns.pick(rows, ["none"], "double").alias("absent")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS f_price, o_orderstatus AS f_status, NULL::DOUBLE AS f_more FROM orders""")
def coerced_columns(spark: SparkSession, d: str) -> DataFrame:
    """Text columns of a known prefix become numbers where most values are; a missing column is made."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.col("o_totalprice").cast("string")).alias("f_price"), F.col("o_orderstatus").alias("f_status"))
    return tidy(columns.ensure(columns.coerce_numeric(rows, ["f_"]), ["f_price", "f_more"]))


@query("""SELECT c_custkey, coalesce(c_acctbal, n_nationkey) AS value FROM customer, nation WHERE n_nationkey = c_nationkey""")
def sanitized_columns(spark: SparkSession, d: str) -> DataFrame:
    """Names are stripped; two columns of one name become one."""
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias(" value"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("value\n"))
    return tidy(columns.sanitize(rows))


@query("""SELECT c_custkey, 1.5::DOUBLE AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'moved' ELSE c_name END AS c_name FROM customer""")
def overridden_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name")
    moved = rows.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("moved").alias("c_name"), F.lit(1).alias("unknown"))
    return tidy(columns.override(rows, {"c_acctbal": 1.5, "absent": 2}, moved, ["c_custkey"]))


@query("""SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_name IN ('NATION_7', 'NATION_2', 'NATION_11')""")
def listed_rows(spark: SparkSession, d: str) -> DataFrame:
    return tidy(columns.in_list_order(table(spark, d, "nation").select("n_name", "n_nationkey"), "n_name", ["NATION_11", "NATION_7", "NOWHERE", "NATION_2"]))


def _names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS name")
def selected_features(spark: SparkSession, d: str) -> DataFrame:
    """Numeric columns without keys, money and empty ones."""
    rows = table(spark, d, "lineitem").select("*", F.lit(None).cast("double").alias("l_none"))
    return _names(spark, columns.select_features(rows, blacklist=["l_linenumber"], drop_pattern="key$|price"))


@query("SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_orderdate', 'o_custkey']) AS name")
def filtered_names(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, columns.filter_columns(table(spark, d, "orders").columns, keep=["o_order"], drop=["o_orderp"], contains=["cust"], exact=["o_none"]))


@query("SELECT unnest(['track_is_spa', 'hist_pre_hist_n', 'driver_trend', 'reliab_dnf_risk']) AS name")
def future_profile(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, columns.future_columns(["track_is_spa", "qexec_pre_best_lap_s", "hist_pre_hist_n", "driver_trend", "driver_trend_2", "reliab_dnf_risk"]))


@query("SELECT * FROM (VALUES ('hist_finish_p50', -1), ('top10_rate', 1), ('laps_n', NULL), ('quali_pos_iqr', -1)) t(name, direction)")
def expected_directions(spark: SparkSession, d: str) -> DataFrame:
    return tidy(spark.createDataFrame([(n, columns.direction(n)) for n in ("hist_finish_p50", "top10_rate", "laps_n", "quali_pos_iqr")], "name string, direction int"))


@query(f"""WITH {RES} SELECT k, (driver % 2 = 0)::INT::DOUBLE AS x, 0.0::DOUBLE AS track_is_spa, 1.0::DOUBLE AS track_is_monza, CASE driver WHEN 1 THEN 20 WHEN 2 THEN 19 ELSE grid END::DOUBLE AS grid, 31.5::DOUBLE AS weather_air FROM res""")
def scenario_overrides(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).select("k", "driver", (F.col("driver") % 2 == 0).cast("double").alias("x"), F.lit(1.0).alias("track_is_spa"), F.lit(0.0).alias("track_is_monza"), "grid", F.col("points").alias("weather_air"))
    return tidy(columns.scenario(rows, track="Monza", weather={"air": (["air_temp", "Weather_Air"], 31.5), "wind": (["wind"], 3.0)}, grid={1: 20, 2: 19}).drop("driver"))


@query(f"""WITH {RES} SELECT k, coalesce(pos, NULL)::DOUBLE AS finish_pos_eff FROM (SELECT k, CASE WHEN status = 'P' THEN 21 ELSE pos END AS pos FROM res)""")
def derived_target(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("status") == "P", "Retired: engine").otherwise("Finished")
    rows = results(spark, d).select("k", F.lit("x").alias("finish_pos"), F.col("pos").cast("string").alias("Position"), status.alias("Status"))
    return tidy(columns.with_target(rows).select("k", "finish_pos_eff"))


# --- laps ------------------------------------------------------------------------------------------------------------

_STATUS = ["1", " 1", "12", "4", "", "2"]


@query(f"""WITH {LAPS}, s AS (SELECT *, CASE event_id % 7 WHEN 0 THEN NULL ELSE ['1', ' 1', '12', '4', '', '2'][event_id % 6 + 1] END AS s FROM laps)
SELECT event_id, coalesce(trim(s) = '1', true) AS green, NOT coalesce(regexp_matches(s, '[24567]'), false) AS no_caution, code IN ('click', 'view') AS pit, x BETWEEN 20 AND 80 AS within FROM s""")
def lap_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = laps(spark, d)
    status = F.when(F.col("event_id") % 7 != 0, F.element_at(F.array(*[F.lit(s) for s in _STATUS]), (F.col("event_id") % 6 + 1).cast("int")))
    rows = rows.withColumns({"s": status, "pit_in": F.when(F.col("code") == "click", F.col("x")), "pit_out": F.when(F.col("code") == "view", F.col("x"))})
    return rows.select("event_id", fq.is_green(F.col("s")).alias("green"), fq.no_caution(F.col("s")).alias("no_caution"), fq.is_pit().alias("pit"), F.col("x").between(20, 80).alias("within"))


@query(f"""WITH {LAPS} SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN day END, sum((code = 'view')::INT) OVER (PARTITION BY driver ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM laps""")
def run_ids(spark: SparkSession, d: str) -> DataFrame:
    stint = F.when(F.col("event_id") % 3 == 0, F.col("day"))
    return tidy(laps(spark, d).select("event_id", windows.run_id(stint, F.col("code") == "view", ["driver"], ["us", "event_id"]).alias("run")))


@query(f"""WITH {LAPS}, t AS (SELECT driver, us, x FROM laps WHERE code = 'purchase' QUALIFY row_number() OVER (PARTITION BY driver, us ORDER BY event_id) = 1), l AS (SELECT event_id, driver, us FROM laps WHERE code <> 'purchase' QUALIFY count(*) OVER (PARTITION BY driver, us) = 1)
SELECT event_id, t.x AS tyre, coalesce(lag(l.us) OVER (PARTITION BY l.driver ORDER BY l.us), 0)::BIGINT AS lap_start FROM l ASOF LEFT JOIN t ON t.driver = l.driver AND t.us <= l.us""")
def rebuilt_laps(spark: SparkSession, d: str) -> DataFrame:
    rows = laps(spark, d)
    tyres = lookback.last_rows(rows.filter("code = 'purchase'"), ["driver", "us"], [F.col("event_id")], 1).select("driver", "us", F.col("x").alias("tyre"))
    ends = rows.filter("code <> 'purchase'").withColumn("_n", F.count("*").over(Window.partitionBy("driver", "us"))).filter("_n = 1").select("event_id", "driver", "us")
    return tidy(joins.rebuilt_laps(ends, tyres, ["driver"], "us", ["tyre"], F.lit(0).cast("long")).select("event_id", "tyre", "lap_start"))


@query(f"""WITH {LAPS} SELECT event_id, n::BIGINT AS drivers FROM laps JOIN (SELECT day, count(DISTINCT driver) AS n FROM laps GROUP BY 1) USING (day)""")
def distinct_in_group(spark: SparkSession, d: str) -> DataFrame:
    return tidy(windows.with_distinct(laps(spark, d), "driver", ["day"], "drivers").select("event_id", "drivers"))


@query(f"""WITH {LAPS}, f AS (SELECT driver, code, min((us, event_id)) AS f FROM laps WHERE code <> 'error' GROUP BY 1, 2) SELECT driver, string_agg(code, ',' ORDER BY f) AS codes FROM f GROUP BY 1""")
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = laps(spark, d).withColumn("c", F.when(F.col("code") == "error", " ").otherwise(F.concat(F.lit(" "), "code", F.lit(" "))))
    return windows.distinct_in_order(rows, ["driver"], "c", ["us", "event_id"]).select("driver", F.array_join("values", ",").alias("codes"))


@query(f"""WITH {LAPS}, p AS (SELECT driver, day, avg(x) AS mean, max(x) AS most, count(*) AS n FROM laps GROUP BY 1, 2) SELECT driver, round(avg(mean), 6) AS mean, round(avg(most), 6) AS most, round(avg(n), 6) AS n FROM p GROUP BY 1""")
def telemetry_per_race(spark: SparkSession, d: str) -> DataFrame:
    """The mean over laps of what each lap gave: laps count alike, however many samples they have."""
    per = laps(spark, d).groupBy("driver", "day").agg(F.avg("x").alias("mean"), F.max("x").alias("most"), F.count("*").alias("n"))
    return tidy(per.groupBy("driver").agg(*[F.avg(c).alias(c) for c in ("mean", "most", "n")]))


@query(f"""WITH {RES} SELECT k, round(points - avg(points) OVER (PARTITION BY y, r, team), 6) AS delta FROM res""")
def team_mean_delta(spark: SparkSession, d: str) -> DataFrame:
    return tidy(stats.with_stats(results(spark, d), ["y", "r", "team"], {"m": F.avg("points")}).select("k", (F.col("points") - F.col("m")).alias("delta")))


@query(f"""WITH {LAPS} SELECT event_id, round((x - (SELECT quantile_cont(x, 0.05) FROM laps)) / (SELECT quantile_cont(x, 0.95) - quantile_cont(x, 0.05) FROM laps), 6) AS scaled FROM laps""")
def exact_quantile_scale(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of a whole column by refinement of counts."""
    rows = laps(spark, d)
    lo, hi = stats.exact_quantiles(rows, "x", [0.05, 0.95])
    return tidy(rows.select("event_id", ((F.col("x") - lo) / (hi - lo)).alias("scaled")))


# --- text ------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT o_orderkey, o_orderkey % 60 AS s, o_orderkey % 7 AS h, o_orderkey % 4 AS kind FROM orders)
SELECT o_orderkey, CASE kind WHEN 0 THEN o_orderkey WHEN 1 THEN (h * 3600 + 5 * 60 + s + 0.25) * 1000 WHEN 2 THEN (86400 + h * 3600 + s) * 1000 END::DOUBLE AS ms FROM a""")
def milliseconds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s, h, kind = F.lpad((k % 60).cast("string"), 2, "0"), (k % 7).cast("string"), k % 4
    value = F.when(kind == 0, k.cast("string")).when(kind == 1, F.concat(h, F.lit(":05:"), s, F.lit(".25"))).when(kind == 2, F.concat(F.lit("1 days 0"), h, F.lit(":00:"), s)).otherwise("box box")
    return tidy(table(spark, d, "orders").select("o_orderkey", text.milliseconds(value).alias("ms")))


@query("""SELECT c_custkey, regexp_replace(lower(trim(c_mktsegment || '  and ' || c_name)), '\\s+', '_', 'g') AS slug FROM customer""")
def slugify_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.slug_space(F.concat(F.lit(" "), "c_mktsegment", F.lit("  and "), "c_name")).alias("slug"))


_SESSIONS = ["Race", " sprint_qualifying", "Practice  2", "fp1", "Sprint Shootout", "qualifying"]


@query("""SELECT o_orderkey, ['R', 'SQ', 'FP2', 'FP1', 'SQ', 'Q'][o_orderkey % 6 + 1] AS session FROM orders""")
def session_codes(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(s) for s in _SESSIONS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", text.session_code(name).alias("session"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def mixed_timestamps(spark: SparkSession, d: str) -> DataFrame:
    t, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 5
    value = F.when(k == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(t, "yyyy-MM-dd")).when(k == 3, F.date_format(t, "dd/MM/yyyy")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(text.timestamp_mixed(value), "yyyy-MM-dd").alias("day"))


@query(f"""WITH {RES} SELECT k, CASE WHEN k % 3 = 0 THEN 3 WHEN k % 5 = 0 THEN 2 WHEN k % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS stage, y * 1000 + r AS race_id, printf('%.1f%%', 100 * (grid % 8) / 8.0) AS share,
  CASE WHEN k % 2 = 0 THEN y END AS label_year, CASE WHEN k % 2 = 0 THEN r END AS label_round, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM res""")
def labels_and_stages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    q = [F.when(k % m == 0, F.lit(80.0)) for m in (2, 5, 3)]
    label = F.when(k % 2 == 0, F.concat(F.lit("build "), "y", F.lit("-R"), F.lpad(F.col("r").cast("string"), 2, "0"))).otherwise("none")
    year, round_ = params.build_label(label)
    flag = text.boolean_text(F.element_at(F.array(*[F.lit(s) for s in ("yes", "0.0", "maybe", "")]), (k % 4 + 1).cast("int")))
    return tidy(results(spark, d).select("k", text.stage_reached(*q).alias("stage"), text.race_id(F.col("y"), F.col("r")).alias("race_id"), params.percent((F.col("grid") % 8) / 8.0).alias("share"), year.alias("label_year"), round_.alias("label_round"), flag.alias("flag")))


@query(f"""WITH {RES} SELECT k, CASE driver WHEN 1 THEN 1.0 WHEN 2 THEN 2.5 END::DOUBLE AS weight FROM res WHERE r IN (1, 3, 5, 6, 7)""")
def parameter_lists(spark: SparkSession, d: str) -> DataFrame:
    weights = params.pairs("1=1, 2=2.5")
    value = F.coalesce(*[F.when(F.col("driver").cast("string") == n, F.lit(w)) for n, w in weights.items()])
    return tidy(results(spark, d).filter(F.col("r").isin(params.number_list("1,3,5-7"))).select("k", value.alias("weight")))


@query(f"""WITH {RES}, f AS (SELECT y, r, driver, avg(points) AS pace FROM res GROUP BY ALL), t AS (SELECT *, ['Finished', '+1 Lap', 'Engine', 'Disqualified', 'Collision', 'Unknown'][k % 6 + 1] AS s FROM res QUALIFY row_number() OVER (PARTITION BY y, r, driver ORDER BY k) = 1),
o AS (SELECT y, r, driver, pos, CASE WHEN s = 'Disqualified' THEN 'dsq' WHEN s IN ('Finished', '+1 Lap') THEN 'finish' WHEN s IN ('Engine', 'Collision') THEN 'dnf' WHEN pos > 0 THEN 'finish' ELSE 'dnf' END AS outcome FROM t)
SELECT y AS year, r AS round, driver, round(pace, 6) AS pace, outcome AS result_outcome, CASE outcome WHEN 'finish' THEN 0 WHEN 'dnf' THEN 1 ELSE 2 END::BIGINT AS outcome_id,
  CASE WHEN outcome = 'finish' AND pos IS NOT NULL THEN pos WHEN outcome = 'dsq' THEN 25 ELSE 21 END::DOUBLE AS finish_pos_eff FROM o JOIN f USING (y, r, driver)""")
def train_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).withColumnsRenamed({"y": "year", "r": "round"})
    names = F.array(*[F.lit(s) for s in ("Finished", "+1 Lap", "Engine", "Disqualified", "Collision", "Unknown")])
    targets = lookback.last_rows(rows, fq.KEY, [F.col("k")], 1).select(*fq.KEY, F.col("pos").alias("finish_position"), F.element_at(names, (F.col("k") % 6 + 1).cast("int")).alias("Status"))
    return tidy(fq.train_table(rows.groupBy(*fq.KEY).agg(F.avg("points").alias("pace")), targets).drop("finish_position", "Status"))


# --- weights, scores, models -----------------------------------------------------------------------------------------


@query(f"""WITH {RES}, {_ROUNDS}, a AS (SELECT y, r, r::DOUBLE AS w FROM rd WHERE y < 1997), b AS (SELECT y, r, 2.0 AS w FROM rd WHERE y > 1994), p AS (SELECT y, r, coalesce(a.w, 1) * coalesce(b.w, 1) AS w FROM a FULL JOIN b USING (y, r))
SELECT y, r, round((w / avg(w) OVER ())::DOUBLE, 6) AS weight FROM p""")
def weight_product(spark: SparkSession, d: str) -> DataFrame:
    rounds = results(spark, d).select("y", "r").distinct()
    maps = [rounds.filter("y < 1997").withColumn("weight", F.col("r").cast("double")), rounds.filter("y > 1994").withColumn("weight", F.lit(2.0))]
    return tidy(scoring.combined_weights(maps, ["y", "r"]))


@query(f"""WITH {RES}, {_ROUNDS}, w AS (SELECT CASE WHEN y <= 1995 THEN 'old' ELSE 'new' END AS era, CASE WHEN y <= 1995 THEN 0.5 ELSE 1.0 END * r AS w FROM rd) SELECT era, count(*)::BIGINT AS races, round(avg(w)::DOUBLE, 6) AS weight_mean, min(w)::DOUBLE AS weight_min, max(w)::DOUBLE AS weight_max FROM w GROUP BY 1""")
def era_summary(spark: SparkSession, d: str) -> DataFrame:
    era = F.when(F.col("y") <= 1995, "old").otherwise("new")
    rounds = results(spark, d).select("y", "r").distinct().withColumn("weight", F.when(F.col("y") <= 1995, 0.5).otherwise(1.0) * F.col("r"))
    return tidy(scoring.era_summary(rounds, era))


@query(f"""WITH {RES}, a AS (SELECT *, points / 100000 - 1.5 * 0.25 * (coalesce(nullif(grid, 7), 10) - 1) AS s, 1 + (k % 11) / 11.0 AS st, 0.5 + 0.4 * (k % 11) / 10 AS pf FROM res),
z AS (SELECT *, avg(s) OVER w AS m, stddev_pop(s) OVER w AS sd, s + ln(pf) AS l FROM a WINDOW w AS (PARTITION BY y, r)), e AS (SELECT *, 10 * st + least(greatest(CASE WHEN sd < 1e-6 THEN s - m ELSE (s - m) / sd END, -3), 3) AS score, exp(l - max(l) OVER (PARTITION BY y, r)) AS e FROM z)
SELECT k, round(score, 6) AS score, round(e / sum(e) OVER (PARTITION BY y, r), 6) AS p_win, row_number() OVER (PARTITION BY y, r ORDER BY score DESC, driver, k) AS rank FROM e""")
def regridded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = results(spark, d).select("k", "y", "r", "driver", "grid", (F.col("points") / 100000).alias("rank_score"), (1 + (k % 11) / 11.0).alias("score_status"), (0.5 + 0.4 * (k % 11) / 10).alias("p_finish"))
    return tidy(scoring.regridded(rows, ["y", "r"], F.nullif("grid", F.lit(7).cast("long")), 1.5).select("k", "score", "p_win", "rank"))


@query(f"""WITH {RES}, m AS (SELECT y AS epoch, corr(pos, grid) AS spearman, CASE WHEN y % 2 = 0 THEN avg((status = 'O')::INT) END AS macro_f1 FROM res GROUP BY 1) SELECT epoch, round(spearman, 6) AS spearman, round(macro_f1, 6) AS macro_f1, round(coalesce(spearman + macro_f1, macro_f1, spearman), 6) AS selection_score
FROM m ORDER BY selection_score DESC NULLS LAST, epoch LIMIT 1""")
def best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    metrics = results(spark, d).groupBy(F.col("y").alias("epoch")).agg(F.corr("pos", "grid").alias("spearman"), F.avg((F.col("status") == "O").cast("int")).alias("f")).withColumn("macro_f1", F.when(F.col("epoch") % 2 == 0, F.col("f"))).drop("f")
    return tidy(scoring.best_checkpoint(metrics))


@query(f"""WITH {RES}, f AS (SELECT *, row_number() OVER (PARTITION BY y, r ORDER BY grid) AS fin, points / 100000 AS s FROM res), a AS (SELECT y, r, fin, ln(sum(exp(s)) OVER (PARTITION BY y, r ORDER BY fin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - s AS l FROM f) SELECT y, r, round(sum(l), 6) AS nll, round(sum(l) FILTER (WHERE fin <= 5), 6) AS nll_top5 FROM a GROUP BY 1, 2""")
def list_mle(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).withColumn("s", F.col("points") / 100000)
    whole, top = (scoring.plackett_luce_nll(rows, ["y", "r"], "s", "grid", k, total=True) for k in (None, 5))
    return tidy(whole.join(top.withColumnRenamed("nll", "nll_top5"), ["y", "r"]))


_WEIGHTS = {"w": np.array([[0.8], [-0.5]]), "b": np.array([0.3]), "rank": np.array([1.2]), "status": np.array([[0.4, -0.2, -0.6]]), "bias": np.array([0.1, 0.3, -0.4])}


def _cut_scores(spark: SparkSession, d: str) -> tuple[DataFrame, training.RankModel]:
    """Priors of each driver at each cut-off, scored by one model: all cut-offs at once."""
    seen = lookback.history(results(spark, d), 5).groupBy("cut_y", "cut_r", "driver").agg((F.avg("points") / 100000).alias("a"), (F.avg("grid") / 50).alias("b"))
    roster = results(spark, d).select(F.col("y").alias("cut_y"), F.col("r").alias("cut_r"), "driver").distinct()
    return roster.join(seen, ["cut_y", "cut_r", "driver"]), training.RankModel(["a", "b"], 1, weights=_WEIGHTS)


_SCORED = f"""{RES}, {SEEN.format(n=5)}, f AS (SELECT cut_y, cut_r, driver, avg(points) / 100000 AS a, avg(grid) / 50 AS b FROM hist GROUP BY 1, 2, 3), q AS (SELECT f.* FROM f JOIN (SELECT DISTINCT y, r, driver FROM res) c ON c.y = cut_y AND c.r = cut_r AND c.driver = f.driver),
h AS (SELECT *, greatest(0.8 * a - 0.5 * b + 0.3, 0) AS h FROM q), l AS (SELECT *, 1.2 * h AS rs, exp(0.4 * h + 0.1) AS e0, exp(-0.2 * h + 0.3) AS e1, exp(-0.6 * h - 0.4) AS e2 FROM h), p AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM l),
z AS (SELECT *, avg(rs) OVER w AS m, stddev_pop(rs) OVER w AS sd FROM p WINDOW w AS (PARTITION BY cut_y, cut_r)), s AS (SELECT *, 10 * (2 * p0 + p1) + least(greatest(CASE WHEN sd < 1e-6 THEN rs - m ELSE (rs - m) / sd END, -3), 3) AS score,
  CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'finish' WHEN p1 >= p2 THEN 'dnf' ELSE 'dsq' END AS outcome FROM z)"""


@query(f"""WITH {_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY cut_y, cut_r ORDER BY round(score, 9) DESC, driver) AS rank FROM s),
g AS (SELECT *, CASE WHEN outcome = 'finish' THEN rank ELSE 99 END AS place, CASE WHEN outcome = 'finish' AND rank <= 10 THEN [25, 18, 15, 12, 10, 8, 6, 4, 2, 1][rank] ELSE 0 END AS pts FROM k),
t AS (SELECT cut_y, driver, sum(pts) AS points, count_if(place = 1) AS wins, count_if(place <= 3) AS podiums, count(DISTINCT cut_r) AS races FROM g GROUP BY 1, 2)
SELECT cut_y, driver, points::BIGINT AS points, wins::BIGINT AS wins, podiums::BIGINT AS podiums, races::BIGINT AS races, row_number() OVER (PARTITION BY cut_y ORDER BY points DESC, wins DESC, podiums DESC, driver) AS rank FROM t""")
def season_simulation(spark: SparkSession, d: str) -> DataFrame:
    """The standings of every season, simulated over all of its cut-offs from priors built for each."""
    rows, model = _cut_scores(spark, d)
    return tidy(training.simulate_seasons(rows, model, "cut_y", "cut_r", "driver"))


@query(f"""WITH {_SCORED}, e AS (SELECT cut_y, cut_r, driver, unnest([{{'feature': 'a', 'x': a, 'w': 0.8}}, {{'feature': 'b', 'x': b, 'w': -0.5}}], recursive := true), h FROM s)
SELECT cut_y, cut_r, driver, feature, round(abs(x), 6) AS abs_z, round(CASE WHEN h > 0 THEN 1.2 * w * x ELSE 0 END, 6) AS grad_input FROM e""")
def explanations(spark: SparkSession, d: str) -> DataFrame:
    rows, model = _cut_scores(spark, d)
    return tidy(training.explained(rows, model, ["cut_y", "cut_r"], "driver"))


# --- audits ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {RES}, l AS (SELECT y, r, k, pos, unnest([{{'feature': 'same', 'v': pos::DOUBLE}}, {{'feature': 'negative', 'v': -pos::DOUBLE}}, {{'feature': 'grid', 'v': grid::DOUBLE}}], recursive := true) FROM res WHERE pos IS NOT NULL),
o AS (SELECT *, row_number() OVER (w ORDER BY pos, v) AS t, row_number() OVER (w ORDER BY v, pos) AS u, row_number() OVER (w ORDER BY v DESC, pos) AS d, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY feature, y, r)),
g AS (SELECT feature, y, r, greatest(sum((n - t + 1) / log2(u + 1)) FILTER (WHERE u <= 5), sum((n - t + 1) / log2(d + 1)) FILTER (WHERE d <= 5)) / sum((n - t + 1) / log2(t + 1)) FILTER (WHERE t <= 5) AS ndcg FROM o GROUP BY 1, 2, 3)
SELECT feature, min(ndcg) > 0.999 AS ndcg_one, feature = 'points' AS late_name FROM g GROUP BY 1""")
def sorts_as_target(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).withColumns({"same": F.col("pos"), "negative": -F.col("pos")})
    return audit.sorts_as_target(rows, ["y", "r"], ["same", "negative", "grid"], "pos").withColumn("late_name", audit.looks_late(F.col("feature")))


@query(f"""WITH {RES}, a AS (SELECT *, row_number() OVER (PARTITION BY y, r, driver ORDER BY k DESC) AS n FROM res), v AS (SELECT y, r, row_number() OVER (ORDER BY y DESC, r DESC) <= 6 AS v FROM (SELECT DISTINCT y, r FROM res))
SELECT y, r, driver, points, grid, v AS is_validation FROM a JOIN v USING (y, r) WHERE n = 1""")
def split_keep_last(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d)
    return tidy(audit.split_keep_last(rows.select("y", "r", "driver", "points", "k"), rows.select("y", "r", "driver", "grid", "k"), ["y", "r", "driver"], ["k"], "y", "r", 6).drop("k"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 2 = 0 AS m, p_partkey % 3 = 0 AS f, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice / 500 END AS psi, p_size::DOUBLE AS g, -p_retailprice AS d FROM part)
SELECT p_partkey, round(0.35 * m::INT + 0.25 * f::INT + 0.10 * least(greatest(coalesce(psi, 0), 0), 2) + 0.10 * g / (max(g) OVER () + 1e-9) + 0.10 * abs(d) / (max(abs(d)) OVER () + 1e-9), 6) AS suspicious FROM p""")
def suspicion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", (k % 2 == 0).alias("polarity_mismatch"), (k % 3 == 0).alias("flip"), F.when(k % 5 > 0, F.col("p_retailprice") / 500).alias("psi"), F.col("p_size").cast("double").alias("grad"), (-F.col("p_retailprice")).alias("drop"))
    return tidy(audit.suspicion(rows).select("p_partkey", "suspicious"))


_PERMUTED = " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(avg(abs(f.rho) - abs(s.rho)), 6) AS drop FROM (SELECT y, r, corr(rank_s, rank_p) AS rho FROM (SELECT y, r, rank() OVER (PARTITION BY y, r ORDER BY a + b) + (count(*) OVER (PARTITION BY y, r, a + b) - 1) / 2 AS rank_s, rank() OVER (PARTITION BY y, r ORDER BY pos) AS rank_p FROM b WHERE pos IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 3) f
JOIN (SELECT y, r, corr(rank_s, rank_p) AS rho FROM (SELECT y, r, rank() OVER (PARTITION BY y, r ORDER BY s) + (count(*) OVER (PARTITION BY y, r, s) - 1) / 2 AS rank_s, rank() OVER (PARTITION BY y, r ORDER BY pos) AS rank_p FROM m_{c} WHERE pos IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 3) s USING (y, r)""" for c in "ab")


@query(f"""WITH {RES}, b AS (SELECT y, r, k, pos, points AS a, grid::DOUBLE AS b, row_number() OVER (PARTITION BY y, r ORDER BY k) AS n, row_number() OVER (PARTITION BY y, r ORDER BY (k * 48271) % 2147483647, k) AS m FROM res),
m_a AS (SELECT b.y, b.r, b.pos, o.a + b.b AS s FROM b JOIN b o ON o.y = b.y AND o.r = b.r AND o.m = b.n), m_b AS (SELECT b.y, b.r, b.pos, b.a + o.b AS s FROM b JOIN b o ON o.y = b.y AND o.r = b.r AND o.m = b.n) {_PERMUTED}""")
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """The drop of each race's rank correlation when a feature is shuffled within the race, by a multiplicative hash of the key."""
    base = results(spark, d).select("y", "r", "k", "pos", F.col("points").alias("a"), F.col("grid").cast("double").alias("b"))
    whole = audit.spearman(base.withColumn("s", F.col("a") + F.col("b")), ["y", "r"], ["s"], "pos").select("y", "r", F.col("rho").alias("full"))
    shuffle, drops = F.col("k") * 48271 % 2147483647, None
    for c in ("a", "b"):
        part = audit.spearman(audit.permuted(base, ["y", "r"], c, "k", order=shuffle).withColumn("s", F.col("a") + F.col("b")), ["y", "r"], ["s"], "pos").join(whole, ["y", "r"]).groupBy().agg(F.avg(F.abs("full") - F.abs("rho")).alias("drop")).withColumn("feature", F.lit(c))
        drops = part if drops is None else drops.unionByName(part)
    return tidy(drops)


@query(r"""WITH k AS (SELECT DISTINCT p_name AS match, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS b FROM part), n AS (SELECT DISTINCT p_name[:4] || p_name[6:] AS name, regexp_replace(lower(p_name[:4] || p_name[6:]), '[^a-z0-9]', '', 'g') AS a FROM part),
p AS (SELECT name, match, 1 - levenshtein(a, b) / greatest(length(a), length(b), 1) AS score FROM n, k WHERE abs(length(a) - length(b)) <= 0.2 * greatest(length(a), length(b)) + 1e-9)
SELECT name, match, round(score, 6) AS score FROM p WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, match) = 1""")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Part names with a letter missing against the whole names."""
    part = table(spark, d, "part").select(F.col("p_name").alias("name"))
    return tidy(joins.fuzzy_match(part.select(F.concat(F.substring("name", 1, 4), F.expr("substring(name, 6)")).alias("name")), part, "name"))


# --- streams ---------------------------------------------------------------------------------------------------------


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS samples, round(avg(value), 6) AS speed_mean, round(max(value), 6) AS speed_max, round(avg((value >= 95)::INT), 6) AS full_throttle_share, round(avg((value / 100 >= 0.5)::INT), 6) AS brake_share FROM events GROUP BY 1, 2""")
def stream_per_lap(spark: SparkSession, d: str) -> DataFrame:
    samples = _stream(spark, d).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "throttle": F.col("value"), "brake": F.col("value") / 100})
    return tidy(_finished(streaming.per_lap(samples, "ts", ["user_id", "day"], "value", "throttle", "brake"), "per-lap", "complete"))


@query("""SELECT e.event_id, l.event_id AS lap FROM events e JOIN events l ON l.user_id = e.user_id AND l.event_type = 'purchase' AND e.event_type = 'click' AND e.ts >= l.ts - INTERVAL 20 MINUTE AND e.ts < l.ts""")
def stream_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Clicks with the purchases of the same user up to twenty minutes after them; both sides are streams."""
    rows = _stream(spark, d)
    clicks = rows.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    laps_ = rows.filter("event_type = 'purchase'").select(F.col("event_id").alias("lap"), "user_id", (F.col("ts") - F.expr("INTERVAL 20 MINUTES")).alias("start"), F.col("ts").alias("end"))
    return tidy(_finished(streaming.aligned(clicks, laps_, ["user_id"], "ts", "start", "end").select("event_id", "lap"), "aligned", "append"))


@query("""SELECT event_id, year(ts)::BIGINT AS year, dayofyear(ts)::BIGINT AS round FROM events""")
def stream_into_rounds(spark: SparkSession, d: str) -> DataFrame:
    """A stream written twice by rounds: the second run leaves the same table."""
    path = files.scratch_path(spark, "rounds")
    for _ in range(2):
        rows = _stream(spark, d).select("event_id", F.year("ts").alias("year"), F.dayofyear("ts").alias("round"))
        streaming.into_rounds(rows, path, files.scratch_path(spark, "rounds-state")).awaitTermination()
    return tidy(spark.read.schema("event_id long, year int, round int").parquet(path))
