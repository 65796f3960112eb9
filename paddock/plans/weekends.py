"""The weekend feature queries over the events table: each day is a round, each user a driver, each event a lap.

Sessions, compounds and the like are functions of the event's id, so the canonical tables have rows of every kind. All rounds
are cut-offs, the roster of a round is who has events in it, and all events are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import features as fq
from .registry import QUERIES, SQL, table, tidy


def choose(n: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", F.year("ts").alias("year"), F.dayofyear("ts").alias("round"), F.concat(F.lit("D"), F.col("user_id")).alias("driver"), F.concat(F.lit("T"), F.col("user_id") % 40).alias("team"),
                                              (F.unix_micros(F.col("ts").cast("timestamp")) % 86_400_000_000 / 1e6).alias("t"), "event_type", "value")
    n = F.col("event_id")
    own = Window.partitionBy("year", "round", "driver", "session").orderBy("t", "event_id")
    sessions = e.withColumn("session", choose(n, ["R", "R", "R", "Q", "Q", "FP1", "FP2", "FP2", "FP3", "SQ"])).withColumn("lap", F.row_number().over(own))
    order = Window.partitionBy("year", "round", "session", "lap").orderBy("value", "event_id")
    laps = sessions.select(
        "year", "round", "session", "driver", "team", "lap", (80 + F.col("value") / 10).alias("lap_s"), F.col("t").alias("time_s"), (F.col("t") - 80).alias("start_s"), ((F.col("lap") + 2) / 3).cast("int").alias("stint"), choose(F.col("lap") / 3, fq.DRY).alias("compound"), F.col("lap").alias("tyre_age"),
        choose(n, ["1"] * 9 + ["12"]).alias("track_status"), (n % 17 != 0).alias("is_accurate"), (n % 23 == 0).alias("deleted"), F.when(F.col("event_type") == "purchase", F.col("t")).alias("pit_in"), F.lit(None).cast("double").alias("pit_out"),
        F.row_number().over(order).cast("double").alias("position"), *[(26 + F.col("value") / 30 + (n % k) / 10).alias(f"s{i}") for i, k in ((1, 3), (2, 5), (3, 7))], (n % 5).cast("double").alias("gap_s"))
    # places are by sums of doubles, so these are summed in the order of the events, as the table has them
    key = ["year", "round", "session", "driver", "team"]
    summed = sessions.withColumn("sum", F.sum("value").over(Window.partitionBy(*key).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)))
    per = summed.groupBy(*key).agg(F.max_by("sum", "event_id").alias("v"), F.min("value").alias("best"), F.min("event_id").alias("n"))
    place = lambda c: F.row_number().over(Window.partitionBy("year", "round", "session").orderBy(c, "driver")).cast("double")
    status = choose(F.floor(F.col("n") / 10), ["Finished"] * 6 + ["+1 Lap", "Engine", "Collision", "Disqualified"])
    best = 80 + F.col("best") / 10
    results = per.select("year", "round", "session", "driver", "team", F.when(F.col("n") % 11 != 0, place(F.desc("v"))).alias("position"), place("n").alias("grid"), F.greatest(F.lit(0.0), 26 - place(F.desc("v"))).alias("points"), status.alias("status"), (best + 1).alias("q1"), F.when(F.col("n") % 3 > 0, best + 0.5).alias("q2"), F.when(F.col("n") % 3 > 1, best).alias("q3"), F.lit(None).cast("double").alias("time"))
    days = e.select("year", "round").distinct()
    slug = choose(F.col("round"), ["Monza", "Interlagos", "Suzuka", "Spa", "Marina Bay"])
    messages = choose(n, ["GREEN", "SAFETY CAR DEPLOYED", "VIRTUAL SAFETY CAR DEPLOYED", "RED FLAG", "START DELAYED", "YELLOW", "CLEAR"])
    measured, forecast = sessions.filter("event_type = 'view'"), sessions.filter("event_type = 'signup' and round % 3 = 0").withColumn("session", F.lit(fq.FORECAST))
    air = ["year", "round", "session", F.col("t").alias("t_s"), F.lit(None).cast("timestamp").alias("utc"), (15 + F.col("value") / 10).alias("air"), (20 + F.col("value") / 5).alias("track"), F.col("value").alias("humidity"), (F.col("value") / 20).alias("wind")]
    return {
        "laps": laps, "results": results,
        "meta": days.select("year", "round", F.concat(slug, F.lit(" Grand Prix")).alias("event"), F.lit(None).cast("string").alias("official"), slug.alias("circuit"), F.lit(None).cast("string").alias("location"), choose(F.col("round"), ["conventional", "sprint"]).alias("format")),
        "weather": measured.select(*air, (n % 7 == 0).cast("double").alias("rain"), F.lit(None).cast("double").alias("rain_prob")).unionByName(forecast.select(*air, F.lit(None).cast("double").alias("rain"), (F.col("value") / 100).alias("rain_prob"))),
        "race_events": e.filter("event_type = 'error'").select("year", "round", (n % 5 + 1).cast("int").alias("lap"), "driver", choose(F.floor(n / 5), ["Pit exit closed", "Contact with car 4", "Yellow", "Spin at turn 3"]).alias("event")),
        "race_ctrl": e.filter("event_type = 'error'").select("year", "round", F.col("t").alias("t_s"), (n % 50 + 1).cast("int").alias("lap"), F.lit("Other").alias("category"), messages.alias("message"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("flag")),
        "track_status": e.filter("event_type = 'signup'").select("year", "round", F.col("t").alias("t_s"), choose(n, ["1", "2", "4", "6"]).alias("status"), choose(n, ["AllClear", "Yellow", "SCDeployed", "VSCDeployed"]).alias("message")),
        "session_status": e.filter("event_type = 'click'").select("year", "round", F.col("t").alias("t_s"), choose(n, ["Started"] * 39 + ["Delayed"]).alias("status"), F.lit(None).cast("string").alias("message")),
        "telemetry": sessions.select("year", "round", "session", "driver", F.col("t").alias("t_s"), (100 + 2 * F.col("value")).alias("speed"), F.col("value").alias("throttle"), (F.col("value") < 20).cast("double").alias("brake"), (n % 14).cast("double").alias("drs"), (n % 8).cast("double").alias("gear"), (8000 + 40 * F.col("value")).alias("rpm")),
        "pit_stops": laps.filter("session = 'R' and pit_in is not null").select("year", "round", "driver", "lap", (2 + F.col("gap_s")).alias("seconds")),
    }


def context(spark: SparkSession, sf_dir: str) -> fq.Context:
    t = tables(spark, sf_dir)
    people = t["laps"].groupBy("year", "round", "driver").agg(F.max("team").alias("team"))
    return fq.Context(t, people.select("year", "round").distinct(), people)


def _bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tidy(fq.FEATURES[name](context(spark, sf_dir)))


QUERIES.update({f"weekend_{name}": _bound(name) for name in fq.FEATURES})

_PEOPLE = """e AS (SELECT event_id, year(ts)::BIGINT AS year, dayofyear(ts)::BIGINT AS round, 'D' || user_id AS driver, 'T' || (user_id % 40) AS team, value,
  ['R', 'R', 'R', 'Q', 'Q', 'FP1', 'FP2', 'FP2', 'FP3', 'SQ'][event_id % 10 + 1] AS session FROM events),
people AS (SELECT year, round, driver, max(team) AS team FROM e GROUP BY 1, 2, 3),
per AS (SELECT year, round, session, driver, team, sum(value) AS v, min(value) AS best, min(event_id) AS n FROM e GROUP BY 1, 2, 3, 4, 5),
res AS (SELECT *, CASE WHEN n % 11 <> 0 THEN row_number() OVER (PARTITION BY year, round, session ORDER BY v DESC, driver) END AS position, row_number() OVER (PARTITION BY year, round, session ORDER BY n, driver) AS grid,
  greatest(0, 26 - row_number() OVER (PARTITION BY year, round, session ORDER BY v DESC, driver)) AS points, n // 10 % 10 IN (7, 8, 9) AS odd, n // 10 % 10 IN (7, 8) AS dnf FROM per),
seen AS (SELECT c.year AS cy, c.round AS cr, p.year, p.round, c.o - p.o AS age FROM (SELECT *, row_number() OVER (ORDER BY year, round) AS o FROM (SELECT DISTINCT year, round FROM people)) c
  JOIN (SELECT *, row_number() OVER (ORDER BY year, round) AS o FROM (SELECT DISTINCT year, round FROM people)) p ON p.o < c.o AND p.o >= c.o - 10),
h AS (SELECT res.*, cy, cr FROM res JOIN seen USING (year, round) WHERE session = 'R')"""

SQL["weekend_results_target"] = f"""WITH {_PEOPLE} SELECT year, round, driver, position::DOUBLE AS finish_position, ['Finished', 'Finished', 'Finished', 'Finished', 'Finished', 'Finished', '+1 Lap', 'Engine', 'Collision', 'Disqualified'][n // 10 % 10 + 1] AS "Status",
  points::DOUBLE AS "Points", grid::DOUBLE AS "GridPosition", NULL::DOUBLE AS "Time" FROM res WHERE session = 'R'"""

SQL["weekend_driver_team_priors_pre"] = f"""WITH {_PEOPLE},
d AS (SELECT cy AS year, cr AS round, driver, count(*) AS n, quantile_cont(position, 0.5) AS p50, CASE WHEN count(position) > 0 THEN avg(coalesce(position <= 10, false)::INT) END AS top10, avg(dnf::INT) AS dnf, avg(points) AS pts,
  CASE WHEN count(position) >= 2 THEN quantile_cont(position, 0.75) - quantile_cont(position, 0.25) END AS iqr, quantile_cont(grid, 0.5) AS grid, max(year * 1000 + round) AS last FROM h GROUP BY 1, 2, 3),
t AS (SELECT cy AS year, cr AS round, team, count(*) AS n, quantile_cont(position, 0.5) AS p50, CASE WHEN count(position) > 0 THEN avg(coalesce(position <= 10, false)::INT) END AS top10, avg(dnf::INT) AS dnf, avg(points) AS pts FROM h GROUP BY 1, 2, 3)
SELECT year, round, driver, team AS "Team", d.n::BIGINT AS driver_team_pre_driver_hist_n, round(d.p50, 6) AS driver_team_pre_driver_finish_p50, round(d.top10, 6) AS driver_team_pre_driver_top10_rate, round(d.dnf, 6) AS driver_team_pre_driver_dnf_rate,
  round(d.pts, 6) AS driver_team_pre_driver_points_mean, round(d.iqr, 6) AS driver_team_pre_driver_finish_iqr, round(d.grid, 6) AS driver_team_pre_driver_grid_p50, (last // 1000)::BIGINT AS driver_team_pre_last_seen_year, (last % 1000)::BIGINT AS driver_team_pre_last_seen_round,
  t.n::BIGINT AS driver_team_pre_team_hist_n, round(t.p50, 6) AS driver_team_pre_team_finish_p50, round(t.top10, 6) AS driver_team_pre_team_top10_rate, round(t.dnf, 6) AS driver_team_pre_team_dnf_rate, round(t.pts, 6) AS driver_team_pre_team_points_mean
FROM people LEFT JOIN d USING (year, round, driver) LEFT JOIN t USING (year, round, team)"""
