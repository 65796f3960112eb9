"""The query catalogue, third part: weekends exported as one file a round and session, and read back as canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import weekend
from ..sources.files import scratch_path, write_events
from . import features as fq
from . import jobs, weekends
from .registry import SQL, query, tidy
from .weekend_sql import _TABLES


def _exported(spark: SparkSession, d: str, *names: str) -> str:
    """A folder with the weekends' laps, results or weather as files of the source's shape: laps of practice with lap times in
    milliseconds, those of other sessions with durations; results with names of their own."""
    folder, t = scratch_path(spark, "weekend-files"), weekends.tables(spark, d)
    said = lambda c: text.duration_text(F.col(c))
    laps = t["laps"]
    kept = [F.col("lap").alias("LapNumber"), F.col("compound").alias("Compound"), F.col("stint").alias("Stint"), F.col("tyre_age").alias("TyreLife"), F.col("track_status").alias("TrackStatus"), F.col("is_accurate").alias("IsAccurate"), said("pit_in").alias("PitInTime")]
    key = ["year", "round", "session"]
    if "laps" in names:
        write_events(laps.filter("session not like 'FP%'").select(*key, F.col("driver").alias("Driver"), F.col("team").alias("Team"), said("lap_s").alias("LapTime"), said("time_s").alias("Time"), *kept), folder, "laps")
        write_events(laps.filter("session like 'FP%'").select(*key, *kept, (F.col("lap_s") * 1000).alias("milliseconds"), F.col("driver").alias("Abbreviation"), F.col("team").alias("TeamName")), folder, "laps")
    if "results" in names:
        write_events(t["results"].select(*key, F.col("driver").alias("Abbreviation"), F.col("team").alias("TeamName"), F.col("position").alias("Position"), F.col("grid").alias("GridPosition"), F.col("points").alias("Points"), F.col("status").alias("Status"), *[said(c).alias(c.upper()) for c in ("q1", "q2", "q3")]), folder, "results")
    if "weather" in names:
        weather = t["weather"].filter("session <> 'FC'")
        write_events(weather.select(*key, said("t_s").alias("Time"), F.col("air").alias("AirTemp"), F.col("track").alias("TrackTemp"), F.col("humidity").alias("Humidity"), F.col("wind").alias("WindSpeed"), F.when(F.col("rain") > 0, "True").otherwise("False").alias("Rainfall")), folder, "weather")
    return folder


def _third(c: str) -> Column:
    """Thousandths, rounded as SQL rounds doubles (see ``tidy``)."""
    return (F.round(F.col(c) * 1000) / 1000).alias(c)


@query(f"""WITH {_TABLES} SELECT year, round, session, driver, team, lap::BIGINT AS lap, round(lap_s, 3) AS lap_s, CASE WHEN session NOT LIKE 'FP%' THEN round(t, 3) END AS time_s, stint::BIGINT AS stint, compound, CASE WHEN caution THEN '12' ELSE '1' END AS track_status, accurate AS is_accurate, CASE WHEN pit THEN round(t, 3) END AS pit_in FROM laps""")
def files_laps(spark: SparkSession, d: str) -> DataFrame:
    """Laps that were exported and read back: durations and milliseconds both become seconds."""
    rows = weekend.laps(spark, _exported(spark, d, "laps"))
    return tidy(rows.select("year", "round", "session", "driver", "team", "lap", _third("lap_s"), _third("time_s"), "stint", "compound", "track_status", "is_accurate", _third("pit_in")))


@query(f"""WITH {_TABLES} SELECT year, round, session, count(*)::BIGINT AS n, round(avg(15 + v / 10), 6) AS air, round(avg(v / 20), 6) AS wind, round(avg((n % 7 = 0)::INT), 6) AS rain, round(min(t), 6) AS first, round(max(t), 6) AS last FROM ses WHERE kind = 'view' GROUP BY year, round, session""")
def files_weather(spark: SparkSession, d: str) -> DataFrame:
    rows = weekend.weather(spark, _exported(spark, d, "weather"))
    return tidy(rows.groupBy("year", "round", "session").agg(F.count("*").alias("n"), F.avg("air").alias("air"), F.avg("wind").alias("wind"), F.avg("rain").alias("rain"), F.min("t_s").alias("first"), F.max("t_s").alias("last")))


@query(f"""WITH {_TABLES} SELECT year, round, session, driver, team, position, grid, points::DOUBLE AS points, ['Finished', 'Finished', 'Finished', 'Finished', 'Finished', 'Finished', '+1 Lap', 'Engine', 'Collision', 'Disqualified'][n // 10 % 10 + 1] AS status, round(q1, 3) AS q1, round(q2, 3) AS q2, round(q3, 3) AS q3 FROM results""")
def files_results(spark: SparkSession, d: str) -> DataFrame:
    rows = weekend.results(spark, _exported(spark, d, "results"))
    return tidy(rows.select("year", "round", "session", "driver", "team", "position", "grid", "points", "status", *[_third(c) for c in ("q1", "q2", "q3")]))


_ROSTER = f"""WITH {_TABLES}, hq AS (SELECT *, bool_or(session = 'Q') OVER (PARTITION BY year, round) AS has_q FROM ev)
SELECT year, round, driver, max(team) AS team FROM hq WHERE (has_q AND session = 'Q') OR (NOT has_q AND session <> 'R') GROUP BY year, round, driver"""


@query(_ROSTER)
def files_roster(spark: SparkSession, d: str) -> DataFrame:
    """Who a weekend's files say takes part: the results of its qualifying, else its practice laps."""
    folder = _exported(spark, d, "laps", "results")
    tables = {"results": weekend.results(spark, folder), "laps": weekend.laps(spark, folder), "entries": weekend.entries(spark, folder)}
    return tidy(fq.roster_of(tables, tables["laps"].select("year", "round").distinct()))


_BUILT = " JOIN ".join(f"({SQL[f'weekend_{n}']}) {a}" + ("" if a == "a" else " USING (year, round, driver)") for a, n in (("a", "driver_team_priors_pre"), ("b", "quali_priors_pre")))


@query(f"""SELECT x.* FROM (SELECT * FROM {_BUILT}) x JOIN ({_ROSTER}) r USING (year, round, driver)""")
def files_built_features(spark: SparkSession, d: str) -> DataFrame:
    """From files to features: exported, ingested as canonical tables, and built round by round for who takes part."""
    path, out = scratch_path(spark, "weekend-store"), scratch_path(spark, "weekend-built")
    jobs.ingest(spark, _exported(spark, d, "laps", "results"), path)
    return tidy(jobs.build_features(spark, path, out, names=["driver_team_priors_pre", "quali_priors_pre"]).drop("scenario_mode"))
