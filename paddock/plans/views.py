"""The roles of the queries, bound to the tables, once for Spark and once as SQL.

results: a driver (customer) of a team (nation) in a round (month of a year), with a position by price, a grid by order
number, points and status; a third of the positions are null. laps: a user's events of a day, in order of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import table


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("r"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("team"))
    race = Window.partitionBy("y", "r")
    return o.join(c, "o_custkey").select(
        "y", "r", F.col("o_custkey").alias("driver"), "team", F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderstatus") != "P", F.row_number().over(race.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")).alias("pos"),
        F.row_number().over(race.orderBy("o_orderkey")).cast("long").alias("grid"), F.col("o_totalprice").alias("points"), F.col("o_orderstatus").alias("status"))


RES = """res AS (SELECT year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS r, o_custkey AS driver, c_nationkey::BIGINT AS team, o_orderkey AS k,
  CASE WHEN o_orderstatus <> 'P' THEN row_number() OVER (PARTITION BY year(o_orderdate), month(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) END AS pos,
  row_number() OVER (PARTITION BY year(o_orderdate), month(o_orderdate) ORDER BY o_orderkey) AS grid, o_totalprice AS points, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

#: The rounds in time, and what each sees of the {n} before it.
SEEN = """rounds AS (SELECT y, r, row_number() OVER (ORDER BY y, r) AS ord FROM (SELECT DISTINCT y, r FROM res)),
seen AS (SELECT c.y AS cut_y, c.r AS cut_r, c.ord - p.ord AS age, p.y, p.r FROM rounds c JOIN rounds p ON p.ord < c.ord AND p.ord >= c.ord - {n}),
hist AS (SELECT res.*, cut_y, cut_r, age FROM res JOIN seen USING (y, r))"""


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("driver"), F.dayofmonth("ts").cast("long").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("code"), F.col("value").alias("x"))


LAPS = "laps AS (SELECT event_id, user_id AS driver, day(ts)::BIGINT AS day, epoch_us(ts)::BIGINT AS us, event_type AS code, value AS x FROM events)"
