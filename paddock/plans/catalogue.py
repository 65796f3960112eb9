"""The query catalogue: each operator applied to whole tables, with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns, text
from ..operators import audit, joins, lookback, pivots, scoring, stats, telemetry, windows
from .registry import query, table, tidy
from .views import LAPS, RES, SEEN, laps, results

DRIVER = ["cut_y", "cut_r", "driver"]
CODES = ["click", "error", "purchase", "signup", "view"]
_CODES = ", ".join(f"'{c}'" for c in CODES)


# --- look-back and history -------------------------------------------------------------------------------------------


def _round_points(res: DataFrame) -> DataFrame:
    """A driver's points by round: their total, how many are known, and the rows. A driver has a calendar's rounds at most."""
    return res.groupBy("driver", "y", "r").agg(F.sum("points").alias("total"), F.count("points").alias("known"), F.count("*").alias("rows"))


@query(f"""WITH {RES}, {SEEN.format(n=10)}
SELECT c.y AS cut_y, c.r AS cut_r, c.driver, coalesce(count(h.k), 0)::BIGINT AS hist_n, round(quantile_cont(h.pos, 0.5), 6) AS finish_p50,
  round(CASE WHEN count(h.pos) >= 2 THEN quantile_cont(h.pos, 0.75) - quantile_cont(h.pos, 0.25) END, 6) AS finish_iqr,
  round(CASE WHEN count(h.pos) > 0 THEN avg(coalesce(h.pos <= 10, false)::INT) FILTER (WHERE h.k IS NOT NULL) END, 6) AS top10_rate,
  round(avg((h.status = 'O')::INT), 6) AS dnf_rate, round(quantile_cont(h.grid, 0.5), 6) AS grid_p50, round(avg(h.points), 6) AS points_mean
FROM (SELECT DISTINCT y, r, driver FROM res) c LEFT JOIN hist h ON h.cut_y = c.y AND h.cut_r = c.r AND h.driver = c.driver GROUP BY 1, 2, 3""")
def asof_entity_priors(spark: SparkSession, d: str) -> DataFrame:
    past = F.col("age") > 0
    rows = lookback.own_history(results(spark, d), ["driver"], 10).select(*DRIVER, past.alias("past"), *[F.when(past, F.col(c)).alias(c) for c in ("pos", "status", "grid", "points")])
    share = lambda c: F.avg(F.when(F.col("past"), F.coalesce(c, F.lit(False)).cast("int")))
    seen = rows.groupBy(*DRIVER).agg(
        F.count_if("past").alias("hist_n"), stats.quartiles("pos").alias("q"), F.count("pos").alias("known"), F.when(F.count("pos") > 0, share(F.col("pos") <= 10)).alias("top10_rate"),
        share(F.col("status") == "O").alias("dnf_rate"), stats.percentile("grid", 0.5).alias("grid_p50"), F.avg("points").alias("points_mean"))
    return tidy(seen.withColumns({"finish_p50": F.col("q")[1], "finish_iqr": F.when(F.col("known") >= 2, F.col("q")[2] - F.col("q")[0])}).drop("q", "known"))


@query(f"""WITH {RES}, {SEEN.format(n=10)}
SELECT cut_y, cut_r, team, count(*)::BIGINT AS hist_n, round(quantile_cont(pos, 0.5), 6) AS finish_p50,
  round(CASE WHEN count(pos) > 0 THEN avg(coalesce(pos <= 10, false)::INT) END, 6) AS top10_rate, round(sum(points), 2) / count(*) AS points_mean FROM hist GROUP BY 1, 2, 3""")
def asof_team_priors(spark: SparkSession, d: str) -> DataFrame:
    seen = lookback.history(results(spark, d), 10)
    out = seen.groupBy("cut_y", "cut_r", "team").agg(F.count("*").alias("hist_n"), stats.percentile("pos", 0.5).alias("finish_p50"), stats.rate(F.col("pos") <= 10, F.col("pos")).alias("top10_rate"), F.sum("points").alias("sum"))
    # sums of cents are exact once rounded, so the mean needs no rounding
    return tidy(out).withColumn("points_mean", F.round("sum", 2) / F.col("hist_n")).drop("sum")


@query(f"""WITH {RES}, {SEEN.format(n=30)} SELECT cut_y, cut_r, driver, arg_max(y, y * 100 + r)::BIGINT AS last_y, arg_max(r, y * 100 + r)::BIGINT AS last_r FROM hist GROUP BY 1, 2, 3""")
def last_seen_lexicographic(spark: SparkSession, d: str) -> DataFrame:
    last = F.element_at("seen", -1)
    return lookback.rounds_seen(results(spark, d), ["driver"], 30).select(*DRIVER, last["y"].alias("last_y"), last["r"].alias("last_r"))


@query(f"""WITH {RES}, {SEEN.format(n=30)} SELECT cut_y, cut_r, driver, max(y)::BIGINT AS last_y, max(r)::BIGINT AS last_r FROM hist GROUP BY 1, 2, 3""")
def last_seen_independent(spark: SparkSession, d: str) -> DataFrame:
    return lookback.rounds_seen(results(spark, d), ["driver"], 30).select(*DRIVER, F.array_max("seen.y").alias("last_y"), F.array_max("seen.r").alias("last_r"))


@query(f"""WITH {RES}, {SEEN.format(n=10)} SELECT cut_y, cut_r, driver, arg_max(team, (y * 100 + r)::HUGEINT * 1000000000 + k) AS last_team FROM hist GROUP BY 1, 2, 3""")
def last_known_team(spark: SparkSession, d: str) -> DataFrame:
    ends = lookback.latest(results(spark, d), ["driver", "y", "r"], "team", ["k"])
    own = Window.partitionBy("driver").orderBy("y", "r")
    seen = lookback.history(ends.withColumns({"next_y": F.lead("y").over(own), "next_r": F.lead("r").over(own)}), 10)
    # a round is the last that a cut-off sees until the driver's next one is before the cut-off, so no copies need to be grouped
    last = seen.filter(F.col("next_y").isNull() | ~lookback.before(F.col("next_y"), F.col("next_r"), F.col("cut_y"), F.col("cut_r")))
    return last.select(*DRIVER, F.col("team").alias("last_team"))


@query(f"""WITH {RES} SELECT driver, k, y, r FROM (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY y DESC, r DESC, k DESC) AS n FROM res) WHERE n <= 8""")
def last_n_rows_per_key(spark: SparkSession, d: str) -> DataFrame:
    return lookback.last_rows(results(spark, d), ["driver"], [F.desc("y"), F.desc("r"), F.desc("k")], 8).select("driver", "k", "y", "r")


@query(f"""WITH {RES}, {SEEN.format(n=12)}, m AS (SELECT *, count_if(r = cut_r) OVER (PARTITION BY cut_y, cut_r, driver) >= 1 AS e FROM hist)
SELECT cut_y, cut_r, driver, count(*)::BIGINT AS n, round(avg(points), 6) AS points_mean FROM m WHERE (e AND r = cut_r) OR (NOT e AND age <= 8) GROUP BY 1, 2, 3""")
def same_else_recent(spark: SparkSession, d: str) -> DataFrame:
    seen = lookback.history(_round_points(results(spark, d)), 12, by=["driver"])
    cut = ["driver", "cut_y", "cut_r"]
    used = lookback.prefer_same(seen, cut, F.col("r") == F.col("cut_r"), 1, F.col("age") <= 8)
    # summed where they are sorted already; a driver has a round once, so one of a cut-off's rows is the latest
    over = lambda c: c.over(Window.partitionBy(*cut))
    summed = used.select(*DRIVER, "age", over(F.min("age")).alias("latest"), over(F.sum("rows")).alias("n"), F.try_divide(over(F.sum("total")), over(F.sum("known"))).alias("points_mean"))
    return tidy(summed.filter("age = latest").drop("age", "latest"))


@query(f"""WITH {RES}, {SEEN.format(n=24)} SELECT cut_y, cut_r, driver, count(*)::BIGINT AS same_n, round(quantile_cont(pos, 0.5), 6) AS finish_p50, min(pos)::BIGINT AS best
FROM hist WHERE list_has_any([r % 6, 100 + r % 4], [cut_r % 6, 100 + cut_r % 4]) GROUP BY 1, 2, 3""")
def same_key_history(spark: SparkSession, d: str) -> DataFrame:
    keys = lambda r: F.array(F.col(r) % 6, F.col(r) % 4 + 100)
    same = lookback.history(results(spark, d), 24).filter(F.arrays_overlap(keys("r"), keys("cut_r")))
    return tidy(same.groupBy(*DRIVER).agg(F.count("*").alias("same_n"), stats.percentile("pos", 0.5).alias("finish_p50"), F.min("pos").alias("best")))


@query(f"""WITH {RES}, a AS (SELECT y, r, driver, 0 AS p FROM res WHERE status = 'F' AND r <= 4), b AS (SELECT y, r, driver, 1 AS p FROM res WHERE status = 'O' AND r <= 8), c AS (SELECT y, r, driver, 2 AS p FROM res),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), m AS (SELECT *, min(p) OVER (PARTITION BY y, r) AS b FROM u)
SELECT y, r, driver, count(*)::BIGINT AS n FROM m WHERE p = b GROUP BY 1, 2, 3""")
def fallback_roster(spark: SparkSession, d: str) -> DataFrame:
    res = results(spark, d).select("y", "r", "driver", "status")
    sources = [res.filter("status = 'F' and r <= 4"), res.filter("status = 'O' and r <= 8"), res]
    return lookback.first_available(sources, ["y", "r"]).groupBy("y", "r", "driver").agg(F.count("*").alias("n"))


# --- robust and weighted statistics ----------------------------------------------------------------------------------


@query(f"""WITH {LAPS}, a AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY driver, day) AS m, count(x) OVER (PARTITION BY driver, day) AS n FROM laps),
b AS (SELECT *, quantile_cont(abs(x - m), 0.5) OVER (PARTITION BY driver, day) AS d FROM a)
SELECT driver, day, round(avg((CASE WHEN n < 3 THEN true WHEN d = 0 THEN x <= m ELSE (x - m) / d > -3 AND (x - m) / d < 2 END)::INT), 6) AS clean_share FROM b GROUP BY 1, 2""")
def mad_clean_share(spark: SparkSession, d: str) -> DataFrame:
    marked = stats.mad_clean(laps(spark, d), ["driver", "day"], "x")
    return tidy(marked.groupBy("driver", "day").agg(F.avg(F.col("clean").cast("int")).alias("clean_share")))


@query(f"""WITH {LAPS}, a AS (SELECT *, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.75) OVER w AS q3, count(x) OVER w AS n FROM laps WINDOW w AS (PARTITION BY driver, day))
SELECT driver, day, round(avg((n < 3 OR x <= q3 + 2 * (q3 - q1))::INT), 6) AS clean_share FROM a GROUP BY 1, 2""")
def tukey_clean_share(spark: SparkSession, d: str) -> DataFrame:
    marked = stats.tukey_clean(laps(spark, d), ["driver", "day"], "x")
    return tidy(marked.groupBy("driver", "day").agg(F.avg(F.col("clean").cast("int")).alias("clean_share")))


@query(f"""WITH {LAPS}, a AS (SELECT *, quantile_cont(x, 0.05) OVER w AS lo, quantile_cont(x, 0.95) OVER w AS hi FROM laps WINDOW w AS (PARTITION BY driver))
SELECT driver, round(quantile_cont(x, 0.5), 6) AS trimmed_median FROM a WHERE x BETWEEN lo AND hi GROUP BY 1""")
def trimmed_median(spark: SparkSession, d: str) -> DataFrame:
    return tidy(stats.trimmed_median(laps(spark, d), ["driver"], "x"))


@query(f"""WITH {LAPS} SELECT driver, code, round(CASE WHEN quantile_cont(x, 0.75) > quantile_cont(x, 0.25) THEN (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.35 ELSE stddev_pop(x) END, 6) AS sigma FROM laps GROUP BY 1, 2""")
def robust_sigma_iqr(spark: SparkSession, d: str) -> DataFrame:
    return tidy(laps(spark, d).groupBy("driver", "code").agg(stats.robust_sigma("x").alias("sigma")))


@query(f"""WITH {LAPS}, a AS (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY x, event_id) AS n FROM laps) SELECT driver, round(avg(x), 6) AS best_mean FROM a WHERE n <= 10 GROUP BY 1""")
def best_n_mean(spark: SparkSession, d: str) -> DataFrame:
    return tidy(stats.best_n_mean(laps(spark, d), ["driver"], "x", [F.col("event_id")]))


@query(f"""WITH {LAPS} SELECT event_id, round(x - quantile_cont(x, 0.5) OVER (PARTITION BY day), 6) AS x_rel FROM laps""")
def median_detrend(spark: SparkSession, d: str) -> DataFrame:
    return tidy(stats.detrend(laps(spark, d), ["day"], "x", "x_rel").select("event_id", "x_rel"))


@query(f"""WITH {LAPS}, a AS (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s FROM laps WINDOW w AS (PARTITION BY driver, day)) SELECT event_id, round(CASE WHEN s > 0 THEN -(x - m) / s ELSE 0 END, 6) AS z FROM a""")
def zscore_sample(spark: SparkSession, d: str) -> DataFrame:
    return tidy(laps(spark, d).select("event_id", stats.zscore("x", ["driver", "day"], sign=-1).alias("z")))


@query(f"""WITH {LAPS}, a AS (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM laps WINDOW w AS (PARTITION BY code, day)) SELECT event_id, round(CASE WHEN s > 0 THEN -(x - m) / s ELSE 0 END, 6) AS z FROM a""")
def zscore_pop_inv(spark: SparkSession, d: str) -> DataFrame:
    return tidy(stats.with_zscore(laps(spark, d), ["code", "day"], "x", "z", sample=False, sign=-1).select("event_id", "z"))


@query(f"""WITH {LAPS}, a AS (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY us, event_id)::DOUBLE AS i FROM laps) SELECT driver, round(coalesce(CASE WHEN count(x) >= 2 THEN regr_slope(x, i) END, 0), 6) AS slope FROM a GROUP BY 1""")
def trend_slope_all(spark: SparkSession, d: str) -> DataFrame:
    return tidy(stats.trend(laps(spark, d), ["driver"], "x", ["us", "event_id"]))


@query(f"""WITH {LAPS}, a AS (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY us DESC, event_id DESC) AS n, row_number() OVER (PARTITION BY driver ORDER BY us, event_id)::DOUBLE AS i FROM laps)
SELECT driver, round(CASE WHEN count(x) >= 3 THEN regr_slope(x, i) END, 6) AS slope FROM a WHERE n <= 6 GROUP BY 1""")
def trend_slope_last_k(spark: SparkSession, d: str) -> DataFrame:
    return tidy(stats.trend(laps(spark, d), ["driver"], "x", ["us", "event_id"], last=6, least=3, short=None))


@query(f"""WITH {LAPS}, p AS (SELECT *, day::DOUBLE AS age FROM laps), a AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY driver, code) AS m FROM p), b AS (SELECT *, 1.4826 * quantile_cont(abs(x - m), 0.5) OVER (PARTITION BY driver, code) AS s FROM a)
SELECT driver, code, round(CASE WHEN count(x) >= 4 AND count(DISTINCT age) >= 3 AND var_pop(age) > 1e-9 THEN regr_slope(x, age) END + 1e-9, 6) AS slope FROM b WHERE s = 0 OR abs(x - m) <= 4 * s GROUP BY 1, 2""")
def robust_slope(spark: SparkSession, d: str) -> DataFrame:
    return stats.robust_slope(laps(spark, d).withColumn("age", F.col("day").cast("double")), ["driver", "code"], "age", "x").withColumn("slope", F.round(F.col("slope") + 1e-9, 6))


@query(f"""WITH {LAPS}, s AS (SELECT driver, day, avg((x > 50)::INT) - 0.5 AS v, count(*) * 4 AS n FROM laps GROUP BY 1, 2), a AS (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY day DESC) - 1 AS age FROM s),
w AS (SELECT *, CASE WHEN n >= 8 THEN least(greatest(n, 0), 200) * exp(-0.35 * age) END AS w FROM a)
SELECT driver, round(least(greatest(sum(w * least(greatest(v, -0.5), 0.5)) / sum(w), -0.3), 0.3), 6) AS share FROM w GROUP BY 1""")
def recency_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    days = laps(spark, d).groupBy("driver", "day").agg((F.avg((F.col("x") > 50).cast("int")) - 0.5).alias("v"), (F.count("*") * 4).alias("n"))
    aged = days.withColumn("age", F.row_number().over(Window.partitionBy("driver").orderBy(F.desc("day"))) - 1)
    mean = stats.weighted_mean(stats.clip(F.col("v"), -0.5, 0.5), stats.recency_weight(F.col("age"), F.col("n")))
    return tidy(aged.groupBy("driver").agg(stats.clip(mean, -0.3, 0.3).alias("share")))


@query(f"""WITH {RES}, {SEEN.format(n=10)}, z AS (SELECT *, 1 + 0.5 * (r % 3 = cut_r % 3)::INT AS w FROM hist) SELECT cut_y, cut_r, driver, round(coalesce(sum(w * pos), 0) / sum(w), 6) AS weighted FROM z GROUP BY 1, 2, 3""")
def same_group_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    seen = lookback.rounds_seen(results(spark, d), ["driver"], 10, total=F.coalesce(F.sum("pos"), F.lit(0)), rows=F.count("*"))
    w = lambda x: 1 + 0.5 * (x["r"] % 3 == F.col("cut_r") % 3).cast("int")
    summed = lambda c: F.aggregate("seen", F.lit(0.0), lambda a, x: a + w(x) * x[c])
    return tidy(seen.select(*DRIVER, (summed("total") / summed("rows")).alias("weighted")))


@query(f"""WITH {RES}, a AS (SELECT driver, count(pos) AS n, quantile_cont(pos, 0.5) AS p50, avg((status = 'O')::INT) AS rate FROM res GROUP BY 1), b AS (SELECT quantile_cont(p50, 0.5) AS bp, avg(rate) AS br FROM a)
SELECT driver, round((n * p50 + 3 * bp) / (n + 3), 6) AS finish, round((n * rate + 6 * br) / (n + 6), 6) AS retire FROM a, b""")
def eb_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    own = results(spark, d).groupBy("driver").agg(F.count("pos").alias("n"), stats.percentile("pos", 0.5).alias("p50"), stats.rate(F.col("status") == "O").alias("rate"))
    base = own.agg(stats.percentile("p50", 0.5).alias("bp"), F.avg("rate").alias("br"))
    both = own.join(F.broadcast(base))
    return tidy(both.select("driver", stats.shrink(F.col("p50"), F.col("n"), F.col("bp"), 3).alias("finish"), stats.shrink(F.col("rate"), F.col("n"), F.col("br"), 6).alias("retire")))


@query(f"""WITH {RES}, {SEEN.format(n=10)}, a AS (SELECT cut_y, cut_r, driver, avg(points) FILTER (WHERE r % 4 = cut_r % 4) AS same, count(*) FILTER (WHERE r % 4 = cut_r % 4) AS n, avg(points) FILTER (WHERE age <= 8) AS recent FROM hist GROUP BY 1, 2, 3)
SELECT cut_y, cut_r, driver, round(CASE WHEN same IS NULL THEN recent WHEN recent IS NULL THEN same ELSE least(n / 3.0, 1) * same + (1 - least(n / 3.0, 1)) * recent END, 6) AS blended FROM a""")
def blend_same_recent(spark: SparkSession, d: str) -> DataFrame:
    same = F.col("r") % 4 == F.col("cut_r") % 4
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("total"))), F.sum(F.when(c, F.col("known"))))
    seen = lookback.history(_round_points(results(spark, d)), 10, by=["driver"], spread=4)
    a = seen.groupBy(*DRIVER).agg(mean(same).alias("same"), F.sum(F.when(same, F.col("rows"))).alias("n"), mean(F.col("age") <= 8).alias("recent"))
    return tidy(a.select(*DRIVER, stats.blend(F.col("same"), F.col("recent"), F.col("n")).alias("blended")))


@query(f"""WITH {RES} SELECT k, round(avg((status = 'O')::INT) OVER (PARTITION BY driver ORDER BY y, r, k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS prev10,
  round(avg((status = 'O')::INT) OVER (PARTITION BY driver, y ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS season FROM res""")
def rolling10_lagged_rate(spark: SparkSession, d: str) -> DataFrame:
    dnf = (F.col("status") == "O").cast("int")
    season = F.avg(dnf).over(Window.partitionBy("driver", "y").orderBy("r").rangeBetween(Window.unboundedPreceding, -1))
    return tidy(results(spark, d).select("k", windows.rolling(dnf, ["driver"], ["y", "r", "k"], -10, -1).alias("prev10"), season.alias("season")))


@query(f"""WITH {RES}, {SEEN.format(n=12)} SELECT cut_y, cut_r, driver, round(avg((status = 'O')::INT), 6) AS rate FROM hist WHERE y = cut_y GROUP BY 1, 2, 3""")
def season_to_date_rate(spark: SparkSession, d: str) -> DataFrame:
    return tidy(lookback.history(results(spark, d), 12).filter("y = cut_y").groupBy(*DRIVER).agg(stats.rate(F.col("status") == "O").alias("rate")))


@query(f"""WITH {LAPS}, a AS (SELECT driver, day, avg(x) OVER w AS m, count(x) OVER w AS n FROM laps WINDOW w AS (PARTITION BY driver, day ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT driver, day, round(min(m) FILTER (WHERE n = 3), 6) AS best3 FROM a GROUP BY 1, 2""")
def rolling3_min(spark: SparkSession, d: str) -> DataFrame:
    frame = Window.partitionBy("driver", "day").orderBy("us", "event_id").rowsBetween(-2, 0)
    rows = laps(spark, d).select("driver", "day", windows.rolling(F.col("x"), ["driver", "day"], ["us", "event_id"], -2, 0).alias("m"), F.count("x").over(frame).alias("n"))
    return tidy(rows.groupBy("driver", "day").agg(F.min(F.when(F.col("n") == 3, F.col("m"))).alias("best3")))


# --- runs, states, intervals -----------------------------------------------------------------------------------------


@query(f"""WITH {LAPS} SELECT event_id, last_value(nullif(code, 'view') IGNORE NULLS) OVER (PARTITION BY driver ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS code FROM laps""")
def ffill_code(spark: SparkSession, d: str) -> DataFrame:
    rows = laps(spark, d).withColumn("c", F.nullif("code", F.lit("view")))
    return rows.select("event_id", windows.ffill("c", ["driver"], ["us", "event_id"]).alias("code"))


_STINTS = f"""{LAPS}, a AS (SELECT *, lag(code) OVER (PARTITION BY driver ORDER BY us, event_id) AS p FROM laps), st AS (SELECT *, sum((p IS NULL OR p <> code)::INT) OVER (PARTITION BY driver ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS stint FROM a)"""


@query(f"""WITH {_STINTS} SELECT event_id, stint, row_number() OVER (PARTITION BY driver, stint ORDER BY us, event_id) AS stint_age FROM st""")
def stint_ids(spark: SparkSession, d: str) -> DataFrame:
    return tidy(windows.stints(laps(spark, d), "code", ["driver"], ["us", "event_id"], fill=False).select("event_id", "stint", "stint_age"))


@query(f"""WITH {_STINTS} SELECT driver, stint, code, count(*)::BIGINT AS laps, round(quantile_cont(x, 0.5), 6) AS pace FROM st GROUP BY 1, 2, 3""")
def stint_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.stints(laps(spark, d), "code", ["driver"], ["us", "event_id"], fill=False)
    return tidy(rows.groupBy("driver", "stint", "code").agg(F.count("*").alias("laps"), stats.percentile("x", 0.5).alias("pace")))


@query(f"""WITH {_STINTS} SELECT driver, max(stint) - 1 AS stops, count(DISTINCT day) FILTER (WHERE code = 'purchase')::BIGINT AS pit_days FROM st GROUP BY 1""")
def stop_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.stints(laps(spark, d), "code", ["driver"], ["us", "event_id"], fill=False)
    return tidy(rows.groupBy("driver").agg((F.max("stint") - 1).alias("stops"), F.count_distinct(F.when(F.col("code") == "purchase", F.col("day"))).alias("pit_days")))


@query(f"""WITH {LAPS}, a AS (SELECT *, x > 50 AS f, row_number() OVER (PARTITION BY driver ORDER BY us, event_id) - row_number() OVER (PARTITION BY driver, x > 50 ORDER BY us, event_id) AS g FROM laps),
b AS (SELECT driver, f, g, count(*) AS n FROM a GROUP BY 1, 2, 3) SELECT driver, coalesce(max(n) FILTER (WHERE f), 0)::BIGINT AS longest_run FROM b GROUP BY 1""")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return tidy(windows.longest_run(laps(spark, d), F.col("x") > 50, ["driver"], ["us", "event_id"]))


@query(f"""WITH {LAPS}, a AS (SELECT *, us / 1e6 AS t FROM laps), b AS (SELECT driver, (x - lag(x) OVER w) / nullif(t - lag(t) OVER w, 0) AS v FROM a WINDOW w AS (PARTITION BY driver ORDER BY t))
SELECT driver, round(quantile_cont(v, 0.95) FILTER (WHERE v > 0), 6) AS accel_p95, round(quantile_cont(-v, 0.95) FILTER (WHERE v < 0), 6) AS decel_p95 FROM b GROUP BY 1""")
def derivative_p95(spark: SparkSession, d: str) -> DataFrame:
    rows = telemetry.derivative(laps(spark, d).withColumn("t", F.col("us") / 1e6), ["driver"], "t", "x")
    v = F.col("rate_of")
    return tidy(rows.groupBy("driver").agg(stats.percentile(F.when(v > 0, v), 0.95).alias("accel_p95"), stats.percentile(F.when(v < 0, -v), 0.95).alias("decel_p95")))


_SIGNALS = "sig AS (SELECT driver, day, us / 1e6 AS t, x * 3 AS speed, x AS throttle, (x < 20)::INT AS brake, CASE WHEN event_id % 9 > 0 THEN (event_id % 8)::INT END AS gear, (event_id % 14)::INT AS drs, 8000 + 40 * x AS rpm FROM laps)"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    x, n = F.col("x"), F.col("event_id")
    return laps(spark, d).select("driver", "day", (F.col("us") / 1e6).alias("t"), (x * 3).alias("speed"), x.alias("throttle"), (x < 20).cast("int").alias("brake"), F.when(n % 9 > 0, (n % 8).cast("int")).alias("gear"), (n % 14).cast("int").alias("drs"), (8000 + 40 * x).alias("rpm"))


_LAP_STATS = [f"{c}_{n}" for c in ("speed", "throttle", "brake", "gear", "rpm", "drs") for n in ("mean", "max", "std")]
_PER_LAP = f"""{LAPS}, {_SIGNALS}, a AS (SELECT *, (speed - lag(speed) OVER w) / nullif(t - lag(t) OVER w, 0) AS v FROM sig WINDOW w AS (PARTITION BY driver, day ORDER BY t)),
g AS (SELECT driver, day, count_if(gear IS DISTINCT FROM before) AS sh FROM (SELECT *, lag(gear) OVER (PARTITION BY driver, day ORDER BY t) AS before FROM sig WHERE gear IS NOT NULL) GROUP BY driver, day),
lp AS (SELECT driver, day, {', '.join(f"{f}({c}) AS {c}_{n}" for c in ("speed", "throttle", "brake", "gear", "rpm", "drs") for n, f in (("mean", "avg"), ("max", "max"), ("std", "stddev_samp")))},
  avg((throttle >= 90)::INT) AS throttle_p90_share, avg((brake > 0)::INT) AS brake_active_share, avg((drs > 0)::INT) AS drs_share, quantile_cont(rpm, 0.95) AS rpm_p95, quantile_cont(v, 0.95) FILTER (WHERE v > 0) AS accel_p95,
  quantile_cont(-v, 0.95) FILTER (WHERE v < 0) AS decel_p95, max(sh) / nullif(max(t) - min(t), 0) AS shift_rate_hz, count(*) AS samples FROM a LEFT JOIN g USING (driver, day) GROUP BY driver, day)"""
_LAP_RATES = ["throttle_p90_share", "brake_active_share", "drs_share", "rpm_p95", "accel_p95", "decel_p95", "shift_rate_hz"]
_WHOLE = ("brake_max", "gear_max", "drs_max")


@query(f"""WITH {_PER_LAP} SELECT driver, day, {', '.join(f"{c}::BIGINT AS {c}" if c in _WHOLE else f"round({c}, 6) AS {c}" for c in [*_LAP_STATS, *_LAP_RATES])}, samples::BIGINT AS samples FROM lp""")
def per_lap_telemetry_agg(spark: SparkSession, d: str) -> DataFrame:
    return tidy(telemetry.per_lap(_signals(spark, d), ["driver", "day"], "t", "speed", "throttle", "brake", "gear", "drs", "rpm"))


@query(f"""WITH {_PER_LAP} SELECT driver, {', '.join(f"round(avg({c}), 6) AS {c}" for c in [*_LAP_STATS, *_LAP_RATES, "samples"])} FROM lp GROUP BY driver""")
def per_race_telemetry_agg(spark: SparkSession, d: str) -> DataFrame:
    per = telemetry.per_lap(_signals(spark, d), ["driver", "day"], "t", "speed", "throttle", "brake", "gear", "drs", "rpm")
    return tidy(telemetry.per_race(per.drop("day"), ["driver"]))


@query(f"""WITH {RES}, w AS (SELECT driver, pos, pow(2, -((row_number() OVER (PARTITION BY driver ORDER BY y DESC, r DESC, k DESC)) - 1) / 4.0) AS w FROM res WHERE pos IS NOT NULL),
c AS (SELECT driver, pos, w, (sum(w) OVER o - w / 2) / sum(w) OVER (PARTITION BY driver) AS c FROM w WINDOW o AS (PARTITION BY driver ORDER BY pos, w ROWS UNBOUNDED PRECEDING)),
lo AS (SELECT driver, max(c) AS c, arg_max(pos, c) AS x FROM c WHERE c <= 0.5 GROUP BY driver), hi AS (SELECT driver, min(c) AS c, arg_min(pos, c) AS x FROM c WHERE c > 0.5 GROUP BY driver)
SELECT driver, round(CASE WHEN lo.c IS NULL THEN hi.x WHEN hi.c IS NULL THEN lo.x ELSE lo.x + (hi.x - lo.x) * (0.5 - lo.c) / (hi.c - lo.c) END::DOUBLE, 6) AS middle FROM lo FULL JOIN hi USING (driver)""")
def recency_weighted_median(spark: SparkSession, d: str) -> DataFrame:
    """The median position, each result worth half of one four results later."""
    rows = results(spark, d).filter("pos is not null")
    back = rows.withColumn("age", F.row_number().over(Window.partitionBy("driver").orderBy(F.desc("y"), F.desc("r"), F.desc("k"))) - 1)
    return tidy(back.groupBy("driver").agg(stats.weighted_percentile(F.col("pos"), stats.half_life_weight(F.col("age"), 4), 0.5).alias("middle")))


@query(f"""WITH {LAPS}, {_SIGNALS}, a AS (SELECT *, throttle >= 95 AND speed >= 150 AS st, drs >= 10 AS o FROM sig)
SELECT driver, count(*)::BIGINT AS samples, round(quantile_cont(speed, 0.95), 6) AS speed_p95, round(max(speed), 6) AS speed_max, round(avg((throttle >= 95)::INT), 6) AS full_throttle_share, round(avg((brake >= 0.5)::INT), 6) AS brake_share,
  round(avg(speed) FILTER (WHERE brake >= 0.5), 6) AS brake_speed_mean, round(avg(o::INT), 6) AS drs_share, round(avg(st::INT), 6) AS straight_share, round(avg(speed) FILTER (WHERE st), 6) AS straight_speed_mean, round(avg(speed) FILTER (WHERE st AND o) - avg(speed) FILTER (WHERE st AND NOT o), 6) AS drs_gain FROM a GROUP BY 1""")
def weekend_telemetry_metrics(spark: SparkSession, d: str) -> DataFrame:
    return tidy(telemetry.efficiency(_signals(spark, d), ["driver"], "speed", "throttle", "brake", "drs"))


@query(f"""WITH {LAPS}, l AS (SELECT * FROM laps WHERE code = 'purchase'), b AS (SELECT * FROM laps WHERE code = 'click')
SELECT l.event_id, b.event_id AS lap_id, round(b.x, 6) AS lap_x FROM l ASOF LEFT JOIN b ON l.driver = b.driver AND l.us >= b.us""")
def asof_align(spark: SparkSession, d: str) -> DataFrame:
    rows = laps(spark, d)
    right = rows.filter("code = 'click'").select("driver", "us", F.col("event_id").alias("lap_id"), F.col("x").alias("lap_x"))
    return tidy(joins.asof_join(rows.filter("code = 'purchase'"), right, ["driver"], "us", ["lap_id", "lap_x"]).select("event_id", "lap_id", "lap_x"))


_WINDOWS = f"""{LAPS}, w0 AS (SELECT *, coalesce(min(CASE WHEN code IN ('view', 'signup') THEN us END) OVER (PARTITION BY driver ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(us) OVER (PARTITION BY driver)) AS t1 FROM laps),
w1 AS (SELECT *, lag(t1) OVER (PARTITION BY driver ORDER BY us) AS again FROM w0 WHERE code = 'error'), win AS (SELECT driver, code AS kind, us AS t0, t1 FROM w1 WHERE again IS NULL OR again <> t1)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.state_windows(laps(spark, d), ["driver"], "us", "code", ["error"], ["view", "signup"])


@query(f"WITH {_WINDOWS} SELECT * FROM win")
def status_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


@query(f"""WITH {_WINDOWS}, lap AS (SELECT driver, event_id, us, lead(us) OVER (PARTITION BY driver ORDER BY us) AS t1 FROM laps)
SELECT event_id, sum(least(l.t1, w.t1) - greatest(l.us, w.t0))::BIGINT AS overlap_us FROM lap l JOIN win w ON l.driver = w.driver AND w.t0 < l.t1 AND w.t1 > l.us GROUP BY 1""")
def overlap_share(spark: SparkSession, d: str) -> DataFrame:
    rows = laps(spark, d)
    lap = rows.select("driver", "event_id", F.col("us").alias("a0"), F.lead("us").over(Window.partitionBy("driver").orderBy("us")).alias("a1")).filter("a1 is not null")
    win = _windows(spark, d).select("driver", F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    return joins.overlaps(lap, win, ["driver"], 3.6e10).groupBy("event_id").agg(F.sum("seconds").cast("long").alias("overlap_us"))


@query(f"""WITH {_WINDOWS} SELECT event_id, arg_min(w.t0, w.t0) AS window_start FROM laps l JOIN win w ON l.driver = w.driver AND l.us >= w.t0 AND l.us <= w.t1 GROUP BY 1""")
def tag_in_window(spark: SparkSession, d: str) -> DataFrame:
    win = _windows(spark, d).select("driver", F.col("t0").alias("us"), F.col("t0").alias("window_start"), F.col("t1").alias("window_end"))
    # windows of a driver follow each other, so the window that holds a point is the latest begun, or the one before if it just ends there
    before = win.withColumn("prior_end", F.lag("window_end").over(Window.partitionBy("driver").orderBy("us"))).withColumn("prior_start", F.lag("window_start").over(Window.partitionBy("driver").orderBy("us")))
    tagged = joins.asof_join(laps(spark, d), before, ["driver"], "us", ["window_start", "window_end", "prior_start", "prior_end"])
    first = F.when(F.col("us") <= F.col("prior_end"), F.col("prior_start")).when(F.col("us") <= F.col("window_end"), F.col("window_start"))
    return tagged.select("event_id", first.alias("window_start")).filter("window_start is not null")


@query(f"""WITH {RES}, one AS (SELECT y, r, team, driver, min(points) AS p FROM res GROUP BY 1, 2, 3, 4), m AS (SELECT a.y, a.r, a.team, a.driver, a.p - b.p AS delta, row_number() OVER (PARTITION BY a.y, a.r, a.team, a.driver ORDER BY b.driver) AS n
FROM one a JOIN one b ON a.y = b.y AND a.r = b.r AND a.team = b.team AND a.driver <> b.driver) SELECT y, r, team, driver, round(delta, 6) AS mate_delta FROM m WHERE n = 1""")
def mate_delta(spark: SparkSession, d: str) -> DataFrame:
    return tidy(joins.mate_delta(results(spark, d), ["y", "r", "team"], "driver", "points"))


_NUMBERED = f"{LAPS}, num AS (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY us, event_id) AS lap FROM laps)"


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return laps(spark, d).withColumn("lap", F.row_number().over(Window.partitionBy("driver").orderBy("us", "event_id")).cast("long"))


@query(f"""WITH {_NUMBERED} SELECT driver, count(*)::BIGINT AS laps, round(quantile_cont(x, 0.5), 6) AS pace FROM num a WHERE NOT EXISTS (SELECT 1 FROM num p WHERE p.driver = a.driver AND p.code = 'purchase' AND (p.lap = a.lap OR p.lap + 1 = a.lap)) GROUP BY 1""")
def pit_lap_anti_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _numbered(spark, d)
    kept = joins.without_laps(rows, rows.filter("code = 'purchase'"), ["driver"], "lap")
    return tidy(kept.groupBy("driver").agg(F.count("*").alias("laps"), stats.percentile("x", 0.5).alias("pace")))


@query(f"""WITH {_NUMBERED}, ref AS (SELECT lap, quantile_cont(x, 0.5) AS m FROM num GROUP BY 1), a AS (SELECT n.*, n.x - ref.m AS p, lead(n.x - ref.m) OVER (PARTITION BY driver ORDER BY n.lap) AS q FROM num n JOIN ref USING (lap))
SELECT driver, lap, round(p, 6) AS in_penalty, round(q, 6) AS out_penalty, round(-(p + coalesce(q, 0)), 6) AS undercut_gain FROM a WHERE code = 'purchase'""")
def in_out_lap_penalty(spark: SparkSession, d: str) -> DataFrame:
    rows = _numbered(spark, d).withColumn("p", F.col("x") - stats.percentile("x", 0.5).over(Window.partitionBy("lap")))
    out = rows.withColumn("q", F.lead("p").over(Window.partitionBy("driver").orderBy("lap"))).filter("code = 'purchase'")
    return tidy(out.select("driver", "lap", F.col("p").alias("in_penalty"), F.col("q").alias("out_penalty"), (-(F.col("p") + F.coalesce("q", F.lit(0.0)))).alias("undercut_gain")))


@query(f"""WITH {LAPS} SELECT event_id, round(min(x) OVER (PARTITION BY day ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND 1800000000 FOLLOWING), 6) AS best FROM laps""")
def band_window_best(spark: SparkSession, d: str) -> DataFrame:
    return tidy(windows.with_band_best(laps(spark, d), ["day"], "x", "us", 1_800_000_000, "best").select("event_id", "best"))


@query(f"""WITH {LAPS}, a AS (SELECT *, us <= min(us) OVER (PARTITION BY day) + 900000000 AS h, us >= max(us) OVER (PARTITION BY day) - 900000000 AS t FROM laps)
SELECT day, round(avg(x) FILTER (WHERE h), 6) AS head_mean, count_if(h)::BIGINT AS head_n, round(avg(x) FILTER (WHERE t), 6) AS tail_mean, count_if(t)::BIGINT AS tail_n FROM a GROUP BY 1""")
def head_tail_time_window(spark: SparkSession, d: str) -> DataFrame:
    rows = laps(spark, d)
    part = lambda head, name: windows.edge_rows(rows, ["day"], "us", 900_000_000, head).groupBy("day").agg(F.avg("x").alias(f"{name}_mean"), F.count("*").alias(f"{name}_n"))
    return tidy(part(True, "head").join(part(False, "tail"), "day"))


@query(f"""WITH {LAPS} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY driver ORDER BY us, event_id) AS n FROM laps) WHERE (n - 1) % 5 = 0""")
def every_kth_row(spark: SparkSession, d: str) -> DataFrame:
    return windows.every_kth(laps(spark, d), ["driver"], ["us", "event_id"], 5).select("event_id")


# --- categories ------------------------------------------------------------------------------------------------------


@query(f"""WITH {LAPS} SELECT driver, {', '.join(f"round(count_if(code = '{c}') / count(*), 6) AS share_{c}" for c in CODES[:3])} FROM laps WHERE code IN ('click', 'error', 'purchase') GROUP BY 1""")
def compound_mix(spark: SparkSession, d: str) -> DataFrame:
    return tidy(pivots.mix(laps(spark, d), ["driver"], "code", CODES[:3]))


@query(f"""WITH {LAPS} SELECT day, round(quantile_cont(x, 0.5) FILTER (WHERE code = 'click') - quantile_cont(x, 0.5) FILTER (WHERE code = 'error'), 6) AS delta_click_error,
  round(quantile_cont(x, 0.5) FILTER (WHERE code = 'error') - quantile_cont(x, 0.5) FILTER (WHERE code = 'view'), 6) AS delta_error_view FROM laps GROUP BY 1""")
def compound_delta(spark: SparkSession, d: str) -> DataFrame:
    return tidy(pivots.median_deltas(laps(spark, d), ["day"], "code", "x", [("click", "error"), ("error", "view")]))


@query(f"""WITH {LAPS} SELECT driver, {', '.join(f"count_if(code = '{c}')::BIGINT AS {c}" for c in CODES)} FROM laps GROUP BY 1""")
def compound_counts(spark: SparkSession, d: str) -> DataFrame:
    return pivots.counts(laps(spark, d), ["driver"], "code", CODES)


@query(f"""WITH {LAPS}, a AS (SELECT code, day, quantile_cont(x, 0.5) AS m FROM laps GROUP BY 1, 2) SELECT code, round(quantile_cont(m, 0.5), 6) AS median FROM a GROUP BY 1""")
def two_level_median(spark: SparkSession, d: str) -> DataFrame:
    return tidy(pivots.two_level_median(laps(spark, d), ["code", "day"], ["code"], "x"))


@query(f"""WITH {LAPS}, p AS (SELECT day, quantile_cont(x, 0.9) AS p90 FROM laps GROUP BY 1) SELECT driver, round(avg((x > p90)::INT), 6) AS risk FROM laps JOIN p USING (day) GROUP BY 1""")
def exceedance_risk(spark: SparkSession, d: str) -> DataFrame:
    return tidy(pivots.exceedance(laps(spark, d), ["day"], ["driver"], "x"))


@query(f"""WITH {RES}, f AS (SELECT y, r, team, driver, min(grid) AS g FROM res GROUP BY 1, 2, 3, 4), a AS (SELECT y, r, team, list_sort(list(g)) AS l FROM f GROUP BY 1, 2, 3)
SELECT y, r, team, (l[2] - l[1] <= 3)::BIGINT AS stacked, (l[1] = l[2])::BIGINT AS same FROM a WHERE len(l) >= 2""")
def double_stack(spark: SparkSession, d: str) -> DataFrame:
    return tidy(pivots.first_two_gap(results(spark, d), ["y", "r", "team"], "driver", "grid", 3))


@query("""SELECT conv_id, coalesce(bool_or(regexp_matches(upper(text), 'TION')), false)::BIGINT AS has_tion, coalesce(bool_or(role = 'system'), false)::BIGINT AS has_system, coalesce(bool_or(regexp_matches(upper(text), '^TH')), false)::BIGINT AS starts_th FROM conversations GROUP BY 1""")
def any_flag_rates(spark: SparkSession, d: str) -> DataFrame:
    words = F.upper("text")
    return tidy(pivots.any_flags(table(spark, d, "conversations"), ["conv_id"], {"has_tion": words.rlike("TION"), "has_system": F.col("role") == "system", "starts_th": words.rlike("^TH")}))


@query(f"""WITH {LAPS}, a AS (SELECT * FROM laps WHERE x BETWEEN 5 AND 95), q AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM a) SELECT driver, count(*)::BIGINT AS n, round(avg(x), 6) AS mean FROM a, q WHERE x BETWEEN lo AND hi GROUP BY 1""")
def trimmed_bounds(spark: SparkSession, d: str) -> DataFrame:
    return tidy(pivots.trim_bounds(laps(spark, d), "x", 5, 95).groupBy("driver").agg(F.count("*").alias("n"), F.avg("x").alias("mean")))


@query(f"""WITH {RES}, a AS (SELECT *, pos - lag(pos) OVER (PARTITION BY driver ORDER BY y, r, k) AS s FROM res) SELECT driver, coalesce(sum(greatest(-s, 0)) - sum(greatest(s, 0)), NULL)::BIGINT AS net_change, count(pos)::BIGINT AS rows FROM a GROUP BY 1""")
def net_position_change(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d)
    return tidy(pivots.position_changes(rows, ["driver"], ["y", "r", "k"], "pos"))


@query(f"""WITH {LAPS}, a AS (SELECT event_id, nullif(round(x / 10), 5) AS v, day FROM laps), b AS (SELECT *, rank() OVER (PARTITION BY day, v IS NOT NULL ORDER BY v) + (count(*) OVER (PARTITION BY day, v) - 1) / 2.0 AS m, count(*) OVER (PARTITION BY day, v IS NOT NULL) AS n FROM a)
SELECT event_id, round(CASE WHEN v IS NULL THEN NULL WHEN n = 1 THEN 1 ELSE 1 - (m - 1) / (n - 1) END, 6) AS pct FROM b""")
def pct_rank_avg(spark: SparkSession, d: str) -> DataFrame:
    rows = laps(spark, d).withColumn("v", F.nullif(F.round(F.col("x") / 10), F.lit(5.0)))
    return tidy(rows.select("event_id", windows.percent_rank_avg("v", ["day"]).alias("pct")))


@query(f"""WITH {LAPS}, b AS (SELECT driver, day, min(x) AS best FROM laps GROUP BY 1, 2) SELECT driver, day, round(best - min(best) OVER (PARTITION BY day), 6) AS gap_to_best, round(best - quantile_cont(best, 0.5) OVER (PARTITION BY day), 6) AS gap_to_median FROM b""")
def gap_to_best(spark: SparkSession, d: str) -> DataFrame:
    best = laps(spark, d).groupBy("driver", "day").agg(F.min("x").alias("best"))
    w = Window.partitionBy("day")
    return tidy(best.select("driver", "day", (F.col("best") - F.min("best").over(w)).alias("gap_to_best"), (F.col("best") - stats.percentile("best", 0.5).over(w)).alias("gap_to_median")))


# --- scalars ---------------------------------------------------------------------------------------------------------

_STATUS = "['Finished', '+1 Lap', 'Engine', 'Disqualified', 'Collision', 'Unknown']"


def _statuses(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("Finished", "+1 Lap", "Engine", "Disqualified", "Collision", "Unknown")])
    return df.withColumn("s", F.element_at(names, (F.col("k") % 6 + 1).cast("int")))


_OUT = f"""{RES}, s AS (SELECT *, {_STATUS}[k % 6 + 1] AS s FROM res), o AS (SELECT *, CASE WHEN s = 'Disqualified' THEN 'dsq' WHEN s IN ('Finished', '+1 Lap') THEN 'finish' WHEN s IN ('Engine', 'Collision') THEN 'dnf' WHEN pos > 0 THEN 'finish' ELSE 'dnf' END AS outcome FROM s)"""


@query(f"WITH {_OUT} SELECT k, outcome, CASE outcome WHEN 'finish' THEN 0 WHEN 'dnf' THEN 1 ELSE 2 END::BIGINT AS outcome_id, CASE s WHEN 'Engine' THEN 'mechanical' WHEN 'Collision' THEN 'accident' WHEN 'Finished' THEN 'finish' ELSE 'other' END AS bucket FROM o")
def outcome_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = _statuses(results(spark, d)).withColumn("outcome", text.outcome(F.col("s"), F.col("pos")))
    return tidy(rows.select("k", "outcome", text.outcome_id(F.col("outcome")).alias("outcome_id"), text.status_bucket(F.col("s")).alias("bucket")))


@query(f"WITH {_OUT} SELECT k, CASE WHEN outcome = 'finish' AND pos IS NOT NULL THEN pos WHEN outcome = 'dsq' THEN 25 ELSE 21 END::DOUBLE AS effective FROM o")
def effective_position(spark: SparkSession, d: str) -> DataFrame:
    rows = _statuses(results(spark, d)).withColumn("outcome", text.outcome(F.col("s"), F.col("pos")))
    return tidy(rows.select("k", text.effective_position(F.col("outcome"), F.col("pos")).alias("effective")))


@query("""SELECT page_id, trim(regexp_replace(strip_accents(lower(url)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages""")
def slugify_ascii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.slug_ascii(F.col("url")).alias("slug"))


@query("""SELECT p_partkey, CASE WHEN trim(regexp_replace(lower(trim(p_name)), '[^\\w]+', '_', 'g'), '_') = '' THEN 'unknown' ELSE trim(regexp_replace(lower(trim(p_name)), '[^\\w]+', '_', 'g'), '_') END AS slug, regexp_replace(lower(trim(p_type)), '\\s+', '_', 'g') AS kind FROM part""")
def slugify_word(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug_word(F.col("p_name")).alias("slug"), text.slug_space(F.col("p_type")).alias("kind"))


@query("""SELECT o_orderkey, (o_orderkey % 3 * 86400 + o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 59 + 0.25)::DOUBLE AS seconds FROM orders""")
def duration_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    written = F.format_string("%d days %02d:%02d:%02d.250000", k % 3, k % 24, k % 60, k % 59)
    return table(spark, d, "orders").select("o_orderkey", text.duration_seconds(written).alias("seconds"))


@query(f"""WITH {RES} SELECT k, round(least(pos, grid), 6)::DOUBLE AS low, greatest(pos, grid)::DOUBLE AS high, round(list_avg(list_filter([pos, grid], lambda x: x IS NOT NULL)), 6) AS mean, round(list_stddev_pop(list_filter([pos, grid], lambda x: x IS NOT NULL)), 6) AS std, (y * 1000 + r)::BIGINT AS race_id FROM res""")
def row_statistics(spark: SparkSession, d: str) -> DataFrame:
    both = [F.col("pos"), F.col("grid")]
    return tidy(results(spark, d).select("k", *[text.row_stat(both, s).alias(n) for s, n in (("min", "low"), ("max", "high"), ("mean", "mean"), ("std", "std"))], text.race_id(F.col("y"), F.col("r")).alias("race_id")))


# --- joins, unions, keys ---------------------------------------------------------------------------------------------


@query(f"""WITH {RES}, a AS (SELECT driver, count(*)::BIGINT AS n, round(avg(points), 6) AS m FROM res WHERE y <= 1998 GROUP BY 1), b AS (SELECT driver, max(grid)::BIGINT AS g FROM res WHERE y >= 1998 GROUP BY 1) SELECT driver, n, m, g FROM a FULL JOIN b USING (driver)""")
def full_outer_spine(spark: SparkSession, d: str) -> DataFrame:
    res = results(spark, d)
    a = res.filter("y <= 1998").groupBy("driver").agg(F.count("*").alias("n"), F.avg("points").alias("m"))
    b = res.filter("y >= 1998").groupBy("driver").agg(F.max("grid").alias("g"))
    return tidy(joins.coalesce_outer(a, b, ["driver"]))


@query("""SELECT c_custkey, coalesce(a.v, b.v) AS v FROM (SELECT c_custkey, nullif(c_nationkey, 3)::BIGINT AS v FROM customer) a FULL JOIN (SELECT c_custkey, nullif(c_nationkey, 5)::BIGINT AS v FROM customer) b USING (c_custkey)""")
def coalesce_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    side = lambda n: c.select("c_custkey", F.nullif(F.col("c_nationkey").cast("long"), F.lit(n).cast("long")).alias("v"))
    return joins.coalesce_outer(side(3), side(5), ["c_custkey"])


@query("""SELECT s_suppkey AS k, s_acctbal AS bal, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer""")
def union_superset(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*)::BIGINT AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""")
def key_violations(spark: SparkSession, d: str) -> DataFrame:
    return tidy(columns.check_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").distinct().join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey < 12 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def key_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter("c_nationkey < 12").select("c_custkey").intersect(table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


# --- scoring ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {RES}, f AS (SELECT y, r, driver, min(points) AS p FROM res GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY y, r ORDER BY p DESC, driver) AS rank FROM f),
v AS (SELECT *, coalesce([25, 18, 15, 12, 10, 8, 6, 4, 2, 1][rank], 0) AS pts FROM k), t AS (SELECT driver, sum(pts)::BIGINT AS points, count_if(rank = 1)::BIGINT AS wins, count_if(rank <= 3)::BIGINT AS podiums, count(*)::BIGINT AS races FROM v GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY points DESC, wins DESC, podiums DESC, driver) AS rank FROM t""")
def points_standings_entity(spark: SparkSession, d: str) -> DataFrame:
    return tidy(scoring.standings(_ranked(spark, d), "driver", "rank", ["y", "r"]))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    first = results(spark, d).groupBy("y", "r", "driver").agg(F.min("points").alias("p"), F.min("team").alias("team"))
    return first.withColumn("rank", scoring.sequential_rank("p", ["y", "r"], "driver"))


@query(f"""WITH {RES}, f AS (SELECT y, r, driver, min(team) AS team, min(points) AS p FROM res GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY y, r ORDER BY p DESC, driver) AS rank FROM f),
v AS (SELECT *, coalesce([25, 18, 15, 12, 10, 8, 6, 4, 2, 1][rank], 0) AS pts FROM k), t AS (SELECT team, sum(pts)::BIGINT AS points, count_if(rank = 1)::BIGINT AS wins, count_if(rank <= 3)::BIGINT AS podiums, count(DISTINCT y * 100 + r)::BIGINT AS races FROM v GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY points DESC, wins DESC, podiums DESC, team) AS rank FROM t""")
def points_standings_team(spark: SparkSession, d: str) -> DataFrame:
    return tidy(scoring.standings(_ranked(spark, d), "team", "rank", ["y", "r"]))


@query(f"""WITH {RES}, n AS (SELECT y, r, row_number() OVER (ORDER BY y DESC, r DESC) <= 6 AS v FROM (SELECT DISTINCT y, r FROM res)) SELECT v AS is_validation, count(*)::BIGINT AS rows, count(DISTINCT y * 100 + r)::BIGINT AS rounds FROM res JOIN n USING (y, r) GROUP BY 1""")
def time_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.time_split(results(spark, d), "y", "r", 6).groupBy("is_validation").agg(F.count("*").alias("rows"), F.count_distinct("y", "r").alias("rounds"))


@query(f"""WITH {RES}, n AS (SELECT y, r, row_number() OVER (ORDER BY y DESC, r DESC) - 1 AS age FROM (SELECT DISTINCT y, r FROM res)) SELECT y, r, round(exp(-ln(2) / 8 * age) / avg(exp(-ln(2) / 8 * age)) OVER (), 6) AS weight FROM n""")
def race_recency_weights(spark: SparkSession, d: str) -> DataFrame:
    rounds = results(spark, d).select("y", "r").distinct().withColumn("age", F.row_number().over(Window.orderBy(F.desc("y"), F.desc("r"))) - 1)
    w = stats.half_life_weight(F.col("age"), 8)
    return tidy(rounds.select("y", "r", (w / F.avg(w).over(Window.partitionBy())).alias("weight")))


@query(f"""WITH {RES}, e AS (SELECT * FROM (VALUES (1, 0, 1995, 0.3), (2, 1996, 1998, 0.5), (3, 1999, 9999, 1.0)) t(era, lo, hi, w)) SELECT era::BIGINT AS era, count(DISTINCT y * 100 + r)::BIGINT AS rounds, count(*)::BIGINT AS rows, round(sum(w)::DOUBLE, 6) AS weight FROM res JOIN e ON y BETWEEN lo AND hi GROUP BY 1""")
def era_weights(spark: SparkSession, d: str) -> DataFrame:
    era = F.when(F.col("y") <= 1995, 1).when(F.col("y") <= 1998, 2).otherwise(3)
    weight = F.when(era == 1, 0.3).when(era == 2, 0.5).otherwise(1.0)
    return tidy(results(spark, d).withColumn("era", era).withColumn("w", weight).groupBy("era").agg(F.count_distinct("y", "r").alias("rounds"), F.count("*").alias("rows"), F.sum("w").alias("weight")))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), w AS (SELECT label, sum(n) OVER () / n AS w FROM c) SELECT label::BIGINT AS label, round(least(greatest(w / avg(w) OVER (), 0.5), 8), 6) AS weight FROM w""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return tidy(scoring.class_weights(table(spark, d, "embeddings"), "label"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END, 6) AS std FROM lineitem" for c in _NUM))
def scaler_fit(spark: SparkSession, d: str) -> DataFrame:
    return tidy(scoring.fit_scaler(table(spark, d, "lineitem"), _NUM))


@query("""WITH a AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders), m AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM a) SELECT o_orderkey, round((coalesce(v, m) - m) / sd, 6) AS v FROM a, m""")
def impute_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    return tidy(scoring.apply_scaler(rows, scoring.fit_scaler(rows, ["v"]), ["v"]))


@query(f"""WITH {LAPS} SELECT event_id, round(exp((x - max(x) OVER (PARTITION BY day)) / 12.0) / sum(exp(x / 12.0)) OVER (PARTITION BY day) * exp(max(x) OVER (PARTITION BY day) / 12.0), 6) AS p_win FROM laps""")
def softmax_win_prob(spark: SparkSession, d: str) -> DataFrame:
    return tidy(scoring.with_softmax(laps(spark, d), "x", ["day"], "p_win", 12.0).select("event_id", "p_win"))


_P = "pr AS (SELECT k, y, r, driver, grid, points / 100000 AS s, 0.5 + 0.4 * (k % 11) / 10 AS pf, 0.1 * (1 - (k % 11) / 10.0) AS pd FROM res)"
_SCORE = f"""{RES}, {_P}, z AS (SELECT *, avg(s) OVER w AS m, stddev_pop(s) OVER w AS sd FROM pr WINDOW w AS (PARTITION BY y, r)),
sc AS (SELECT *, 10 * (2 * pf + pd) + least(greatest(CASE WHEN sd < 1e-6 THEN s - m ELSE (s - m) / sd END, -3), 3) AS score, s + ln(least(greatest(pf, 1e-6), 1)) AS l FROM z)"""


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return results(spark, d).select("k", "y", "r", "driver", "grid", (F.col("points") / 100000).alias("s"), (0.5 + 0.4 * (k % 11) / 10).alias("pf"), (0.1 * (1 - (k % 11) / 10.0)).alias("pd"))


@query(f"""WITH {_SCORE}, e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY y, r)) AS e FROM sc) SELECT k, round(score, 6) AS score, round(e / sum(e) OVER (PARTITION BY y, r), 6) AS p_win FROM e""")
def race_scores(spark: SparkSession, d: str) -> DataFrame:
    return tidy(scoring.race_scores(_probabilities(spark, d), ["y", "r"], "s", "pf", "pd").select("k", "score", "p_win"))


@query(f"""WITH {LAPS} SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY x DESC, event_id) AS rank FROM laps""")
def score_rank(spark: SparkSession, d: str) -> DataFrame:
    return tidy(laps(spark, d).select("event_id", scoring.sequential_rank("x", ["day"], "event_id").alias("rank")))


@query(f"""WITH {RES}, a AS (SELECT *, points / 10000 - 1.5 * 0.25 * (coalesce(nullif(grid, 7), 10) - 1) AS s FROM res) SELECT k, round(s, 6) AS score FROM a""")
def grid_penalty(spark: SparkSession, d: str) -> DataFrame:
    grid = F.nullif("grid", F.lit(7).cast("long"))
    return tidy(results(spark, d).select("k", scoring.grid_penalty(F.col("points") / 10000, grid, 1.5).alias("score")))


@query(f"""WITH {RES}, f AS (SELECT *, row_number() OVER (PARTITION BY y, r ORDER BY grid) AS fin, points / 100000 AS s FROM res), a AS (SELECT y, r, fin, s, ln(sum(exp(s)) OVER (PARTITION BY y, r ORDER BY fin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - s AS l FROM f) SELECT y, r, round(avg(l), 6) AS nll FROM a GROUP BY 1, 2""")
def plackett_luce_nll(spark: SparkSession, d: str) -> DataFrame:
    return tidy(scoring.plackett_luce_nll(results(spark, d).withColumn("s", F.col("points") / 100000), ["y", "r"], "s", "grid"))


@query(f"""WITH {RES}, a AS (SELECT *, row_number() OVER (PARTITION BY y, r ORDER BY grid % 17 DESC, k) AS p, row_number() OVER (PARTITION BY y, r ORDER BY pos, k) AS a, count(*) OVER (PARTITION BY y, r) AS n FROM res WHERE pos IS NOT NULL)
SELECT y, r, round(corr(p, a), 6) AS spearman, round(avg(abs(p - a)), 6) AS mae, max((p = 1 AND a = 1)::INT)::DOUBLE AS top1, round(sum((n - a + 1) / log2(p + 1)) FILTER (WHERE p <= 5) / sum((n - p + 1) / log2(p + 1)) FILTER (WHERE p <= 5), 6) AS ndcg FROM a GROUP BY 1, 2""")
def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    return tidy(scoring.rank_metrics(results(spark, d).withColumn("s", F.col("grid") % 17), ["y", "r"], "s", "pos", "k"))


@query("""WITH a AS (SELECT quality AS l, toxic AS p FROM labels), t AS (SELECT avg((l = p)::INT) AS acc FROM a), c AS (SELECT l AS label, count(*) AS support, count_if(l = p) AS tp FROM a GROUP BY 1), g AS (SELECT p AS label, count(*) AS guessed FROM a GROUP BY 1)
SELECT label::BIGINT AS label, support::BIGINT AS support, round(coalesce(tp / guessed, 0), 6) AS precision, round(tp / support, 6) AS recall, round(coalesce(2 * (tp / guessed) * (tp / support) / nullif(tp / guessed + tp / support, 0), 0), 6) AS f1, round(acc, 6) AS accuracy FROM c LEFT JOIN g USING (label), t""")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return tidy(scoring.class_metrics(table(spark, d, "labels"), "quality", "toxic"))


# --- audits ----------------------------------------------------------------------------------------------------------

_AUD = ["pos", "grid", "points"]


@query(f"WITH {RES}, " + "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, y, r, {c}::DOUBLE AS v FROM res" for c in _AUD) + """), p AS (SELECT feature, y, r, count(*) AS n, count(v) AS k, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1, 2, 3), d AS (SELECT feature, count(DISTINCT v) AS dv FROM l GROUP BY 1)
SELECT feature, sum(n)::BIGINT AS rows, sum(k)::BIGINT AS non_null, round(avg(CASE WHEN k > 0 THEN (lo = hi)::INT ELSE 1 END), 6) AS race_constant_share, round(avg((k > 0)::INT), 6) AS race_non_null_share, any_value(dv)::BIGINT AS distinct_values,
  round(1 - sum(k) / sum(n), 6) AS missing_rate, sum(k) = 0 AS all_null FROM p JOIN d USING (feature) GROUP BY 1""")
def column_health(spark: SparkSession, d: str) -> DataFrame:
    return tidy(audit.column_health(results(spark, d), ["y", "r"], _AUD))


@query(f"WITH {RES}, " + "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM res" for c in _AUD) + """), h AS (SELECT feature, 1 - count(v) / count(*) AS m, count(v) = 0 AS a FROM l GROUP BY 1)
SELECT CASE WHEN starts_with(feature, 'po') THEN 'outcome' ELSE 'other' END AS "group", count(*)::BIGINT AS columns, count_if(a)::BIGINT AS all_null_columns, round(avg(m), 6) AS missing_rate, count(*) = count_if(a) AS dead FROM h GROUP BY 1""")
def group_health(spark: SparkSession, d: str) -> DataFrame:
    return tidy(audit.group_health(audit.column_health(results(spark, d), ["y", "r"], _AUD), {"po": "outcome"}))


@query("WITH a AS (SELECT *, year(o_orderdate) >= 2000 AS v FROM (SELECT o_orderdate, o_totalprice AS x FROM orders)), " + """c AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM a WHERE NOT v),
i AS (SELECT v, least(len(list_filter(e, lambda z: z <= x)), len(e) - 1) AS bin FROM a, c WHERE x >= e[1] AND x <= e[len(e)]), b AS (SELECT unnest(range(1, len(e))) AS bin FROM c),
s AS (SELECT b.bin, count_if(NOT v) AS t, count_if(v) AS w FROM b LEFT JOIN i USING (bin) GROUP BY 1), n AS (SELECT t / sum(t) OVER () + 1e-6 AS t, w / sum(w) OVER () + 1e-6 AS w FROM s) SELECT 'o_totalprice' AS feature, round(sum((w - t) * ln(w / t)), 6) AS psi FROM n""")
def psi(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_totalprice", (F.year("o_orderdate") >= 2000).alias("v"))
    return tidy(audit.psi(rows, ["o_totalprice"], "v"))


@query(f"""WITH {RES}, l AS (SELECT 'grid' AS feature, y, r, grid::DOUBLE AS v, pos FROM res UNION ALL SELECT 'points', y, r, points, pos FROM res), k AS (SELECT * FROM l WHERE v IS NOT NULL AND pos IS NOT NULL),
a AS (SELECT *, rank() OVER (PARTITION BY feature, y, r ORDER BY v) + (count(*) OVER (PARTITION BY feature, y, r, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature, y, r ORDER BY pos) + (count(*) OVER (PARTITION BY feature, y, r, pos) - 1) / 2.0 AS b FROM k)
SELECT feature, y, r, round(CASE WHEN count(*) >= 3 THEN corr(a, b) END, 6) AS rho, count(*)::BIGINT AS n FROM a GROUP BY 1, 2, 3""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return tidy(audit.spearman(results(spark, d), ["y", "r"], ["grid", "points"], "pos"))


@query(f"""WITH {RES}, b AS (SELECT *, pos AS same, -pos AS negative, 1 AS fixed FROM res), l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, y, r, {c}::DOUBLE AS v, pos FROM b" for c in ('same', 'negative', 'fixed', 'grid', 'points'))}),
p AS (SELECT feature, count(v) = 0 AS all_null, coalesce(min(v) = max(v), false) AS constant, coalesce(bool_and(v = pos) FILTER (WHERE v IS NOT NULL AND pos IS NOT NULL), false) AS equals_target, coalesce(bool_and(v = -pos) FILTER (WHERE v IS NOT NULL AND pos IS NOT NULL), false) AS equals_negative FROM l GROUP BY 1),
k AS (SELECT * FROM l WHERE v IS NOT NULL AND pos IS NOT NULL), a AS (SELECT *, rank() OVER (PARTITION BY feature, y, r ORDER BY v) + (count(*) OVER (PARTITION BY feature, y, r, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature, y, r ORDER BY pos) AS b FROM k),
c AS (SELECT feature, y, r, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 THEN corr(a, b) END AS rho FROM a GROUP BY 1, 2, 3), s AS (SELECT feature, coalesce(min(abs(rho)) > 0.999, false) AS ranks_as_target FROM c GROUP BY 1)
SELECT p.*, coalesce(ranks_as_target, false) AS ranks_as_target FROM p LEFT JOIN s USING (feature)""")
def leakage_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).withColumns({"same": F.col("pos"), "negative": -F.col("pos"), "fixed": F.lit(1)})
    return audit.leakage(rows, ["y", "r"], ["same", "negative", "fixed", "grid", "points"], "pos")


@query(f"""WITH {LAPS}, s AS (SELECT day, code, quantile_cont(x, 0.5) AS m, count(*) AS n FROM laps WHERE code IN ('view', 'click') GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY (code <> 'view')::INT) AS p FROM s) SELECT day, code, round(m, 6) AS median, n::BIGINT AS n FROM k WHERE p = 1""")
def session_weather_summary(spark: SparkSession, d: str) -> DataFrame:
    per = laps(spark, d).filter(F.col("code").isin("view", "click")).groupBy("day", "code").agg(stats.percentile("x", 0.5).alias("median"), F.count("*").alias("n"))
    return tidy(lookback.last_rows(per, ["day"], [(F.col("code") != "view").cast("int")], 1))
