"""The feature queries of a race weekend, over canonical tables and for all cut-off rounds at once.

Tables (see TABLES) are keyed by year, round, session and driver; durations are seconds. ``ctx.cutoffs`` names the rounds to
compute, ``ctx.roster`` their drivers and teams. History is what lies strictly before a cut-off; current-weekend queries read
practice and qualifying of the round itself, never its race. Each query returns year, round, driver and its own columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, lookback, pivots, stats, telemetry, windows
from ..operators.stats import clip, iqr, percentile, rate
from . import tracks

KEY = ["year", "round", "driver"]
RACE = ["year", "round"]
CUT = ["cut_y", "cut_r"]

TABLES = {
    "results": "year int, round int, session string, driver string, team string, position double, grid double, points double, status string, q1 double, q2 double, q3 double, time double",
    "laps": "year int, round int, session string, driver string, team string, lap int, lap_s double, time_s double, start_s double, stint int, compound string, tyre_age int, track_status string, is_accurate boolean, deleted boolean, pit_in double, pit_out double, position double, s1 double, s2 double, s3 double, gap_s double",
    "meta": "year int, round int, event string, official string, circuit string, location string, format string",
    "schedule": "year int, round int, session string, starts timestamp",
    "session_windows": "year int, round int, session string, t0 timestamp, t1 timestamp",
    "weather": "year int, round int, session string, t_s double, utc timestamp, air double, track double, humidity double, wind double, rain double, rain_prob double",
    "race_ctrl": "year int, round int, t_s double, lap int, category string, message string, status string, flag string",
    "track_status": "year int, round int, t_s double, status string, message string",
    "race_events": "year int, round int, lap int, driver string, event string",
    "session_status": "year int, round int, t_s double, status string, message string",
    "telemetry": "year int, round int, session string, driver string, t_s double, speed double, throttle double, brake double, drs double, gear double, rpm double",
    "telemetry_best": "year int, round int, driver string, best double, top double",
    "entries": "year int, round int, session string, driver string, team string",
    "pit_stops": "year int, round int, driver string, lap int, seconds double",
}
SESSION_ORDER = {"FP1": 1, "FP2": 2, "FP3": 3, "Q": 4}
DRY = ["SOFT", "MEDIUM", "HARD"]


@dataclass
class Context:
    """tables by name; cutoffs: year, round; roster: year, round, driver, team; options: tunables of the queries."""

    tables: dict[str, DataFrame]
    cutoffs: DataFrame
    roster: DataFrame
    options: dict[str, object] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self.cutoffs.sparkSession.createDataFrame([], TABLES[name])

    def past(self, facts: DataFrame, n: int) -> DataFrame:
        return lookback.seen_by(facts, self.cutoffs, n)

    def now(self, facts: DataFrame) -> DataFrame:
        return facts.join(lookback.few(self.cutoffs.select(*RACE).distinct()), RACE, "left_semi")


Feature = Callable[[Context], DataFrame]
FEATURES: dict[str, Feature] = {}
#: Queries that read nothing of the weekend itself.
FUTURE_SAFE = ["track_onehot", "track_profile", "driver_track_cluster_pre", "event_chaos_priors_pre", "history_form", "telemetry_history_pre", "quali_priors_pre", "tyre_priors_pre", "dev_trend_pre", "reliability_risk_pre", "traffic_overtake_pre", "driver_team_priors_pre", "weather_basic"]
EXPERIMENTAL = ["strategy_priors_pre", "pit_ops_risk_pre", "pit_ops_pre"]


def feature(f: Feature) -> Feature:
    FEATURES[f.__name__] = f
    return f


def on_roster(ctx: Context, found: DataFrame, key: list[str] | None = None) -> DataFrame:
    key = key or KEY
    return ctx.roster.select(*KEY, "team").distinct().join(found, key, "left").drop("team")


def back(df: DataFrame) -> DataFrame:
    """Cut-off columns under their canonical names."""
    return df.withColumnsRenamed({"cut_y": "year", "cut_r": "round"})


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def is_green(status: Column) -> Column:
    return F.coalesce(F.trim(status) == "1", F.lit(True))


def no_caution(status: Column) -> Column:
    return ~F.coalesce(status.rlike("[24567]"), F.lit(False))


def is_pit(df_in: str = "pit_in", df_out: str = "pit_out") -> Column:
    return F.col(df_in).isNotNull() | F.col(df_out).isNotNull()


def race_results(ctx: Context) -> DataFrame:
    rows = ctx.table("results").filter("session = 'R'")
    return rows.withColumn("dnf", text.history_dnf(F.col("status")).cast("int"))


def pick(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return lookback.last_rows(df, key, order, 1)


def session_ord() -> Column:
    return F.coalesce(*[F.when(F.col("session") == s, F.lit(n)) for s, n in SESSION_ORDER.items()])


# --- priors from results ---------------------------------------------------------------------------------------------


def middle(ctx: Context, option: str, x: str) -> Column:
    """The median of a cut-off's past rounds; with a half-life in rounds as the option, later rounds weigh more."""
    half_life = ctx.options.get(option)
    return stats.weighted_percentile(F.col(x), stats.half_life_weight(F.col("age") - 1, float(half_life)), 0.5) if half_life else percentile(x, 0.5)


def _priors(ctx: Context, prefix: str, with_grid: bool) -> list[Column]:
    out = [F.count("*").alias(f"{prefix}hist_n"), middle(ctx, "driver_team_recency_half_life", "position").alias(f"{prefix}finish_p50"), rate(F.col("position") <= 10, F.col("position")).alias(f"{prefix}top10_rate"), F.avg("dnf").alias(f"{prefix}dnf_rate"), F.avg("points").alias(f"{prefix}points_mean")]
    return [*out, iqr("position").alias(f"{prefix}finish_iqr"), percentile("grid", 0.5).alias(f"{prefix}grid_p50")] if with_grid else out


@feature
def driver_team_priors_pre(ctx: Context) -> DataFrame:
    """Ten rounds of the driver and of the current team, else of the last known one."""
    seen = ctx.past(race_results(ctx), 10)
    pre = "driver_team_pre_"
    drivers = back(seen.groupBy(*CUT, "driver").agg(*_priors(ctx, f"{pre}driver_", True), F.max_by("team", F.struct("year", "round")).alias("last_team"), F.max(F.struct("year", "round")).alias("m")).withColumns({f"{pre}last_seen_year": F.col("m.year"), f"{pre}last_seen_round": F.col("m.round")}).drop("m"))
    teams = back(seen.groupBy(*CUT, "team").agg(*_priors(ctx, f"{pre}team_", False)))
    base = ctx.roster.select(*KEY, "team").distinct().join(drivers, KEY, "left").withColumn("team", F.coalesce("team", "last_team")).drop("last_team")
    return base.join(teams, [*RACE, "team"], "left").select(*KEY, F.col("team").alias("Team"), *[c for c in [*drivers.columns, *teams.columns] if c.startswith(pre)])


@feature
def quali_priors_pre(ctx: Context) -> DataFrame:
    """Thirty qualifyings; Q first, sprint qualifying where there was none."""
    q = ctx.table("results")
    rows = lookback.first_available([q.filter("session = 'Q'"), q.filter("session = 'SQ'")], RACE)
    rows = rows.withColumn("rel", clip(F.col("position") - percentile("position", 0.5).over(Window.partitionBy(*RACE)), -5, 5))
    missing = F.coalesce(text.any_word(F.col("status"), text.NO_TIME_WORDS) | (F.upper("status") == "NC"), F.col("position").isNull())
    spread = iqr("rel")
    p = "quali_pre_"
    agg = ctx.past(rows, 30).groupBy(*CUT, "driver").agg(F.count("*").alias(f"{p}hist_n"), middle(ctx, "quali_recency_half_life", "position").alias(f"{p}pos_p50"), spread.alias(f"{p}pos_iqr"), F.min("position").alias(f"{p}bestpos_min"), rate(F.col("position") <= 10, F.col("position")).alias(f"{p}top10_rate"), rate(missing).alias(f"{p}notime_or_pen_rate"), F.avg("points").alias(f"{p}points_mean"), (-spread).alias(f"{p}pos_consistency"), F.max(F.struct("year", "round")).alias("m"))
    out = back(agg.withColumns({f"{p}last_seen_year": F.col("m.year"), f"{p}last_seen_round": F.col("m.round")}).drop("m"))
    return on_roster(ctx, out)


def track_keys(ctx: Context) -> DataFrame:
    """year, round, keys: slugs of the event, circuit and place."""
    slugs = F.array(*[text.slug_ascii(F.col(c)) for c in ("event", "circuit", "official", "location")])
    return ctx.table("meta").select(*RACE, F.array_distinct(F.filter(slugs, lambda s: F.coalesce(s, F.lit("")) != "")).alias("keys"), tracks.slug_of(text.slug_ascii(F.coalesce("circuit", "event"))).alias("track"))


def with_same_track(ctx: Context, seen: DataFrame) -> DataFrame:
    """seen with ``same``: the past round shares a key with the cut-off."""
    keys = track_keys(ctx)
    past, cut = keys.select(*RACE, F.col("keys").alias("_pk")), keys.select(F.col("year").alias("cut_y"), F.col("round").alias("cut_r"), F.col("keys").alias("_ck"))
    return seen.join(lookback.few(past), RACE, "left").join(lookback.few(cut), CUT, "left").withColumn("same", F.coalesce(F.arrays_overlap("_pk", "_ck"), F.lit(False))).drop("_pk", "_ck")


@feature
def track_onehot(ctx: Context) -> DataFrame:
    """What a driver did at the same track in up to 256 rounds, and the track as a 0/1 column per known track of the cut-offs."""
    p = "track_same_"
    seen = with_same_track(ctx, ctx.past(race_results(ctx), 256)).filter("same")
    agg = seen.groupBy(*CUT, "driver").agg(F.count("*").alias(f"{p}hist_n"), percentile("position", 0.5).alias(f"{p}finish_p50"), F.min("position").alias(f"{p}bestpos_min"), rate(F.col("position") <= 10, F.col("position")).alias(f"{p}top10_rate"), F.avg("dnf").alias(f"{p}dnf_rate"), F.avg("points").alias(f"{p}points_mean"), percentile("grid", 0.5).alias(f"{p}grid_p50"), F.max(F.struct("year", "round")).alias("m"))
    out = on_roster(ctx, back(agg.withColumns({f"{p}last_seen_year": F.col("m.year"), f"{p}last_seen_round": F.col("m.round")}).drop("m"))).na.fill(0, [f"{p}hist_n"])
    cut = ctx.now(track_keys(ctx)).select(*RACE, "track")
    names = sorted(r.track for r in cut.select("track").distinct().collect() if r.track)
    return out.join(lookback.few(cut), RACE, "left").withColumns({f"track_is_{n}": (F.coalesce("track", F.lit("")) == n).cast("double") for n in names}).drop("track")


@feature
def track_profile(ctx: Context) -> DataFrame:
    """Profile columns of the round's track and the indices derived from them."""
    cut = ctx.now(track_keys(ctx)).select(*RACE, F.col("track").alias("slug"))
    return ctx.roster.select(*KEY).distinct().join(lookback.few(tracks.profiles(cut, ctx.tables.get("track_profiles"))), RACE, "left")


@feature
def driver_track_cluster_pre(ctx: Context) -> DataFrame:
    """The last eight races of the track's cluster, shrunk towards the field of drivers.

    Cut-offs of a cluster are numbered in time. A race is among a driver's last eight for the cut-offs behind it, up to the one
    before the eighth race after it; so it is copied to these only, not to all later ones."""
    clusters = track_keys(ctx).select(*RACE, tracks.cluster_of(F.col("track")).alias("cluster"))
    cuts = ctx.cutoffs.select(*RACE).distinct().join(lookback.few(clusters), RACE).withColumn("no", F.row_number().over(Window.partitionBy("cluster").orderBy(*RACE)))
    upto = F.coalesce(F.max("no").over(Window.partitionBy("cluster").orderBy(*RACE)), F.lit(0))
    marks = clusters.join(lookback.few(cuts.select(*RACE, "no")), RACE, "left").withColumn("upto", upto).withColumn("all", F.coalesce(F.max("no").over(Window.partitionBy("cluster")), F.lit(0)))
    races = race_results(ctx).join(lookback.few(marks.drop("no")), RACE)
    until = F.coalesce(F.lead("upto", 8).over(Window.partitionBy("driver", "cluster").orderBy(*RACE)), F.col("all"))
    copied = races.withColumn("until", until).filter("until > upto").withColumn("no", F.explode(F.sequence(F.col("upto") + 1, F.col("until")))).drop(*RACE)
    last = copied.join(lookback.few(cuts.select(F.col("year").alias("cut_y"), F.col("round").alias("cut_r"), "cluster", "no")), ["cluster", "no"])
    retired = F.coalesce(text.any_word(F.col("status"), text.RETIRED_WORDS), F.lit(False))
    own = last.groupBy(*CUT, "driver").agg(F.count("position").alias("n"), percentile("position", 0.5).alias("finish_p50"), F.avg(F.coalesce("points", F.lit(0.0))).alias("points_mean"), rate(F.col("position").between(1, 10), F.col("position")).alias("top10_rate"), percentile("grid", 0.5).alias("grid_p50"), rate(retired).alias("retire_rate"))
    w = Window.partitionBy(*CUT)
    rules = {"finish_p50": (3, percentile("finish_p50", 0.5)), "points_mean": (6, F.avg("points_mean")), "top10_rate": (6, F.avg("top10_rate")), "grid_p50": (3, percentile("grid_p50", 0.5)), "retire_rate": (6, F.avg("retire_rate"))}
    shrunk = [stats.shrink(F.col(c), F.col("n"), base.over(w), k).alias(f"driver_trackc_pre_{c}") for c, (k, base) in rules.items()]
    return on_roster(ctx, back(own.select(*CUT, "driver", *shrunk, F.col("n").alias("driver_trackc_pre_hist_n"))))


# --- pace history ----------------------------------------------------------------------------------------------------


def clean_pace(ctx: Context) -> DataFrame:
    """Per race and driver: the mean of the ten best clean laps and the clean share, both also against the race's median."""
    rows = ctx.table("laps").filter((F.col("session") == "R") & ~is_pit() & is_green(F.col("track_status")) & (F.col("lap_s") > 0))
    marked = stats.mad_clean(rows, KEY, "lap_s")
    n = F.row_number().over(Window.partitionBy(*KEY, "clean").orderBy("lap_s", "lap"))
    agg = marked.withColumn("_n", n).groupBy(*KEY).agg(F.avg(F.when(F.col("clean") & (F.col("_n") <= 10), F.col("lap_s"))).alias("best10"), F.avg(F.col("clean").cast("int")).alias("share"), F.count("*").alias("laps"))
    return stats.detrend(stats.detrend(agg, RACE, "best10", "best10_rel"), RACE, "share", "share_rel")


@feature
def history_form(ctx: Context) -> DataFrame:
    p = "hist_pre_"
    seen = ctx.past(clean_pace(ctx), 10)
    seen = seen.withColumn("back", F.row_number().over(Window.partitionBy(*CUT, "driver").orderBy("age")) - 1)
    mean = stats.weighted_mean(clip(F.col("share_rel"), -0.5, 0.5), stats.recency_weight(F.col("back"), F.col("laps")))
    pace = back(seen.groupBy(*CUT, "driver").agg(F.count("*").alias(f"{p}hist_n"), percentile("best10_rel", 0.5).alias(f"{p}best10_pace_p50_s"), iqr("best10_rel").alias(f"{p}best10_pace_iqr_s"), clip(mean, -0.3, 0.3).alias(f"{p}clean_share_mean"), F.max(F.struct("year", "round")).alias("m")).withColumns({f"{p}last_seen_year": F.col("m.year"), f"{p}last_seen_round": F.col("m.round")}).drop("m"))
    team = ctx.roster.select(F.col("year").alias("cut_y"), F.col("round").alias("cut_r"), "driver", F.col("team").alias("now_team"))
    res = back(ctx.past(race_results(ctx), 10).join(team, [*CUT, "driver"], "left").groupBy(*CUT, "driver").agg(F.avg("dnf").alias(f"{p}dnf_rate"), F.avg((F.col("team") == F.col("now_team")).cast("int")).alias(f"{p}team_stability")))
    return on_roster(ctx, pace.join(res, KEY, "full_outer"))


@feature
def telemetry_history_pre(ctx: Context) -> DataFrame:
    """Best lap and top speed of ten races: from a race's own summary, else the top speed from telemetry and the best clean lap."""
    tele = ctx.table("telemetry").filter("session = 'R'").groupBy(*KEY).agg(F.max("speed").alias("top"))
    best = ctx.table("laps").filter((F.col("session") == "R") & ~is_pit() & (F.col("lap_s") > 0)).groupBy(*KEY).agg(F.min("lap_s").alias("best"))
    own = best.join(tele, KEY, "full_outer").select(*KEY, "best", "top")
    per = lookback.first_available([ctx.table("telemetry_best").select(*KEY, "best", "top"), own], RACE).withColumn("z", stats.zscore("best", RACE, sample=False, sign=-1))
    seen = with_same_track(ctx, ctx.past(per, 10)).withColumn("w", 1 + 0.5 * F.col("same").cast("int"))
    p = "tele_pre_"
    agg = seen.groupBy(*CUT, "driver").agg(F.count("*").alias(f"{p}hist_n"), middle(ctx, "telemetry_recency_half_life", "best").alias(f"{p}bestlap_p50_s"), iqr("best").alias(f"{p}bestlap_iqr_s"), (F.coalesce(F.sum(F.col("w") * F.col("z")), F.lit(0.0)) / F.sum("w")).alias(f"{p}pace_z_mean"), percentile("top", 0.75).alias(f"{p}topspeed_p75"), F.count_if("same").alias(f"{p}same_track_n"), F.max(F.struct("year", "round")).alias("m"))
    slope = stats.trend(seen, [*CUT, "driver"], "z", ["year", "round"]).withColumnRenamed("slope", f"{p}pace_z_trend")
    out = back(agg.join(slope, [*CUT, "driver"], "left").withColumns({f"{p}last_seen_year": F.col("m.year"), f"{p}last_seen_round": F.col("m.round")}).drop("m"))
    return on_roster(ctx, out).na.fill(0, [f"{p}hist_n", f"{p}same_track_n", f"{p}pace_z_mean", f"{p}pace_z_trend"])


@feature
def dev_trend_pre(ctx: Context) -> DataFrame:
    """Slopes of the race z scores of a driver and of the team over six races, and the driver's spread against the team over eight."""
    laps = ctx.table("laps").filter("session = 'R' and lap_s > 0")
    kept = joins.without_laps(laps, laps.filter("pit_in is not null"), KEY, "lap")
    medians = stats.trimmed_median(kept.withColumn("ms", F.col("lap_s") * 1000), KEY, "ms")
    z = medians.withColumn("z", stats.zscore("trimmed_median", RACE, sign=-1))
    teams = race_results(ctx).select(*KEY, "team").unionByName(laps.select(*KEY, "team")).filter("team is not null").dropDuplicates(KEY)
    z = z.join(teams, KEY, "left")
    team_z = z.groupBy(*RACE, "team").agg(F.avg("z").alias("team_z"))
    seen = ctx.past(z.join(team_z, [*RACE, "team"], "left"), 8).withColumn("delta", F.col("z") - F.col("team_z"))
    driver = stats.trend(seen, [*CUT, "driver"], "z", ["year", "round"], last=6, least=3, short=None).withColumnRenamed("slope", "driver_trend")
    team = stats.trend(ctx.past(team_z, 8), [*CUT, "team"], "team_z", ["year", "round"], last=6, least=3, short=None).withColumnRenamed("slope", "team_dev_trend")
    spread = seen.groupBy(*CUT, "driver").agg(stats.robust_sigma("delta").alias("stability_delta_vs_tm"), F.max_by("team", F.struct("year", "round")).alias("last_team"))
    out = back(spread.join(driver, [*CUT, "driver"], "left"))
    base = ctx.roster.select(*KEY, "team").distinct().join(out, KEY, "left").withColumn("team", F.coalesce("team", "last_team"))
    return base.join(back(team), [*RACE, "team"], "left").select(*KEY, "driver_trend", "team_dev_trend", "stability_delta_vs_tm")


@feature
def traffic_overtake_pre(ctx: Context) -> DataFrame:
    """Places won on the first lap, incidents on it, what a car close ahead costs, and net passes a hundred green laps: means of ten races.

    Incidents are those of the race's events; only where these name nobody, who lost three places or stopped has one."""
    laps = ctx.table("laps").filter("session = 'R'")
    grid = race_results(ctx).select(*KEY, "grid")
    first = laps.filter("lap = 1").groupBy(*KEY).agg(F.min("position").alias("after"), F.max(is_pit().cast("int")).alias("pit")).join(grid, KEY, "left").withColumn("gain", F.col("grid") - F.col("after")).filter("gain is not null")
    named = ctx.table("race_events").filter((F.col("lap") == 1) & text.any_word(F.col("event"), text.INCIDENT_WORDS)).select(*KEY).distinct().withColumn("named", F.lit(1))
    first = first.join(named, KEY, "left").withColumn("any_named", F.max(F.coalesce("named", F.lit(0))).over(Window.partitionBy(*RACE)))
    incident = F.when(F.col("any_named") == 1, F.coalesce("named", F.lit(0))).otherwise(((F.col("gain") <= -3) | (F.col("pit") == 1)).cast("int"))
    free = laps.filter(~is_pit() & no_caution(F.col("track_status")))
    close = F.coalesce(F.col("gap_s") < 1.5, F.lit(False))
    traffic = free.filter(F.col("lap_s").between(40, 200)).groupBy(*KEY).agg((F.avg(F.when(close, F.col("lap_s"))) - F.avg(F.when(~close, F.col("lap_s")))).alias("penalty"))
    net = pivots.position_changes(free, KEY, ["lap"], "position").select(*KEY, "net_change").join(free.groupBy(*KEY).agg((F.count_distinct("lap") - 1).alias("green")), KEY)
    per = first.withColumn("incident", incident).select(*KEY, "gain", "incident").join(traffic, KEY, "full_outer").join(net, KEY, "full_outer").withColumn("net", F.try_divide(100 * F.col("net_change"), F.col("green")))
    agg = ctx.past(per, 10).groupBy(*CUT, "driver").agg(F.avg("gain").alias("lap1_gain_avg_prev10"), F.avg("incident").alias("lap1_incident_rate_prev10"), F.avg("penalty").alias("traffic_penalty_s_prev10"), F.avg("net").alias("net_pass_index_prev10"))
    return on_roster(ctx, back(agg))


# --- risks and strategy ----------------------------------------------------------------------------------------------


def any_of(c: Column, *parts: str) -> Column:
    """Whether an upper-case text holds one of the parts."""
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def races_of(ctx: Context) -> DataFrame:
    """The rounds of the calendar: those of the meta data and of the race results."""
    return ctx.table("meta").select(*RACE).unionByName(race_results(ctx).select(*RACE)).distinct()


def chaos_stats(ctx: Context) -> DataFrame:
    """Per race of the calendar: whether and how often neutralisations came, red flags, wet and late starts, early yellows. What no
    message tells did not happen; wet starts and early yellows are unknown without rows. A virtual deployment also sets the
    safety-car flag and count, as its words contain the other's."""
    up = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    said = lambda c, *parts: F.max(any_of(up(c), *parts).cast("int"))
    control = ctx.table("race_ctrl").groupBy(*RACE).agg(
        F.greatest(said("message", "SAFETY CAR DEPLOYED", "SAFETY CAR IN THIS LAP", "SAFETY CAR THROUGH THE PIT LANE"), F.max(((up("category") == "SAFETYCAR") & up("status").isin("DEPLOYED", "IN THIS LAP")).cast("int"))).alias("sc"),
        said("message", "VIRTUAL SAFETY CAR DEPLOYED", "VIRTUAL SAFETY CAR ENDING").alias("vsc"), F.greatest(said("message", "RED FLAG"), said("flag", "RED")).alias("red"),
        said("message", "STARTING PROCEDURE SUSPENDED", "START DELAYED", "FORMATION LAP WILL START AT").alias("delayed"), said("message", "RACE WILL START BEHIND THE SAFETY CAR", "FORMATION LAP WILL BE STARTED BEHIND THE SAFETY CAR").alias("behind"),
        F.count_if(up("message").rlike(r"\bSAFETY CAR DEPLOYED\b")).alias("sc_n"), F.count_if(up("message").rlike(r"\bVIRTUAL SAFETY CAR DEPLOYED\b")).alias("vsc_n"))
    early = any_of(up("message"), "YELLOW", "SCDEPLOYED", "VSCDEPLOYED", "RED") | F.coalesce(F.col("status").isin("2", "4", "5", "6", "7"), F.lit(False))
    status = ctx.table("track_status").groupBy(*RACE).agg(
        said("message", "SCDEPLOYED").alias("sc_t"), said("message", "VSCDEPLOYED", "VSCENDING").alias("vsc_t"), said("message", "RED").alias("red_t"), F.max(F.when(F.col("t_s") <= 900, early.cast("int"))).alias("yellow"),
        F.count_if(up("message") == "SCDEPLOYED").alias("sc_tn"), F.count_if(up("message") == "VSCDEPLOYED").alias("vsc_tn"))
    session = ctx.table("session_status").groupBy(*RACE).agg(
        said("message", "VIRTUAL SAFETY CAR").alias("vsc_s"), F.greatest(said("message", "RED FLAG"), said("status", "ABORTED", "SUSPENDED", "RED")).alias("red_s"),
        F.greatest(said("message", "DELAY", "SUSPEND"), said("status", "DELAYED", "SUSPENDED")).alias("delayed_s"), said("message", "START BEHIND THE SAFETY CAR").alias("behind_s"))
    rain = F.coalesce("rain", clip(F.col("rain_prob"), 0, 1))
    first = (F.col("t_s") <= 720).cast("int")
    start = ctx.table("weather").filter("session = 'R'").withColumn("_first", F.coalesce(first, F.lit(0))).withColumn("_any", F.max("_first").over(Window.partitionBy(*RACE))).filter("_first = 1 or _any = 0")
    wet = start.groupBy(*RACE).agg(F.max((rain > 0).cast("int")).alias("wet"), F.avg(rain).alias("rain_share"))
    out = races_of(ctx).join(control, RACE, "left").join(status, RACE, "left").join(session, RACE, "left").join(wet, RACE, "left")
    one = lambda *names: F.greatest(*[F.coalesce(n, F.lit(0)) for n in names], F.lit(0))
    sums = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return out.select(*RACE, one("sc", "sc_t").alias("sc_rate"), one("vsc", "vsc_t", "vsc_s").alias("vsc_rate"), one("red", "red_t", "red_s").alias("red_flag_rate"), F.col("wet").alias("wet_start_rate"), one("delayed", "delayed_s").alias("delayed_start_rate"), one("behind", "behind_s").alias("start_behind_sc_rate"),
                      F.col("yellow").alias("early_yellow_rate"), sums("sc_n", "sc_tn").alias("sc_deploy_mean"), sums("vsc_n", "vsc_tn").alias("vsc_deploy_mean"), F.col("rain_share").alias("rainfall_share_start"))


# The weights of the index.
CHAOS_WEIGHTS = {"sc_rate": 0.28, "vsc_rate": 0.12, "red_flag_rate": 0.22, "wet_start_rate": 0.16, "start_behind_sc_rate": 0.10, "delayed_start_rate": 0.04, "early_yellow_rate": 0.08}


def with_same_event(ctx: Context, seen: DataFrame) -> DataFrame:
    """seen with ``same``: the past round has the cut-off's event name, else official name, place or circuit."""
    slug = ctx.table("meta").select(*RACE, text.slug_word(F.coalesce("event", "official", "location", "circuit")).alias("_s"))
    past, cut = slug.withColumnRenamed("_s", "_ps"), slug.select(F.col("year").alias("cut_y"), F.col("round").alias("cut_r"), F.col("_s").alias("_cs"))
    return seen.join(lookback.few(past), RACE, "left").join(lookback.few(cut), CUT, "left").withColumn("same", F.coalesce(F.col("_ps") == F.col("_cs"), F.lit(False))).drop("_ps", "_cs")


def chaos_priors(ctx: Context) -> DataFrame:
    """Per cut-off: means of the last eight races blended with those at the same event among the last ten."""
    recent, wide = int(ctx.options.get("chaos_recent_window", 8)), int(ctx.options.get("chaos_prev_n", 10))
    seen = with_same_event(ctx, ctx.past(chaos_stats(ctx), wide))
    names = [*CHAOS_WEIGHTS, "sc_deploy_mean", "vsc_deploy_mean", "rainfall_share_start"]
    late = F.col("age") <= recent
    agg = seen.groupBy(*CUT).agg(F.count_if(late).alias("chaos_pre_hist_n"), F.count_if("same").alias("chaos_pre_same_track_n"), *[F.avg(F.when(F.col("same"), F.col(c))).alias(f"s_{c}") for c in names], *[F.avg(F.when(late, F.col(c))).alias(f"r_{c}") for c in names])
    out = agg.select(*CUT, "chaos_pre_hist_n", "chaos_pre_same_track_n", *[stats.blend(F.col(f"s_{c}"), F.col(f"r_{c}"), F.col("chaos_pre_same_track_n")).alias(f"chaos_pre_{c}") for c in names])
    index = total([w * F.coalesce(F.col(f"chaos_pre_{c}"), F.lit(0.0)) for c, w in CHAOS_WEIGHTS.items()])
    return out.withColumn("chaos_pre_index", F.when(F.coalesce(*[F.col(f"chaos_pre_{c}") for c in CHAOS_WEIGHTS]).isNotNull(), index))


@feature
def event_chaos_priors_pre(ctx: Context) -> DataFrame:
    return on_roster(ctx, back(chaos_priors(ctx)), RACE).na.fill(0, ["chaos_pre_hist_n", "chaos_pre_same_track_n"])


#: The order in which sessions stand in for the race's weather where no schedule tells their times.
EARLIER_SESSIONS = ("Q", "SQ", "S", "FP3", "FP2", "FP1")
FORECAST = "FC"


def weather_source(ctx: Context) -> DataFrame:
    """The rows of each round's source, with ``tail``: whether it is an earlier session, of which the last minutes count.

    By ``weather_mode``: pre_race takes the forecast, else the latest session that the schedule has before the race (else the
    first of EARLIER_SESSIONS); auto does too and, with ``allow_fallback_actual``, then takes the race's own; forecast and actual
    take theirs alone."""
    mode, fallback = ctx.options.get("weather_mode", "pre_race"), bool(ctx.options.get("allow_fallback_actual", False))
    starts = ctx.now(ctx.table("schedule")).groupBy(*RACE, "session").agg(F.max("starts").alias("starts"))
    race = starts.filter("session = 'R'").select(*RACE, F.col("starts").alias("_race"))
    before = starts.filter("session <> 'R'").join(lookback.few(race), RACE, "left").filter(F.coalesce(F.col("starts") < F.col("_race"), F.lit(True)))
    place = before.select(*RACE, "session", F.row_number().over(Window.partitionBy(*RACE).orderBy(F.desc_nulls_last("starts"), "session")).alias("_place"))
    few = lambda df: lookback.few(df, 8 * lookback.MOST_ROUNDS)
    rows = ctx.now(ctx.table("weather")).join(few(place), [*RACE, "session"], "left").join(few(place.select(*RACE, F.lit(True).alias("_listed")).distinct()), RACE, "left")
    listed = F.coalesce(*[F.when(F.col("session") == s, F.lit(n + 1)) for n, s in enumerate(EARLIER_SESSIONS)])
    forecast, earlier, own = F.when(F.col("session") == FORECAST, 0), F.when(F.col("_listed"), F.col("_place")).otherwise(listed), F.when(F.col("session") == "R", 99)
    rank = {"forecast": forecast, "actual": own, "pre_race": F.coalesce(forecast, earlier), "auto": F.coalesce(forecast, earlier, own) if fallback else F.coalesce(forecast, earlier)}[mode]
    one = rows.withColumn("_o", rank).withColumn("_b", F.min("_o").over(Window.partitionBy(*RACE))).filter("_o = _b")
    return one.withColumn("tail", F.col("_o").between(1, 98)).drop("_place", "_listed", "_o", "_b")


def weather_means(ctx: Context) -> DataFrame:
    """Per cut-off: the source's rows within the race's own window where both have absolute times, else the last 15 minutes of an
    earlier session or the first 15 of a forecast; all of them where that leaves none."""
    w = Window.partitionBy(*RACE)
    span = ctx.table("session_windows").filter("session = 'R'").groupBy(*RACE).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    rows = weather_source(ctx).join(lookback.few(span), RACE, "left")
    absolute = F.max((F.col("utc").isNotNull() & F.col("t0").isNotNull() & F.col("t1").isNotNull()).cast("int")).over(w) == 1
    edge = F.when(F.col("tail"), F.col("t_s") >= F.max("t_s").over(w) - 900).otherwise(F.col("t_s") <= 900)
    inside = F.coalesce(F.when(absolute, F.col("utc").between(F.col("t0"), F.col("t1"))).otherwise(edge), F.lit(False))
    kept = rows.withColumn("_in", inside.cast("int")).withColumn("_any", F.max("_in").over(w)).filter("_in = 1 or _any = 0")
    p = "weather_pre_"
    rain = F.coalesce(percentile("rain_prob", 0.75), percentile("rain", 0.75))
    return kept.groupBy(*RACE).agg(F.avg("air").alias(f"{p}air_temp_mean"), F.stddev_pop("air").alias(f"{p}air_temp_std"), F.avg("track").alias(f"{p}track_temp_mean"), F.avg("humidity").alias(f"{p}humidity_mean"), F.avg("wind").alias(f"{p}wind_kph_mean"), rain.alias(f"{p}rain_prob_p75"), F.count("*").alias(f"{p}records_n"))


@feature
def weather_basic(ctx: Context) -> DataFrame:
    return on_roster(ctx, weather_means(ctx), RACE).na.fill(0, ["weather_pre_records_n"])


def conditions(ctx: Context) -> DataFrame:
    """year, round, track_temp, rain, sc, overtake with their defaults: for queries that depend on the day."""
    w, c = weather_means(ctx), back(chaos_priors(ctx)).select(*RACE, "chaos_pre_sc_rate")
    profile = tracks.profiles(ctx.now(track_keys(ctx)).select(*RACE, F.col("track").alias("slug")), ctx.tables.get("track_profiles")).select(*RACE, "track_overtake_index")
    base = ctx.cutoffs.select(*RACE).distinct().join(w, RACE, "left").join(c, RACE, "left").join(profile, RACE, "left")
    track = F.coalesce("weather_pre_track_temp_mean", F.col("weather_pre_air_temp_mean") + 5, F.lit(25.0))
    return base.select(*RACE, track.alias("track_temp"), F.coalesce("weather_pre_rain_prob_p75", F.lit(0.0)).alias("rain"), F.coalesce("chaos_pre_sc_rate", F.lit(0.25)).alias("sc"), F.coalesce("track_overtake_index", F.lit(0.5)).alias("overtake"))


@feature
def reliability_risk_pre(ctx: Context) -> DataFrame:
    rows = race_results(ctx).withColumn("bucket", text.status_bucket(F.col("status"))).withColumns({"acc": (F.col("bucket") == "accident").cast("int"), "mech": (F.col("bucket") == "mechanical").cast("int")})
    seen = ctx.past(rows, 256).withColumn("back", F.row_number().over(Window.partitionBy(*CUT, "driver").orderBy("age")))
    last = F.col("back") <= 10
    season = F.col("year") == F.col("cut_y")
    agg = back(seen.groupBy(*CUT, "driver").agg(*[F.avg(F.when(c, F.col(k))).alias(f"{k}_{n}") for k in ("acc", "mech") for n, c in (("prev", last), ("season", season))]))
    out = on_roster(ctx, agg).join(lookback.few(conditions(ctx)), RACE, "left")
    base = lambda k: 0.6 * F.coalesce(F.col(f"{k}_prev"), F.lit(0.05)) + 0.4 * F.coalesce(F.col(f"{k}_season"), F.lit(0.03))
    delta = (F.col("track_temp") - 25) / 10
    chaos = clip(F.col("sc") * F.col("overtake") * F.col("rain"), 0, 1)
    acc, mech = clip(base("acc") * (1 + 0.75 * chaos), 0, 0.8), clip(base("mech") * (1 + 0.25 * F.greatest(F.lit(0.0), delta) + 0.15 * chaos), 0, 0.8)
    return out.select(*KEY, acc.alias("reliab_accident_risk"), mech.alias("reliab_mech_risk"), (1 - (1 - acc) * (1 - mech)).alias("reliab_dnf_risk"), delta.alias("reliab_temp_delta"))


def practice_laps(ctx: Context, least_age: int = 2) -> DataFrame:
    laps = ctx.now(ctx.table("laps").filter(F.col("session").isin("FP1", "FP2", "FP3")))
    return laps.withColumn("compound", F.upper("compound")).filter(F.col("compound").isin(DRY) & (F.col("lap_s") > 0) & ~is_pit() & no_caution(F.col("track_status")) & (F.coalesce("tyre_age", F.lit(0)) >= least_age)).withColumn("ord", session_ord())


@feature
def tyre_priors_pre(ctx: Context) -> DataFrame:
    laps = ctx.table("laps").filter("session = 'R' and lap_s > 0").withColumn("compound", F.upper("compound"))
    kept = joins.without_laps(laps, laps.filter("pit_in is not null"), KEY, "lap")
    per = pivots.mix(laps, RACE, "compound", DRY, "f_").join(pivots.median_deltas(kept, RACE, "compound", "lap_s", [("SOFT", "MEDIUM"), ("MEDIUM", "HARD")]), RACE, "full_outer")
    rows = lookback.prefer_same(with_same_track(ctx, ctx.past(per, 12)), CUT, F.col("same"), 3, F.col("age") <= 8)
    mixes = back(rows.groupBy(*CUT).agg(*[middle(ctx, "tyre_recency_half_life", f"f_{c}").alias(f"compound_mix_priors_{c[0]}") for c in DRY], percentile("delta_SOFT_MEDIUM", 0.5).alias("tyre_delta_priors_s_SM"), percentile("delta_MEDIUM_HARD", 0.5).alias("tyre_delta_priors_s_MH")))
    now = stats.robust_slope(practice_laps(ctx), [*KEY, "session", "stint", "compound"], "tyre_age", "lap_s").filter("slope > 0").groupBy(*RACE, "compound").agg(percentile("slope", 0.5).alias("practice"))
    old = stats.robust_slope(kept.filter(F.col("compound").isin(DRY)), [*KEY, "stint", "compound"], "tyre_age", "lap_s").filter("slope > 0").groupBy(*RACE, "compound").agg(percentile("slope", 0.5).alias("race"))
    history = back(ctx.past(old, 12).groupBy(*CUT, "compound").agg(percentile("race", 0.5).alias("historic")))
    spread = kept.groupBy(*KEY).agg(iqr("lap_s").alias("i"))
    field_ = back(ctx.past(spread, 12).groupBy(*CUT).agg(clip(percentile("i", 0.5) / 12, 0.005, 0.08).alias("fallback")))
    factor = {"SOFT": 1.10, "MEDIUM": 1.00, "HARD": 0.90}
    every = ctx.cutoffs.select(*RACE).distinct().select(*RACE, F.explode(F.array(*[F.lit(c) for c in DRY])).alias("compound"))
    both = every.join(now, [*RACE, "compound"], "left").join(history, [*RACE, "compound"], "left").join(field_, RACE, "left").join(conditions(ctx).select(*RACE, "track_temp"), RACE, "left")
    scaled = F.coalesce("practice", "historic", F.col("fallback") * F.coalesce(*[F.when(F.col("compound") == c, F.lit(f)) for c, f in factor.items()]))
    value = clip(scaled * (1 + 0.015 * (F.col("track_temp") - 25)), 0.003, 0.12)
    deg = both.withColumn("v", value).groupBy(*RACE).agg(*[F.max(F.when(F.col("compound") == c, F.col("v"))).alias(f"expected_deg_{c[0]}") for c in DRY])
    return on_roster(ctx, deg.join(mixes, RACE, "left"), RACE)


def pit_penalties(ctx: Context) -> DataFrame:
    """Per pit stop: the in-lap and the out-lap against the median of the field on the same lap."""
    laps = ctx.table("laps").filter("session = 'R' and lap_s > 0").withColumn("ref", F.col("lap_s") - percentile("lap_s", 0.5).over(Window.partitionBy(*RACE, "lap")))
    nxt = F.lead("ref").over(Window.partitionBy(*KEY).orderBy("lap"))
    return laps.withColumn("out_pen", nxt).filter("pit_in is not null").select(*KEY, "team", "lap", F.col("ref").alias("in_pen"), "out_pen")


@feature
def strategy_priors_pre(ctx: Context) -> DataFrame:
    laps = ctx.table("laps").filter("session = 'R'")
    per = laps.groupBy(*KEY).agg((F.max("stint") - 1).alias("stops"), F.count_if(F.col("stint") == 1).alias("first_stint"))
    medians = lambda c: back(pivots.two_level_median(ctx.past(per, 8), [*CUT, *RACE], CUT, c).withColumnRenamed("median", c))
    gain = pit_penalties(ctx).withColumn("gain_ms", -1000 * (F.col("in_pen") + F.coalesce("out_pen", F.lit(0.0)))).groupBy(*RACE, "lap").agg(percentile("gain_ms", 0.5).alias("gain_ms"))
    runs = windows.longest_run(gain, F.col("gain_ms") > 250, RACE, ["lap"])
    undercut = back(ctx.past(runs, 8).groupBy(*CUT).agg(percentile("longest_run", 0.5).alias("undercut_window_width")))
    firsts = ctx.table("pit_stops").filter("lap >= 5").join(race_results(ctx).select(*KEY, "team"), KEY)
    stack = pivots.first_two_gap(firsts, [*RACE, "team"], "driver", "lap", 1)
    stacks = back(ctx.past(stack, 8).groupBy(*CUT, "team").agg(F.avg("stacked").alias("double_stack_risk"), F.avg("same").alias("double_stack_same_lap")))
    c = conditions(ctx).withColumn("d", (F.col("track_temp") - 25) / 10)
    out = c.join(medians("stops"), RACE, "left").join(medians("first_stint"), RACE, "left").join(undercut, RACE, "left")
    stops, first = F.coalesce("stops", F.lit(2.0)), F.coalesce("first_stint", F.lit(15.0))
    per_race = out.select(*RACE, clip(stops + 0.15 * F.col("d") + 0.5 * F.col("sc"), 1, 4).alias("expected_stop_count"), clip(first * (1 - 0.10 * F.col("d")) - 0.5 * F.col("sc") * 5, 5, 30).alias("first_stint_len_exp"), "undercut_window_width")
    return ctx.roster.select(*KEY, "team").distinct().join(per_race, RACE, "left").join(stacks, [*RACE, "team"], "left").drop("team")


def stops_by_team(ctx: Context, n: int = 10) -> DataFrame:
    stops = ctx.table("pit_stops").join(race_results(ctx).select(*KEY, "team"), KEY)
    return ctx.past(stops, n).filter(F.col("seconds").between(1.5, 25)).withColumn("_q", F.percentile("seconds", F.array(F.lit(0.01), F.lit(0.99))).over(Window.partitionBy(*CUT))).filter(F.col("seconds").between(F.col("_q")[0], F.col("_q")[1])).drop("_q")


@feature
def pit_ops_pre(ctx: Context) -> DataFrame:
    seen = stops_by_team(ctx)
    risk = pivots.exceedance(seen, CUT, [*CUT, "team"], "seconds").withColumnRenamed("risk", "pitcrew_slowstop_risk_team")
    team = back(seen.groupBy(*CUT, "team").agg(percentile("seconds", 0.5).alias("pitcrew_time_team_p50_s"), percentile("seconds", 0.9).alias("pitcrew_time_team_p90_s")).join(risk, [*CUT, "team"]))
    pens = pit_penalties(ctx).filter((F.abs("in_pen") <= 60) & (F.abs("out_pen") <= 60)).withColumn("under", F.col("in_pen") - F.col("out_pen")).groupBy(*RACE).agg(percentile("under", 0.5).alias("under"), percentile(-F.col("under"), 0.5).alias("over"))
    rows = lookback.prefer_same(with_same_track(ctx, ctx.past(pens, 10)), CUT, F.col("same"), 2, F.lit(True))
    gains = back(rows.groupBy(*CUT).agg(percentile("under", 0.5).alias("undercut_gain_hist_s"), percentile("over", 0.5).alias("overcut_gain_hist_s")))
    return ctx.roster.select(*KEY, "team").distinct().join(team, [*RACE, "team"], "left").join(gains, RACE, "left").drop("team")


@feature
def pit_ops_risk_pre(ctx: Context) -> DataFrame:
    seen = stops_by_team(ctx)
    risk = pivots.exceedance(seen, CUT, [*CUT, "team"], "seconds")
    team = back(seen.groupBy(*CUT, "team").agg((1000 * iqr("seconds")).alias("pitcrew_iqr_team")).join(risk, [*CUT, "team"]))
    under = back(ctx.past(pit_penalties(ctx), 10).groupBy(*CUT).agg(percentile(-(F.col("in_pen") + F.coalesce("out_pen", F.lit(0.0))), 0.5).alias("under")))
    out = ctx.roster.select(*KEY, "team").distinct().join(team, [*RACE, "team"], "left").join(under, RACE, "left").join(conditions(ctx).select(*RACE, "sc"), RACE, "left")
    cond = clip(F.col("risk") * (1 + 0.6 * (F.col("sc") - 0.25)) * (1 + 0.25 * clip(F.coalesce("under", F.lit(0.0)) / 5, 0, 1)), 0, 1)
    return out.select(*KEY, "pitcrew_iqr_team", F.col("risk").alias("slowstop_risk_team"), cond.alias("slowstop_risk_cond_SC"))


# --- the current weekend ---------------------------------------------------------------------------------------------


def practice_runs(ctx: Context, least: int = 5) -> DataFrame:
    """Runs of at least five dry green laps: pace, slope, spread and the best mean of three laps in a row."""
    key = [*KEY, "session", "ord", "stint", "compound"]
    rows = practice_laps(ctx)
    three = Window.partitionBy(*key).orderBy("lap", "tyre_age").rowsBetween(-2, 0)
    rows = rows.withColumn("b3", F.when(F.count("lap_s").over(three) == 3, F.avg("lap_s").over(three)))
    runs = rows.groupBy(*key).agg(F.count("*").alias("n"), percentile("lap_s", 0.5).alias("pace"), (percentile("lap_s", 0.75) - percentile("lap_s", 0.25)).alias("iqr"), F.min("b3").alias("best3")).filter(F.col("n") >= least)
    return runs.join(stats.robust_slope(rows, key, "tyre_age", "lap_s"), key, "left")


@feature
def practice_longrun_pre(ctx: Context) -> DataFrame:
    p, runs = "prac_pre_", practice_runs(ctx)
    tie = [F.asc("stint"), F.asc("compound")]
    long = pick(runs, KEY, [F.desc("n"), F.desc("ord"), F.asc_nulls_last("best3"), *tie]).select(*KEY, F.col("pace").alias(f"{p}longrun_pace_s"), F.col("slope").alias(f"{p}longrun_deg_s_per_lap"), F.col("iqr").alias(f"{p}longrun_iqr_s"), F.col("n").alias(f"{p}longrun_laps"), F.col("ord").alias(f"{p}longrun_session_ord"))
    short = pick(runs.filter("best3 is not null"), KEY, [F.asc("best3"), F.desc("ord"), *tie]).select(*KEY, F.col("best3").alias(f"{p}shortrun_best3_s"), F.col("ord").alias(f"{p}shortrun_session_ord"))
    n = runs.groupBy(*KEY).agg(F.count("*").alias(f"{p}dry_runs_n"))
    return on_roster(ctx, n.join(long, KEY, "left").join(short, KEY, "left"))


@feature
def practice_compound_pre(ctx: Context) -> DataFrame:
    p = "prac_cmp_pre_"
    best = pick(practice_laps(ctx, 0), [*KEY, "compound"], [F.asc("lap_s"), F.desc("ord"), F.asc("lap")]).groupBy(*KEY).agg(F.count("*").alias(f"{p}dry_compounds_n"), *[F.max(F.when(F.col("compound") == c, F.col("lap_s"))).alias(f"{p}{c[0].lower()}_best_s") for c in DRY])
    long = pick(practice_runs(ctx), [*KEY, "compound"], [F.desc("n"), F.desc("ord"), F.asc("pace"), F.asc("stint")]).groupBy(*KEY).agg(*[F.max(F.when(F.col("compound") == c, F.col(x))).alias(f"{p}{c[0].lower()}_{n}") for c in DRY for x, n in (("pace", "longrun_pace_s"), ("slope", "deg_s_per_lap"))])
    out = best.join(long, KEY, "left").withColumns({f"{p}crossover_sm_s": F.col(f"{p}m_best_s") - F.col(f"{p}s_best_s"), f"{p}crossover_mh_s": F.col(f"{p}h_best_s") - F.col(f"{p}m_best_s")})
    return on_roster(ctx, out)


def mates(ctx: Context, df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """df with, for each column, the difference from the first team mate (by name) that has a value. One window for all columns."""
    w = Window.partitionBy(*RACE, "_team")
    out = df.join(ctx.roster.groupBy(*KEY).agg(F.max("team").alias("_team")), KEY, "left")
    has = {x: F.col("_team").isNotNull() & F.col(x).isNotNull() for x in pairs}
    value = lambda x: F.struct("driver", F.col(x).alias("v"))
    out = out.withColumns({f"_1_{x}": F.min(F.when(c, value(x))).over(w) for x, c in has.items()})
    out = out.withColumns({f"_2_{x}": F.min(F.when(c & (F.col("driver") != F.col(f"_1_{x}.driver")), value(x))).over(w) for x, c in has.items()})
    delta = {name: F.when(has[x], F.col(x) - F.when(F.col("driver") == F.col(f"_1_{x}.driver"), F.col(f"_2_{x}.v")).otherwise(F.col(f"_1_{x}.v"))) for x, name in pairs.items()}
    return out.withColumns(delta).drop("_team", *[f"_{i}_{x}" for i in (1, 2) for x in pairs])


@feature
def practice_readiness_pre(ctx: Context) -> DataFrame:
    """Who ran how much in practice. Who did not run, and flags of sessions that nobody ran, are unknown."""
    p = "ready_pre_"
    laps = ctx.now(ctx.table("laps").filter(F.col("session").isin("FP1", "FP2", "FP3") & F.col("lap_s").isNotNull())).withColumn("ord", session_ord())
    flags = {"accurate": F.coalesce("is_accurate", F.lit(True)), "green": is_green(F.col("track_status")), "dry": F.coalesce(F.upper("compound").isin(DRY), F.lit(False))}
    per = laps.groupBy(*KEY, "session", "ord").agg(F.count("*").alias("n"), *[F.avg(c.cast("int")).alias(k) for k, c in flags.items()])
    agg = per.groupBy(*KEY).agg(F.count("*").alias(f"{p}sessions_seen_n"), F.sum("n").alias(f"{p}total_laps"), *[stats.weighted_mean(F.col(k), F.col("n")).alias(f"{p}{k}_share") for k in flags], F.max("ord").alias(f"{p}latest_session_ord"), F.max_by("n", "ord").alias(f"{p}latest_session_laps"), *[F.max((F.col("session") == s).cast("int")).alias(f"has_{s}") for s in ("FP2", "FP3")])
    held = per.groupBy(*RACE).agg(*[F.max((F.col("session") == s).cast("int")).alias(f"held_{s}") for s in ("FP2", "FP3")])
    out = on_roster(ctx, agg).join(lookback.few(held), RACE, "left")
    out = out.withColumns({f"{p}missing_{s.lower()}_flag": F.when(F.col(f"held_{s}") == 1, 1 - F.col(f"has_{s}")) for s in ("FP2", "FP3")})
    out = mates(ctx, out, {f"{p}total_laps": f"{p}total_laps_tm_delta", f"{p}accurate_share": f"{p}accurate_share_tm_delta"})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    issue = 0.6 * zero(F.col(f"{p}missing_fp3_flag")) + 0.35 * zero(F.col(f"{p}missing_fp2_flag")) + zero(clip(-F.col(f"{p}total_laps_tm_delta") / 25, 0, 1)) + zero(clip(0.9 - F.col(f"{p}accurate_share"), 0, 0.9))
    return out.withColumn(f"{p}issue_index", F.when(F.col("held_FP2").isNotNull(), clip(issue, 0, 3))).drop("has_FP2", "has_FP3", "held_FP2", "held_FP3")


def quali_laps(ctx: Context) -> DataFrame:
    """Timed laps of the qualifying; good ones are green, accurate and not deleted."""
    laps = ctx.now(ctx.table("laps").filter("session = 'Q' and lap_s is not null"))
    return laps.withColumn("good", is_green(F.col("track_status")) & F.coalesce("is_accurate", F.lit(True)) & ~F.coalesce("deleted", F.lit(False)))


def good_or_all(laps: DataFrame) -> DataFrame:
    """The good laps; where a whole field has none, all of them."""
    return laps.withColumn("_any", F.max("good").over(Window.partitionBy(*RACE))).filter(F.col("good") | ~F.col("_any")).drop("_any")


def quali_times(ctx: Context) -> DataFrame:
    """position, best time and the stage reached of the qualifying's results."""
    res = ctx.now(ctx.table("results").filter("session = 'Q'"))
    return res.select(*KEY, "position", text.row_stat([F.col("q1"), F.col("q2"), F.col("q3"), F.col("time")], "min").alias("best"), text.stage_reached(F.col("q1"), F.col("q2"), F.col("q3")).alias("stage"))


@feature
def quali_execution_pre(ctx: Context) -> DataFrame:
    p, laps = "qexec_pre_", quali_laps(ctx)
    out_lap = F.sum(F.col("pit_out").isNotNull().cast("int")).over(Window.partitionBy(*KEY).orderBy("lap", "time_s").rowsBetween(Window.unboundedPreceding, 0))
    runs = good_or_all(laps.withColumn("run", F.coalesce("stint", out_lap))).withColumn("_last", F.max("run").over(Window.partitionBy(*KEY)))
    agg = runs.groupBy(*KEY).agg(F.min("lap_s").alias("lap_best"), (F.min("s1") + F.min("s2") + F.min("s3")).alias("ideal"), (F.min(F.when(F.col("run") < F.col("_last"), F.col("lap_s"))) - F.min(F.when(F.col("run") == F.col("_last"), F.col("lap_s")))).alias(f"{p}final_run_improve_s"), F.count("*").alias(f"{p}timed_laps_n"))
    gone = laps.groupBy(*KEY).agg(F.avg(F.coalesce("deleted", F.lit(False)).cast("int")).alias(f"{p}deleted_lap_share"))
    out = quali_times(ctx).join(agg.join(gone, KEY), KEY, "full_outer").withColumn("best", F.coalesce("best", "lap_best"))
    out = out.withColumns({f"{p}best_lap_s": F.col("best"), f"{p}gap_to_pole_s": F.col("best") - F.min("best").over(Window.partitionBy(*RACE)), f"{p}ideal_lap_gap_s": F.col("lap_best") - F.col("ideal"), f"{p}stage_reached": F.col("stage")})
    out = mates(ctx, out, {f"{p}best_lap_s": f"{p}gap_to_tm_s"})
    return on_roster(ctx, out.select(*KEY, *[c for c in out.columns if c.startswith(p)]))


@feature
def quali_evolution_pre(ctx: Context) -> DataFrame:
    """Where in the session laps were set; positions are whole thousandths of the session, so that frames are exact."""
    p, laps = "qevo_pre_", good_or_all(quali_laps(ctx).filter("time_s is not null"))
    progress = clip(F.try_divide(F.col("time_s"), F.max("time_s").over(Window.partitionBy(*RACE))), 0, 1)
    rows = laps.withColumn("progress", progress).withColumn("_m", F.round(F.col("progress") * 1000).cast("long"))
    rows = windows.with_band_best(rows, RACE, "lap_s", "_m", 75, "band").withColumn("session_best", F.min("lap_s").over(Window.partitionBy(*RACE)))
    best = pick(rows, KEY, [F.asc("lap_s"), F.asc("time_s")]).select(*KEY, F.col("progress").alias(f"{p}best_lap_progress_pct"), (F.col("lap_s") - F.col("band")).alias(f"{p}window_gap_s"), (F.col("band") - F.col("session_best")).alias(f"{p}timing_luck_s"))
    agg = rows.groupBy(*KEY).agg(F.max("progress").alias(f"{p}final_push_progress_pct"), F.avg((F.col("progress") >= 0.6).cast("int")).alias(f"{p}late_push_share"), F.count("*").alias(f"{p}push_laps_n"))
    out = on_roster(ctx, best.join(agg, KEY))
    return out.withColumn(f"{p}window_rank_pct", windows.percent_rank_avg(f"{p}window_gap_s", RACE))


@feature
def weekend_team_delta_pre(ctx: Context) -> DataFrame:
    """Differences from the team mate in qualifying and practice, and how even the sectors are."""
    p = "wknd_pre_"
    clean = quali_laps(ctx).filter(is_green(F.col("track_status")) & F.coalesce("is_accurate", F.lit(True)))
    sectors = clean.groupBy(*KEY).agg(*[F.min(s).alias(s) for s in ("s1", "s2", "s3")])
    prac = practice_longrun_pre(ctx).select(*KEY, F.col("prac_pre_shortrun_best3_s").alias("short"), F.col("prac_pre_longrun_pace_s").alias("long"), F.col("prac_pre_longrun_deg_s_per_lap").alias("deg"))
    out = on_roster(ctx, quali_times(ctx).select(*KEY, "best", "position")).join(sectors, KEY, "left").join(prac, KEY, "left")
    names = {"best": "q_tm_delta_s", "position": "q_pos_tm_delta", "s1": "q_s1_tm_delta_s", "s2": "q_s2_tm_delta_s", "s3": "q_s3_tm_delta_s", "long": "prac_longrun_tm_delta_s", "deg": "prac_deg_tm_delta_s_per_lap", "short": "prac_shortrun_tm_delta_s"}
    out = mates(ctx, out, {x: f"{p}{n}" for x, n in names.items()})
    size = ctx.roster.select(*KEY, "team").distinct().filter("team is not null").withColumn("_size", F.count("*").over(Window.partitionBy(*RACE, "team"))).select(*KEY, F.when(F.col("_size") >= 2, (F.col("_size") == 2).cast("int")).alias(f"{p}tm_has_pair"))
    deltas, own = [F.col(f"{p}q_s{i}_tm_delta_s") for i in (1, 2, 3)], [F.col(f"s{i}") for i in (1, 2, 3)]
    out = out.join(size, KEY, "left").withColumns({f"{p}q_sector_tm_delta_std_s": text.row_stat(deltas, "std"), f"{p}q_sector_tm_delta_max_s": text.row_stat(deltas, "max"), f"{p}q_sector_tm_delta_min_s": text.row_stat(deltas, "min"), f"{p}q_sector_balance_std_s": text.row_stat(own, "std"), f"{p}q_sector_balance_span_s": text.row_stat(own, "max") - text.row_stat(own, "min")})
    return out.select(*KEY, *[c for c in out.columns if c.startswith(p)])


@feature
def weekend_field_form_pre(ctx: Context) -> DataFrame:
    p = "field_pre_"
    q = quali_execution_pre(ctx).select(*KEY, F.col("qexec_pre_best_lap_s").alias("q"))
    prac = practice_longrun_pre(ctx).select(*KEY, F.col("prac_pre_shortrun_best3_s").alias("s"), F.col("prac_pre_longrun_pace_s").alias("l"))
    wk = weekend_team_delta_pre(ctx).select(*KEY, F.col("wknd_pre_q_tm_delta_s").alias("d"))
    rows = q.join(prac, KEY, "left").join(wk, KEY, "left")
    w = Window.partitionBy(*RACE)
    ranks = {"q": "q_rank_pct", "s": "prac_short_rank_pct", "l": "prac_longrun_rank_pct", "d": "tm_delta_rank_pct"}
    out = rows.withColumns({f"{p}q_gap_to_best_s": F.col("q") - F.min("q").over(w), f"{p}q_gap_to_median_s": F.col("q") - percentile("q", 0.5).over(w), **{f"{p}{n}": windows.percent_rank_avg(x, RACE) for x, n in ranks.items()}})
    known = [F.col(f"{p}{n}") for n in ranks.values()]
    return out.select(*KEY, *[c for c in out.columns if c.startswith(p)], text.row_stat(known, "count").alias(f"{p}available_scores_n"), text.row_stat(known, "mean").alias(f"{p}combo_rank_pct"))


@feature
def sprint_weekend_pre(ctx: Context) -> DataFrame:
    """Sprint qualifying and sprint of the weekend. has_data tells whether the weekend has results of either."""
    p, res = "sprint_pre_", ctx.now(ctx.table("results"))
    times = text.row_stat([F.col("q1"), F.col("q2"), F.col("q3"), F.col("time")], "min")
    sq = res.filter("session = 'SQ'").select(*KEY, F.col("position").alias(f"{p}sq_pos"), times.alias(f"{p}sq_best_s"))
    s = res.filter("session = 'S'").select(*KEY, F.col("position").alias(f"{p}finish_pos"), (F.col("grid") - F.col("position")).alias(f"{p}gain_vs_grid"), F.col("points").alias(f"{p}points"))
    out = on_roster(ctx, sq.join(s, KEY, "full_outer")).withColumns({f"{p}sq_gap_to_best_s": F.col(f"{p}sq_best_s") - F.min(f"{p}sq_best_s").over(Window.partitionBy(*RACE)), f"{p}gain_abs": F.abs(f"{p}gain_vs_grid")})
    out = mates(ctx, out, {f"{p}sq_best_s": f"{p}sq_tm_delta_s", f"{p}finish_pos": f"{p}tm_finish_delta"})
    named = ctx.now(ctx.table("meta")).groupBy(*RACE).agg(F.max(F.lower("format").contains("sprint").cast("int")).alias("named"))
    present = res.filter("session in ('S', 'SQ')").select(*RACE).distinct().withColumn("present", F.lit(1))
    flags = ctx.cutoffs.select(*RACE).distinct().join(lookback.few(named), RACE, "left").join(lookback.few(present), RACE, "left").select(*RACE, F.greatest(F.coalesce("named", F.lit(0)), F.coalesce("present", F.lit(0))).alias(f"{p}format_flag"), F.coalesce("present", F.lit(0)).alias(f"{p}has_data"))
    return out.join(lookback.few(flags), RACE, "left")


@feature
def telemetry_efficiency_pre(ctx: Context) -> DataFrame:
    p = "tele_eff_pre_"
    order = {"Q": 4, "FP3": 3, "FP2": 2}
    rows = ctx.now(ctx.table("telemetry").filter(F.col("session").isin(list(order)))).withColumn("ord", F.coalesce(*[F.when(F.col("session") == s, F.lit(n)) for s, n in order.items()]))
    best = pick(telemetry.efficiency(rows, [*KEY, "ord"], "speed", "throttle", "brake", "drs"), KEY, [F.desc("ord"), F.desc("samples"), F.desc("speed_p95")])
    names = {"ord": "session_ord", "samples": "samples_n", "speed_p95": "speed_p95_kph", "speed_max": "speed_max_kph", "full_throttle_share": "full_throttle_share", "brake_share": "brake_share", "brake_speed_mean": "brake_speed_mean_kph", "drs_share": "drs_open_share", "drs_gain": "drs_speed_gain_kph"}
    out = best.select(*KEY, *[F.col(c).alias(f"{p}{n}") for c, n in names.items()])
    return on_roster(ctx, mates(ctx, out, {f"{p}speed_p95_kph": f"{p}speed_tm_delta_kph", f"{p}drs_speed_gain_kph": f"{p}drs_gain_tm_delta_kph"}))


@feature
def results_target(ctx: Context) -> DataFrame:
    """The target, from the round's own race: never an input."""
    rows = ctx.now(ctx.table("results").filter("session = 'R'"))
    return rows.select(*KEY, F.col("position").alias("finish_position"), F.col("status").alias("Status"), F.col("points").alias("Points"), F.col("grid").alias("GridPosition"), F.col("time").alias("Time"))


# --- building --------------------------------------------------------------------------------------------------------


def roster_of(tables: dict[str, DataFrame], cutoffs: DataFrame) -> DataFrame:
    """The drivers of each cut-off: its qualifying, else its entry list (the qualifying's first), else its practice laps, else the
    latest earlier race. The round's own race is never read."""
    now = lookback.fixed(cutoffs.select(*RACE).distinct())
    res, laps, entries = tables["results"], tables.get("laps"), tables.get("entries")
    people = [*KEY, "team"]
    of_now = lambda df: df.filter("driver is not null").join(lookback.few(now), RACE, "left_semi").select(*people)
    sources = [of_now(res.filter("session = 'Q'"))]
    if entries is not None:
        sources += [of_now(entries.filter("session = 'Q'")), of_now(entries.filter("session <> 'Q'"))]
    if laps is not None:
        sources.append(of_now(laps.filter("session <> 'R'")))
    sources.append(lookback.seen_by(res.filter("session = 'R'"), now, 1).select(F.col("cut_y").alias("year"), F.col("cut_r").alias("round"), "driver", "team"))
    return lookback.first_available(sources, RACE).groupBy(*KEY).agg(F.max("team").alias("team"))


def build(ctx: Context, names: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """One row per round and driver of the roster with the columns of all queries; a column that two have must agree."""
    chosen = [n for n in (names or [n for n in FEATURES if n not in EXPERIMENTAL and n != "results_target"]) if n not in exclude]
    out = ctx.roster.select(*KEY).distinct()
    for n in chosen:
        out = joins.coalesce_outer(out, FEATURES[n](ctx), KEY)
    return out


def train_table(features: DataFrame, targets: DataFrame) -> DataFrame:
    rows = features.join(targets, KEY)
    named = rows.withColumn("result_outcome", text.outcome(F.col("Status"), F.col("finish_position")))
    return named.withColumns({"outcome_id": text.outcome_id(F.col("result_outcome")), "finish_pos_eff": text.effective_position(F.col("result_outcome"), F.col("finish_position"))})
