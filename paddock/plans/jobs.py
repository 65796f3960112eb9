"""What a season's work consists of, from files to standings: ingest, build, train, predict, simulate, audit, refresh.

Each job reads and writes tables in folders that all executors share, and none of them collects rows: features and targets are
tables by (year, round), of which a job replaces the rounds that it computes. A round is observed once files of its weekend are
there; before that it is a future round, for which only queries that read nothing of the weekend are built, and only a model
that was trained on those columns is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import audit, lookback, scoring, stats
from ..sources import weekend
from ..sources.files import exists, missing_rounds, united, write_rounds
from . import artifacts, training
from . import features as fq

RACE, KEY = fq.RACE, fq.KEY
# Eras of the rules, their last years, and what a race of them weighs; columns that are no features.
ERAS = (("pre_2000", 1999, 0.03), ("v10_groove", 2004, 0.08), ("v8_refuel", 2008, 0.12), ("aero_kers", 2013, 0.18), ("hybrid_v6_initial", 2016, 0.30), ("wide_aero_hybrid", 2021, 0.50), ("ground_effect", 2025, 0.75), ("next_gen_2026", 9999, 1.00))
NO_FEATURES = ["year", "round", "finish_position", "finish_pos", "finish_order", "position", "place", "finish_pos_eff", "outcome_id", "result_outcome", "Points", "GridPosition", "Status", "Time"]
BLOCKED = r"_last_seen_(year|round)$|^(quali_pre|driver_team_pre).*_hist_n$|^quali_pre_pos_iqr$|^driver_team_pre_driver_finish_iqr$"
ONE_HOT = ("track_is_", "team_is_", "driver_is_", "track_cluster_")


def ingest(spark: SparkSession, folder: str, path: str) -> None:
    """A folder of weekend files as canonical Parquet tables."""
    weekend.store(weekend.read(spark, folder), path)


def calendar(tables: dict[str, DataFrame]) -> DataFrame:
    """The rounds of which there are files or a schedule."""
    named = [tables[t].select(*RACE) for t in ("laps", "results", "meta", "schedule") if t in tables]
    return united(named).distinct()


def observed(tables: dict[str, DataFrame]) -> DataFrame:
    """The rounds of whose weekend there are laps, results or weather."""
    return united([tables[t].select(*RACE) for t in ("laps", "results", "weather") if t in tables]).distinct()


def context(spark: SparkSession, path: str, cutoffs: DataFrame, **options) -> fq.Context:
    """Queries' input over ingested tables; cutoffs: year, round."""
    tables = weekend.stored(spark, path, fq.TABLES)
    cut = cutoffs.select(*RACE).distinct()
    return fq.Context(tables, cut, fq.roster_of(tables, cut), options)


def build_features(spark: SparkSession, path: str, out: str, cutoffs: DataFrame | None = None, names: list[str] | None = None, exclude: list[str] = (), skip_existing: bool = False, **options) -> DataFrame:
    """Writes the features of the cut-offs (all rounds with laps or results, if none are given) and their targets, and returns all
    features written so far. Observed rounds get every query, or those named; future ones the queries that need no weekend."""
    tables = weekend.stored(spark, path, fq.TABLES)
    known = observed(tables)
    cut = (cutoffs if cutoffs is not None else known).select(*RACE).distinct()
    if skip_existing and exists(spark, f"{out}/features"):
        cut = cut.join(spark.read.parquet(f"{out}/features").select(*RACE).distinct(), RACE, "left_anti")
    now, later = cut.join(lookback.few(known), RACE, "left_semi"), cut.join(lookback.few(known), RACE, "left_anti")
    future = [n for n in (names or fq.FUTURE_SAFE) if n in fq.FUTURE_SAFE]
    for rounds, chosen, mode in ((now, names, "observed"), (later, future, "future")):
        ctx = context(spark, path, rounds, **options)
        if not ctx.roster.isEmpty():
            write_rounds(fq.build(ctx, chosen, exclude).withColumn("scenario_mode", F.lit(mode)), f"{out}/features")
            targets = fq.results_target(ctx)
            if not targets.isEmpty():
                write_rounds(targets, f"{out}/targets")
    return built(spark, out)


def built(spark: SparkSession, out: str, what: str = "features") -> DataFrame:
    """Rounds may have different columns, as each knows its own tracks; a column that a round lacks is null."""
    return spark.read.option("mergeSchema", True).parquet(f"{out}/{what}")


def era_of(year: Column) -> Column:
    return F.coalesce(*[F.when(year <= last, F.lit(name)) for name, last, _ in ERAS])


def race_weights(rounds: DataFrame, half_life: float | None = None, eras: dict[str, float] | None = None) -> DataFrame:
    """year, round, weight of mean 1: halved every ``half_life`` races back (None: not), times that of the round's era ({}: the fixed ones, None: none)."""
    one = rounds.select(*RACE).distinct()
    age = F.row_number().over(Window.orderBy(F.desc("year"), F.desc("round"))) - 1
    maps = [one.withColumn("weight", stats.half_life_weight(age, half_life) if half_life else F.lit(1.0))]
    if eras is not None:
        worth = {name: w for name, _, w in ERAS} | eras
        maps.append(one.withColumn("weight", F.coalesce(*[F.when(era_of(F.col("year")) == n, F.lit(float(w))) for n, w in worth.items()])))
    return scoring.combined_weights(maps, RACE)


def train_model(spark: SparkSession, out: str, model_path: str, last: int = 6, future: bool = False, keep: list[str] = (), drop: list[str] = (), half_life: float | None = None, eras: dict[str, float] | None = None, **options) -> training.Fit:
    """Trains on all built rounds but the last ones, which validate, and stores the model with its scaler and metrics.

    Features are chosen on the training rows alone: numbers, not blocked, not all null, with the prefixes to keep and without those
    to drop; for the future profile only those known before a weekend."""
    rows = fq.train_table(built(spark, out), built(spark, out, "targets"))
    split = scoring.time_split(rows, "year", "round", last)
    train, held = split.filter("not is_validation").drop("is_validation"), split.filter("is_validation").drop("is_validation")
    names = columns.filter_columns(columns.select_features(train, NO_FEATURES, drop_pattern=BLOCKED), keep=list(keep), drop=list(drop))
    names = columns.future_columns(names) if future else names
    scaler = scoring.fit_scaler(train, names, [n for n in names if n.startswith(ONE_HOT)])
    weights = race_weights(train, half_life or (8.0 if future else None), eras)
    ready = scoring.apply_scaler(train, scaler, names).join(lookback.few(weights), RACE)
    finished = lambda df: df.withColumn("finish_position", F.when(F.col("outcome_id") == 0, F.col("finish_position")))
    fitted = training.fit(finished(ready), names, RACE, finished(scoring.apply_scaler(held, scaler, names)), "driver", weight="weight", **options)
    told = [r.asDict() for r in scaler.collect()]
    metrics = dict(fitted.metrics[fitted.best - 1]) if fitted.best else {}
    artifacts.save(spark, fitted.model, model_path, metrics | {"feature_profile": "future" if future else "full"}, told)
    return fitted


def usable_model(spark: SparkSession, paths: list[str], future: bool) -> str:
    """The first of the models that may be used: for a future round one of the future profile."""
    for path in paths:
        if exists(spark, path) and (not future or artifacts.told(spark, path)["metrics"].get("feature_profile") == "future"):
            return path
    raise ValueError("no model for this kind of round")


def predict(spark: SparkSession, features: DataFrame, model_path: str, temperature: float = 1.2, grid: Column | None = None, grid_weight: float = 0.0) -> DataFrame:
    """features' rounds with p_finish, p_dnf, p_dsq, predicted_outcome, score, p_win and rank. A feature that the rows lack counts as
    missing, so it takes the training's mean. With a grid, places behind the first cost by ``grid_weight``."""
    model, told = artifacts.load(spark, model_path), artifacts.told(spark, model_path)
    lacking = {n: F.lit(None).cast("double") for n in model.features if n not in features.columns}
    scaler = spark.createDataFrame([(r["feature"], float(r["mean"]), float(r["std"])) for r in told["scaler"]], "feature string, mean double, std double")
    ready = scoring.apply_scaler(features.withColumns(lacking).withColumns({n: F.col(n).cast("double") for n in model.features if n not in lacking}), scaler, model.features)
    scored = training.score(ready, model, RACE, temperature)
    if grid is not None and grid_weight:
        scored = scoring.regridded(scored.withColumn("score_status", 2 * F.col("p_finish") + F.col("p_dnf")).withColumn("_grid", grid), RACE, F.col("_grid"), grid_weight, temperature).drop("_grid", "score_status")
    place = F.row_number().over(Window.partitionBy(*RACE).orderBy(F.desc("score"), "driver"))
    return scored.select(*KEY, "p_finish", "p_dnf", "p_dsq", "predicted_outcome", "rank_score", "score", "p_win", place.alias("rank"))


def simulate_season(spark: SparkSession, features: DataFrame, model_path: str, teams: DataFrame | None = None, temperature: float = 1.2) -> tuple[DataFrame, DataFrame | None]:
    """Standings of each year's drivers, and of teams if a roster (year, round, driver, team) is given, over the predicted rounds. Who
    is not predicted to finish brings no points."""
    ranked = predict(spark, features, model_path, temperature).withColumn("place", F.when(F.col("predicted_outcome") == "finish", F.col("rank")).otherwise(F.lit(99)))
    drivers = scoring.standings(ranked, "driver", "place", ["round"], ["year"])
    if teams is None:
        return drivers, None
    people = teams.groupBy(*KEY).agg(F.max("team").alias("team")).filter("team is not null")
    return drivers, scoring.standings(ranked.join(people, KEY), "team", "place", ["round"], ["year"])


def audit_features(features: DataFrame, targets: DataFrame, last: int = 6) -> DataFrame:
    """Per feature: missing and constant shares, PSI between the last rounds and those before, Spearman's rho with the finishing
    position in both, and whether it leaks the target."""
    rows = scoring.time_split(fq.train_table(features, targets), "year", "round", last)
    names = columns.select_features(rows, [*NO_FEATURES, "is_validation"], skip_empty=False)
    health = audit.column_health(rows, RACE, names)
    rho = audit.spearman(rows, ["is_validation"], names, "finish_pos_eff")
    wide = rho.groupBy("feature").agg(F.max(F.when(~F.col("is_validation"), F.col("rho"))).alias("rho_train"), F.max(F.when(F.col("is_validation"), F.col("rho"))).alias("rho_validation"))
    leaks = audit.leakage(rows, RACE, names, "finish_pos_eff")
    out = health.join(audit.psi(rows, names, "is_validation"), "feature", "left").join(wide, "feature", "left")
    return out.join(leaks.drop(*[c for c in leaks.columns if c != "feature" and c in out.columns]), "feature", "left")


def refresh(spark: SparkSession, folder: str, path: str, out: str, now: Column, fetch: Callable[[DataFrame], None] | None = None, **options) -> DataFrame:
    """Rounds of the schedule that are over and not yet ingested; ``fetch`` may bring their files. What is then new is ingested and
    built, other rounds stay; the rounds are returned."""
    plan = weekend.schedule(spark, folder).groupBy(*RACE).agg(F.max("starts").alias("starts"))
    have = weekend.stored(spark, path, fq.TABLES) if exists(spark, path) else {}
    present = have["results"].filter("session = 'R'").select(*RACE).distinct() if "results" in have else spark.createDataFrame([], "year int, round int")
    due = missing_rounds(plan, present, ["starts"], now)
    # a calendar's rounds are few; they are fixed before what they were told from changes
    rounds = spark.createDataFrame([(r.year, r["round"]) for r in due.limit(lookback.MOST_ROUNDS).collect()], "year int, round int")
    if fetch is not None:
        fetch(rounds)
    ingest(spark, folder, path)
    if not rounds.isEmpty():
        build_features(spark, path, out, rounds, **options)
    return rounds
