"""Per-lap and per-session aggregates of sampled signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import percentile, rate


def derivative(df: DataFrame, key: list[str], t: str, x: str) -> DataFrame:
    """df with rate_of: the change of x per second since the row before; null at the start and for equal times."""
    w = Window.partitionBy(*key).orderBy(t)
    return df.withColumn("rate_of", F.try_divide(F.col(x) - F.lag(x).over(w), F.col(t) - F.lag(t).over(w)))


def per_lap(df: DataFrame, key: list[str], t: str, speed: str, throttle: str, brake: str, gear: str, drs: str, rpm: str | None = None) -> DataFrame:
    """Per key (a driver's lap): mean, greatest value and spread of each signal, shares, 95th percentiles of engine speed,
    acceleration and deceleration, and gear shifts a second (the first gear counts as one), in one aggregate."""
    w = Window.partitionBy(*key).orderBy(t)
    geared = Window.partitionBy(*key, F.col(gear).isNotNull()).orderBy(t)
    shift = F.when(F.col(gear).isNotNull(), F.coalesce(F.col(gear) != F.lag(gear).over(geared), F.lit(True)).cast("int"))
    rows = derivative(df, key, t, speed).withColumn("_shift", shift)
    signals = [c for c in (speed, throttle, brake, gear, rpm, drs) if c]
    stats = [f(c).alias(f"{c}_{n}") for c in signals for n, f in (("mean", F.avg), ("max", F.max), ("std", F.stddev_samp))]
    seconds = F.max(t) - F.min(t)
    return rows.groupBy(*key).agg(
        *stats, rate(F.col(throttle) >= 90).alias("throttle_p90_share"), rate(F.col(brake) > 0).alias("brake_active_share"), rate(F.col(drs) > 0).alias("drs_share"), *([percentile(rpm, 0.95).alias(f"{rpm}_p95")] if rpm else []),
        percentile(F.when(F.col("rate_of") > 0, F.col("rate_of")), 0.95).alias("accel_p95"), percentile(F.when(F.col("rate_of") < 0, -F.col("rate_of")), 0.95).alias("decel_p95"),
        F.try_divide(F.sum("_shift"), F.when(seconds > 0, seconds)).alias("shift_rate_hz"), F.count("*").alias("samples"))


def per_race(laps: DataFrame, key: list[str]) -> DataFrame:
    """The mean over laps of everything that ``per_lap`` gave: laps count alike, however many samples they have."""
    return laps.groupBy(*key).agg(*[F.avg(c).alias(c) for c, kind in laps.dtypes if c not in key and kind in ("double", "bigint", "int")])


def efficiency(df: DataFrame, key: list[str], speed: str, throttle: str, brake: str, drs: str) -> DataFrame:
    """The eight session metrics of a weekend: shares, top speed and the speed on straights."""
    full, on = F.col(throttle) >= 95, F.col(drs) >= 10
    straight = full & (F.col(speed) >= 150)
    return df.groupBy(*key).agg(
        F.count("*").alias("samples"), percentile(speed, 0.95).alias("speed_p95"), F.max(speed).alias("speed_max"), rate(full).alias("full_throttle_share"), rate(F.col(brake) >= 0.5).alias("brake_share"),
        F.avg(F.when(F.col(brake) >= 0.5, F.col(speed))).alias("brake_speed_mean"), rate(on).alias("drs_share"), rate(straight).alias("straight_share"), F.avg(F.when(straight, F.col(speed))).alias("straight_speed_mean"),
        (F.avg(F.when(straight & on, F.col(speed))) - F.avg(F.when(straight & ~on, F.col(speed)))).alias("drs_gain"))
