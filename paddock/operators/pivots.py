"""Shares, differences and risks of categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import exact_quantiles, percentile


def mix(df: DataFrame, key: list[str], code: str, values: list[str], prefix: str = "share_") -> DataFrame:
    """The share of each value among the rows that have one of them."""
    counts = df.filter(F.col(code).isin(values)).groupBy(*key).agg(*[F.count_if(F.col(code) == v).alias(v) for v in values])
    total = sum((F.col(v) for v in values), F.lit(0))
    return counts.select(*key, *[(F.col(v) / total).alias(f"{prefix}{v}") for v in values])


def counts(df: DataFrame, key: list[str], code: str, values: list[str]) -> DataFrame:
    return df.groupBy(*key).pivot(code, values).count().na.fill(0, values)


def median_deltas(df: DataFrame, key: list[str], code: str, x: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """The difference of the medians of two values, for each pair."""
    names = sorted({v for p in pairs for v in p})
    medians = df.groupBy(*key).agg(*[percentile(F.when(F.col(code) == v, F.col(x)), 0.5).alias(f"_{v}") for v in names])
    return medians.select(*key, *[(F.col(f"_{a}") - F.col(f"_{b}")).alias(f"delta_{a}_{b}") for a, b in pairs])


def two_level_median(df: DataFrame, inner: list[str], outer: list[str], x: str) -> DataFrame:
    """The median of the medians: each inner group counts once."""
    return df.groupBy(*inner).agg(percentile(x, 0.5).alias("_m")).groupBy(*outer).agg(percentile("_m", 0.5).alias("median"))


def exceedance(df: DataFrame, field: list[str], group: list[str], x: str, p: float = 0.9) -> DataFrame:
    """The share of a group's values above the field's percentile."""
    limit = df.groupBy(*field).agg(percentile(x, p).alias("_p"))
    return df.join(limit, field).groupBy(*group).agg(F.avg((F.col(x) > F.col("_p")).cast("int")).alias("risk"))


def first_two_gap(df: DataFrame, key: list[str], member: str, x: str, within: int) -> DataFrame:
    """Whether the two earliest first values of a key's members lie within a distance, and whether they are equal."""
    firsts = df.groupBy(*key, member).agg(F.min(x).alias("_x"))
    ranked = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_x", member))).filter("_n <= 2")
    two = ranked.groupBy(*key).agg(F.max(F.when(F.col("_n") == 1, F.col("_x"))).alias("a"), F.max(F.when(F.col("_n") == 2, F.col("_x"))).alias("b"))
    return two.filter("b is not null").select(*key, (F.col("b") - F.col("a") <= within).cast("int").alias("stacked"), (F.col("a") == F.col("b")).cast("int").alias("same"))


def any_flags(df: DataFrame, key: list[str], tests: dict[str, Column]) -> DataFrame:
    """For each key, 1 where any row passes the test."""
    return df.groupBy(*key).agg(*[F.coalesce(F.bool_or(t), F.lit(False)).cast("int").alias(name) for name, t in tests.items()])


def trim_bounds(df: DataFrame, x: str, low: float, high: float, p: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Rows within absolute bounds, then within two percentiles of what is left; these are found by refinement, when the plan is made."""
    inside = df.filter(F.col(x).between(low, high))
    lo, hi = exact_quantiles(inside, x, list(p))
    return inside if lo is None else inside.filter(F.col(x).between(lo, hi))


def position_changes(df: DataFrame, key: list[str], order: list[str], position: str) -> DataFrame:
    """Places won less places lost from row to row."""
    step = F.col(position) - F.lag(position).over(Window.partitionBy(*key).orderBy(*order))
    rows = df.withColumn("_s", step)
    return rows.groupBy(*key).agg((F.sum(F.greatest(-F.col("_s"), F.lit(0))) - F.sum(F.greatest(F.col("_s"), F.lit(0)))).alias("net_change"), F.count(position).alias("rows"))
