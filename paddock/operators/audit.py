"""Data-quality, drift, importance and leakage audits over many columns: unpivot once, then aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookback import last_rows
from .scoring import time_split
from .stats import correlation, exact_quantiles
from .windows import average_rank


def unpivoted(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    return df.select(*key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(key, columns, "feature", "value")


def column_health(df: DataFrame, race: list[str], columns: list[str]) -> DataFrame:
    """Per column: rows, non_null, missing_rate, distinct values, share of races with one value at most, share with any."""
    long = unpivoted(df, race, columns)
    per = long.groupBy("feature", *race).agg(F.count("*").alias("n"), F.count("value").alias("known"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    values = long.groupBy("feature").agg(F.count_distinct("value").alias("distinct_values"))
    same = F.when(F.col("known") > 0, (F.col("lo") == F.col("hi")).cast("double")).otherwise(1.0)
    out = per.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum("known").alias("non_null"), F.avg(same).alias("race_constant_share"), F.avg((F.col("known") > 0).cast("double")).alias("race_non_null_share"))
    return out.join(values, "feature").withColumn("missing_rate", 1 - F.col("non_null") / F.col("rows")).withColumn("all_null", F.col("non_null") == 0)


def group_health(health: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Per group of columns (by prefix, the first that fits): columns, all_null columns, mean missing rate, dead if all are null."""
    name = F.coalesce(*[F.when(F.col("feature").startswith(p), F.lit(g)) for p, g in groups.items()], F.lit("other"))
    out = health.groupBy(name.alias("group")).agg(F.count("*").alias("columns"), F.count_if(F.col("all_null")).alias("all_null_columns"), F.avg("missing_rate").alias("missing_rate"))
    return out.withColumn("dead", F.col("columns") == F.col("all_null_columns"))


def psi(df: DataFrame, columns: list[str], is_validation: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """feature, psi between training and validation rows over the training quantiles; values outside their range don't count."""
    long = unpivoted(df, [is_validation], columns).filter("value is not null")
    training = df.filter(~F.col(is_validation))
    edges = [(c, sorted({q for q in exact_quantiles(training, c, [i / bins for i in range(bins + 1)]) if q is not None})) for c in columns]
    cuts = df.sparkSession.createDataFrame(edges, "feature string, edges array<double>")
    inside = long.join(F.broadcast(cuts), "feature").filter((F.col("value") >= F.element_at("edges", 1)) & (F.col("value") <= F.element_at("edges", -1)) & (F.size("edges") >= 3))
    place = F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.size("edges") - 1)
    cells = inside.withColumn("bin", place).groupBy("feature", "bin").agg(F.count_if(~F.col(is_validation)).alias("t"), F.count_if(F.col(is_validation)).alias("v"))
    every = cuts.filter(F.size("edges") >= 3).select("feature", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    full = every.join(cells, ["feature", "bin"], "left").na.fill(0, ["t", "v"])
    w = Window.partitionBy("feature")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(0.0)) + eps
    shares = full.select("feature", share("t").alias("t"), share("v").alias("v"))
    return shares.groupBy("feature").agg(F.sum((F.col("v") - F.col("t")) * F.log(F.col("v") / F.col("t"))).alias("psi"))


def spearman(df: DataFrame, key: list[str], columns: list[str], target: str) -> DataFrame:
    """feature, key, rho, n of the pairs of known values; null for fewer than 3 pairs."""
    long = unpivoted(df, [*key, target], columns).filter(F.col("value").isNotNull() & F.col(target).isNotNull())
    by = ["feature", *key]
    ranked = long.withColumn("_a", average_rank("value", by)).withColumn("_b", average_rank(target, by))
    return ranked.groupBy(*by).agg(F.when(F.count("*") >= 3, correlation("_a", "_b")).alias("rho"), F.count("*").alias("n"))


def leakage(df: DataFrame, key: list[str], columns: list[str], target: str, limit: float = 0.999) -> DataFrame:
    """Per column whether it is empty, constant, equal to the target or its negative, or ranks as the target in every race."""
    long = unpivoted(df, [*key, target], columns)
    known = F.col("value").isNotNull() & F.col(target).isNotNull()
    plain = long.groupBy("feature").agg(
        (F.count("value") == 0).alias("all_null"), F.coalesce(F.min("value") == F.max("value"), F.lit(False)).alias("constant"),
        F.coalesce(F.bool_and(F.when(known, F.col("value") == F.col(target))), F.lit(False)).alias("equals_target"),
        F.coalesce(F.bool_and(F.when(known, F.col("value") == -F.col(target))), F.lit(False)).alias("equals_negative"))
    rho = spearman(df, key, columns, target).groupBy("feature").agg(F.coalesce(F.min(F.abs("rho")) > limit, F.lit(False)).alias("ranks_as_target"))
    return plain.join(rho, "feature", "left").na.fill(False, ["ranks_as_target"])


#: Parts of names that a column made after the race may have.
LATE_NAMES = ("finish", "result", "target", "points", "status", "classified")


def looks_late(name: Column) -> Column:
    return F.lower(name).rlike("|".join(LATE_NAMES))


def sorts_as_target(df: DataFrame, key: list[str], columns: list[str], target: str, k: int = 5, limit: float = 0.999) -> DataFrame:
    """feature, ndcg_one: whether sorting by the column, up or down, puts the first k of every race into the target's order.
    Gains are n - place, discounts log2(1 + place); rows without the value don't count."""
    long = unpivoted(df, [*key, target], columns).filter(F.col("value").isNotNull() & F.col(target).isNotNull())
    w = Window.partitionBy("feature", *key)
    place = lambda c: F.row_number().over(w.orderBy(c, target))
    rows = long.withColumn("_t", F.row_number().over(w.orderBy(target, "value"))).withColumn("_u", place(F.asc("value"))).withColumn("_d", place(F.desc("value"))).withColumn("_n", F.count("*").over(w))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, (F.col("_n") - F.col("_t") + 1) / F.log2(F.col(at) + 1)))
    ideal = F.sum(F.when(F.col("_t") <= k, (F.col("_n") - F.col("_t") + 1) / F.log2(F.col("_t") + 1)))
    per = rows.groupBy("feature", *key).agg((F.greatest(gain("_u"), gain("_d")) / ideal).alias("ndcg"))
    return per.groupBy("feature").agg((F.min("ndcg") > limit).alias("ndcg_one"))


def split_keep_last(features: DataFrame, targets: DataFrame, key: list[str], order: list[str], y: str, r: str, last: int) -> DataFrame:
    """Features joined to targets, one row a key (of repeated ones the last in ``order``), with is_validation for the last rounds."""
    kept = [last_rows(df, key, [F.desc(c) for c in order if c in df.columns], 1) for df in (features, targets)]
    return time_split(kept[0].join(kept[1].drop(*order), key), y, r, max(1, last))


def suspicion(df: DataFrame) -> DataFrame:
    """df (polarity_mismatch, flip, psi, grad, drop) with suspicious: their weighted sum, psi up to 2, grad and drop as shares of
    the greatest."""
    most = df.agg(F.max("grad").alias("_g"), F.max(F.abs("drop")).alias("_d"))
    share = lambda c, m: F.coalesce(c / (F.col(m) + 1e-9), F.lit(0.0))
    fixed = 0.35 * F.coalesce(F.col("polarity_mismatch").cast("double"), F.lit(0.0)) + 0.25 * F.coalesce(F.col("flip").cast("double"), F.lit(0.0)) + 0.20 * F.least(F.greatest(F.coalesce("psi", F.lit(0.0)), F.lit(0.0)), F.lit(2.0)) / 2
    return df.join(F.broadcast(most)).withColumn("suspicious", fixed + 0.10 * share(F.col("grad"), "_g") + 0.10 * share(F.abs("drop"), "_d")).drop("_g", "_d")


def permuted(df: DataFrame, key: list[str], column: str, tie: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """df with the column's values shuffled within each group, by a hash of ``tie`` or a given order, so that it repeats."""
    by = Window.partitionBy(*key)
    place = F.row_number().over(by.orderBy(tie))
    shuffled = df.select(*key, F.col(column).alias("_v"), F.row_number().over(by.orderBy(F.xxhash64(F.lit(seed), tie) if order is None else order, tie)).alias("_n"))
    return df.withColumn("_n", place).join(shuffled, [*key, "_n"]).withColumn(column, F.col("_v")).drop("_v", "_n")


def suspicious_score(df: DataFrame, parts: dict[str, float]) -> DataFrame:
    """A weighted sum of the absolute parts, each as a share of its largest."""
    w = Window.partitionBy()
    terms = [weight * F.coalesce(F.try_divide(F.abs(c), F.max(F.abs(c)).over(w)), F.lit(0.0)) for c, weight in parts.items()]
    return df.withColumn("suspicious", sum(terms, F.lit(0.0)))
