"""Robust, weighted and shrunk statistics as aggregate or window columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(x: str | Column, p: float) -> Column:
    """Exact, with linear interpolation; nulls don't count."""
    return F.percentile(x, F.lit(p))


def iqr(x: str | Column, least: int = 2) -> Column:
    return F.when(F.count(x) >= least, percentile(x, 0.75) - percentile(x, 0.25))


def quartiles(x: str) -> Column:
    """The three quartiles in one aggregate (array)."""
    return F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def rate(condition: Column, known: Column | None = None) -> Column:
    """Share of rows for which the condition holds; unknown counts as false. Null if ``known`` is null in all rows."""
    share = F.avg(F.coalesce(condition, F.lit(False)).cast("int"))
    return share if known is None else F.when(F.count(known) > 0, share)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def mad_clean(df: DataFrame, key: list[str], x: str, low: float = -3.0, high: float = 2.0, least: int = 3) -> DataFrame:
    """Marks rows (``clean``) whose deviation from the key's median, in MADs, lies between the bounds. A MAD of 0 keeps what is
    at most the median; keys of fewer than ``least`` rows keep all."""
    w = Window.partitionBy(*key)
    out = df.withColumn("_m", percentile(x, 0.5).over(w)).withColumn("_n", F.count(x).over(w))
    out = out.withColumn("_d", percentile(F.abs(F.col(x) - F.col("_m")), 0.5).over(w))
    z = F.try_divide(F.col(x) - F.col("_m"), F.col("_d"))
    clean = F.when(F.col("_n") < least, F.col(x).isNotNull()).when(F.col("_d") == 0, F.col(x) <= F.col("_m")).otherwise((z > low) & (z < high))
    return out.withColumn("clean", F.coalesce(clean, F.lit(False))).drop("_m", "_n", "_d")


def tukey_clean(df: DataFrame, key: list[str], x: str, k: float = 2.0, least: int = 3) -> DataFrame:
    """Marks rows (``clean``) of at most Q3 + k * IQR of their key."""
    w = Window.partitionBy(*key)
    out = df.withColumn("_q", F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(w)).withColumn("_n", F.count(x).over(w))
    fence = F.col("_q")[1] + k * (F.col("_q")[1] - F.col("_q")[0])
    return out.withColumn("clean", F.coalesce(F.when(F.col("_n") < least, F.col(x).isNotNull()).otherwise(F.col(x) <= fence), F.lit(False))).drop("_q", "_n")


def trimmed_median(df: DataFrame, key: list[str], x: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The median of what lies within the two percentiles of the key."""
    w = Window.partitionBy(*key)
    cut = df.withColumn("_q", F.percentile(x, F.array(F.lit(low), F.lit(high))).over(w)).filter(F.col(x).between(F.col("_q")[0], F.col("_q")[1]))
    return cut.groupBy(*key).agg(percentile(x, 0.5).alias("trimmed_median"))


def robust_sigma(x: str) -> Column:
    spread = percentile(x, 0.75) - percentile(x, 0.25)
    return F.when(spread > 0, spread / 1.35).otherwise(F.stddev_pop(x))


def best_n_mean(df: DataFrame, key: list[str], x: str, order: list[Column], n: int = 10) -> DataFrame:
    """The mean of the n smallest values of each key."""
    ranked = df.filter(F.col(x).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(x), *order)))
    return ranked.filter(F.col("_n") <= n).groupBy(*key).agg(F.avg(x).alias("best_mean"))


def with_stats(df: DataFrame, key: list[str], stats: dict[str, Column]) -> DataFrame:
    """df with aggregates of its key. They are aggregated and joined back, so rows of a key needn't fit one task, as in a window they must."""
    per = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(*[c.alias(n) for n, c in stats.items()])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    return df.join(per, on, "left").drop(*[f"_k_{k}" for k in key])


def detrend(df: DataFrame, key: list[str], x: str, out: str) -> DataFrame:
    """df with x less the key's median. Percentiles are merged counts of distinct values, pre-aggregated by partition."""
    return with_stats(df, key, {"_m": percentile(x, 0.5)}).withColumn(out, F.col(x) - F.col("_m")).drop("_m")


def exact_quantiles(df: DataFrame, x: str, ps: list[float], bins: int = 4096) -> list[float | None]:
    """Exact quantiles of a whole column (linear interpolation) for any number of rows, in bounded memory: each pass counts the
    values between equidistant edges of the open intervals, and keeps the interval that holds the wanted rank, until it holds one
    value or few rows. At most ``bins`` counts an interval come back."""
    v = F.col(x).cast("double")
    rows = df.select(v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    whole = rows.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not whole.n:
        return [None] * len(ps)
    ranks = sorted({int(f(p * (whole.n - 1))) for p in ps for f in (math.floor, math.ceil)})
    found: dict[int, float] = {0: whole.lo, whole.n - 1: whole.hi}
    # rank -> the interval lo <= v <= hi that holds it, and the rows before it
    open_ = {k: (whole.lo, whole.hi, 0) for k in ranks if k not in found}
    while open_:
        spans = sorted(set(open_.values()))
        edge = lambda s: (s[1] - s[0]) / bins
        cell = [F.when((F.col("v") >= s[0]) & (F.col("v") <= s[1]), F.struct(F.lit(i).alias("span"), (F.least(F.floor((F.col("v") - s[0]) / edge(s)), F.lit(bins - 1)).cast("int") if edge(s) > 0 else F.lit(0)).alias("bin"))) for i, s in enumerate(spans)]
        counted = rows.select("v", F.explode(F.array_compact(F.array(*cell))).alias("c")).groupBy("c.span", "c.bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by_span: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r.span, r.bin)):
            by_span.setdefault(r.span, []).append(r)
        left = {}
        for k, s in open_.items():
            before = s[2]
            for r in by_span[spans.index(s)]:
                if k < before + r.n:
                    if r.lo == r.hi:
                        found[k] = r.lo
                    elif k == before:
                        found[k] = r.lo
                    elif k == before + r.n - 1:
                        found[k] = r.hi
                    else:
                        left[k] = (r.lo, r.hi, before)
                    break
                before += r.n
        open_ = left
    out = []
    for p in ps:
        at = p * (whole.n - 1)
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out


def with_zscore(df: DataFrame, key: list[str], x: str, out: str, sample: bool = True, sign: int = 1) -> DataFrame:
    """df with (x - mean) / sd of the key; 0 where the sd is 0 or not defined."""
    rows = with_stats(df, key, {"_m": F.avg(x), "_sd": F.stddev_samp(x) if sample else F.stddev_pop(x)})
    return rows.withColumn(out, F.when(F.col(x).isNotNull(), F.when(F.col("_sd") > 0, sign * (F.col(x) - F.col("_m")) / F.col("_sd")).otherwise(0.0))).drop("_m", "_sd")


def zscore(x: str, key: list[str], sample: bool = True, sign: int = 1) -> Column:
    """(x - mean) / sd within the key; 0 where the sd is 0 or not defined."""
    w = Window.partitionBy(*key)
    sd = (F.stddev_samp(x) if sample else F.stddev_pop(x)).over(w)
    return F.when(F.col(x).isNotNull(), F.when(sd > 0, sign * (F.col(x) - F.avg(x).over(w)) / sd).otherwise(0.0))


def trend(df: DataFrame, key: list[str], x: str, order: list[str], last: int | None = None, least: int = 2, short: float | None = 0.0) -> DataFrame:
    """The least-squares slope of the non-null values, in order, against 0, 1, ...; of the last values only if ``last`` is given."""
    rows = df.filter(F.col(x).isNotNull())
    by = Window.partitionBy(*key)
    if last:
        rows = rows.withColumn("_d", F.row_number().over(by.orderBy(*[F.desc(c) for c in order]))).filter(F.col("_d") <= last)
    rows = rows.withColumn("_i", F.row_number().over(by.orderBy(*order)).cast("double"))
    slope = F.when(F.count(x) >= least, F.regr_slope(x, "_i"))
    return rows.groupBy(*key).agg((slope if short is None else F.coalesce(slope, F.lit(short))).alias("slope"))


def robust_slope(df: DataFrame, key: list[str], x: str, y: str, least: int = 4, distinct: int = 3, mads: float = 4.0) -> DataFrame:
    """The slope of y against x without values beyond ``mads`` scaled MADs; null for few points or a constant x."""
    w = Window.partitionBy(*key)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_m", percentile(y, 0.5).over(w))
    rows = rows.withColumn("_s", 1.4826 * percentile(F.abs(F.col(y) - F.col("_m")), 0.5).over(w))
    kept = rows.filter((F.col("_s") == 0) | (F.abs(F.col(y) - F.col("_m")) <= mads * F.col("_s")))
    fit = F.when((F.count(y) >= least) & (F.count_distinct(x) >= distinct) & (F.var_pop(x) > 1e-9), F.regr_slope(y, x))
    return kept.groupBy(*key).agg(fit.alias("slope"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Null where no weight is left."""
    used = F.when(x.isNotNull() & w.isNotNull(), w)
    return F.when(F.sum(used) > 0, F.sum(used * x) / F.sum(used))


def recency_weight(age: Column, volume: Column, decay: float = 0.35, most: float = 200.0, least: float = 8.0) -> Column:
    return F.when(volume >= least, clip(volume.cast("double"), 0, most) * F.exp(-decay * age))


def shrink(x: Column, n: Column, base: Column, k: float) -> Column:
    """Empirical Bayes: the mean of n observations and k of the base."""
    return F.when(x.isNotNull(), (n * x + k * base) / (n + k))


def blend(same: Column, recent: Column, n_same: Column, full: float = 3.0) -> Column:
    alpha = clip(n_same / full, 0, 1)
    return F.when(same.isNull(), recent).when(recent.isNull(), same).otherwise(alpha * same + (1 - alpha) * recent)


def half_life_weight(age: Column, half_life: float) -> Column:
    return F.exp(-math.log(2) / half_life * age)


def correlation(a: str, b: str) -> Column:
    """Pearson's coefficient; null where either side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def weighted_percentile(x: Column, weight: Column, p: float) -> Column:
    """An aggregate: the percentile of a group's known values whose weights are positive. A value stands at the middle of its own
    share of the weights, between two it is linear; with equal weights the median is the usual one. Groups are small: a group's
    values are held as an array."""
    points = F.array_sort(F.collect_list(F.when(x.isNotNull() & (weight > 0), F.struct(x.cast("double").alias("x"), weight.cast("double").alias("w")))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v["w"])

    def of(a: Column) -> Column:
        placed = F.transform(a, lambda v, i: F.struct(v["x"].alias("x"), ((total(F.slice(a, 1, i + 1)) - v["w"] / 2) / total(a)).alias("c")))
        low, high = F.filter(placed, lambda v: v["c"] <= p), F.filter(placed, lambda v: v["c"] > p)
        before, behind = F.get(low, F.size(low) - 1), F.get(high, F.lit(0))
        return F.when(F.size(low) == 0, behind["x"]).when(F.size(high) == 0, before["x"]).otherwise(before["x"] + (behind["x"] - before["x"]) * F.try_divide(F.lit(p) - before["c"], behind["c"] - before["c"]))

    return F.get(F.transform(F.array(points), of), F.lit(0))
