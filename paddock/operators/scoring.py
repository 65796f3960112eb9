"""Scaling, within-group scoring, ranking, standings, weights, losses and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookback import few
from .stats import clip

#: Points of the first ten ranks, and what an outcome is worth.
POINTS = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)
PRIORITY = {"finish": 2.0, "dnf": 1.0, "dsq": 0.0}


def time_split(df: DataFrame, y: str, r: str, last: int) -> DataFrame:
    """df with is_validation: the rows of the last rounds. Raises if no rounds are left to train on."""
    rounds = df.select(y, r).distinct()
    ranked = rounds.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(y), F.desc(r)))).withColumn("_all", F.count("*").over(Window.partitionBy()))
    checked = F.when(F.col("_all") <= last, F.raise_error(F.lit("too few rounds to split"))).otherwise(F.col("_n") <= last)
    return df.join(few(ranked.select(y, r, checked.cast("boolean").alias("is_validation"))), [y, r])


def fit_scaler(df: DataFrame, columns: list[str], flags: list[str] = ()) -> DataFrame:
    """feature, mean, std of the finite values; a std below 1e-6 is 1, flags keep mean 0 and std 1. One pass."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in columns}
    row = df.agg(*[F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).alias(c) for c, v in finite.items()])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std"), F.lit(c in flags).alias("flag")) for c in columns])).alias("s")).select("s.*")
    std = F.when(F.col("std") < 1e-6, 1.0).otherwise(F.coalesce("std", F.lit(1.0)))
    return long.select("feature", F.when(F.col("flag"), 0.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("mean"), F.when(F.col("flag"), 1.0).otherwise(std).alias("std"))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Columns standardised; a missing value takes the mean, so it becomes 0."""
    wide = scaler.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.struct("mean", "std"))).alias(f"_{c}") for c in columns])
    out = df.join(F.broadcast(wide))
    z = {c: (F.coalesce(F.when(~F.isnan(c), F.col(c)), F.col(f"_{c}.mean")) - F.col(f"_{c}.mean")) / F.col(f"_{c}.std") for c in columns}
    return out.withColumns(z).drop(*[f"_{c}" for c in columns])


def softmax(score: Column, key: list[str], temperature: float = 1.0) -> Column:
    w = Window.partitionBy(*key)
    return F.exp((score - F.max(score).over(w)) / temperature) / F.sum(F.exp((score - F.max(score).over(w)) / temperature)).over(w)


def with_softmax(df: DataFrame, score: str, key: list[str], out: str, temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy(*key)
    shifted = df.withColumn("_e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    return shifted.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def sequential_rank(score: str, key: list[str], tie: str) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy(F.col(score).desc_nulls_last(), tie))


def clipped_z(x: str, key: list[str], limit: float = 3.0) -> Column:
    w = Window.partitionBy(*key)
    centred, sd = F.col(x) - F.avg(x).over(w), F.stddev_pop(x).over(w)
    return clip(F.when(sd < 1e-6, centred).otherwise(centred / F.when(sd >= 1e-6, sd)), -limit, limit)


def race_scores(df: DataFrame, key: list[str], rank_score: str, p_finish: str, p_dnf: str, temperature: float = 1.0) -> DataFrame:
    """df with score (10 times the expected priority plus the clipped z of the rank score), p_win and rank."""
    value = 10.0 * (PRIORITY["finish"] * F.col(p_finish) + PRIORITY["dnf"] * F.col(p_dnf))
    out = df.withColumn("score", value + clipped_z(rank_score, key))
    out = out.withColumn("_s", F.col(rank_score) + F.log(clip(F.col(p_finish), 1e-6, 1.0)))
    return with_softmax(out, "_s", key, "p_win", temperature).drop("_s")


def grid_penalty(score: Column, grid: Column, weight: float, default: float = 10.0) -> Column:
    return score - weight * 0.25 * (F.coalesce(grid, F.lit(default)) - 1)


def regridded(df: DataFrame, key: list[str], grid: Column, weight: float, temperature: float = 1.0) -> DataFrame:
    """df (rank_score, score_status, p_finish) after the grid penalty on the rank score: score, p_win and rank worked out anew."""
    out = df.withColumn("rank_score", grid_penalty(F.col("rank_score"), grid, weight))
    out = out.withColumn("score", 10.0 * F.col("score_status") + clipped_z("rank_score", key))
    out = with_softmax(out.withColumn("_s", F.col("rank_score") + F.log(clip(F.col("p_finish"), 1e-6, 1.0))), "_s", key, "p_win", temperature).drop("_s")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), *[c for c in ("driver", "k") if c in df.columns])))


def normalised_weights(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights of mean 1; a mean that isn't positive counts as 1."""
    mean = df.agg(F.avg(weight).alias("_m"))
    return df.join(F.broadcast(mean)).withColumn(weight, F.col(weight) / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)).drop("_m")


def combined_weights(maps: list[DataFrame], key: list[str], normalise: bool = True) -> DataFrame:
    """key, weight: the product of the maps' weights; a map that lacks a key counts as 1."""
    out = maps[0].select(*key, F.col("weight").alias("_w0"))
    for i, m in enumerate(maps[1:], 1):
        out = out.join(m.select(*key, F.col("weight").alias(f"_w{i}")), key, "full_outer")
    product = F.lit(1.0)
    for i in range(len(maps)):
        product = product * F.coalesce(F.col(f"_w{i}"), F.lit(1.0))
    out = out.select(*key, product.alias("weight"))
    return normalised_weights(out) if normalise else out


def era_summary(weights: DataFrame, era: Column) -> DataFrame:
    """era, races and the mean, least and greatest weight of its races."""
    return weights.groupBy(era.alias("era")).agg(F.count("*").alias("races"), F.avg("weight").alias("weight_mean"), F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"))


def selection_score(spearman: Column, macro_f1: Column) -> Column:
    """The sum of both, or the one that is finite."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return F.coalesce(finite(spearman) + finite(macro_f1), finite(macro_f1), finite(spearman))


def best_checkpoint(metrics: DataFrame, epoch: str = "epoch") -> DataFrame:
    """The row of the epoch with the greatest selection score, the first of equals."""
    scored = metrics.withColumn("selection_score", selection_score(F.col("spearman"), F.col("macro_f1")))
    return scored.orderBy(F.col("selection_score").desc_nulls_last(), epoch).limit(1)


def points_for(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(p) for p in POINTS]), rank - 1), F.lit(0))


def standings(results: DataFrame, entity: str, rank: str, race: list[str], season: list[str] = ()) -> DataFrame:
    """entity, points, wins, podiums, races, rank: by points, wins and podiums, then by name; per season if its columns are given."""
    points = results.withColumn("_p", points_for(F.col(rank)))
    total = points.groupBy(*season, entity).agg(F.sum("_p").cast("long").alias("points"), F.count_if(F.col(rank) == 1).alias("wins"), F.count_if(F.col(rank) <= 3).alias("podiums"), F.count_distinct(*race).alias("races"))
    place = F.row_number().over(Window.partitionBy(*season).orderBy(F.desc("points"), F.desc("wins"), F.desc("podiums"), entity))
    return total.withColumn("rank", place.cast("long"))


def plackett_luce_nll(df: DataFrame, key: list[str], score: str, finish: str, top: int | None = None, total: bool = False) -> DataFrame:
    """The mean (or, as ListMLE has it, the total) negative log likelihood of the finishing order of each group, over the first
    ``top`` places if given."""
    w = Window.partitionBy(*key)
    rows = df.filter(F.col(finish).isNotNull()).withColumn("_c", F.col(score) - F.max(score).over(w))
    # summed from the last place on: a frame that ends with the group would be summed anew for every row
    tail = F.sum(F.exp("_c")).over(w.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0))
    terms = rows.withColumn("_n", F.row_number().over(w.orderBy(finish))).withColumn("_l", F.log(tail) - F.col("_c"))
    if top:
        terms = terms.filter(F.col("_n") <= top)
    return terms.groupBy(*key).agg((F.sum("_l") if total else F.avg("_l")).alias("nll"))


def rank_metrics(df: DataFrame, key: list[str], score: str, position: str, tie: str, k: int = 5) -> DataFrame:
    """Per group: spearman, mae, top1, ndcg (of the first k, with gain n - place) of the predicted order."""
    w = Window.partitionBy(*key)
    rows = df.filter(F.col(position).isNotNull()).withColumn("_p", F.row_number().over(w.orderBy(F.desc(score), tie))).withColumn("_a", F.row_number().over(w.orderBy(position, tie))).withColumn("_n", F.count("*").over(w))
    gain = (F.col("_n") - F.col("_a") + 1).cast("double")
    best = (F.col("_n") - F.col("_p") + 1).cast("double")
    discount = F.log2(F.col("_p") + 1)
    return rows.groupBy(*key).agg(
        F.corr(F.col("_p").cast("double"), F.col("_a").cast("double")).alias("spearman"),
        F.avg(F.abs(F.col("_p") - F.col("_a"))).alias("mae"),
        F.max(((F.col("_p") == 1) & (F.col("_a") == 1)).cast("int")).cast("double").alias("top1"),
        (F.sum(F.when(F.col("_p") <= k, gain / discount)) / F.sum(F.when(F.col("_p") <= k, best / discount))).alias("ndcg"),
    )


def class_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 of each class that occurs, and the accuracy of all rows."""
    cells = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("all"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    by_label = cells.groupBy(F.col(label).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    by_guess = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("guessed"))
    out = by_label.join(by_guess, "label", "left").join(F.broadcast(total))
    recall, precision = F.col("tp") / F.col("support"), F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0))
    return out.select("label", "support", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), (F.col("hit") / F.col("all")).alias("accuracy"))


def class_weights(df: DataFrame, label: str, low: float = 0.5, high: float = 8.0) -> DataFrame:
    """label, weight: inverse shares, of mean 1, clipped."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    raw = counts.withColumn("_w", F.sum("n").over(w) / F.col("n"))
    return raw.select(label, clip(F.col("_w") / F.avg("_w").over(w), low, high).alias("weight"))
