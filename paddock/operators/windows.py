"""Ordered operators: fills, runs, rolling frames, ranks and state windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import with_stats


def ffill(x: str, key: list[str], order: list[str]) -> Column:
    return F.last(x, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def change_id(x: str, key: list[str], order: list[str]) -> Column:
    """A running number that grows where the value changes; a null differs from every other value."""
    raise_if = F.col(x).isNull() | F.col("_prev").isNull() | (F.col(x) != F.col("_prev"))
    return F.sum(raise_if.cast("int")).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def stints(df: DataFrame, x: str, key: list[str], order: list[str], fill: bool = True) -> DataFrame:
    """df with stint (from 1) and stint_age (from 1): runs of equal values, filled forward first if asked."""
    out = df.withColumn("_x", ffill(x, key, order) if fill else F.col(x))
    by = Window.partitionBy(*key).orderBy(*order)
    out = out.withColumn("_prev", F.lag("_x").over(by)).withColumn("stint", change_id("_x", key, order))
    return out.withColumn("stint_age", F.row_number().over(Window.partitionBy(*key, "stint").orderBy(*order))).drop("_x", "_prev")


def longest_run(df: DataFrame, flag: Column, key: list[str], order: list[str]) -> DataFrame:
    """The longest run of consecutive rows for which the flag holds."""
    w = Window.partitionBy(*key)
    rows = df.select(*key, *order, F.coalesce(flag, F.lit(False)).alias("_f"))
    islands = rows.withColumn("_g", F.row_number().over(w.orderBy(*order)) - F.row_number().over(Window.partitionBy(*key, "_f").orderBy(*order)))
    runs = islands.groupBy(*key, "_f", "_g").agg(F.count("*").alias("_n"))
    return runs.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("_f"), F.col("_n"))), F.lit(0)).alias("longest_run"))


def rolling(x: Column, key: list[str], order: list[str], first: int, last: int) -> Column:
    return F.avg(x).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(first, last))


def percent_rank_avg(x: str, key: list[str], ascending: bool = True) -> Column:
    """1 for the best down to 0, ties share their mean rank; 1 for a lone value, null for a null."""
    value = F.col(x) if ascending else -F.col(x)
    known = F.col(x).isNotNull()
    w = Window.partitionBy(*key, known)
    ties = F.count("*").over(Window.partitionBy(*key, x))
    mean_rank = F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0
    n = F.count("*").over(w)
    return F.when(known, F.when(n == 1, 1.0).otherwise(1 - (mean_rank - 1) / F.greatest(n - 1, F.lit(1))))


def average_rank(x: str, key: list[str]) -> Column:
    """The middle of the first and last place of a row's ties, both from one sort: cume_dist is the last place over all."""
    w = Window.partitionBy(*key)
    by = w.orderBy(x)
    return (F.rank().over(by) + F.round(F.cume_dist().over(by) * F.count("*").over(w))) / 2.0


def state_windows(df: DataFrame, key: list[str], t: str, code: str, opens: list[str], closes: list[str]) -> DataFrame:
    """kind, t0, t1 of the windows that an opening code begins and the next closing code ends; what is open at the end ends with the
    last row. An opening within an open window begins nothing."""
    w = Window.partitionBy(*key).orderBy(t)
    end = F.min(F.when(F.col(code).isin(closes), F.col(t))).over(w.rowsBetween(1, Window.unboundedFollowing))
    tail = F.max(t).over(Window.partitionBy(*key))
    rows = df.withColumn("_end", F.coalesce(end, tail)).filter(F.col(code).isin(opens))
    again = F.lag("_end").over(w)
    return rows.withColumn("_again", again).filter(F.col("_again").isNull() | (F.col("_again") != F.col("_end"))).select(*key, F.col(code).alias("kind"), F.col(t).alias("t0"), F.col("_end").alias("t1"))


def with_band_best(df: DataFrame, key: list[str], x: str, position: str, half_width: int, out: str) -> DataFrame:
    """df with the least value among the rows of the key within ``half_width`` of the row's position (whole numbers).

    Positions are cut into blocks as wide as half the band. A row meets its own block and copies of the rows of the next block up to the
    band's upper end and of the one before down to its lower end: two running minima, where a moving frame is read anew for every row."""
    width = F.lit(half_width + 1)
    own = F.col(position) - F.pmod(F.col(position), width)
    rows = df.withColumn("_g", F.explode(F.array(*[F.lit(g) for g in (-1, 0, 1)]))).withColumn("_b", own - F.col("_g") * width)
    w = Window.partitionBy(*key, "_b")
    running = lambda order, kept: F.min(F.when(kept, F.col(x))).over(w.orderBy(order).rangeBetween(Window.unboundedPreceding, half_width))
    rows = rows.withColumns({"_up": running(F.asc(position), F.col("_g") >= 0), "_down": running(F.desc(position), F.col("_g") <= 0)})
    return rows.filter("_g = 0").withColumn(out, F.least("_up", "_down")).drop("_g", "_b", "_up", "_down")


def with_distinct(df: DataFrame, x: str, key: list[str], out: str) -> DataFrame:
    """df with how many distinct values the row's key has: counted once a key and joined back."""
    return with_stats(df, key, {out: F.count_distinct(x)})


def distinct_in_order(df: DataFrame, key: list[str], x: str, order: list[str]) -> DataFrame:
    """Per key the distinct values, without blanks around them, in the order in which each came first; empty ones don't count."""
    value = F.trim(F.col(x).cast("string"))
    firsts = df.withColumn("_v", value).filter((F.col("_v") != "") & (F.lower("_v") != "nan")).groupBy(*key, "_v").agg(F.min(F.struct(*order)).alias("_f"))
    return firsts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_f", "_v"))).alias("_s")).select(*key, F.col("_s._v").alias("values"))


def run_id(stint: Column, leaves_pit: Column, key: list[str], order: list[str]) -> Column:
    """The stint, else how many times the key has left the pits so far."""
    return F.coalesce(stint, F.sum(leaves_pit.cast("int")).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def every_kth(df: DataFrame, key: list[str], order: list[str], stride: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter((F.col("_n") - 1) % stride == 0).drop("_n")


def edge_rows(df: DataFrame, key: list[str], t: str, seconds: int, head: bool = True) -> DataFrame:
    """The rows of the first (or last) seconds of each key; all rows of a key that has none. t: seconds."""
    w = Window.partitionBy(*key)
    flag = (F.col(t) <= F.min(t).over(w) + seconds) if head else (F.col(t) >= F.max(t).over(w) - seconds)
    return df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_any", F.max("_f").over(w)).filter(F.col("_f") | ~F.col("_any")).drop("_f", "_any")
