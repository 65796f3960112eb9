"""As-of look-back: what was known strictly before a cut-off round, for all cut-offs at once.

Rounds are (year, round) pairs. They are few, so they are numbered once and every cut-off is paired with the numbers of
the rounds that it may see; facts meet these pairs by equality on the number. Facts are never compared with facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rounds are a calendar's: a table of one row a round that has more is refused, as it would not be broadcast safely.
MOST_ROUNDS = 5000


def few(df: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """df marked for a broadcast; the query raises if it has more than ``most`` rows. What is counted is cut off behind ``most``
    rows first, so a table that is far too large is neither collected nor sent to one task."""
    n = F.row_number().over(Window.orderBy(F.lit(1)))
    fits = F.when(F.col("_n") > most, F.raise_error(F.lit(f"more than {most} rows to broadcast"))).otherwise(F.lit(True)).cast("boolean")
    return F.broadcast(df.limit(most + 1).withColumn("_n", n).filter(fits).drop("_n"))


def fixed(rounds: DataFrame) -> DataFrame:
    """The rounds, found once: what is told of many rows (laps, files) would else be read again by each join that the rounds take part
    in. They are few; more than a calendar has are refused."""
    found = rounds.limit(MOST_ROUNDS + 1).collect()
    if len(found) > MOST_ROUNDS:
        raise ValueError("too many rounds")
    return rounds.sparkSession.createDataFrame(found, rounds.schema)


def before(y: Column, r: Column, cut_y: Column, cut_r: Column) -> Column:
    """The strict as-of predicate."""
    return (y < cut_y) | ((y == cut_y) & (r < cut_r))


def numbered_rounds(facts: DataFrame, y: str = "y", r: str = "r") -> DataFrame:
    """The distinct rounds with their place ``ord`` in time (from 1)."""
    return facts.select(y, r).distinct().withColumn("ord", F.row_number().over(Window.orderBy(y, r))).withColumn("ord", F.when(F.col("ord") > MOST_ROUNDS, F.raise_error(F.lit("too many rounds"))).otherwise(F.col("ord")).cast("int"))


def visible(rounds: DataFrame, n: int) -> DataFrame:
    """cut_ord, ord: each cut-off with the last ``n`` rounds before it."""
    return rounds.select(F.col("ord").alias("cut_ord"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("ord") - n), F.col("ord") - 1)).alias("ord")).filter("ord < cut_ord and ord >= 1")


def history(facts: DataFrame, n: int, y: str = "y", r: str = "r", by: list[str] | None = None, spread: int = 1) -> DataFrame:
    """The facts that each cut-off sees: cut_y, cut_r, age (rounds back, from 1) and the facts' own columns.
    With ``by`` the facts are dealt by these columns before they are copied, so what groups the copies by them and the cut-off shuffles no
    copies. All facts of a key then meet in one task: give facts that are few a key, such as sums by round. They are dealt over ``spread``
    times the partitions of a shuffle, so that a task holds fewer of the copies; each partition is a task, and a file where it is written."""
    rounds = numbered_rounds(facts, y, r)
    if by:
        # a number, as AQE would else put partitions together by the size that they have before the copying
        facts = facts.repartition(spread * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    pairs = visible(rounds.filter("ord > 1"), n)
    cuts = rounds.select(F.col("ord").alias("cut_ord"), F.col(y).alias("cut_y"), F.col(r).alias("cut_r"))
    seen = pairs.join(F.broadcast(cuts), "cut_ord").join(rounds, "ord").withColumn("age", F.col("cut_ord") - F.col("ord")).drop("cut_ord", "ord")
    return facts.join(F.broadcast(seen), [y, r])


def rounds_seen(facts: DataFrame, key: list[str], n: int, y: str = "y", r: str = "r", **aggregates: Column) -> DataFrame:
    """cut_y, cut_r, key, seen: for each cut-off that a key has facts before, its last ``n`` rounds with facts as an array of (ord, y, r and
    the round's aggregates), the earliest first. Facts are aggregated by round once and never copied to cut-offs; an array has a calendar's rounds at most."""
    rounds = numbered_rounds(facts, y, r)
    last = rounds.agg(F.max("ord").alias("_last"))
    cuts = rounds.select(F.col("ord").alias("_c"), F.col(y).alias("cut_y"), F.col(r).alias("cut_r"))
    per = facts.groupBy(*key, y, r).agg(*[c.alias(name) for name, c in aggregates.items()]) if aggregates else facts.select(*key, y, r).distinct()
    per = per.join(F.broadcast(rounds), [y, r])
    own = per.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", y, r, *aggregates))).alias("_own")).join(F.broadcast(last))
    ends = F.element_at("_own", 1)["ord"] + 1, F.least(F.element_at("_own", -1)["ord"] + n, F.col("_last"))
    at = own.filter(ends[0] <= ends[1]).withColumn("_c", F.explode(F.sequence(*ends)))
    seen = at.withColumn("seen", F.filter("_own", lambda x: (x["ord"] < F.col("_c")) & (x["ord"] >= F.col("_c") - n))).filter(F.size("seen") > 0)
    return seen.join(F.broadcast(cuts), "_c").select("cut_y", "cut_r", *key, "seen")


def own_history(facts: DataFrame, key: list[str], n: int, y: str = "y", r: str = "r") -> DataFrame:
    """The facts that a key's own rounds see, and those of the round itself, which have age 0: cut_y, cut_r, age and the facts' columns.
    A fact is copied only to rounds that its key has, at most ``n`` and its own."""
    rounds = numbered_rounds(facts, y, r)
    cuts = rounds.select(F.col("ord").alias("_c"), F.col(y).alias("cut_y"), F.col(r).alias("cut_r"))
    marked = facts.join(F.broadcast(rounds.withColumnsRenamed({y: "_y", r: "_r"})), F.col(y).eqNullSafe(F.col("_y")) & F.col(r).eqNullSafe(F.col("_r"))).drop("_y", "_r")
    own = marked.groupBy(*key).agg(F.collect_set("ord").alias("_own"))
    # a fact without a date is seen by no other round
    upto = F.col("ord") + F.when(F.col(y).isNotNull() & F.col(r).isNotNull(), n).otherwise(0)
    copied = marked.join(own, key).withColumn("_c", F.explode(F.filter("_own", lambda c: (c >= F.col("ord")) & (c <= upto))))
    return copied.withColumn("age", F.col("_c") - F.col("ord")).join(F.broadcast(cuts), "_c").drop("_c", "_own", "ord")


def seen_by(facts: DataFrame, cutoffs: DataFrame, n: int, y: str = "year", r: str = "round") -> DataFrame:
    """As ``history``, for given cut-offs (y, r), which need not have facts of their own: cut_y, cut_r, age and the facts' columns."""
    marked = facts.select(y, r).distinct().withColumn("_f", F.lit(1)).unionByName(cutoffs.select(y, r).distinct().withColumn("_f", F.lit(0)))
    rounds = marked.groupBy(y, r).agg(F.max("_f").alias("_f"), F.min("_f").alias("_c"))
    upto = F.sum("_f").over(Window.orderBy(y, r).rowsBetween(Window.unboundedPreceding, -1))
    numbered = rounds.withColumn("_before", F.coalesce(upto, F.lit(0))).withColumn("_before", F.when(F.col("_before") >= MOST_ROUNDS, F.raise_error(F.lit("too many rounds"))).otherwise(F.col("_before")).cast("int"))
    cuts = numbered.join(cutoffs.select(y, r).distinct(), [y, r], "left_semi").select(F.col(y).alias("cut_y"), F.col(r).alias("cut_r"), F.col("_before").alias("_m"))
    places = cuts.select("cut_y", "cut_r", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.greatest(F.col("_m"), F.lit(1))))).alias("age"), "_m").filter("age <= _m").withColumn("_no", F.col("_m") - F.col("age") + 1)
    return facts.join(F.broadcast(numbered.filter("_f = 1").select(y, r, (F.col("_before") + 1).alias("_no")).join(places, "_no").drop("_no", "_m")), [y, r])


def latest(facts: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of each key's last row in the order."""
    return facts.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def last_rows(facts: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    return facts.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def prefer_same(facts: DataFrame, cut: list[str], same: Column, least: int, recent: Column) -> DataFrame:
    """Rows of the same kind where a cut-off has ``least`` of them, else those that ``recent`` marks."""
    enough = F.count_if(same).over(Window.partitionBy(*cut)) >= least
    # other rows are never returned, so they needn't be sorted
    return facts.filter(same | recent).withColumn("_e", enough).filter((F.col("_e") & same) | (~F.col("_e") & recent)).drop("_e")


def first_available(frames: list[DataFrame], group: list[str]) -> DataFrame:
    """For each group the rows of the first frame in the list that has any."""
    tagged = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("_b", F.min("_p").over(Window.partitionBy(*group))).filter("_p = _b").drop("_p", "_b")
