"""As-of, interval and group-mate joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: list[str], t: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of the same key at or before its time: one sort of both, no pairs."""
    l = left.withColumn("_side", F.lit(1))
    r = right.select(*key, t, F.struct(*values).alias("_v")).withColumn("_side", F.lit(0))
    both = r.unionByName(l, allowMissingColumns=True)
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy(*key).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_last", last).filter("_side = 1").select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def buckets(t0: Column, t1: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(t0 / width), F.floor(t1 / width)))


def overlaps(left: DataFrame, right: DataFrame, key: list[str], width: float) -> DataFrame:
    """Pairs of intervals (left a0, a1; right b0, b1) of one key that overlap, met through time buckets. A pair counts in the first
    bucket that both have, so it comes out once; ``seconds`` is their overlap."""
    l = left.withColumn("_b", buckets(F.col("a0"), F.col("a1"), width)).withColumn("_first", F.floor(F.col("a0") / width))
    r = right.withColumn("_b", buckets(F.col("b0"), F.col("b1"), width)).withColumn("_start", F.floor(F.col("b0") / width))
    met = l.join(r, [*key, "_b"]).filter((F.col("b0") < F.col("a1")) & (F.col("b1") > F.col("a0")) & (F.col("_b") == F.greatest("_first", "_start")))
    return met.withColumn("seconds", F.least("a1", "b1") - F.greatest("a0", "b0")).drop("_b", "_first", "_start")


def rebuilt_laps(laps: DataFrame, tyres: DataFrame, key: list[str], t: str, values: list[str], start: Column | None = None) -> DataFrame:
    """Laps (key, t: their end) with the latest tyre row at or before their end and lap_start: the end of the key's lap before, for
    the first one ``start``."""
    out = asof_join(laps, tyres, key, t, values)
    before = F.lag(t).over(Window.partitionBy(*key).orderBy(t))
    return out.withColumn("lap_start", before if start is None else F.coalesce(before, start))


def mate_delta(df: DataFrame, group: list[str], member: str, x: str) -> DataFrame:
    """own less mate's value for members of groups of two or more: the mate is the first other member in order."""
    one = df.groupBy(*group, member).agg(F.min(x).alias(x))
    mates = one.select(*group, F.col(member).alias("_mate"), F.col(x).alias("_x"))
    w = Window.partitionBy(*group)
    # only the first two members of a group can be anybody's mate
    mates = mates.withColumn("_n", F.row_number().over(w.orderBy("_mate"))).filter("_n <= 2")
    pairs = one.join(mates, group).filter(F.col(member) != F.col("_mate"))
    first = F.row_number().over(Window.partitionBy(*group, member).orderBy("_n"))
    return pairs.withColumn("_r", first).filter("_r = 1").select(*group, member, (F.col(x) - F.col("_x")).alias("mate_delta"))


def without_laps(df: DataFrame, marks: DataFrame, key: list[str], lap: str) -> DataFrame:
    """df without the marked laps and those right after them."""
    gone = marks.select(*key, F.explode(F.array(F.col(lap), F.col(lap) + 1)).alias(lap)).distinct()
    return df.join(gone, [*key, lap], "left_anti")


def coalesce_outer(left: DataFrame, right: DataFrame, key: list[str], tolerance: tuple[float, float] = (1e-6, 1e-8)) -> DataFrame:
    """Full outer join on the key; a column that both have is taken from the left, else from the right. Where both have a
    value they must agree, else the query raises."""
    shared = [c for c in left.columns if c in right.columns and c not in key]
    r = right.select(*key, *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns if c not in key])
    out = left.join(r, key, "full_outer")
    for c in shared:
        a, b = F.col(c), F.col(f"_r_{c}")
        if dict(left.dtypes)[c] in ("double", "float"):
            differs = F.abs(a - b) > tolerance[1] + tolerance[0] * F.abs(b)
        else:
            differs = a != b
        out = out.withColumn(c, F.when(differs, F.raise_error(F.lit(f"conflicting values in {c}"))).otherwise(F.coalesce(a, b)))
    return out.select(*left.columns, *[c for c in right.columns if c not in left.columns])


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def fuzzy_match(names: DataFrame, known: DataFrame, name: str, least: float = 0.8) -> DataFrame:
    """name, match, score: equal after normalising, else the most similar known name of all.

    A known name of n letters is within k = n * (1 / least - 1) edits of whatever is similar enough, so of its k + 1 segments one
    is untouched and stands in the other at most k places away: candidates meet by length, number and letters of a segment."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    edits = lambda n: F.floor(n * (1 / least - 1) + 1e-9).cast("int")
    start = lambda i: F.floor(i * F.col("_l") / (F.col("_k") + 1)).cast("int")
    a = names.select(name).distinct().withColumn("_a", norm(F.col(name)))
    b = known.select(F.col(name).alias("match")).distinct().withColumn("_b", norm(F.col("match"))).withColumn("_l", F.length("_b"))
    of = lambda df: df.withColumn("_k", edits(F.col("_l"))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k")))).withColumn("_at", start(F.col("_i"))).withColumn("_n", start(F.col("_i") + 1) - F.col("_at"))
    lengths = F.sequence(F.ceil(F.length("_a") * least - 1e-9).cast("int"), F.floor(F.length("_a") / least + 1e-9).cast("int"))
    probes = of(a.withColumn("_l", F.explode(lengths))).withColumn("_at", F.explode(F.sequence(F.col("_at") - F.col("_k"), F.col("_at") + F.col("_k")))).filter((F.col("_at") >= 0) & (F.col("_at") + F.col("_n") <= F.length("_a")))
    segment = lambda text: F.substring(F.col(text), F.col("_at") + 1, F.col("_n")).alias("_s")
    met = probes.select(name, "_a", "_l", "_i", segment("_a")).distinct().join(of(b).select("match", "_b", "_l", "_i", segment("_b")), ["_l", "_i", "_s"])
    scored = met.select(name, "_a", "match", "_b").distinct().withColumn("score", similarity(F.col("_a"), F.col("_b"))).filter(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("score"), "match"))
    return scored.withColumn("_n", best).filter("_n = 1").select(name, "match", "score")
