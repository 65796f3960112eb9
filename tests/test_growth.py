"""Steps whose work must not grow with the square of a group, and results that must not depend on how a table is split."""

import random
import re

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paddock.functions import text
from paddock.operators import lookback, scoring, stats, windows
from paddock.plans import catalogue, catalogue_files, features, registry, views, weekends
from paddock.sources import files, weekend


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_likelihoods_sum_from_the_end(spark):
    rows = spark.createDataFrame([(1, 0.5, 2), (1, 1.5, 1), (1, 0.1, 3), (2, 0.3, 1)], "r int, s double, place int")
    out = scoring.plackett_luce_nll(rows, ["r"], "s", "place", total=True)
    assert "currentrow$(), unboundedfollowing" not in plan(out)
    e = [F.exp(F.lit(v)) for v in (1.5, 0.5, 0.1)]
    want = spark.range(1).select((F.log(e[0] + e[1] + e[2]) - 1.5 + F.log(e[1] + e[2]) - 0.5).alias("v")).first().v
    assert {r.r: pytest.approx(r.nll) for r in out.collect()} == {1: want, 2: 0.0}


def test_places_do_not_depend_on_how_events_are_split(spark, tmp_path):
    """Sums of doubles are those in the order of the events, so drivers with the same events tie as in SQL."""
    rng, rows = random.Random(3), []
    for user in range(6):
        values = [0.1, 0.2, 0.3, 0.7, 1.1, 2.3]
        rng.shuffle(values)
        rows += [(i * 10 + user * 1000, user, v) for i, v in enumerate(values)]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?)", rows)
    want = con.execute("SELECT 'D' || user_id, row_number() OVER (ORDER BY v DESC, user_id) FROM (SELECT user_id, sum(value) AS v FROM events GROUP BY 1)").fetchall()
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumns({"ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")), "event_type": F.lit("view")})
    df.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    # positions hide every eleventh id, the points' order shows all
    got = weekends.tables(spark, str(tmp_path))["results"].select("driver", (26 - F.col("points")).cast("int")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_millionths_round_as_in_sql(spark):
    """The double next to 0.5082625 is below it once multiplied by a million, though its shortest decimal ends in 5."""
    values = [0.5082625, 0.4734375, 0.1234565, -0.5082625, 2.5e-7, 5e-7, 12345.6789015]
    got = [r.v for r in registry.tidy(spark.createDataFrame([(v,) for v in values], "v double")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_distinct_values_are_counted_once_a_key(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (1, None), (2, "a"), (None, "z")], "d int, x string")
    out = windows.with_distinct(rows, "x", ["d"], "n")
    assert "collect_set" not in plan(out) and sorted(map(tuple, out.select("d", "n").collect()), key=str) == [(1, 2)] * 4 + [(2, 1), (None, 1)]


@pytest.mark.parametrize("half", [1, 7, 50])
def test_band_minima_without_a_moving_frame(spark, half):
    rng = random.Random(half)
    rows = [(rng.randrange(2), rng.randrange(-60, 60), rng.choice([None, *range(100)])) for _ in range(300)] + [(0, None, 5), (0, None, 3), (None, 4, 1)]
    out = windows.with_band_best(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d int, t long, x int"), ["d"], "x", "t", half, "best")
    assert f"rangeframe, -{half}," not in plan(out)
    for r in out.collect():
        near = [x for d, t, x in rows if d == r.d and x is not None and (t == r.t if r.t is None or t is None else abs(t - r.t) <= half)]
        assert r.best == min(near, default=None), r
    assert out.count() == len(rows)


def facts_of(spark):
    rng = random.Random(8)
    rows = [(2023 + o // 4, 1 + o % 4, d, rng.randrange(20)) for o in range(12) for d in "abcd" for _ in range(rng.randrange(3))]
    return rows, spark.createDataFrame([*rows, (None, 1, "a", 7)], "y int, r int, d string, v int")


def test_rounds_seen_copies_no_facts(spark):
    """Equal to the history that copies each fact to every cut-off, and without its join of facts and cut-offs."""
    rows, df = facts_of(spark)
    out = lookback.rounds_seen(df, ["d"], 3, total=F.sum("v"), rows=F.count("*"))
    add = lambda c: F.aggregate("seen", F.lit(0).cast("long"), lambda a, x: a + x[c])
    got = out.select("cut_y", "cut_r", "d", add("total"), add("rows"), F.array_max("seen.r"), F.element_at("seen", -1)["y"])
    want = lookback.history(df, 3).groupBy("cut_y", "cut_r", "d").agg(F.sum("v"), F.count("*"), F.max("r"), F.max("y"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_own_history_copies_facts_to_own_rounds_only(spark):
    rows, df = facts_of(spark)
    out = lookback.own_history(df, ["d"], 3)
    past = sorted(map(tuple, out.filter("age > 0").select("cut_y", "cut_r", "d", "y", "r", "v", "age").collect()))
    mine = df.select(F.col("y").alias("cut_y"), F.col("r").alias("cut_r"), "d").distinct()
    want = lookback.history(df, 3).join(mine, ["cut_y", "cut_r", "d"]).select("cut_y", "cut_r", "d", "y", "r", "v", "age")
    assert past == sorted(map(tuple, want.collect()))
    assert out.filter("age = 0").count() == len(rows) + 1


def test_average_ranks_take_one_sort(spark):
    rows = [(k, v) for k in (1, 2) for v in (3.0, 1.0, 3.0, 2.0, 3.0, 1.0)] + [(3, 5.0)]
    out = spark.createDataFrame(rows, "k int, v double").select("k", "v", windows.average_rank("v", ["k"]).alias("a"))
    assert plan(out).count("sort [") == 1
    assert {(r.k, r.v): r.a for r in out.collect()} == {**{(k, v): a for k in (1, 2) for v, a in ((1.0, 1.5), (2.0, 3.0), (3.0, 5.0))}, (3, 5.0): 1.0}


def test_rounds_of_a_roster_are_found_once(spark):
    """The cut-offs meet each source of a roster; what they are told from is not read again for each."""
    people = "year int, round int, session string, driver string, team string"
    res = spark.createDataFrame([(2024, 1, "R", "a", "A"), (2024, 2, "Q", "b", "B"), (2024, 4, "Q", "z", "Z")], people)
    laps = spark.createDataFrame([(2024, 2, "FP1", "c", "C"), (2024, 3, "FP1", "c", "C"), (2024, 3, "R", "d", "D")], people)
    cuts = spark.range(1, 4).select(F.lit(2024).alias("year"), F.col("id").cast("int").alias("round"))
    out = features.roster_of({"results": res, "laps": laps}, cuts)
    assert " range (" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(2024, 2, "b", "B"), (2024, 3, "c", "C")]
    assert features.roster_of({"results": res, "laps": laps}, cuts.filter("round > 9")).collect() == []
    with pytest.raises(ValueError, match="too many rounds"):
        lookback.fixed(spark.range(lookback.MOST_ROUNDS + 1).select(F.lit(1).alias("year"), F.col("id").cast("int").alias("round")))


def test_keys_of_files_take_one_search(spark):
    names = {"f:/t_2023_1.csv/laps_2024_10_FP1_VER.csv/part-1-a.csv": (2024, 10, "FP1", "VER"), "laps_2024_1_SS.csv": (2024, 1, "SQ", None), "x/laps_2024_1_VER.csv": (2024, 1, "R", "VER"), "x/laps_2024_1_Q_44A.csv": (2024, 1, "Q", "44A"),
             "x/laps_2024_1.csv": (2024, 1, "R", None), "x/9_2024_1.csv": (None, None, "R", None), "x/laps_2024_1_SQS.csv": (2024, 1, "R", "SQS"), "x/laps_2024_123.csv": (None, None, "R", None), "x/laps_2024_1_FP1_FP2.csv": (2024, 1, "FP1", "FP2")}
    # a written table, as a local one is computed when it is planned
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(2)
    out = files.with_name_key(df, F.col("n"))
    assert plan(out.select("year", "round", "session", "file_driver")).count("regexp_extract(substring_index(") > 0
    assert plan(out.select("year")).count("regexp_extract(") == 1 and plan(out.select("session")).count(", 3)") == 0
    assert {r.n: (r.year, r["round"], r.session, r.file_driver) for r in out.collect()} == names


def test_durations_are_compiled(spark, tmp_path):
    """Java leaves methods of over 8000 bytes interpreted, so the projections of laps must stay below; and they are read as before."""
    (tmp_path / "laps_2025_1_Q.csv").write_text("Driver,LapNumber,LapTime,Time,PitInTime\nVER,1,0 days 00:01:35.400000,0 days 01:00:00.500000,\nVER,2,1:35,-0 days 00:00:01.5,1:00:00\n")
    (tmp_path / "laps_2025_1_FP1.csv").write_text("Driver,LapNumber,LapTime\nVER,1,95400\nVER,2,x|1|2|3|4\n")
    rows = weekend.laps(spark, str(tmp_path)).select(*weekend.KEY, "lap", "lap_s", "time_s", "pit_in", "stint", "compound", "track_status")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", rows.select("*")._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert sizes and max(sizes) < 8000
    assert {(r.session, r.lap): (r.lap_s, r.time_s, r.pit_in) for r in rows.collect()} == {("Q", 1): (95.4, 3600.5, None), ("Q", 2): (95.0, -1.5, 3600.0), ("FP1", 1): (95.4, None, None), ("FP1", 2): (None, None, None)}


def test_durations_of_all_shapes(spark):
    said = {"1 day, 1:02:03.25": 90123.25, "-1:02": -62.0, " 5:06 ": 306.0, "2 days 1:02": 172862.0, "7.5": 7.5, "1:|02": None, "1|0|0|1|2": None, "1:2:3:4": None, "nan": None, "": None, "x": None}
    got = spark.createDataFrame([(v,) for v in said], "v string").repartition(2).select("v", text.duration_seconds(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in got} == said
    texts = {95.4: "0 days 00:01:35.400000", -1.5: "-0 days 00:00:01.500000", 90123.25: "1 days 01:02:03.250000", 0.000001: "0 days 00:00:00.000001"}
    out = spark.createDataFrame([(v,) for v in texts], "v double").select("v", text.duration_text(F.col("v")).alias("t"))
    assert "format_string" not in plan(out) and {r.v: r.t for r in out.collect()} == texts


def test_thousandths_of_files_round_as_in_sql(spark):
    values = [16485.9855, 2079.3385, 80.0065, -1.0005, 95.4]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(catalogue_files._third("v")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 3)", [v]).fetchone()[0] for v in values]


@pytest.fixture
def odd_results(spark, tmp_path):
    """A folder of orders and customers with nulls, rows that come twice, rounds that a driver leaves out and one driver with a fifth of the orders."""
    rng, rows = random.Random(11), []
    for k in range(600):
        driver = 1 if k % 5 == 0 else rng.choice([None, *range(2, 30)])
        day = f"{rng.choice([1995, 1996, 1996, 1998])}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}" if k % 41 else None
        rows.append((k if k % 53 else None, driver, rng.choice("FOP"), rng.choice([None, *(round(rng.uniform(1, 999), 2) for _ in range(5))]), day))
    orders = spark.createDataFrame([*rows, *rows[100:140]], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, d string")
    orders.withColumn("o_orderdate", F.col("d").cast("timestamp_ntz")).drop("d").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    teams = [(d, d % 7 if d % 6 else None) for d in range(1, 27)]
    spark.createDataFrame([*teams, *teams[:3], (None, 4)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def rows_of(df, *names):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=str)


def test_last_team_groups_no_copies(spark, odd_results):
    """Equal to the last row of all copies, and what is shuffled or grouped are facts, not their copies."""
    out = catalogue.last_known_team(spark, odd_results)
    want = lookback.latest(lookback.history(views.results(spark, odd_results), 10), catalogue.DRIVER, "team", ["y", "r", "k"])
    assert rows_of(out, *catalogue.DRIVER, "last_team") == rows_of(want, *catalogue.DRIVER, "team") != []
    assert "hashpartitioning(cut_" not in plan(out) and "keys=[cut_" not in plan(out) and "key=[cut_" not in plan(out)


def test_same_else_recent_shuffles_no_copies(spark, odd_results):
    """Equal to groups of the copied rows themselves, while only sums by round are dealt by driver, before they are copied."""
    out = catalogue.same_else_recent(spark, odd_results)
    seen = lookback.history(views.results(spark, odd_results), 12)
    e = F.count_if(F.col("r") == F.col("cut_r")).over(Window.partitionBy(*catalogue.DRIVER)) >= 1
    used = seen.withColumn("e", e).filter((F.col("e") & (F.col("r") == F.col("cut_r"))) | (~F.col("e") & (F.col("age") <= 8)))
    want = used.groupBy(*catalogue.DRIVER).agg(F.count("*").alias("n"), F.avg("points").alias("points_mean"))
    assert rows_of(out, *catalogue.DRIVER, "n", "points_mean") == rows_of(want, *catalogue.DRIVER, "n", "points_mean") != []
    assert "cut_y" not in "".join(x for x in plan(out).splitlines() if "hashpartitioning(" in x)
    # as many partitions as a shuffle has, whatever the size before the copying
    assert re.search(r"hashpartitioning\(driver#\w+, 4\), repartition_by_num", plan(out))


def test_other_rows_are_not_sorted_for_the_same(spark):
    rows = spark.createDataFrame([(1, True, False), (1, False, True), (1, False, False), (1, None, True), (2, None, True), (2, False, None), (2, False, False), (3, None, None)], "c int, s boolean, w boolean")
    got = lookback.prefer_same(rows.repartition(2), ["c"], F.col("s"), 1, F.col("w"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, True, False), (2, None, True)]
    assert "filter (s#" in plan(got)[plan(got).index("window"):]


def test_blend_holds_few_copies_a_task(spark, odd_results):
    """Equal to means of the copied rows themselves, while sums by round are dealt over more partitions than a shuffle has, for the copies."""
    out = catalogue.blend_same_recent(spark, odd_results)
    same, points = F.col("r") % 4 == F.col("cut_r") % 4, F.col("points")
    a = lookback.history(views.results(spark, odd_results), 10).groupBy(*catalogue.DRIVER).agg(F.avg(F.when(same, points)).alias("same"), F.count_if(same).alias("n"), F.avg(F.when(F.col("age") <= 8, points)).alias("recent"))
    want = registry.tidy(a.select(*catalogue.DRIVER, stats.blend(F.col("same"), F.col("recent"), F.col("n")).alias("blended")))
    assert rows_of(out, *catalogue.DRIVER, "blended") == rows_of(want, *catalogue.DRIVER, "blended") != []
    assert "hashpartitioning(cut_" not in plan(out) and re.search(r"hashpartitioning\(driver#\w+, 16\), repartition_by_num", plan(out))
