"""Rules that the catalogue's tables do not reach."""

import datetime as dt
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paddock.functions import columns, text
from paddock.operators import audit, joins, lookback, pivots, scoring, stats, windows
from paddock.sources import files
from paddock.streaming import events


def values(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_a_future_row_changes_nothing(spark):
    past = [(2025, 1, "VER", 1.0), (2025, 2, "VER", 3.0), (2025, 3, "VER", 5.0)]
    agg = lambda rows: values(lookback.history(spark.createDataFrame(rows, "y int, r int, driver string, v double"), 10).filter("cut_r <= 3").groupBy("cut_r").agg(F.avg("v").alias("v")).orderBy("cut_r"), "cut_r", "v")
    assert agg(past) == agg([*past, (2025, 4, "VER", 1000.0)]) == [(2, 1.0), (3, 2.0)]


def test_look_back_counts_rounds_not_rows(spark):
    df = spark.createDataFrame([(2024, 24, 1), (2025, 1, 2), (2025, 2, 3)], "y int, r int, v int")
    assert sorted(values(lookback.history(df, 1), "cut_y", "cut_r", "v")) == [(2025, 1, 1), (2025, 2, 2)]


def test_mad_of_zero_keeps_the_lower_half(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 9.0), ("b", 5.0)], "k string, x double")
    assert sorted(values(stats.mad_clean(df, ["k"], "x"), "x", "clean")) == [(1.0, True), (1.0, True), (1.0, True), (5.0, True), (9.0, False)]


def test_unknown_counts_as_not_in_the_top_ten(spark):
    df = spark.createDataFrame([(1,), (None,), (12,)], "pos int")
    assert df.agg(stats.rate(F.col("pos") <= 10, F.col("pos")).alias("x")).first().x == pytest.approx(1 / 3)


def test_null_starts_a_stint(spark):
    df = spark.createDataFrame([("a", 1, "S"), ("a", 2, None), ("a", 3, None), ("a", 4, "M")], "d string, lap int, c string")
    assert values(windows.stints(df, "c", ["d"], ["lap"], fill=False).orderBy("lap"), "stint") == [(1,), (2,), (3,), (4,)]
    assert values(windows.stints(df, "c", ["d"], ["lap"]).orderBy("lap"), "stint", "stint_age") == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_percent_rank_shares_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("r", 2.0), ("r", None), ("s", 4.0)], "k string, x double")
    assert sorted(values(df.select("k", "x", windows.percent_rank_avg("x", ["k"]).alias("p")), "k", "x", "p"), key=str) == [("r", 1.0, 1.0), ("r", 2.0, 0.25), ("r", 2.0, 0.25), ("r", None, None), ("s", 4.0, 1.0)]


def test_states_open_once_and_close_at_the_end(spark):
    df = spark.createDataFrame([("k", t, c) for t, c in enumerate("144152244")], "k string, t int, c string")
    assert values(windows.state_windows(df, ["k"], "t", "c", ["4"], ["1", "5"]).orderBy("t0"), "t0", "t1") == [(1, 3), (7, 8)]


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, t int, v string")
    assert sorted(values(joins.asof_join(left, right, ["k"], "t", ["v"]), "k", "t", "v")) == [("a", 1, None), ("a", 5, "y"), ("b", 5, None)]


def test_overlaps_come_out_once(spark):
    a = spark.createDataFrame([("k", 0.0, 100.0)], "k string, a0 double, a1 double")
    b = spark.createDataFrame([("k", 5.0, 95.0), ("k", 100.0, 110.0)], "k string, b0 double, b1 double")
    assert values(joins.overlaps(a, b, ["k"], 10.0), "seconds") == [(90.0,)]


def test_mates(spark):
    df = spark.createDataFrame([("T", "A", 90.0), ("T", "B", 91.0), ("T", "C", 95.0), ("U", "D", 90.0)], "team string, driver string, x double")
    assert sorted(values(joins.mate_delta(df, ["team"], "driver", "x"), "driver", "mate_delta")) == [("A", -1.0), ("B", 1.0), ("C", 5.0)]


def test_conflicts_raise(spark):
    a, b = (spark.createDataFrame([("A", x)], "k string, v double") for x in (1.0, 2.0))
    with pytest.raises(Exception, match="conflicting"):
        joins.coalesce_outer(a, b, ["k"]).collect()
    both = spark.createDataFrame([("A", 1.0, None), ("B", None, 2.0)], "k string, v double, w double").toDF("k", "score", "score\n")
    assert sorted(values(columns.sanitize(both), "k", "score")) == [("A", 1.0), ("B", 2.0)]


def test_durations(spark):
    df = spark.createDataFrame([("0 days 00:01:35.400000",), ("1:02:03",), ("95.4",), ("nan",), ("x",), (None,), ("-0 days 00:00:01",)], "t string")
    assert [r.s for r in df.select(text.duration_seconds(F.col("t")).alias("s")).collect()] == [95.4, 3723.0, 95.4, None, None, None, -1.0]


def test_outcomes(spark):
    df = spark.createDataFrame([("Finished", 1), ("+2 Laps", 12), ("Engine", 15), ("DSQ", 3), (None, 4), (None, None)], "s string, p int")
    assert [r.o for r in df.select(text.outcome(F.col("s"), F.col("p")).alias("o")).collect()] == ["finish", "finish", "dnf", "dsq", "finish", "dnf"]


def test_points_and_standings(spark):
    df = spark.createDataFrame([("VER", 1, 1), ("NOR", 2, 1), ("HAM", 11, 1)], "driver string, rank int, race int")
    assert sorted(values(scoring.standings(df, "driver", "rank", ["race"]), "driver", "points", "wins", "podiums", "rank")) == [("HAM", 0, 0, 0, 3), ("NOR", 18, 0, 1, 2), ("VER", 25, 1, 1, 1)]


def test_slug(spark):
    row = spark.createDataFrame([("São Paulo  GP!",)], "t string").select(text.slug_ascii(F.col("t")).alias("a"), text.slug_word(F.lit(" ?? ")).alias("b")).first()
    assert (row.a, row.b) == ("sao_paulo_gp", "unknown")


def test_leakage_finds_the_target(spark):
    df = spark.createDataFrame([(1, i, float(i), float(-i), 0.0, float(i * i)) for i in range(1, 9)], "race int, pos int, same double, neg double, fixed double, squared double")
    got = {r.feature: r for r in audit.leakage(df, ["race"], ["same", "neg", "fixed", "squared"], "pos").collect()}
    assert got["same"].equals_target and got["neg"].equals_negative and got["fixed"].constant and got["squared"].ranks_as_target and not got["fixed"].ranks_as_target


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "y int, r int, driver string, v double")
    assert lookback.history(empty, 5).count() == stats.trend(empty, ["driver"], "v", ["y"]).count() == pivots.mix(empty, ["driver"], "driver", ["a"]).count() == 0


def test_csv_columns_in_another_order(spark, tmp_path):
    (tmp_path / "laps_2025_1_FP2.csv").write_text("Driver,LapTime\nVER,0 days 00:01:35\n")
    (tmp_path / "laps_2025_2.csv").write_text("LapTime,Driver,Extra\n0 days 00:01:30,NOR,1\n")
    df = files.normalise(files.read_events(spark, str(tmp_path), "laps"), {"driver": (["Driver", "Abbreviation"], "string"), "lap": (["laptime"], "string"), "missing": (["Nothing"], "double")})
    assert sorted(values(df, "year", "round", "session", "driver", "lap", "missing")) == [(2025, 1, "FP2", "VER", "0 days 00:01:35", None), (2025, 2, "R", "NOR", "0 days 00:01:30", None)]
    assert sorted(values(files.manifest(spark, str(tmp_path)), "table", "year", "round", "session")) == [("laps", 2025, 1, "FP2"), ("laps", 2025, 2, "R")]


def test_rounds_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_rounds(spark.createDataFrame([("a", 1, 2025, 1), ("a", 1, 2025, 2)], "k string, v int, year int, round int"), path)
    files.write_rounds(spark.createDataFrame([("a", 9, 2025, 2)], "k string, v int, year int, round int"), path)
    assert sorted(values(spark.read.parquet(path), "round", "v")) == [(1, 1), (2, 9)]


def test_missing_rounds(spark):
    day = lambda n: dt.datetime(2025, 1, n)
    schedule = spark.createDataFrame([(2025, 1, day(1), day(2)), (2025, 2, day(3), None), (2025, 3, day(9), day(10))], "year int, round int, s1 timestamp, s2 timestamp")
    present = spark.createDataFrame([(2025, 1)], "year int, round int")
    assert values(files.missing_rounds(schedule, present, ["s1", "s2"], F.lit(day(5))), "round") == [(2,)]


def test_streamed_windows_equal_batch(spark, tmp_path):
    t = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    rows = [("k", t(1), "4", 1.0), ("k", t(2), "4", 2.0), ("k", t(3), "1", 3.0), ("k", t(5), "4", 4.0), ("k", t(7), "1", 5.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, code string, x double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), df.schema)
    q = events.status_windows(stream, "k", "ts", "code", ["4"], ["1"]).writeStream.format("memory").queryName("closed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.t0.second, r.t1.second) for r in spark.table("closed").collect()) == [(1, 3), (5, 7)]
    q = events.windowed(stream, "ts", ["k"], "x").writeStream.format("memory").queryName("per_window").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.mean) for r in spark.table("per_window").collect()] == [(5, 3.0)]


def test_without_the_corpus_operators(tmp_path):
    """A copy of the library without the folders of the corpus operators imports, and has all other queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"
    run = lambda folder: [int(n) for n in subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()]
    without, with_ = run(tmp_path / "copy"), run(root)
    assert without[2] == 0 and without[0] > 100 and with_[0] - with_[2] == without[0] and with_[1] >= without[1]
    used = subprocess.run(["grep", "-rlE", "paddock[.]llm|from [.]+llm|import llm", str(root / "paddock"), "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all("/llm/" in f for f in used)


def test_fuzzy_names_equal_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, last = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != d)))
        return row[-1]

    rng = random.Random(6)
    known = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 16))) for _ in range(120)} | {"interlagos", "Monza", "spa", "!"})
    asked = {"nterlagos", "xnterlagos", "terlagos", "ainterlagos", "Inter-Lagos", "onza", "ronza", "a", "", "zz"}
    for name in known:
        for _ in range(3):
            letters = list(name)
            for _ in range(rng.randrange(1, 4)):
                at = rng.choice([0, rng.randrange(len(letters) + 1)])
                letters[at : at + rng.randrange(2)] = rng.choice(["", "a", "x"])
            asked.add("".join(letters))
    norm = lambda t: "".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    table = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    for least in (0.8, 0.7):
        want = {}
        for a in asked:
            scores = sorted((-(1 - distance(norm(a), norm(b)) / max(len(norm(a)), len(norm(b)), 1)), b) for b in known)
            if -scores[0][0] >= least:
                want[a] = scores[0][1], -scores[0][0]
        got = {r.name: (r.match, r.score) for r in joins.fuzzy_match(table(sorted(asked)), table(known), "name", least).collect()}
        assert got == want and got["nterlagos"][0] == got["xnterlagos"][0] == got["ainterlagos"][0] == "interlagos"


def test_quantiles_of_whole_columns(spark):
    rng = random.Random(9)
    for xs in ([], [3.0], [1.0, 1.0, 2.0], [rng.gauss(0, 1e6) for _ in range(2000)] + [1e-300, 1e300, 0.0], [5.0] * 500 + [float(k % 7) for k in range(500)]):
        df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
        got = stats.exact_quantiles(df, "x", [0.0, 0.01, 0.5, 0.9, 1.0], bins=16)
        for p, q in zip([0.0, 0.01, 0.5, 0.9, 1.0], got):
            at = p * (len(xs) - 1)
            ys = sorted(xs)
            want = ys[int(at)] + (ys[min(int(at) + 1, len(ys) - 1)] - ys[int(at)]) * (at - int(at)) if xs else None
            assert q == want or q == pytest.approx(want, rel=1e-12)


def test_saved_rounds_are_recombined(spark, tmp_path):
    rows = lambda x: spark.createDataFrame([("VER", x)], "Driver string, x double").coalesce(1)
    for name, x in (("features_2025_1.parquet", 1.0), ("features_2025_2.parquet", 2.0), ("features_2024_3.parquet", 3.0), ("other_2025_4.parquet", 4.0)):
        rows(x).write.parquet(str(tmp_path / name))
    for name in ("features_2025_1.csv", "features_2023_9.csv"):
        rows(9.0).write.option("header", True).csv(str(tmp_path / name))
    got = files.saved_rounds(spark, str(tmp_path), "features", ["2025_2"])
    assert sorted(values(got, "year", "round", "x")) == [(2023, 9, 9.0), (2024, 3, 3.0), (2025, 1, 1.0)]
    assert files.saved_rounds(spark, str(tmp_path), "none").count() == 0


def test_a_track_that_the_table_lacks_takes_the_defaults(spark):
    from paddock.plans import tracks

    rounds = spark.createDataFrame([(2025, 1, "known"), (2025, 2, "unknown")], "year int, round int, slug string")
    table = spark.createDataFrame([("known", 5.0, 1.0)], "slug string, lap_km double, drs_zones double")
    got = {r.track_slug: (round(r.track_pit_loss_s, 6), round(r.track_fuel_effect_s_per10kg, 6)) for r in tracks.profiles(rounds, table).collect()}
    assert got == {"known": (20.8, 0.185), "unknown": (19.0, 0.21)}
