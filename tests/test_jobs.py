"""From files to standings: ingest, build, train, predict, simulate, audit, refresh."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_weekend_files import dur, put

from paddock.plans import artifacts, jobs, training
from paddock.plans import features as fq
from paddock.sources import weekend

DRIVERS = {"VER": "A", "HAM": "A", "NOR": "B", "PIA": "B", "LEC": "C", "SAI": "C"}
NAMES = ["driver_team_priors_pre", "quali_priors_pre", "history_form", "quali_execution_pre", "weather_basic"]


def season(folder, rounds, race=True):
    rng = np.random.default_rng(3)
    pace = {d: i for i, d in enumerate(DRIVERS)}
    for r in range(1, max(rounds) + 1):
        order = sorted(DRIVERS, key=lambda d: pace[d] + rng.normal(0, 0.4))
        if r not in rounds:
            continue
        put(folder, f"meta_2025_{r}.csv", ["EventName", "Location"], [f"Event {r}", f"Place {r % 3}"])
        put(folder, f"results_2025_{r}_Q.csv", ["Abbreviation", "TeamName", "Position", "Q1"], *[[d, DRIVERS[d], i + 1, dur(90 + 0.1 * i)] for i, d in enumerate(order)])
        if race:
            put(folder, f"results_2025_{r}.csv", ["Abbreviation", "TeamName", "Position", "GridPosition", "Points", "Status"], *[[d, DRIVERS[d], i + 1 if i < 5 else None, i + 1, max(0, 25 - 4 * i), "Finished" if i < 5 else "Engine"] for i, d in enumerate(order)])
            put(folder, f"laps_2025_{r}.csv", ["Driver", "LapNumber", "LapTime", "TrackStatus"], *[[d, n, dur(91 + 0.2 * pace[d] + 0.01 * n), 1] for d in DRIVERS for n in range(1, 5)])
    put(folder, "schedule_2025.csv", ["RoundNumber", "EventName", "Session5", "Session5DateUtc"], *[[r, f"Event {r}", "Race", f"2025-{1 + r:02d}-01 14:00:00"] for r in range(1, 10)])


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("season")
    raw, path, out = base / "raw", str(base / "store"), str(base / "out")
    raw.mkdir()
    season(raw, range(1, 9))
    jobs.ingest(spark, str(raw), path)
    jobs.build_features(spark, path, out, names=NAMES)
    return raw, path, out


def test_features_and_targets_of_all_rounds(spark, store):
    _, path, out = store
    rows = jobs.built(spark, out)
    assert rows.count() == 8 * 6 and rows.select("scenario_mode").distinct().collect() == [("observed",)]
    first = rows.filter("round = 1 and driver = 'VER'").first()
    assert first.driver_team_pre_driver_hist_n is None and rows.filter("round = 8 and driver = 'VER'").first().driver_team_pre_driver_hist_n == 7
    targets = jobs.built(spark, out, "targets")
    assert targets.count() == 48 and targets.filter("finish_position is null").count() == 8
    before = {(r["round"], r.driver): r.hist_pre_hist_n for r in rows.collect()}
    jobs.build_features(spark, path, out, spark.createDataFrame([(2025, 3)], "year int, round int"), names=NAMES)
    assert {(r["round"], r.driver): r.hist_pre_hist_n for r in jobs.built(spark, out).collect()} == before
    same = jobs.build_features(spark, path, out, names=NAMES, skip_existing=True)
    assert same.count() == 48


def test_a_future_round_reads_nothing_of_its_weekend(spark, store, tmp_path):
    _, path, _ = store
    rows = jobs.build_features(spark, path, str(tmp_path / "f"), spark.createDataFrame([(2025, 9)], "year int, round int"), names=NAMES)
    got = {r.driver: r for r in rows.collect()}
    assert set(got) == set(DRIVERS) and "qexec_pre_best_lap_s" not in rows.columns and got["VER"].scenario_mode == "future" and got["VER"].driver_team_pre_driver_hist_n == 8
    assert "finish_position" not in rows.columns


def test_train_predict_simulate_and_audit(spark, store, tmp_path):
    _, path, out = store
    model, later = str(tmp_path / "model"), str(tmp_path / "future")
    fitted = jobs.train_model(spark, out, model, last=2, epochs=6, step=0.1, kind=training.DeepModel, layers=(8, 6), dropout=0.0, half_life=4.0, eras={})
    names = fitted.model.features
    assert "qexec_pre_best_lap_s" in names and not any(n in names for n in ("finish_position", "Points", "year", "driver_team_pre_driver_hist_n", "hist_pre_last_seen_year"))
    told = artifacts.told(spark, model)
    assert told["metrics"]["feature_profile"] == "full" and told["metrics"]["epoch"] == fitted.best and fitted.losses[-1] < fitted.losses[0] and {r["feature"] for r in told["scaler"]} == set(names)
    rows = jobs.built(spark, out).filter("round >= 7")
    scored = jobs.predict(spark, rows, model)
    per = scored.groupBy("round").agg(F.sum("p_win").alias("p"), F.collect_set("rank").alias("ranks")).collect()
    assert all(r.p == pytest.approx(1) and sorted(r.ranks) == [1, 2, 3, 4, 5, 6] for r in per)
    assert jobs.predict(spark, rows.drop("qexec_pre_best_lap_s"), model).count() == 12
    last = scored.filter("round = 8 and rank = 1").first().driver
    moved = jobs.predict(spark, rows, model, grid=F.when(F.col("driver") == last, 20).otherwise(1), grid_weight=50.0)
    assert moved.filter(f"round = 8 and driver = '{last}'").first().p_win < scored.filter("round = 8 and rank = 1").first().p_win
    drivers, teams = jobs.simulate_season(spark, rows, model, weekend.stored(spark, path, fq.TABLES)["results"])
    assert drivers.count() == 6 and teams.count() == 3 and drivers.agg(F.max("races")).first()[0] == 2
    report = {r.feature: r for r in jobs.audit_features(jobs.built(spark, out), jobs.built(spark, out, "targets"), last=2).collect()}
    assert report["quali_pre_pos_p50"].rho_train > 0.3 and report["quali_pre_pos_p50"].rows == 48 and report["weather_pre_air_temp_mean"].non_null == 0
    jobs.train_model(spark, out, later, last=2, future=True, epochs=2, hidden=3)
    assert not any(n.startswith("qexec_") for n in artifacts.load(spark, later).features)
    assert jobs.usable_model(spark, [model, later], future=False) == model and jobs.usable_model(spark, [model, later], future=True) == later
    with pytest.raises(ValueError):
        jobs.usable_model(spark, [model], future=True)


def test_weights_of_races(spark):
    rounds = spark.createDataFrame([(2013, 1), (2026, 1), (2026, 2)], "year int, round int")
    w = {(r.year, r["round"]): r.weight for r in jobs.race_weights(rounds, 1.0, {"aero_kers": 0.5}).collect()}
    assert [w[k] / w[2026, 2] for k in ((2026, 1), (2013, 1))] == [pytest.approx(0.5), pytest.approx(0.125)] and sum(w.values()) == pytest.approx(3)
    assert {r.weight for r in jobs.race_weights(rounds).collect()} == {1.0}


def test_refresh_brings_what_is_over_and_missing(spark, tmp_path):
    raw, path, out = tmp_path / "raw", str(tmp_path / "store"), str(tmp_path / "out")
    raw.mkdir()
    season(raw, range(1, 3))
    jobs.ingest(spark, str(raw), path)
    asked = []

    def fetch(rounds):
        asked.extend(sorted(r["round"] for r in rounds.collect()))
        season(raw, range(1, 4))

    got = jobs.refresh(spark, str(raw), path, out, F.lit("2025-05-15 00:00:00").cast("timestamp"), fetch, names=["driver_team_priors_pre"])
    assert asked == [3, 4] and got.count() == 2
    rows = jobs.built(spark, out)
    assert sorted((r["round"], r.scenario_mode) for r in rows.select("round", "scenario_mode").distinct().collect()) == [(3, "observed"), (4, "future")]
