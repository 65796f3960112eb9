"""Weekends from files as they are exported: known answers of small weekends, from CSV to features."""

import datetime as dt

import pytest

from paddock.plans import features as fq
from paddock.sources import weekend


def put(folder, name, header, *rows):
    lines = [",".join(header), *[",".join("" if v is None else str(v) for v in r) for r in rows]]
    (folder / name).write_text("\n".join(lines) + "\n")


def dur(seconds):
    return f"0 days 00:{int(seconds // 60):02d}:{seconds % 60:09.6f}"


def context(spark, folder, year, round_, **options):
    tables = weekend.read(spark, str(folder))
    cut = spark.createDataFrame([(year, round_)], "year int, round int")
    return fq.Context(tables, cut, fq.roster_of(tables, cut), options)


def rows(df):
    return {r.driver: r for r in df.collect()}


def test_files_of_many_shapes(spark, tmp_path):
    put(tmp_path, "laps_2025_3.csv", ["Driver", "LapNumber", "LapTime", "Compound", "TrackStatus", "PitInTime", "IsAccurate"], ["VER", 1, dur(95.4), "SOFT", 1, None, True], ["VER", 2, dur(94.0), "soft", "12", dur(300), False], ["nan", 3, dur(90), "S", 1, None, None])
    put(tmp_path, "laps_2025_3_FP1.csv", ["LapTime", "Abbreviation", "Extra", "lap", "IsPitIn"], [95400, "NOR", "x", 1, "True"], [96100.0, "NOR", None, 2, "False"])
    put(tmp_path, "laps_2025_4_Q.csv", ["milliseconds", "Driver", "LapNumber", "Stint", "TyreLife"], [95400, "NOR", 1, 2, 7])
    got = {(r["round"], r.session, r.driver, r.lap): r for r in weekend.laps(spark, str(tmp_path)).collect()}
    assert set(got) == {(3, "R", "VER", 1), (3, "R", "VER", 2), (3, "FP1", "NOR", 1), (3, "FP1", "NOR", 2), (4, "Q", "NOR", 1)}
    a, b = got[3, "R", "VER", 1], got[3, "R", "VER", 2]
    assert (a.lap_s, a.compound, a.track_status, a.pit_in, a.is_accurate, a.stint, a.tyre_age) == (95.4, "SOFT", "1", None, True, 1, 1)
    assert (b.lap_s, b.compound, b.track_status, b.pit_in, b.is_accurate, b.stint, b.tyre_age) == (94.0, "SOFT", "12", 300.0, False, 1, 2)
    c, d = got[3, "FP1", "NOR", 1], got[3, "FP1", "NOR", 2]
    assert (c.lap_s, c.pit_in, d.lap_s, d.pit_in) == (95.4, 0.0, 96.1, None) and c.compound is None and (c.stint, d.stint) == (1, 2)
    assert (got[4, "Q", "NOR", 1].lap_s, got[4, "Q", "NOR", 1].stint, got[4, "Q", "NOR", 1].tyre_age) == (95.4, 2, 7)


def test_results_and_rosters(spark, tmp_path):
    put(tmp_path, "results_2025_1.csv", ["Abbreviation", "TeamName", "Position", "GridPosition", "Points", "Status", "Time"], ["VER", "A", 1, 2, 25, "Finished", dur(5400)], ["NOR", "B", "nan", 1, 0, "Engine", None])
    put(tmp_path, "results_2025_2_SS.csv", ["Driver", "Position", "Q1"], ["VER", 3, dur(80.5)])
    put(tmp_path, "qualifying_2025_2.csv", ["Driver", "Team", "Position", "Q1", "Classified"], ["NOR", "B", 4, 91.25, "False"])
    put(tmp_path, "entrylist_2025_3_Q.csv", ["Abbreviation", "TeamName"], ["PIA", "B"], ["HAM", "C"])
    got = {(r["round"], r.session, r.driver): r for r in weekend.results(spark, str(tmp_path)).collect()}
    v = got[1, "R", "VER"]
    assert (v.team, v.position, v.grid, v.points, v.status, v.time) == ("A", 1.0, 2.0, 25.0, "Finished", 5400.0) and got[1, "R", "NOR"].position is None
    assert got[2, "SQ", "VER"].q1 == 80.5 and (got[2, "Q", "NOR"].q1, got[2, "Q", "NOR"].status) == (91.25, "NC")
    tables = weekend.read(spark, str(tmp_path))
    cuts = spark.createDataFrame([(2025, r) for r in (1, 2, 3, 4)], "year int, round int")
    roster = sorted((r["round"], r.driver, r.team) for r in fq.roster_of(tables, cuts).collect())
    assert roster == [(2, "NOR", "B"), (3, "HAM", "C"), (3, "PIA", "B"), (4, "NOR", "B"), (4, "VER", "A")]


def test_weather_windows(spark, tmp_path):
    columns = ["Time", "AirTemp", "Humidity", "WindSpeed", "Rainfall", "TrackTemp"]
    put(tmp_path, "results_2025_1_Q.csv", ["Abbreviation", "TeamName", "Position"], ["VER", "A", 1], ["NOR", "B", 2])
    put(tmp_path, "schedule_2025.csv", ["round", "EventName", *[f"Session{i}{x}" for i in range(1, 6) for x in ("", "DateUtc")]], [1, "Test", "Practice 1", "2025-03-01 10:00:00", "Practice 2", "2025-03-01 14:00:00", "Practice 3", "2025-03-02 10:00:00", "Qualifying", "2025-03-02 14:00:00", "Race", "2025-03-03 14:00:00"])
    put(tmp_path, "weather_2025_1_Q.csv", columns, [dur(60), 10, 50, 1, False, 20], [dur(2400), 30, 60, 3, True, 39], [dur(3000), 32, 70, 5, False, 41])
    put(tmp_path, "weather_2025_1_FP3.csv", columns, [dur(60), -10, 50, 1, False, 20])
    put(tmp_path, "weather_2025_1.csv", columns, [dur(60), 20, 50, 1, True, 20], [dur(600), 22, 50, 1, False, 20], [dur(4000), 90, 50, 1, False, 20])
    of = lambda **o: rows(fq.weather_basic(context(spark, tmp_path, 2025, 1, **o)))["VER"]
    tail = of()
    assert (tail.weather_pre_records_n, tail.weather_pre_air_temp_mean, tail.weather_pre_track_temp_mean, tail.weather_pre_air_temp_std, tail.weather_pre_wind_kph_mean, tail.weather_pre_rain_prob_p75) == (2, 31.0, 40.0, 1.0, 4.0, 0.75)
    head = of(weather_mode="actual")
    assert (head.weather_pre_records_n, head.weather_pre_air_temp_mean, head.weather_pre_rain_prob_p75) == (2, 21.0, 0.75)
    none = of(weather_mode="forecast")
    assert none.weather_pre_records_n == 0 and none.weather_pre_air_temp_mean is None
    put(tmp_path, "weather_forecast_2025_1.csv", ["Utc", "Temperature", "RainProb"], ["2025-03-03 13:50:00", 11, 0.9], ["2025-03-03 14:10:00", 13, 0.2], ["2025-03-03 15:00:00", 15, 0.4], ["2025-03-03 18:00:00", 50, 0.0])
    put(tmp_path, "meta_2025_1.csv", ["EventName", "Session", "StartUtc", "EndUtc"], ["Test", "Race", "2025-03-03 14:00:00", "2025-03-03 16:00:00"])
    window = of()
    assert (window.weather_pre_records_n, window.weather_pre_air_temp_mean, window.weather_pre_rain_prob_p75) == (2, 14.0, pytest.approx(0.35))


def test_without_a_schedule_sessions_stand_in_by_order(spark, tmp_path):
    put(tmp_path, "results_2025_1_Q.csv", ["Abbreviation", "TeamName"], ["VER", "A"])
    put(tmp_path, "weather_2025_1_FP1.csv", ["Time", "AirTemp"], [dur(60), 5])
    put(tmp_path, "weather_2025_1_SQ.csv", ["Time", "AirTemp"], [dur(60), 7])
    put(tmp_path, "weather_2025_1.csv", ["Time", "AirTemp"], [dur(60), 50])
    assert rows(fq.weather_basic(context(spark, tmp_path, 2025, 1)))["VER"].weather_pre_air_temp_mean == 7.0
    (tmp_path / "weather_2025_1_SQ.csv").unlink()
    (tmp_path / "weather_2025_1_FP1.csv").unlink()
    assert rows(fq.weather_basic(context(spark, tmp_path, 2025, 1, weather_mode="auto")))["VER"].weather_pre_records_n == 0
    assert rows(fq.weather_basic(context(spark, tmp_path, 2025, 1, weather_mode="auto", allow_fallback_actual=True)))["VER"].weather_pre_air_temp_mean == 50.0


def test_chaos_of_two_races(spark, tmp_path):
    put(tmp_path, "races.csv", ["year", "round"], [2025, 1], [2025, 2], [2025, 3])
    for r, name in ((1, "Alpha Grand Prix"), (2, "Beta Grand Prix"), (3, "Alpha Grand Prix")):
        put(tmp_path, f"meta_2025_{r}.csv", ["EventName"], [name])
    put(tmp_path, "track_status_2025_1.csv", ["Time", "Status", "Message"], [dur(0), 1, "AllClear"], [dur(300), 4, "SCDeployed"])
    put(tmp_path, "track_status_2025_2.csv", ["Time", "Status", "Message"], [dur(0), 1, "AllClear"])
    put(tmp_path, "race_ctrl_2025_1.csv", ["Utc", "Lap", "Category", "Message", "Status", "Flag"], ["2025-03-01 14:00:00", 1, "Flag", '"RED FLAG, stay"', None, "RED"], ["2025-03-01 14:05:00", 3, "SafetyCar", "VIRTUAL SAFETY CAR DEPLOYED", "DEPLOYED", None])
    put(tmp_path, "session_status_2025_2.csv", ["Time", "Status"], [dur(0), "Delayed"])
    put(tmp_path, "weather_2025_1.csv", ["Time", "Rainfall"], [dur(60), True], [dur(120), False])
    put(tmp_path, "results_2025_3_Q.csv", ["Abbreviation", "TeamName"], ["VER", "A"])
    v = rows(fq.event_chaos_priors_pre(context(spark, tmp_path, 2025, 3)))["VER"]
    assert (v.chaos_pre_hist_n, v.chaos_pre_same_track_n) == (2, 1)
    blend = lambda same, recent: pytest.approx(same / 3 + recent * 2 / 3)
    assert (v.chaos_pre_sc_rate, v.chaos_pre_vsc_rate, v.chaos_pre_red_flag_rate, v.chaos_pre_delayed_start_rate) == (blend(1, 0.5), blend(1, 0.5), blend(1, 0.5), blend(0, 0.5))
    assert (v.chaos_pre_early_yellow_rate, v.chaos_pre_wet_start_rate, v.chaos_pre_rainfall_share_start) == (blend(1, 0.5), 1.0, 0.5)
    assert (v.chaos_pre_sc_deploy_mean, v.chaos_pre_vsc_deploy_mean) == (blend(2, 1), blend(1, 0.5))


def test_same_track_among_many_rounds(spark, tmp_path):
    for r in range(1, 25):
        put(tmp_path, f"meta_2024_{r}.csv", ["EventName"], ["Target" if r == 1 else f"Other {r}"])
        put(tmp_path, f"results_2024_{r}.csv", ["Abbreviation", "Position", "GridPosition", "Status", "Points"], ["VER", 1 if r == 1 else 9, 1, "Finished", 25], ["NOR", 2 if r == 1 else 8, 2, "Finished", 18])
    put(tmp_path, "meta_2025_1.csv", ["EventName"], ["Target"])
    put(tmp_path, "results_2025_1_Q.csv", ["Abbreviation", "TeamName"], ["VER", "A"], ["NOR", "B"])
    out = rows(fq.track_onehot(context(spark, tmp_path, 2025, 1)))
    assert [(out[d].track_same_hist_n, out[d].track_same_finish_p50) for d in ("VER", "NOR")] == [(1, 1.0), (1, 2.0)]


def practice(spark, tmp_path):
    columns = ["Driver", "LapTime", "Stint", "Compound", "TyreLife", "TrackStatus", "PitInTime", "PitOutTime", "IsAccurate"]
    fp2 = [["VER", dur(95 + 0.1 * k), 1, "MEDIUM", k, 1, None, None, True] for k in range(2, 9)] + [["NOR", dur(96), 1, "SOFT", k, 1, None, None, k > 2] for k in range(2, 7)]
    fp3 = [["VER", dur(94 + 0.2 * k), 1, "SOFT", k, 1, None, None, True] for k in range(2, 9)]
    put(tmp_path, "laps_2025_3_FP2.csv", columns, *fp2)
    put(tmp_path, "laps_2025_3_FP3.csv", columns, *fp3)
    put(tmp_path, "results_2025_3_Q.csv", ["Abbreviation", "TeamName", "Position", "Q1", "Q2", "Q3"], ["VER", "A", 1, dur(91), dur(90.5), dur(90)], ["NOR", "A", 2, dur(91.2), dur(90.7), None], ["PIA", "B", 3, dur(92), None, None], ["HAM", "B", 4, dur(92.6), None, None])
    return context(spark, tmp_path, 2025, 3)


def test_practice_and_qualifying(spark, tmp_path):
    put(tmp_path, "laps_2025_3_Q.csv", ["Driver", "LapTime", "Time", "Sector1Time", "Sector2Time", "Sector3Time", "TrackStatus", "IsAccurate", "Deleted", "Stint"], ["VER", dur(90.5), dur(600), dur(30), dur(30), dur(30.5), 1, True, False, 1], ["VER", dur(91), dur(900), dur(30), dur(30), dur(31), 1, True, True, 1], ["VER", dur(90), dur(1800), dur(29.8), dur(30), dur(30.2), 1, True, False, 2], ["NOR", dur(90.7), dur(1750), dur(30.1), dur(30.2), dur(30.4), 1, True, False, 1])
    ctx = practice(spark, tmp_path)
    long = rows(fq.practice_longrun_pre(ctx))
    assert (long["VER"].prac_pre_longrun_laps, long["VER"].prac_pre_longrun_session_ord, long["NOR"].prac_pre_longrun_laps) == (7, 3, 5) and long["PIA"].prac_pre_dry_runs_n is None
    comp = rows(fq.practice_compound_pre(ctx))
    assert (comp["VER"].prac_cmp_pre_dry_compounds_n, comp["VER"].prac_cmp_pre_s_best_s, comp["VER"].prac_cmp_pre_crossover_sm_s) == (2, pytest.approx(94.4), pytest.approx(0.8))
    ready = rows(fq.practice_readiness_pre(ctx))
    assert (ready["VER"].ready_pre_sessions_seen_n, ready["NOR"].ready_pre_missing_fp3_flag, ready["VER"].ready_pre_total_laps_tm_delta, ready["NOR"].ready_pre_accurate_share) == (2, 1, 9, pytest.approx(0.8))
    quali = rows(fq.quali_execution_pre(ctx))
    v = quali["VER"]
    assert (v.qexec_pre_final_run_improve_s, v.qexec_pre_deleted_lap_share, v.qexec_pre_gap_to_tm_s, v.qexec_pre_stage_reached, v.qexec_pre_timed_laps_n) == (pytest.approx(0.5), pytest.approx(1 / 3), pytest.approx(-0.7), 3, 2)
    evolution = rows(fq.quali_evolution_pre(ctx))
    assert evolution["VER"].qevo_pre_best_lap_progress_pct > evolution["NOR"].qevo_pre_best_lap_progress_pct and evolution["PIA"].qevo_pre_push_laps_n is None
    delta = rows(fq.weekend_team_delta_pre(ctx))
    assert {d: delta[d].wknd_pre_q_tm_delta_s for d in ("PIA", "HAM")} == {"PIA": pytest.approx(-0.6), "HAM": pytest.approx(0.6)} and all(r.wknd_pre_tm_has_pair == 1 for r in delta.values())
    form = rows(fq.weekend_field_form_pre(ctx))
    assert form["VER"].field_pre_q_rank_pct > form["NOR"].field_pre_q_rank_pct > form["HAM"].field_pre_q_rank_pct and form["VER"].field_pre_available_scores_n >= 3
    deg = rows(fq.tyre_priors_pre(ctx))["VER"]
    assert deg.expected_deg_S > 0 and deg.expected_deg_M > 0


def test_sprints_and_telemetry(spark, tmp_path):
    put(tmp_path, "meta_2025_2.csv", ["EventName", "EventFormat"], ["Test", "sprint_qualifying"])
    put(tmp_path, "results_2025_2_SQ.csv", ["Abbreviation", "TeamName", "Position", "Q1", "Q2"], ["VER", "A", 1, dur(80), dur(79)], ["NOR", "A", 2, dur(80.5), None])
    put(tmp_path, "results_2025_2_S.csv", ["Abbreviation", "TeamName", "Position", "GridPosition", "Points"], ["VER", "A", 1, 2, 8], ["NOR", "A", 2, 1, 7])
    put(tmp_path, "entrylist_2025_2.csv", ["Abbreviation", "TeamName"], ["VER", "A"], ["NOR", "A"])
    for driver, session, base in (("VER", "Q", 300), ("NOR", "FP3", 290)):
        put(tmp_path, f"telemetry_2025_2_{session}_{driver}.csv", ["Time", "Speed", "Throttle", "DRS", "Brake"], *[[dur(k), base + k, 100, 12 if k > 2 else 0, k == 0] for k in range(5)])
    ctx = context(spark, tmp_path, 2025, 2)
    v = rows(fq.sprint_weekend_pre(ctx))["VER"]
    assert (v.sprint_pre_format_flag, v.sprint_pre_has_data, v.sprint_pre_sq_gap_to_best_s, v.sprint_pre_gain_vs_grid, v.sprint_pre_tm_finish_delta, v.sprint_pre_sq_tm_delta_s) == (1, 1, 0.0, 1.0, -1.0, -1.5)
    tele = rows(fq.telemetry_efficiency_pre(ctx))
    assert (tele["VER"].tele_eff_pre_session_ord, tele["NOR"].tele_eff_pre_session_ord, tele["VER"].tele_eff_pre_brake_speed_mean_kph) == (4, 3, 300.0) and tele["VER"].tele_eff_pre_speed_tm_delta_kph == pytest.approx(10.0)


def test_stops_profiles_and_store(spark, tmp_path):
    raw, path = tmp_path / "raw", str(tmp_path / "store")
    raw.mkdir()
    put(raw, "laps_2025_1.csv", ["Driver", "LapNumber", "LapTime", "PitInTime", "PitOutTime"], ["VER", 1, dur(90), dur(88), None], ["VER", 2, dur(110), None, dur(110.5)], ["VER", 3, dur(90), None, None])
    put(raw, "laps_2026_1.csv", ["Driver", "LapNumber", "LapTime"], ["VER", 1, dur(91)])
    put(raw, "pit_stops_2026_1.csv", ["Driver", "lap", "duration_ms"], ["VER", 9, 23400])
    put(raw, "track_profiles.csv", ["track", "straight_pct", "lap_km"], ["Monza", 0.7, 5.8])
    put(raw, "schedule_2026.csv", ["RoundNumber", "EventName", "Session5", "Session5DateUtc"], [1, "Test", "Race", "2026-03-01T14:00:00Z"])
    tables = weekend.read(spark, str(raw))
    assert sorted((r.year, r.driver, r.lap, round(r.seconds, 6)) for r in tables["pit_stops"].collect()) == [(2025, "VER", 1, 22.5), (2026, "VER", 9, 23.4)]
    weekend.store(tables, path)
    back = weekend.stored(spark, path, fq.TABLES)
    assert set(back) == set(tables) and back["laps"].count() == 4 and back["track_profiles"].first().straight_pct == 0.7
    assert [(r.year, r["round"], r.session, r.starts) for r in back["schedule"].collect()] == [(2026, 1, "R", dt.datetime(2026, 3, 1, 14))]
    (raw / "laps_2025_1.csv").unlink()
    weekend.store({"laps": weekend.laps(spark, str(raw))}, path)
    assert weekend.stored(spark, path, fq.TABLES)["laps"].count() == 4
    assert "telemetry" not in tables and weekend.telemetry(spark, str(raw)).count() == 0
