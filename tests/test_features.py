"""Feature queries on small weekends with known answers."""

import pytest
from conftest import DATA
from pyspark.sql import Row

from paddock.plans import features as fq
from paddock.plans import weekends


def context(spark, cutoffs=((2025, 3),), roster=None, **tables):
    frames = {}
    for name, rows in tables.items():
        schema = spark.createDataFrame([], fq.TABLES[name]).schema
        frames[name] = spark.createDataFrame([Row(**{f.name: r.get(f.name) for f in schema}) for r in rows], schema)
    roster = roster or [("VER", "A"), ("NOR", "B"), ("HAM", "A"), ("PIA", "B")]
    people = spark.createDataFrame([(y, r, d, t) for y, r in cutoffs for d, t in roster], "year int, round int, driver string, team string")
    return fq.Context(frames, spark.createDataFrame(list(cutoffs), "year int, round int"), people)


def rows(df):
    return {r.driver: r for r in df.collect()}


def result(r, driver, team, pos, grid=None, points=0.0, status="Finished", session="R", **more):
    return dict(year=2025, round=r, session=session, driver=driver, team=team, position=pos, grid=grid, points=points, status=status, **more)


RESULTS = [result(1, "VER", "A", 1.0, 2.0, 25.0), result(1, "NOR", "B", 3.0, 1.0, 15.0), result(1, "HAM", "A", None, 9.0, 0.0, "Engine"), result(2, "VER", "A", 5.0, 4.0, 10.0), result(2, "NOR", "B", 1.0, 1.0, 25.0), result(3, "VER", "A", 20.0, 20.0, 0.0), result(2, "HAM", "A", 11.0, 8.0, 0.0)]


def lap(r, driver, n, s, session="R", **more):
    return dict(dict(year=2025, round=r, session=session, driver=driver, lap=n, lap_s=s, time_s=100.0 * n, stint=1, compound="SOFT", tyre_age=n, track_status="1", is_accurate=True, deleted=False), **more)


def test_priors_see_only_the_past(spark):
    out = rows(fq.driver_team_priors_pre(context(spark, results=RESULTS)))
    v, p = out["VER"], "driver_team_pre_"
    assert (v[f"{p}driver_hist_n"], v[f"{p}driver_finish_p50"], v[f"{p}driver_finish_iqr"], v[f"{p}driver_points_mean"], v[f"{p}driver_last_seen_round"] if f"{p}driver_last_seen_round" in v.asDict() else v[f"{p}last_seen_round"]) == (2, 3.0, 2.0, 17.5, 2)
    assert out["HAM"][f"{p}driver_dnf_rate"] == 0.5 and out["HAM"][f"{p}driver_top10_rate"] == 0.0 and v[f"{p}team_hist_n"] == 4
    assert out["PIA"][f"{p}driver_hist_n"] is None and out["PIA"][f"{p}team_finish_p50"] == 2.0
    again = rows(fq.driver_team_priors_pre(context(spark, results=[*RESULTS, result(4, "VER", "A", 1.0), result(3, "NOR", "B", 9.0)])))
    assert again == out


def test_quali_priors_fall_back_to_sprint_qualifying(spark):
    q = [result(1, "VER", "A", 1.0, session="Q"), result(1, "NOR", "B", 4.0, session="Q"), result(1, "VER", "A", 19.0, session="SQ"), result(2, "VER", "A", 3.0, session="SQ"), result(2, "NOR", "B", None, session="SQ", status="No time")]
    out = rows(fq.quali_priors_pre(context(spark, results=q)))
    assert (out["VER"].quali_pre_hist_n, out["VER"].quali_pre_pos_p50, out["VER"].quali_pre_bestpos_min) == (2, 2.0, 1.0)
    assert out["NOR"].quali_pre_notime_or_pen_rate == 0.5 and out["HAM"].quali_pre_hist_n is None


def test_same_track_history_by_any_key(spark):
    meta = [dict(year=2025, round=1, event="São Paulo Grand Prix", circuit="Interlagos", location=None), dict(year=2025, round=2, event="Other", circuit="Monza"), dict(year=2025, round=3, event="Brazil", circuit="Interlagos")]
    out = rows(fq.track_onehot(context(spark, results=RESULTS, meta=meta)))
    assert (out["VER"].track_same_hist_n, out["VER"].track_same_finish_p50, out["PIA"].track_same_hist_n) == (1, 1.0, 0)
    assert out["VER"].track_is_sao_paulo_grand_prix == 1.0
    profile = rows(fq.track_profile(context(spark, meta=meta)))["VER"]
    assert profile.track_slug == "sao_paulo_grand_prix" and profile.track_cluster == "balanced" and profile.track_straight_n == pytest.approx(0.5)
    cluster = rows(fq.driver_track_cluster_pre(context(spark, results=RESULTS, meta=meta)))["VER"]
    assert cluster.driver_trackc_pre_hist_n == 1


def test_history_form(spark):
    laps = [lap(r, d, n, base + 0.1 * n) for r in (1, 2) for d, base in (("VER", 90.0), ("NOR", 91.0)) for n in range(1, 13)]
    laps += [lap(1, "VER", 13, 120.0), lap(1, "VER", 14, 70.0, pit_in=5.0), lap(3, "VER", 1, 50.0)]
    out = rows(fq.history_form(context(spark, results=RESULTS, laps=laps)))
    assert out["VER"].hist_pre_hist_n == 2 and out["VER"].hist_pre_best10_pace_p50_s == pytest.approx(-0.5) and out["VER"].hist_pre_team_stability == 1.0
    assert out["HAM"].hist_pre_hist_n is None and out["HAM"].hist_pre_dnf_rate == 0.5


def test_practice(spark):
    fp = [lap(3, "VER", n, 95.0 + 0.2 * n, "FP2", compound="MEDIUM", is_accurate=n != 3) for n in range(1, 12)] + [lap(3, "VER", n, 94.0 + 0.1 * n, "FP3") for n in range(1, 8)] + [lap(3, "NOR", n, 96.0, "FP2") for n in range(1, 8)]
    ctx = context(spark, laps=fp)
    long = rows(fq.practice_longrun_pre(ctx))["VER"]
    assert (long.prac_pre_dry_runs_n, long.prac_pre_longrun_laps, long.prac_pre_longrun_session_ord, long.prac_pre_shortrun_session_ord) == (2, 10, 2, 3)
    assert long.prac_pre_longrun_deg_s_per_lap == pytest.approx(0.2) and long.prac_pre_longrun_pace_s == pytest.approx(96.3)
    comp = rows(fq.practice_compound_pre(ctx))["VER"]
    assert comp.prac_cmp_pre_dry_compounds_n == 2 and comp.prac_cmp_pre_h_best_s is None and comp.prac_cmp_pre_crossover_sm_s == pytest.approx(1.1)
    ready = rows(fq.practice_readiness_pre(ctx))
    assert (ready["VER"].ready_pre_sessions_seen_n, ready["VER"].ready_pre_total_laps, ready["NOR"].ready_pre_missing_fp3_flag, ready["HAM"].ready_pre_total_laps_tm_delta, ready["HAM"].ready_pre_missing_fp3_flag) == (2, 18, 1, None, None)
    assert ready["VER"].ready_pre_accurate_share == pytest.approx(17 / 18)
    tyre = rows(fq.tyre_priors_pre(ctx))["HAM"]
    assert tyre.expected_deg_M == pytest.approx(0.12) and tyre.expected_deg_S == pytest.approx(0.1)


def test_qualifying(spark):
    res = [result(3, "VER", "A", 1.0, session="Q", q1=91.0, q2=90.5, q3=90.0), result(3, "HAM", "A", 12.0, session="Q", q1=91.2, q2=90.7), result(3, "NOR", "B", 3.0, session="Q", q1=90.9)]
    laps = [lap(3, "VER", 1, 91.0, "Q", s1=30.0, s2=30.0, s3=31.0), lap(3, "VER", 3, 90.5, "Q", s1=29.9, s2=30.1, s3=30.5, stint=2, deleted=True), lap(3, "VER", 5, 90.0, "Q", s1=29.5, s2=30.2, s3=30.3, stint=3), lap(3, "HAM", 2, 90.7, "Q", s1=30.1, s2=30.3, s3=30.3)]
    ctx = context(spark, results=res, laps=laps)
    out = rows(fq.quali_execution_pre(ctx))
    v = out["VER"]
    assert (v.qexec_pre_stage_reached, v.qexec_pre_timed_laps_n, v.qexec_pre_gap_to_pole_s) == (3, 2, 0.0) and v.qexec_pre_deleted_lap_share == pytest.approx(1 / 3)
    assert v.qexec_pre_final_run_improve_s == pytest.approx(1.0) and v.qexec_pre_gap_to_tm_s == pytest.approx(-0.7) and v.qexec_pre_ideal_lap_gap_s == pytest.approx(90.0 - (29.5 + 30.0 + 30.3))
    evo = rows(fq.quali_evolution_pre(ctx))
    assert evo["VER"].qevo_pre_best_lap_progress_pct == 1.0 and evo["VER"].qevo_pre_push_laps_n == 2
    wk = rows(fq.weekend_team_delta_pre(ctx))
    assert wk["HAM"].wknd_pre_q_tm_delta_s == pytest.approx(0.7) and wk["NOR"].wknd_pre_tm_has_pair == 1 and wk["NOR"].wknd_pre_q_tm_delta_s is None
    form = rows(fq.weekend_field_form_pre(ctx))
    assert form["VER"].field_pre_q_rank_pct == 1.0 and form["VER"].field_pre_available_scores_n == 2 and form["NOR"].field_pre_q_gap_to_best_s == pytest.approx(0.9)


def test_sprints(spark):
    res = [result(3, "VER", "A", 2.0, session="SQ", q1=91.0), result(3, "HAM", "A", 3.0, session="SQ", q1=91.5), result(3, "VER", "A", 1.0, 2.0, 8.0, session="S"), result(3, "HAM", "A", 4.0, 3.0, 5.0, session="S")]
    out = rows(fq.sprint_weekend_pre(context(spark, results=res)))
    v = out["VER"]
    assert (v.sprint_pre_format_flag, v.sprint_pre_has_data, v.sprint_pre_sq_gap_to_best_s, v.sprint_pre_gain_vs_grid, v.sprint_pre_tm_finish_delta, v.sprint_pre_sq_tm_delta_s) == (1, 1, 0.0, 1.0, -3.0, -0.5)
    assert out["NOR"].sprint_pre_has_data == 1 and out["NOR"].sprint_pre_sq_pos is None


def test_chaos_and_weather(spark):
    rc = [dict(year=2025, round=1, t_s=100.0, lap=1, message="VIRTUAL SAFETY CAR DEPLOYED"), dict(year=2025, round=2, t_s=5000.0, lap=30, message="RED FLAG")]
    ts = [dict(year=2025, round=1, t_s=0.0, status="1"), dict(year=2025, round=2, t_s=0.0, status="1"), dict(year=2025, round=2, t_s=50.0, status="2")]
    wx = [dict(year=2025, round=1, session="R", t_s=10.0, rain=1.0), dict(year=2025, round=2, session="R", t_s=10.0, rain=0.0), dict(year=2025, round=3, session="Q", t_s=0.0, air=10.0, rain=1.0), dict(year=2025, round=3, session="Q", t_s=2000.0, air=30.0, track=40.0, rain=0.0), dict(year=2025, round=3, session="Q", t_s=2400.0, air=32.0, track=40.0, rain=0.0), dict(year=2025, round=3, session="FP3", t_s=2400.0, air=1.0)]
    ctx = context(spark, race_ctrl=rc, track_status=ts, weather=wx, results=RESULTS)
    v = rows(fq.event_chaos_priors_pre(ctx))["VER"]
    assert (v.chaos_pre_hist_n, v.chaos_pre_sc_rate, v.chaos_pre_vsc_rate, v.chaos_pre_red_flag_rate, v.chaos_pre_wet_start_rate, v.chaos_pre_early_yellow_rate) == (2, 0.5, 0.5, 0.5, 0.5, 0.5)
    assert v.chaos_pre_index == pytest.approx(0.5 * (0.28 + 0.12 + 0.22 + 0.16 + 0.08))
    w = rows(fq.weather_basic(ctx))["VER"]
    assert (w.weather_pre_air_temp_mean, w.weather_pre_track_temp_mean, w.weather_pre_records_n, w.weather_pre_rain_prob_p75) == (31.0, 40.0, 2, 0.0)
    risk = rows(fq.reliability_risk_pre(ctx))
    assert risk["HAM"].reliab_temp_delta == 1.5 and risk["HAM"].reliab_mech_risk == pytest.approx((0.6 * 0.5 + 0.4 * 0.5) * (1 + 0.25 * 1.5)) and risk["VER"].reliab_mech_risk == 0.0


def test_telemetry_and_traffic(spark):
    tel = [dict(year=2025, round=3, session=s, driver=d, t_s=float(n), speed=v + n, throttle=100.0, brake=0.0, drs=12.0 if n > 2 else 0.0) for s, d, v in (("Q", "VER", 300.0), ("FP3", "HAM", 280.0), ("FP2", "VER", 100.0)) for n in range(5)]
    out = rows(fq.telemetry_efficiency_pre(context(spark, telemetry=tel)))
    assert (out["VER"].tele_eff_pre_session_ord, out["HAM"].tele_eff_pre_session_ord) == (4, 3) and out["VER"].tele_eff_pre_speed_tm_delta_kph == pytest.approx(20.0) and out["VER"].tele_eff_pre_drs_open_share == 0.4
    laps = [lap(1, "VER", n, 90.0 + (n % 2), position=float(5 - n), gap_s=1.0 if n % 2 else 9.0) for n in range(1, 5)]
    traffic = rows(fq.traffic_overtake_pre(context(spark, results=RESULTS, laps=laps)))["VER"]
    assert traffic.lap1_gain_avg_prev10 == -2.0 and traffic.traffic_penalty_s_prev10 == 1.0 and traffic.net_pass_index_prev10 == 100.0
    assert rows(fq.telemetry_history_pre(context(spark, laps=laps)))["VER"].tele_pre_bestlap_p50_s == 90.0


def test_strategy_pits_and_trends(spark):
    laps = [lap(r, d, n, 90.0 + i + 0.01 * n, team=t, stint=1 + (n > 6), pit_in=9.0 if n == 6 else None) for r in (1, 2) for i, (d, t) in enumerate([("VER", "A"), ("HAM", "A"), ("NOR", "B")]) for n in range(1, 13)]
    stops = [dict(year=2025, round=r, driver=d, lap=6, seconds=s) for r in (1, 2) for d, s in (("VER", 2.2), ("HAM", 2.4), ("NOR", 4.0))]
    res = [*RESULTS]
    ctx = context(spark, results=res, laps=laps, pit_stops=stops)
    s = rows(fq.strategy_priors_pre(ctx))
    assert s["VER"].double_stack_risk == 1.0 and s["VER"].double_stack_same_lap == 1.0 and s["VER"].first_stint_len_exp == 6.0
    assert s["VER"].expected_stop_count == 1.0
    assert rows(fq.pit_ops_pre(ctx))["VER"].pitcrew_time_team_p50_s == pytest.approx(2.3, abs=0.02)
    assert rows(fq.pit_ops_risk_pre(ctx))["VER"].pitcrew_iqr_team > 0
    trend = rows(fq.dev_trend_pre(ctx))["VER"]
    assert trend.driver_trend is None and trend.stability_delta_vs_tm == pytest.approx(0.0, abs=1e-9)


def test_build_joins_all_queries(spark):
    laps = [lap(3, "VER", n, 95.0 + 0.2 * n, "FP2") for n in range(1, 9)] + [lap(1, "VER", n, 90.0) for n in range(1, 5)]
    ctx = context(spark, results=RESULTS, laps=laps)
    names = ["driver_team_priors_pre", "history_form", "practice_longrun_pre", "weather_basic"]
    out = fq.build(ctx, names)
    assert out.count() == 4 and {"hist_pre_hist_n", "prac_pre_dry_runs_n", "weather_pre_records_n"} <= set(out.columns)
    table = fq.train_table(out, fq.results_target(ctx)).collect()
    assert [(r.driver, r.result_outcome, r.outcome_id, r.finish_pos_eff) for r in table] == [("VER", "finish", 0, 20.0)]
    assert {r.driver for r in fq.roster_of(ctx.tables, ctx.cutoffs).collect()} == {"VER"}


def test_all_clicks_are_session_statuses(spark):
    events = [(r.event_id, r.ts, r.event_type) for r in spark.read.parquet(f"{DATA}/events.parquet").collect()]
    t = weekends.tables(spark, DATA)
    got = t["session_status"].collect()
    assert len(got) == sum(kind == "click" for _, _, kind in events) and {r.status for r in got} == {"Started", "Delayed"}
    day = lambda ts: (ts.year, ts.timetuple().tm_yday)
    late = {day(ts) for i, ts, kind in events if kind == "click" and i % 40 == 39}
    control = {day(ts) for i, ts, kind in events if kind == "error" and i % 7 == 4}
    stats = {(r.year, r["round"]): r.delayed_start_rate for r in fq.chaos_stats(weekends.context(spark, DATA)).collect()}
    assert {d for d, v in stats.items() if v == 1} == late | control and late - control and any(v == 0 for v in stats.values())


def test_later_rounds_weigh_more_with_a_half_life(spark):
    q = [result(1, "VER", "A", 1.0, session="Q"), result(2, "VER", "A", 18.0, session="Q")]
    past = [result(1, "VER", "A", 1.0), result(2, "VER", "A", 17.0)]
    laps = [lap(1, "VER", 1, 90.0, compound="SOFT"), lap(2, "VER", 1, 100.0, compound="MEDIUM")]
    plain = context(spark, results=[*q, *past], laps=laps)
    half = context(spark, results=[*q, *past], laps=laps)
    half.options.update(quali_recency_half_life=1, driver_team_recency_half_life=1, telemetry_recency_half_life=1, tyre_recency_half_life=1)
    of = lambda ctx: (rows(fq.quali_priors_pre(ctx))["VER"].quali_pre_pos_p50, rows(fq.driver_team_priors_pre(ctx))["VER"].driver_team_pre_driver_finish_p50, rows(fq.telemetry_history_pre(ctx))["VER"].tele_pre_bestlap_p50_s, rows(fq.tyre_priors_pre(ctx))["VER"].compound_mix_priors_M)
    assert of(plain) == (9.5, 9.0, 95.0, 0.5)
    third = lambda a, b: pytest.approx(a + (b - a) * 2 / 3)
    assert of(half) == (third(1, 18), third(1, 17), third(90, 100), third(0, 1))
