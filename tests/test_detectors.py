"""Panel, detectors, episodes, ranking and metrics against small definitions in plain Python."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.errors import GateError
from tidewatch.operators import detectors, episodes, metrics, panel, survival
from tidewatch.schemas import Thresholds

START = date(2026, 1, 1)


def series(spark, values, district="Queens 01", problem="Noise", start=START):
    rows = [(start + timedelta(days=k), district, problem, int(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, district string, problem string, requests long")


def history(values, k, n):
    return [values[i] for i in range(k) if (k - i) % 7 == 0][-n:]


def test_spike_effect(spark):
    last = detectors.detect(series(spark, [20] * 69 + [80]), Thresholds()).orderBy(F.desc("date")).first()
    assert last["effect"] == 4.0
    assert last["date"] == START + timedelta(days=69)
    assert last["id"].startswith("SIG-") and len(last["id"]) == 14


def test_sparse_series_is_quiet(spark):
    assert detectors.detect(series(spark, [1] * 69 + [20]), Thresholds()).isEmpty()


def test_zero_deviation(spark):
    last = detectors.detect(series(spark, [20] * 69 + [50]), Thresholds()).orderBy(F.desc("date")).first()
    assert last["anomaly_score"] == 30.0


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="Missing columns: problem, requests"):
        detectors.detect(series(spark, [1]).drop("requests", "problem"), Thresholds())
    with pytest.raises(ValueError, match="Unknown detector"):
        detectors.detect(series(spark, [1]), Thresholds(detector="x"))


def test_ids_are_stable(spark):
    a, b = (detectors.detect(series(spark, [20] * 69 + [80], d), Thresholds()).first()["id"] for d in ("Queens 01", "QUEENS 01"))
    assert a == b


@pytest.mark.parametrize("seed", range(3))
def test_robust_and_counts_by_definition(spark, seed):
    rng = random.Random(seed)
    values = [max(0, int(rng.gauss(20, 6)) + (40 if rng.random() < 0.05 else 0)) for _ in range(250)]
    rows = series(spark, values)
    t = Thresholds(history=8, min_baseline=5, min_delta=5, min_ratio=1.3, robust_z=2)
    expected = set()
    for k, x in enumerate(values):
        past = history(values, k, 8)
        if len(past) == 8:
            m = float(np.median(past))
            s = max(1.4826 * float(np.median(np.abs(np.array(past) - m))), 1.0)
            if m >= 5 and x - m >= 5 and x / max(m, 1) >= 1.3 and (x - m) / s >= 2:
                expected.add(START + timedelta(days=k))
    assert {r["date"] for r in detectors.detect(rows, t).collect()} == expected and expected
    t = Thresholds(detector="nb_conformal", history=13, min_baseline=5, min_delta=5, min_ratio=1.3, prediction_z=2, spike_ratio=1.8, spike_min_baseline=10)
    expected = {}
    for k, x in enumerate(values):
        past = np.array(history(values, k, 26), float)
        if len(past) >= 13:
            m = past.mean()
            a = float(np.clip((past.var(ddof=1) - max(m, 1)) / max(m * m, 1), 0, 1))
            s = max(np.sqrt(m + a * m * m), 1)
            r = x / max(m, 1)
            if m >= 5 and (x > m + 2 * s or (m >= 10 and r >= 1.8)) and x - m >= 5 and r >= 1.3:
                expected[START + timedelta(days=k)] = (x - m) / s
    got = {r["date"]: r["anomaly_score"] for r in detectors.detect(rows, t).collect()}
    assert got == pytest.approx(expected) and expected


def test_shift_by_definition(spark):
    rng = random.Random(7)
    values = [int(rng.gauss(20, 4)) + (15 if 150 <= k < 160 else 0) for k in range(200)]
    t = Thresholds(detector="hybrid_nb_ewma", history=13, min_baseline=5, min_delta=5, min_ratio=1.4, prediction_z=3.5)
    base = [float(np.median(p)) if len(p := history(values, k, 26)) >= 13 else None for k in range(len(values))]
    expected = set()
    for k in range(2, len(values)):
        b, o = base[k - 2 : k + 1], values[k - 2 : k + 1]
        if None not in b and np.mean(b) >= 5 and sum(x >= 1.25 * y for x, y in zip(o, b, strict=True)) >= 2 and sum(o) / max(sum(b), 1) >= 1.25 and sum(o) - sum(b) >= 15:
            expected.add(START + timedelta(days=k))
    shifts = detectors.detect_shifts(series(spark, values), t)
    assert {r["date"] for r in shifts.collect()} == expected and expected
    # Where both rules hold, the shift's row stays.
    both = {r["date"]: r for r in detectors.detect(series(spark, values), t).collect()}
    for r in shifts.collect():
        assert both[r["date"]]["affected_count"] == r["affected_count"]


def test_as_of_and_null_keys(spark):
    rows = series(spark, [20] * 69 + [80]).union(series(spark, [20] * 69 + [80], None))
    assert detectors.detect(rows, Thresholds(), START + timedelta(days=68)).isEmpty()
    assert detectors.detect(rows, Thresholds()).count() == 1


def alert_rows(spark, rows):
    full = [(f"id{k}", "t", d, a, "P", 1.0, 1.0, 1.0, s, s, 1.0, float(k), "x", k) for k, (a, d, s) in enumerate(rows)]
    kinds = ["string", "string", "date", "string", "string", *["double"] * 7, "string", "long"]
    return spark.createDataFrame(full, ", ".join(f"{c} {k}" for c, k in zip(detectors.ALERT_COLUMNS, kinds, strict=True)))


def test_episodes(spark):
    alerts = alert_rows(spark, [("A", date(2026, 7, 1), 3.0), ("A", date(2026, 7, 3), 5.0), ("A", date(2026, 7, 12), 4.0)])
    first, second = episodes.merge_episodes(alerts).orderBy("episode_start").collect()
    assert (first["persistence"], first["episode_end"], first["id"], first["anomaly_score"], first["excess_count"]) == (2, date(2026, 7, 3), "id0", 5.0, 0.0)
    assert second["persistence"] == 1


def test_episodes_equal_sessions(spark):
    from tidewatch.streaming.ingest import episode_sessions

    rng = random.Random(3)
    rows = sorted({(rng.choice("AB"), START + timedelta(days=rng.randrange(200))) for _ in range(80)})
    alerts = alert_rows(spark, [(a, d, rng.random()) for a, d in rows])
    columns = ["district", "problem", "episode_start", "episode_end", "persistence"]
    one = sorted(map(tuple, episodes.merge_episodes(alerts).select(columns).collect()))
    assert one == sorted(map(tuple, episode_sessions(alerts).select(columns).collect()))


def test_ranks_equal_pandas(spark):
    rng = random.Random(5)
    alerts = alert_rows(spark, [("A", START + timedelta(days=30 * k), rng.choice([1.0, 2.0, 3.0])) for k in range(25)])
    got = episodes.rank_episodes(episodes.merge_episodes(alerts)).toPandas().sort_values("date")
    for source, target in (("anomaly_score", "strength_pct"), ("affected_count", "impact_pct")):
        assert np.allclose(got[target], got[source].rank(pct=True, method="average"))
    top = episodes.top_ranked(episodes.rank_episodes(episodes.merge_episodes(alerts)), 5, 2).collect()
    assert [r["place"] for r in top] == [3, 4, 5, 6, 7]


def events(spark, rows):
    full = [(f"E{k}", a, "P", s, e, "spike", "g") for k, (a, s, e) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id string, district string, problem string, start date, end date, scenario string, generator string")


def test_event_match(spark):
    alerts = alert_rows(spark, [("A", date(2026, 7, 3), 3.0), ("A", date(2026, 7, 4), 5.0)])
    found = episodes.merge_episodes(alerts)
    matched = episodes.match_events(found, events(spark, [("A", date(2026, 7, 1), date(2026, 7, 7))]))
    row = metrics.episode_metrics(matched, found, START, START + timedelta(days=219)).first()
    assert (row["true_positive"], row["false_positive"], row["false_negative"], row["median_detection_delay_days"]) == (1, 0, 0, 2.0)


def test_greedy_match(spark):
    # Two events suit the same episodes; each takes the first that is left, in order.
    alerts = alert_rows(spark, [("A", date(2026, 7, 1), 3.0), ("A", date(2026, 7, 20), 5.0), ("B", date(2026, 7, 1), 5.0)])
    rows = [("A", date(2026, 6, 20), date(2026, 7, 25)), ("A", date(2026, 6, 30), date(2026, 7, 25)), ("A", date(2026, 7, 1), date(2026, 7, 25)), ("B", date(2026, 6, 1), date(2026, 6, 29)), ("B", date(2026, 6, 1), date(2026, 6, 28))]
    got = {r["event_id"]: r["matched"] for r in episodes.match_events(episodes.merge_episodes(alerts), events(spark, rows)).collect()}
    assert got == {"E0": date(2026, 7, 1), "E1": date(2026, 7, 20), "E2": None, "E3": date(2026, 7, 1), "E4": None}


def test_unmatched_events_have_no_delay(spark):
    found = episodes.merge_episodes(alert_rows(spark, [("Z", date(2026, 7, 1), 3.0)]))
    row = episodes.match_events(found, events(spark, [("A", date(2026, 7, 1), date(2026, 7, 7))])).first()
    assert (row["matched"], row["delay_days"]) == (None, None)


@pytest.mark.parametrize(("durations", "closed", "expected"), [([1, 3, 10, 10], [True, True, False, False], 0.5), ([8, 12], [True, True], 0.0), ([1, 1], [True, True], 1.0), ([2, 2, 5], [True, False, True], 1.0)])
def test_closure_probability(spark, durations, closed, expected):
    rows = spark.createDataFrame([(float(d), e) for d, e in zip(durations, closed, strict=True)], "duration double, event boolean")
    assert survival.closure_probability(survival.checked(rows)).first()[0] == pytest.approx(expected)


def test_closure_input(spark):
    for rows, text in (([], "no observations"), ([(-1.0, True)], "below zero"), ([(1.0, None)], "needs a duration")):
        with pytest.raises(ValueError, match=text):
            survival.checked(spark.createDataFrame(rows, "duration double, event boolean"))


def test_dense_panel_and_gates(spark):
    rows = [("2026-01-01T00:00:00", "05 BROOKLYN", "Noise", 2), ("2026-01-03T00:00:00", "05 BROOKLYN", "Noise", 1)]
    sparse = spark.createDataFrame(rows, "day string, community_board string, complaint_type string, requests long").withColumn("day", F.to_date("day"))
    dense = panel.densify(panel.as_panel(sparse), START, START + timedelta(days=2)).orderBy("date").collect()
    assert [(r["district"], r["requests"]) for r in dense] == [("Brooklyn 05", 2), ("Brooklyn 05", 0), ("Brooklyn 05", 1)]
    with pytest.raises(GateError, match="incomplete"):
        panel.gate(panel.coverage_gate(sparse, START, START + timedelta(days=3)), "complete", "incomplete")
    with pytest.raises(GateError, match="reconciliation"):
        panel.gate(panel.reconcile(sparse, spark.range(4)), "reconciled", "reconciliation")
    panel.gate(panel.reconcile(sparse, spark.range(3)), "reconciled", "reconciliation")
    with pytest.raises(GateError, match="duplicate"):
        panel.gate_unique(sparse.union(sparse.limit(1)), ["day", "community_board", "complaint_type"])
    assert panel.densify(panel.as_panel(sparse.limit(0))).isEmpty()


def test_bootstrap_is_seeded(spark):
    rows = spark.createDataFrame([("A", "P", 1, 0, 0), ("B", "P", 0, 1, 1)], "district string, problem string, tp long, fp long, fn long")
    a, b = metrics.bootstrap_intervals(rows), metrics.bootstrap_intervals(rows)
    assert a == b and a["f1"][0] <= a["f1"][1]
    assert metrics.bootstrap_intervals(rows.limit(0)) == {"precision": [0.0, 0.0], "recall": [0.0, 0.0], "f1": [0.0, 0.0]}


def test_panel_plan_shares_one_exchange(spark):
    # The weekday window and the series window both use the exchange by series.
    plan = detectors.detect_shifts(series(spark, [1] * 10), Thresholds())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ranks_by_definition(spark):
    rng = random.Random(5)
    values = [None if k % 97 == 0 else rng.choice([rng.random(), float(rng.randrange(40))]) for k in range(3000)]
    rows = spark.createDataFrame(list(enumerate(values)), "k long, x double").repartition(6)
    ranked = episodes.rank_by_counts(rows, {"x": "rank"})
    want = pd.Series(values, dtype=float).rank(method="average", pct=True)
    got = {r["k"]: r["rank"] for r in ranked.collect()}
    assert all(got[k] is None if v is None else got[k] == pytest.approx(want[k]) for k, v in enumerate(values))
    assert episodes.rank_by_counts(rows.limit(0), {"x": "rank"}).isEmpty()
