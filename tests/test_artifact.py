"""Backtest, review, document, publication and the read facade."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.errors import ArtifactUnavailable, GateError, InvalidRequest, NotFound
from tidewatch.operators import review
from tidewatch.plans import artifact, backtest, synthetic
from tidewatch.schemas import SAFE_FIELDS, Gates, Thresholds, Windows
from tidewatch.serving import Facade, latest_snapshot, load_snapshot

START = date(2026, 1, 1)


@pytest.fixture(scope="module")
def history(spark):
    rows = [(date(2025, 9, 1) + timedelta(days=k), f"Queens {d:02d}", "Noise", 20 + (k + d) % 3) for d in range(1, 5) for k in range(92)]
    return spark.createDataFrame(rows, "date date, district string, problem string, requests long").cache()


def test_panels_share_background(spark, history):
    with_events, without, events = synthetic.make_panels(history, seed=1, events=12)
    again, _, _ = synthetic.make_panels(history, seed=1, events=12)
    key = ["date", "district", "problem"]
    assert sorted(map(tuple, with_events.collect())) == sorted(map(tuple, again.collect()))
    changed = with_events.join(without.withColumnRenamed("requests", "plain"), key).where("requests <> plain")
    inside = changed.join(events, ["district", "problem"]).where("date BETWEEN start AND end")
    assert changed.count() == inside.count() > 0
    assert changed.where("requests < plain").isEmpty()
    assert {r["scenario"] for r in events.collect()} == set(synthetic.SCENARIOS)


def test_no_eligible_series(spark, history):
    with pytest.raises(ValueError, match="long and busy enough"):
        synthetic.make_panels(history.limit(10), seed=1, events=2)
    assert backtest.run_backtest(history.limit(10))["injections"] == 0


def test_backtest_is_deterministic(history):
    # Fixed panels: two runs agree, and metrics are shares.
    one, two = (backtest.run_backtest(history, seed=3, events=6) for _ in range(2))
    assert one == two
    assert all(0 <= one[k] <= 1 for k in ("precision", "recall", "f1"))
    assert len(one["candidates"]) == 9 and len(one["protocol_sha256"]) == 64


def test_choice():
    def row(detector, f1, fp=1.0, weakest=0.8):
        return {"detector": detector, "metrics": {"f1": f1, "false_alerts_per_week": fp, "median_detection_delay_days": 0, "scenario_recall": {"spike": weakest}}}

    assert backtest.choose([row("robust_seasonal", 0.95, weakest=0.5), row("nb_conformal", 0.85), row("hybrid_nb_ewma", 0.85)], Gates()) == 1
    assert backtest.choose([row("robust_seasonal", 0.3), row("nb_conformal", 0.4)], Gates()) == 1
    assert backtest.configuration_name(backtest.CANDIDATES[6]) == "nb_conformal-h26-z3.5-d10"
    assert backtest.configuration_name(backtest.CANDIDATES[7]) == "nb_conformal-h26-z3.5-d15-sr1.95-b40"


def labelled(spark, positives, n=60):
    cases = spark.createDataFrame([(f"c{k}", "top" if k < 20 else "rest") for k in range(60)], "case_id string, group_token string")
    rows = [(f"c{k}", "clear_anomaly" if k < positives else "unsupported", ["x"] if k % 2 else None) for k in range(n)]
    return cases, spark.createDataFrame(rows, "case_id string, label string, external_evidence array<string>")


def test_review_score(spark):
    assert review.score(*labelled(spark, 13), "top").first()[:] == ("passed", 60, 13, 0.65, 0.5)
    assert review.score(*labelled(spark, 12), "top").first()["status"] == "failed"
    for cases, labels, text in ((*labelled(spark, 13, 59), "every one of"), (labelled(spark, 1)[0], labelled(spark, 1)[1].withColumn("label", F.lit("maybe")), "other than")):
        with pytest.raises(Exception, match=text):
            review.score(cases, labels, "top").collect()


@pytest.fixture(scope="module")
def snapshot(spark):
    rng = random.Random(11)
    rows, key = [], 0
    w = Windows(START, START + timedelta(days=149), START + timedelta(days=99), START + timedelta(days=120), START + timedelta(days=170))
    boards = [f"{n:02d} {b}" for b in ("BRONX", "QUEENS") for n in range(1, 13)]
    for day in range(150):
        for b, board in enumerate(boards):
            n = 6 + (12 if (day * 7 + b * 5) % 31 == 0 else 0)
            for _ in range(n):
                key += 1
                at = datetime(2026, 1, 1) + timedelta(days=day, minutes=rng.randrange(1440))
                rows.append((f"{key}", at, at + timedelta(days=2) if key % 3 else None, "DOT", "x", "Noise", "y", "Open", board[3:], board, "PHONE"))
    kinds = ["string", "timestamp_ntz", "timestamp_ntz", *["string"] * 8]
    requests = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(SAFE_FIELDS, kinds, strict=True))).cache()
    tested = backtest.run_backtest(requests.limit(0).selectExpr("to_date(created_date) AS date", "borough AS district", "complaint_type AS problem", "0 AS requests")) | {"selected": Thresholds(min_baseline=3, min_delta=5, robust_z=2)}
    return artifact.build_snapshot(requests, w, backtest=tested, problems=3)


def test_document(snapshot):
    assert snapshot["summary"]["districts"] == 24 and snapshot["quality"]["aggregate_request_total"] == snapshot["summary"]["requests"]
    assert len(snapshot["signals"]) == 24 and len({s["id"] for s in snapshot["signals"]}) == 24
    assert len(snapshot["evaluation"]["review_packet"]["cases"]) == 60
    assert all(len(c["points"]) <= 42 for c in snapshot["evaluation"]["review_packet"]["cases"])
    scores = [s["priority_score"] for s in snapshot["signals"]]
    assert scores == sorted(scores, reverse=True)
    assert len(snapshot["meta"]["content_sha256"]) == 64


def test_promotion(snapshot):
    new = review.apply_review(snapshot, {"status": "passed"})
    assert new["meta"]["readiness"] == "revalidation_required"
    snapshot_ok = review.apply_review(snapshot | {"evaluation": snapshot["evaluation"] | {"locked_test": {"passed": True}}}, {"status": "passed"})
    assert snapshot_ok["meta"]["readiness"] == "validated" and {s["severity"] for s in snapshot_ok["signals"]} <= {"high", "watch"}
    assert snapshot["signals"][0]["severity"] == "research_flag"


def test_publish_and_serve(spark, snapshot, tmp_path):
    path = str(tmp_path / "v1")
    manifest = artifact.publish(spark, {"snapshot": snapshot}, path)
    assert manifest["files"]["snapshot"]["bytes"] > 1000
    with pytest.raises(Exception, match="(?i)exists"):
        artifact.publish(spark, {"snapshot": snapshot}, path)
    api = Facade(spark, load_snapshot(spark, f"{path}/snapshot"))
    assert api.health()["status"] == "ok" and api.meta() == snapshot["meta"]
    one = snapshot["signals"][0]
    assert api.signals(limit=3, offset=1) == snapshot["signals"][1:4]
    assert [s["district"] for s in api.signals(district=one["district"].upper(), agency="None")] == [s["district"] for s in snapshot["signals"] if s["district"] == one["district"]]
    assert api.signals(borough="", severity="watch") == []
    assert api.signal(one["id"]) == one
    assert api.trends(signal_id=one["id"])["points"] == snapshot["trends"]["by_signal"][one["id"]]
    assert api.trends(district=one["district"], problem=one["problem"])["points"][-1].keys() == {"date", "observed", "baseline"}
    assert len(api.trends(start_date="2026-01-05", end_date="2026-01-09")["points"]) == 5
    assert api.trends(district="Bronx 01")["points"] == snapshot["trends"]["by_district"]["Bronx 01"]
    assert api.map_values()["districts"] == snapshot["map"]
    for call in (lambda: api.signal("x"), lambda: api.trends(district="x"), lambda: api.trends(signal_id="x")):
        with pytest.raises(NotFound):
            call()
    for call in (lambda: api.signals(limit=1000), lambda: api.signals(offset=-1), lambda: api.signals(severity="bad"), lambda: api.trends(start_date="2020-01-01"), lambda: api.trends(start_date="x"), lambda: api.trends(start_date="2026-02-01", end_date="2026-01-01")):
        with pytest.raises(InvalidRequest) as e:
            call()
        assert e.value.envelope()["error"]["code"] == "validation_error"
    with pytest.raises(ArtifactUnavailable):
        load_snapshot(spark, f"{path}/none")
    spark.createDataFrame([("{ broken",)], "value string").coalesce(1).write.text(f"{path}/broken")
    good = f"{path}/snapshot"
    assert latest_snapshot(spark, [f"{path}/none", f"{path}/broken", good]) == load_snapshot(spark, good)
    with pytest.raises(ArtifactUnavailable):
        latest_snapshot(spark, [f"{path}/broken", f"{path}/none"])


def test_gates_stop_a_build(spark):
    rows = spark.createDataFrame([], ", ".join(f"{c} {'timestamp_ntz' if c.endswith('_date') else 'string'}" for c in SAFE_FIELDS))
    with pytest.raises(GateError):
        artifact.build_panel(rows, Windows())
