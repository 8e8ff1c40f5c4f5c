"""Episodes from streams, replays and matches against the batch rules and plain definitions."""

from __future__ import annotations

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detectors, episodes
from tidewatch.schemas import SERIES, Thresholds
from tidewatch.streaming import ingest

T0 = date(2026, 1, 5)
LOOSE = Thresholds(min_baseline=1, min_delta=2, robust_z=2)
KINDS = {c: "string" for c in ("id", "type", "district", "problem", "detector")} | {"date": "date", "affected_count": "long"}
ALERT = ", ".join(f"{c} {KINDS.get(c, 'double')}" for c in detectors.ALERT_COLUMNS)


def alert(day, score, series=("A", "P")):
    d = T0 + timedelta(days=day)
    return {"id": f"{series}{day}", "type": "v", "date": str(d), "district": series[0], "problem": series[1], "detector": "d", "affected_count": day + 1} | {
        c: score + k for k, c in enumerate(("observed", "expected", "effect", "calibrated_score", "upper_bound", "excess_count"))
    } | {"anomaly_score": score}


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*episodes.EPISODE_COLUMNS).collect())


def test_stream_of_alerts(spark, tmp_path):
    """Sessions are the batch's episodes: gaps of 7 and 8 days, ties of scores, a restart between files, late rows left out."""
    files = [
        [alert(0, 3.0), alert(7, 5.0), alert(14, 5.0), alert(22, 1.0), alert(1, 2.0, ("B", "P"))],
        [alert(29, 4.0), alert(23, 9.0), alert(40, 2.0)],
        [alert(60, 1.0), alert(59, 1.0, ("B", "P"))],
        [alert(3, 99.0), alert(90, 1.0)],  # the first is weeks late
        [alert(200, 1.0)],
    ]
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    for k, lines in enumerate(files):
        (source / f"{k}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
        sessions = ingest.episode_sessions(spark.readStream.schema(ALERT).json(str(source)), delay="10 days")
        sessions.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    on_time = spark.read.schema(ALERT).json(str(source)).where("anomaly_score < 99 AND date < '2026-07-01'")
    want = episodes.merge_episodes(on_time)
    assert rows_of(spark.read.parquet(out)) == rows_of(want)
    assert want.columns == episodes.EPISODE_COLUMNS and want.count() == 7
    first = want.where("district = 'A'").orderBy("date").first()
    assert (first["persistence"], first["anomaly_score"], first["observed"], first["affected_count"]) == (3, 5.0, 5.0, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(4)
    rows = []
    for series in (("A", "P"), ("A", "Q"), ("B", "P")):
        for k in range(400):
            rows.append((T0 + timedelta(days=k), *series, max(0, int(rng.gauss(6, 2))) + (rng.randint(5, 20) if rng.random() < 0.06 else 0)))
    return spark.createDataFrame(rows, "date date, district string, problem string, requests long").cache()


def test_replay_equals_batches(spark, panel):
    days = [T0 + timedelta(days=k) for k in range(60, 400, 17)] + [T0 + timedelta(days=399)]
    got = {}
    for r in ingest.replay(panel, LOOSE, days).collect():
        got.setdefault(r["known_on"], []).append(tuple(r[c] for c in episodes.EPISODE_COLUMNS))
    for day in days:
        want = rows_of(episodes.merge_episodes(detectors.detect(panel, LOOSE, day)))
        assert sorted(got.get(day, [])) == want
    assert len(got[days[-1]]) > 20


def test_year_of_replays_is_one_pass(spark, panel):
    known = ingest.replay(panel, LOOSE, [T0 + timedelta(days=k) for k in range(365)])
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("InMemoryRelation") == 1 and "Python" not in plan
    assert known.select("known_on").distinct().count() > 200


def greedy(found, events, grace=2):
    taken, out = set(), {}
    for name, series, start, end in sorted(events):
        for day in sorted(d for s, d in found if s == series and start <= d <= end + timedelta(days=grace)):
            if (series, day) not in taken:
                taken.add((series, day))
                out[name] = day
                break
    return out


@pytest.mark.parametrize("seed, block", [(0, 512), (1, 3)])
def test_matches_by_definition(spark, monkeypatch, seed, block):
    monkeypatch.setattr(episodes, "MATCH_BLOCK", block)
    rng = random.Random(seed)
    series = [("A", "P"), ("B", "P"), ("B", "Q")]
    days = [T0 + timedelta(days=k) for k in range(120)]
    found = [(rng.choice(series), rng.choice(days)) for _ in range(90)]
    events = []
    for k in range(80):
        start = rng.choice(days)
        events.append((f"E{rng.randrange(10**6):06d}{k}", rng.choice(series), start, start + timedelta(days=rng.choice([0, 3, 10, 40, -5]))))
    e = spark.createDataFrame([(n, *s, a, b, "x") for n, s, a, b in events], "event_id string, district string, problem string, start date, end date, scenario string")
    f = spark.createDataFrame([(*s, d) for s, d in found], "district string, problem string, episode_start date")
    matched = episodes.match_events(f, e)
    got = {r["event_id"]: r["matched"] for r in matched.collect()}
    assert len(got) == len(events) and {k: v for k, v in got.items() if v} == greedy(found, events)
    assert "Python" not in matched._jdf.queryExecution().optimizedPlan().toString() and "Pandas" not in matched._jdf.queryExecution().optimizedPlan().toString()


def test_many_events_of_one_series(spark):
    n = 100_000
    day = F.date_add(F.lit(date(1500, 1, 1)), (F.col("id") * 10).cast("int"))
    e = spark.range(n).select(F.format_string("E%06d", (F.col("id") * 7919) % n).alias("event_id"), F.lit("A").alias("district"), F.lit("P").alias("problem"), day.alias("start"), F.date_add(day, 9).alias("end"))
    f = spark.range(n).select(F.lit("A").alias("district"), F.lit("P").alias("problem"), F.date_add(day, 11).alias("episode_start"))
    got = episodes.match_events(f, e).agg(F.count("matched").alias("n"), F.countDistinct("matched").alias("days"), F.max("delay_days").alias("late")).first()
    # Each episode is wanted by the event before (in its grace) and by the one it falls into.
    assert got["n"] == got["days"] >= n - 1 and got["late"] == 11


def test_matches_of_nothing(spark):
    e = spark.createDataFrame([("e", "A", "P", T0, T0)], "event_id string, district string, problem string, start date, end date")
    f = spark.createDataFrame([], "district string, problem string, episode_start date")
    assert episodes.match_events(f, e).first()["matched"] is None
    assert episodes.match_events(f, e.limit(0)).count() == 0
    assert set(SERIES) <= set(episodes.match_events(f, e).columns)


def test_ranks_by_ranges(spark, monkeypatch):
    """Percent ranks don't depend on the number of ranges, which grows with the rows."""
    rng = random.Random(8)
    values = [rng.choice([None, rng.random(), 0.5, 3.0]) for _ in range(3000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v double")
    monkeypatch.setattr(episodes, "RANGE_ROWS", 20)
    got = {r["id"]: r["p"] for r in episodes.rank_by_counts(df, {"v": "p"}).collect()}
    filled = sorted(v for v in values if v is not None)
    for k, v in enumerate(values):
        if v is None:
            assert got[k] is None
        else:
            first, last = filled.index(v), len(filled) - 1 - filled[::-1].index(v)
            assert got[k] == pytest.approx(((first + last) / 2 + 1) / len(filled))


def test_bootstrap_in_spark(spark):
    from tidewatch.operators import metrics

    rows = spark.createDataFrame([("A", f"P{k}", k % 4, (k + 1) % 3, k % 2) for k in range(40)], "district string, problem string, tp long, fp long, fn long")
    got = {r["metric"]: (r["low"], r["high"]) for r in metrics.bootstrap_by_hash(rows, draws=400).collect()}
    plain = metrics.bootstrap_intervals(rows)
    assert set(got) == set(plain)
    for name, (low, high) in got.items():
        assert low < high and abs(low - plain[name][0]) < 0.04 and abs(high - plain[name][1]) < 0.04
    assert {(r["low"], r["high"]) for r in metrics.bootstrap_by_hash(rows.limit(0)).collect()} == {(0.0, 0.0)}
