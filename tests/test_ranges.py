"""Percentiles and closure by ranges, observed gates, grouping sets and drift, against plain definitions."""

from __future__ import annotations

import json
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.errors import GateError
from tidewatch.operators import drift, marts, panel, ranges, survival


def test_percentiles_by_definition(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.uniform(-5, 5), float(rng.randint(-3, 3)), 1e6])) for _ in range(800)] + [("c", None), ("d", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"low": 0.05, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = {r["k"]: r for r in ranges.percentiles(df, ["k"], "v", points, 0.75).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for key, r in got.items():
        own = [v for k, v in rows if k == key and v is not None]
        for name, p in points.items():
            assert (r[name] is None) if not own else r[name] == pytest.approx(float(np.quantile(own, p)), rel=1e-12)


def test_hot_group_is_split(spark):
    """No buffer or window of a group's medians holds more than its ranges, and one range few values."""
    df = spark.range(300_000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 200_000 / 1440.0).alias("v"))
    hist = ranges.histograms(df, ["k"], "v", 1.0)
    assert hist.agg(F.max(F.size("values"))).first()[0] <= 1440 and hist.count() == 139
    assert ranges.percentiles(df, ["k"], "v", {"m": 0.5}).first()["m"] == pytest.approx(df.agg(F.median("v")).first()[0])


def test_daily_metrics_by_definition(spark):
    rng = random.Random(2)
    t = datetime(2026, 3, 1)
    rows = [(str(k), t.replace(day=rng.randint(1, 3)), rng.choice([None, datetime(2026, 3, rng.randint(1, 28), rng.randint(0, 23))]), rng.choice("xy")) for k in range(400)] + [("n", None, t, "x")]
    made = spark.createDataFrame(rows, "unique_key string, created_date timestamp_ntz, closed_date timestamp_ntz, agency string")
    blank = [c for c in ("agency_name", "complaint_type", "descriptor", "status", "borough", "community_board", "open_data_channel_type")]
    fct = marts.facts(marts.staging(made.select("*", *[F.lit(None).cast("string").alias(c) for c in blank])))
    got = {(r["metric_date"], r["agency"]): (r["request_count"], r["closed_count"], r["median_resolution_days"]) for r in marts.daily_metrics(fct).collect()}
    for key, value in got.items():
        own = [r for r in rows if (r[1].date() if r[1] else None, r[3].upper()) == key]
        days = [(r[2] - r[1]).total_seconds() / 86400 for r in own if r[2] and r[1]]
        assert value[:2] == (len(own), sum(r[2] is not None for r in own))
        assert value[2] == (pytest.approx(float(np.median(days))) if days else None)


@pytest.mark.parametrize("by", [None, ["k"]])
def test_closure_by_definition(spark, by):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([rng.uniform(0, 12), float(rng.randint(0, 9))]), rng.random() < 0.6) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, duration double, event boolean")
    got = survival.closure_probability(df, 7.0, by, width=0.5).collect()
    for r in got:
        own = [x for x in rows if not by or x[0] == r["k"]]
        stays = 1.0
        for t in sorted({x[1] for x in own if x[1] <= 7}):
            stays *= 1 - sum(x[1] == t and x[2] for x in own) / sum(x[1] >= t for x in own)
        assert r["closure_probability"] == pytest.approx(1 - stays, abs=1e-6)
    assert len(got) == (2 if by else 1)


def requests(spark, days):
    rows = [(f"k{i}", datetime(2026, 5, d, 10), None if i % 2 else datetime(2026, 5, d, 12), "03 BRONX", "Noise") for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "unique_key string, created_date timestamp_ntz, closed_date timestamp_ntz, community_board string, complaint_type string")


def test_counts_are_checked_while_written(spark, tmp_path):
    path, start, end = str(tmp_path / "c"), date(2026, 5, 1), date(2026, 5, 4)
    with pytest.raises(GateError, match="no checked"):
        panel.read_counts(spark, path)
    row = panel.write_counts(requests(spark, [1, 1, 2, 4]), path, start, end).first()
    assert (row["source"], row["grouped"], row["reconciled"], row["complete"], row["closed_date_coverage"]) == (4, 4, True, True, 50.0)
    assert panel.read_counts(spark, path).agg(F.sum("requests")).first()[0] == 4
    # A later write that fails its gate takes the mark away.
    with pytest.raises(GateError, match="incomplete"):
        panel.write_counts(requests(spark, [1, 2]), path, start, end)
    with pytest.raises(GateError, match="no checked"):
        panel.read_counts(spark, path)


def test_rollups_equal_single_ones(spark):
    rng = random.Random(6)
    rows = [(date(2026, 1, 1 + k % 31), rng.choice("AB"), rng.choice("PQ"), rng.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "date date, district string, problem string, requests long")
    since, end = date(2026, 1, 10), date(2026, 1, 31)
    every = panel.rollups(df, since, end, 5)

    def of(kind, *columns):
        return sorted(map(tuple, every.where(F.col("kind") == kind).select(*columns).collect()))

    def plain(key, rows):
        out = {}
        for r in rows:
            out[key(r)] = out.get(key(r), 0) + r[3]
        return sorted((*k, v) for k, v in out.items())

    assert of("city", "date", "observed") == plain(lambda r: (r[0],), rows)
    assert of("district", "date", "district", "observed") == plain(lambda r: r[:2], [r for r in rows if r[0] >= since])
    assert of("problem", "date", "problem", "observed") == plain(lambda r: (r[0], r[2]), [r for r in rows if r[0] >= since])
    assert of("map", "district", "observed") == plain(lambda r: (r[1],), [r for r in rows if r[0].day > 26])
    assert every._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1


def test_drift(spark):
    good = {"unique_key": "1", "status": "Open", "agency": None}
    lines = [json.dumps(good), json.dumps(good | {"vehicle": {"a": 1}}), json.dumps(good | {"status": 7}), json.dumps(good | {"status": 7.5, "tags": [1]}), "[1]", "{", None, "3", "{}"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {(r["field"], r["kind"]): (r["records"], r["verdict"]) for r in drift.field_kinds(df).collect()}
    assert got == {
        ("unique_key", "STRING"): (4, "known"), ("agency", "VOID"): (4, "known"), ("status", "STRING"): (2, "known"), ("status", "BIGINT"): (1, "changed"),
        ("status", "DECIMAL"): (1, "changed"), ("vehicle", "OBJECT"): (1, "new"), ("tags", "ARRAY"): (1, "new"), (None, None): (4, "corrupt"),
    }
    assert "vehicle" in drift.seen_schema(df)
    assert drift.field_kinds(df.limit(0)).count() == 0
    statuses = spark.createDataFrame([("open ",), ("Closed",), ("Frozen",), ("frozen",), (None,)], "status string")
    assert [tuple(r) for r in drift.unseen_values(statuses, "status", ["Open", "Closed"]).collect()] == [("FROZEN", 2)]
