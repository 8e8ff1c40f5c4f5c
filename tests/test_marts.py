"""Requests from file to marts, the contract and its quarantine."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest

from tidewatch.operators import contracts, marts
from tidewatch.schemas import SAFE_FIELDS
from tidewatch.sources.files import read_requests, write_requests

ROWS = [
    {"unique_key": "TEST-001", "created_date": "2026-07-01T10:00:00", "closed_date": "2026-07-02T12:00:00", "agency": "DOT", "agency_name": "Department of Transportation", "complaint_type": "Street Condition", "descriptor": "Pothole", "status": "Closed", "borough": "BROOKLYN", "community_board": "05 BROOKLYN", "open_data_channel_type": "ONLINE"},
    {"unique_key": "TEST-002", "created_date": "2026-07-02T11:00:00", "closed_date": None, "agency": "DOT", "agency_name": "Department of Transportation", "complaint_type": "Street Condition", "descriptor": "Pothole", "status": "Open", "borough": "BROOKLYN", "community_board": "05 BROOKLYN", "open_data_channel_type": "MOBILE"},
    {"unique_key": "TEST-003", "created_date": "2026-07-03T09:00:00", "closed_date": "2026-07-08T09:00:00", "agency": "HPD", "agency_name": "Housing", "complaint_type": "Heat/Hot Water", "descriptor": "Entire Building", "status": "Closed", "borough": "BRONX", "community_board": "03 BRONX", "open_data_channel_type": "PHONE"},
]


@pytest.fixture
def requests(spark, tmp_path):
    path = tmp_path / "in" / "part-000000000.ndjson"
    path.parent.mkdir()
    path.write_text("".join(json.dumps(r | {"incident_address": "1 Main St"}) + "\n" for r in ROWS))
    return read_requests(spark, str(path.parent / "*.ndjson"))


def test_marts(requests):
    fct = marts.facts(marts.staging(requests)).cache()
    days = {r["request_id"]: r["resolution_days"] for r in fct.collect()}
    assert days["TEST-001"] == pytest.approx(1560 / 1440)
    assert days["TEST-002"] is None
    assert days["TEST-003"] == 5.0
    daily = sorted((r["metric_date"], r["request_count"], r["closed_count"], r["median_resolution_days"]) for r in marts.daily_metrics(fct).collect())
    assert [d[1:3] for d in daily] == [(1, 1), (1, 0), (1, 1)]
    cohorts = {(r["community_district"], r["problem"]): r for r in marts.closure_cohorts(fct).collect()}
    row = cohorts["05 BROOKLYN", "Street Condition"]
    assert (row["cohort_week"], row["requests"], row["closed_within_7_days"], row["right_censored_requests"]) == (date(2026, 6, 29), 2, 1, 1)
    ages = {r["agency"]: (r["unresolved_requests"], r["aged_30d_requests"]) for r in marts.open_age(fct, date(2026, 8, 21)).collect()}
    assert ages == {"DOT": (1, 1), "HPD": (0, 0)}
    assert tuple(marts.quality(fct).first()) == (3, 3, 0, 0, 0)


def test_minute_boundaries(spark):
    rows = spark.createDataFrame([("a", datetime(2026, 1, 1, 0, 0, 59), datetime(2026, 1, 1, 0, 1))], "unique_key string, created_date timestamp_ntz, closed_date timestamp_ntz")
    for c in SAFE_FIELDS[3:]:
        rows = rows.selectExpr("*", f"'x' as {c}")
    assert marts.facts(marts.staging(rows)).first()["resolution_days"] == pytest.approx(1 / 1440)


def test_contract(spark, tmp_path):
    bad = [
        ROWS[0] | {"unique_key": "A", "closed_date": "2026-06-30T10:00:00"},
        ROWS[0] | {"unique_key": "B", "borough": " \t "},
        ROWS[0] | {"unique_key": "", "status": None},
        ROWS[0] | {"unique_key": "D", "status": "Never Seen", "agency": " DOT "},
    ]
    path = tmp_path / "a.ndjson"
    path.write_text("\n".join(map(json.dumps, bad)) + "\n{broken\n")
    rows = read_requests(spark, str(path)).cache()
    kept = contracts.valid(rows).collect()
    assert [(r["unique_key"], r["status"], r["agency"]) for r in kept] == [("D", "Never Seen", "DOT")]
    broken = {r["unique_key"]: list(r["broken_rules"]) for r in contracts.quarantine(rows).collect()}
    assert broken["A"] == ["closed_before_created"]
    assert broken["B"] == ["borough_blank"]
    assert broken[""] == ["unique_key_missing", "status_blank"]
    assert broken[None] == ["corrupt_record"]


def test_only_safe_fields(requests, tmp_path, spark):
    write_requests(contracts.valid(requests), str(tmp_path / "out"))
    assert set(spark.read.json(str(tmp_path / "out")).columns) <= set(SAFE_FIELDS)


def test_violations(requests):
    found = {(r["check"], r["column"]): r["n_violations"] for r in contracts.violations(requests.drop("_corrupt"), ["closed_date"], ["agency", "unique_key"]).collect()}
    assert found == {("not_null", "closed_date"): 1, ("unique", "agency"): 1, ("unique", "unique_key"): 0}


def test_materialise(spark, requests):
    def daily(df):
        return sorted(map(str, df.collect()))

    first = daily(marts.materialise(requests, date(2026, 8, 21))["mart_daily_metrics"])
    assert spark.catalog.tableExists("fct_requests") and spark.table("stg_requests").count() == 3
    # Tables are replaced.
    assert daily(marts.materialise(requests, date(2026, 8, 21))["mart_daily_metrics"]) == first == daily(marts.daily_metrics(marts.facts(marts.staging(requests))))
    assert {t.name for t in spark.catalog.listTables() if not t.isTemporary} >= {"fct_requests", "mart_daily_metrics", "mart_closure_cohorts", "mart_open_age", "mart_quality"}


def test_refreshed_tables(spark, tmp_path):
    """Partitions that rows belong to are replaced; a writer that ends before its manifest changes nothing."""
    from pyspark.sql import functions as F

    from tidewatch.errors import GateError
    from tidewatch.operators import refresh

    path = str(tmp_path / "t")
    with pytest.raises(GateError):
        refresh.read_refreshed(spark, path)

    def rows(*values):
        return spark.createDataFrame(values, "k int, m string")

    def seen():
        return sorted(((r["k"], r["m"]) for r in refresh.read_refreshed(spark, path).collect()), key=repr)

    assert refresh.refresh(rows((1, "a"), (2, "b"), (3, None)), path, F.col("m")) == 1
    before = refresh.read_refreshed(spark, path)
    assert refresh.refresh(rows((4, "b"), (5, "c")), path, F.col("m")) == 2
    assert seen() == [(1, "a"), (3, None), (4, "b"), (5, "c")]
    assert sorted(r["k"] for r in before.collect()) == [1, 2, 3]  # a reader that began before keeps its state
    rows((9, "a")).withColumn("part", F.col("m")).write.partitionBy("part").parquet(f"{path}/data/cutoff")
    (tmp_path / "t/manifests/000000003").mkdir()
    assert seen() == [(1, "a"), (3, None), (4, "b"), (5, "c")]
    (tmp_path / "t/manifests/000000003").rmdir()
    refresh.refresh(rows((7, None)), path, F.col("m"))
    refresh.refresh(rows((7, None)).limit(0), path, F.col("m"))
    assert seen() == [(1, "a"), (4, "b"), (5, "c"), (7, None)]
