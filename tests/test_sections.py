"""Published sections: written once behind a manifest, answered by filters that reach the scan."""

from __future__ import annotations

from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewatch import oracles
from tidewatch.errors import ArtifactUnavailable, InvalidRequest, NotFound
from tidewatch.plans import sections
from tidewatch.queries import _published, queries
from tidewatch.sources.bindings import PANEL_END

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def version(spark, sf_dir):
    return _published(spark, sf_dir)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_are_pushed_into_the_scan(version):
    best = version.signals(1).first()
    assert f"EqualTo(id,{best['id']})" in plan_of(version.signal(best["id"]))
    assert f"EqualTo(match_district,{best['district'].lower()})" in plan_of(version.signals(district=best["district"]))
    plan = plan_of(version.trends(district="A", start=PANEL_END - timedelta(days=9)))
    assert "PartitionFilters: [isnotnull(kind" in plan and "EqualTo(key,A)" in plan and "GreaterThanOrEqual(date" in plan
    assert "ReadSchema: struct<key:string,date:date,observed:bigint>" in plan


def test_answers(version):
    every = version.signals(100).collect()
    assert [r["place"] for r in every] == list(range(1, len(every) + 1)) and not any(c.startswith("match_") for c in every[0].asDict())
    assert version.signals(3, 2).collect() == every[2:5]
    assert version.signals(severity="Watch", district=every[0]["district"].upper(), agency="none").count() == sum(r["severity"] == "watch" and r["district"] == every[0]["district"] for r in every)
    assert version.signals(agency="police").count() == 0 and version.signals(problem="").count() == len(every)
    assert version.signal(every[-1]["id"]).first() == every[-1]
    assert len(every[0]["evidence"]) == 4 and every[0]["evidence"][0]["value"] == str(int(every[0]["observed"]))
    assert version.trends(signal_id=every[0]["id"]).columns == ["date", "observed", "baseline"]
    assert version.trends().columns == ["date", "observed"] and version.trends(start=PANEL_END).count() == 1
    assert {r["value"] for r in version.map_values().collect()} <= {"high", "watch", "normal"}
    assert version.dimensions("districts").count() == version.map_values("requests").count()
    assert {r["section"]: r["rows"] for r in version.manifest.collect()}["signals"] == len(every)


def test_wrong_questions(version):
    for call in (
        lambda: version.signals(0), lambda: version.signals(101), lambda: version.signals(1, -1), lambda: version.signals(colour="red"), lambda: version.signals(severity="loud"),
        lambda: version.trends(start=date(1980, 1, 1)), lambda: version.trends(start=PANEL_END, end=PANEL_END - timedelta(days=1)), lambda: version.map_values("depth"),
    ):
        with pytest.raises(InvalidRequest):
            call()
    for call in (lambda: version.signal("x"), lambda: version.trends(signal_id="x"), lambda: version.trends(district="x"), lambda: version.trends(district="A", problem="x")):
        with pytest.raises(NotFound):
            call()


def test_versions(spark, tmp_path):
    rows = spark.createDataFrame([("meta", "artifact_version", "v"), ("meta", "window_start", "2026-01-01"), ("meta", "window_end", "2026-02-01")], "section string, name string, value string")
    tables = {"facts": rows, "map": rows, "dimensions": rows, "signals": rows.withColumn("id", F.lit("a")), "trends": rows.selectExpr("'city' AS kind", "'' AS key", "current_date() AS date")}
    good, broken = str(tmp_path / "good"), str(tmp_path / "broken")
    manifest = sections.publish_sections(tables, good)
    assert {r["rows"] for r in manifest.collect()} == {3}
    with pytest.raises(Exception, match="(?i)exists"):
        sections.publish_sections(tables, good)
    for name, table in tables.items():  # a writer that ended before the manifest
        table.write.parquet(f"{broken}/{name}")
    with pytest.raises(ArtifactUnavailable):
        sections.Sections(spark, broken)
    newest = sections.Sections.newest(spark, [str(tmp_path / "none"), broken, good])
    assert newest.health().first()[:] == ("ok", "v") and newest.facts("meta").count() == 3
    with pytest.raises(ArtifactUnavailable):
        sections.Sections.newest(spark, [broken, str(tmp_path / "none")])


@pytest.mark.parametrize("name", ["served_signal", "served_signal_trend", "served_signals", "served_map", "published_manifest"])
def test_tables_without_signals(spark, sf_dir, tmp_path, name):
    """Where no day is unusual there is no best signal to look up: no row, as in SQL."""
    con = duckdb.connect()
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").withColumns({"l_shipdate": F.lit(PANEL_END).cast("timestamp_ntz")} if t == "lineitem" else {}).write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found, want = queries()[name](spark, str(tmp_path)), con.sql(oracles.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(str(Row(**dict(zip(want.columns, r, strict=True)))) for r in want.fetchall())
    assert (found.count() == 0) == name.startswith("served_signal")
