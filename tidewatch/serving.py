"""Read-only facade over a published document: filters, lookups, trends and sections."""

from __future__ import annotations

import json
from contextlib import suppress
from datetime import date
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ArtifactUnavailable, InvalidRequest, NotFound
from .operators.ranked_views import between, filtered

SEVERITIES = ("high", "watch", "research_flag")
FILTERS = ("borough", "district", "problem", "agency", "type", "severity")
MOST_ROWS = 100


@lru_cache(maxsize=4)
def load_snapshot(spark: SparkSession, path: str) -> dict:
    """The document published at path, read once."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (AnalysisException, TypeError, json.JSONDecodeError) as e:
        raise ArtifactUnavailable(f"no document can be read at {path.rsplit('/', 1)[-1]}") from e


def latest_snapshot(spark: SparkSession, versions: list[str]) -> dict:
    """The newest version that can be read: versions are paths, the newest first. Fails if none can."""
    for path in versions[:-1]:
        with suppress(ArtifactUnavailable):
            return load_snapshot(spark, path)
    return load_snapshot(spark, versions[-1])


def _day(value: str | date | None, name: str) -> date | None:
    if value is None or isinstance(value, date):
        return value
    try:
        return date.fromisoformat(value)
    except ValueError as e:
        raise InvalidRequest(f"{name}: dates must use YYYY-MM-DD") from e


class Facade:
    """Answers of the read interface. Lists are DataFrames in Spark and come back as dictionaries."""

    def __init__(self, spark: SparkSession, snapshot: dict) -> None:
        self.spark, self.document = spark, snapshot
        rows = [(i, *[s.get(c) for c in ("id", *FILTERS)], json.dumps(s)) for i, s in enumerate(snapshot["signals"])]
        columns = ", ".join(f"`{c}` string" for c in ("id", *FILTERS))
        self._signals = spark.createDataFrame(rows, f"place int, {columns}, document string").cache()
        points = [(kind, key, p["date"], p["observed"], p.get("baseline")) for kind, lists in self._lists() for key, found in lists.items() for p in found]
        self._trends = spark.createDataFrame(points, "kind string, key string, day string, observed long, baseline double").select("kind", "key", F.to_date("day").alias("date"), "observed", "baseline").cache()

    def _lists(self) -> list[tuple[str, dict]]:
        t = self.document["trends"]
        return [("city", {"": t["citywide_volume"]}), ("signal", t["by_signal"]), ("district", t.get("by_district", {})), ("problem", t.get("by_problem", {}))]

    def health(self) -> dict:
        return {"status": "ok", "artifact": self.document["meta"]["artifact_version"]}

    def meta(self) -> dict:
        return self.document["meta"]

    def snapshot(self) -> dict:
        return self.document

    def dimensions(self) -> dict:
        return self.document["dimensions"]

    def quality(self) -> dict:
        return self.document["quality"]

    def evaluation(self) -> dict:
        return self.document["evaluation"]

    def signals_df(self, limit: int = 50, offset: int = 0, **filters: str | None) -> DataFrame:
        if not 1 <= limit <= MOST_ROWS:
            raise InvalidRequest(f"limit must be from 1 to {MOST_ROWS}")
        if offset < 0:
            raise InvalidRequest("offset must not be negative")
        unknown = sorted(set(filters) - set(FILTERS))
        if unknown:
            raise InvalidRequest(f"unknown filters: {', '.join(unknown)}")
        if filters.get("severity") not in (None, *SEVERITIES):
            raise InvalidRequest(f"severity must be one of: {', '.join(SEVERITIES)}")
        return filtered(self._signals, filters).orderBy("place").offset(offset).limit(limit)

    def signals(self, limit: int = 50, offset: int = 0, **filters: str | None) -> list[dict]:
        return [json.loads(r["document"]) for r in self.signals_df(limit, offset, **filters).collect()]

    def signal(self, signal_id: str) -> dict:
        row = self._signals.where(F.col("id") == signal_id).first()
        if row is None:
            raise NotFound(f"no signal has the id {signal_id}")
        return json.loads(row["document"])

    def trends(self, signal_id: str | None = None, district: str | None = None, problem: str | None = None, start_date: str | date | None = None, end_date: str | date | None = None) -> dict:
        """Points of a signal, else of a district and problem, else of either, else of all."""
        start, end = _day(start_date, "start_date"), _day(end_date, "end_date")
        first, last = (date.fromisoformat(self.document["meta"][k]) for k in ("window_start", "window_end"))
        for name, value in (("start_date", start), ("end_date", end)):
            if value is not None and not first <= value <= last:
                raise InvalidRequest(f"{name} is not within the published days")
        if start and end and start > end:
            raise InvalidRequest("start_date must not be after end_date")
        if signal_id:
            kind, key = "signal", signal_id
        elif district and problem:
            row = self._signals.where((F.col("district") == district) & (F.col("problem") == problem)).orderBy("place").first()
            kind, key = "signal", row["id"] if row else ""
        elif district or problem:
            kind, key = ("district", district) if district else ("problem", problem)
        else:
            kind, key = "city", ""
        points = self._trends.where((F.col("kind") == kind) & (F.col("key") == key))
        if kind != "city" and points.isEmpty():
            raise NotFound("There is no trend for this district, problem or signal")
        rows = between(points, start, end).orderBy("date").collect()
        with_baseline = kind == "signal"
        return {"metric": "volume", "points": [{"date": str(r["date"]), "observed": r["observed"]} | ({"baseline": r["baseline"]} if with_baseline else {}) for r in rows]}

    def map_values(self, metric: str = "severity") -> dict:
        if metric not in ("requests", "severity"):
            raise InvalidRequest("metric must be requests or severity")
        return {"metric": metric, "districts": self.document["map"]}
