"""The published sections as tables: built, written and answered in Spark, none of them collected.

A version is a folder with one table a section, written once, and a manifest that is written last: a
folder without it is not published. Signals are ordered by id and trends by kind, key and date, so that
lookups are filters on the files' own statistics and folders.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactUnavailable, InvalidRequest, NotFound
from ..functions.text import borough_of
from ..operators import features, marts, panel, ranked_views
from ..schemas import Gates, Thresholds, Windows

METHOD_VERSION = "2.0.0"
#: Decimals of published numbers.
DECIMALS = {"observed": 2, "expected": 2, "effect": 2, "anomaly_score": 2, "calibrated_score": 2, "upper_bound": 2, "excess_count": 2, "priority_score": 3}
FILTERS = ("borough", "district", "problem", "agency", "type", "severity")
SEVERITIES = ("high", "watch", "research_flag")
MOST_ROWS = 100
SECTIONS = ("signals", "trends", "map", "dimensions", "facts")
_MANIFEST = "section string, rows long, content long"


def _match(value: Column) -> Column:
    """A value as filters compare it: in any case, a null as `none`."""
    return F.lower(F.coalesce(value.cast("string"), F.lit("None")))


def signals(ranked: DataFrame, detector: str, severity: str | None = None) -> DataFrame:
    """Published signals of ranked episodes with place, and what filters compare (match_*)."""

    def evidence(label: str, value: Column, note: str) -> Column:
        return F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit(note).alias("note"))

    def one(c: str) -> Column:
        return F.format_string("%.1f", F.round(c, 2))

    shown = ranked.withColumn("borough", borough_of(F.col("district"))).withColumn("agency", F.lit(None).cast("string"))
    if severity:
        shown = shown.withColumn("severity", F.lit(severity))
    plain = ["id", "type", "district", "borough", "problem", "agency", "severity", "persistence", "episode_start", "episode_end", F.col("date").alias("as_of")]
    lines = F.array(
        evidence("Observed requests", F.col("observed").cast("long").cast("string"), "Count of new requests that day."),
        evidence("Expected baseline", one("expected"), "What the same weekday had before."),
        evidence("Score", one("anomaly_score"), f"How far the day is from it, by {detector}."),
        evidence("Upper bound", one("upper_bound"), "Counts over this are called unusual."),
    )
    out = shown.select(
        F.col("place").cast("int").alias("place"), *plain, *[F.round(c, d).alias(c) for c, d in DECIMALS.items()], F.lit(detector).alias("detector"), F.lit(METHOD_VERSION).alias("model_version"),
        F.concat(F.lit("More "), "problem", F.lit(" than usual for the weekday")).alias("title"), lines.alias("evidence"),
    )
    return out.select("*", *[_match(F.col(c)).alias(f"match_{c}") for c in FILTERS])


def trends(dense: DataFrame, best: DataFrame, report_start: date, end: date, points: int = 180) -> DataFrame:
    """kind (city, district, problem, signal), key, date, observed and baseline (of signals): all trends of a report."""
    none = F.lit(None).cast("double").alias("baseline")
    sums = panel.rollups(dense, report_start, end).where("kind <> 'map'")
    totals = sums.select("kind", F.coalesce("district", "problem", F.lit("")).alias("key"), "date", "observed", none)
    own = ranked_views.signal_trends(best, features.display_baseline(dense), points)
    return totals.unionByName(own.select(F.lit("signal").alias("kind"), F.col("id").alias("key"), "date", "observed", F.round("baseline", 1).alias("baseline")))


def dimensions(requests: DataFrame, dense: DataFrame, most_agencies: int = 50) -> DataFrame:
    """kind, value and requests: districts and boroughs of the panel, and problems, agencies and channels of the requests."""
    series = dense.select("district").distinct()
    found = [series.select(F.lit("districts").alias("kind"), F.col("district").alias("value"), F.lit(None).cast("long").alias("requests"))]
    found.append(series.select(borough_of(F.col("district")).alias("value")).distinct().select(F.lit("boroughs").alias("kind"), "value", F.lit(None).cast("long").alias("requests")))
    for kind, column, n in (("problems", "complaint_type", None), ("agencies", "agency", most_agencies), ("channels", "open_data_channel_type", None)):
        found.append(marts.top_counts(requests, column, n).select(F.lit(kind).alias("kind"), F.trim(column).alias("value"), "requests"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def facts(requests: DataFrame, dense: DataFrame, best: DataFrame, windows: Windows, gates: Gates | None = None) -> DataFrame:
    """section, name and value (as text) of the single figures: meta, summary, quality and gates."""
    counts = marts.inventory(requests, windows.start, windows.end)
    month = requests.where(F.date_trunc("month", "created_date") == F.date_trunc("month", F.lit(windows.end).cast("timestamp_ntz")))
    quality = marts.coverage(month, ["closed_date", "community_board"]).withColumnsRenamed({"community_board_coverage": "district_field_coverage"})
    days = dense.agg(F.count("*").alias("panel_rows"), F.sum("requests").alias("panel_requests"), F.countDistinct("district").alias("districts"))
    shown = best.agg(F.count("*").alias("signals"), F.count_if(F.col("severity") == "high").alias("high_signals"))
    meta = {"artifact_version": f"{windows.end:%Y.%m}-v1", "method_version": METHOD_VERSION, "window_start": windows.start, "window_end": windows.end, "readiness": "revalidation_required"}
    constant = [("meta", k, str(v)) for k, v in meta.items()] + [("gates", k, str(v)) for k, v in vars(gates or Gates()).items()]
    out = requests.sparkSession.createDataFrame(constant, "section string, name string, value string")
    for section, row in (("summary", counts), ("quality", quality), ("quality", days), ("summary", shown)):
        texts = row.select(*[F.col(c).cast("string").alias(c) for c in row.columns])
        out = out.unionByName(texts.unpivot([], texts.columns, "name", "value").select(F.lit(section).alias("section"), "name", "value"))
    return out


def build_sections(requests: DataFrame, dense: DataFrame, best: DataFrame, t: Thresholds, windows: Windows) -> dict[str, DataFrame]:
    """All sections of a report; best: the top ranked episodes, with place."""
    return {
        "signals": signals(best, t.detector),
        "trends": trends(dense, best, windows.report_start, windows.end),
        "map": ranked_views.map_rows(panel.district_totals(dense, windows.end), best),
        "dimensions": dimensions(requests, dense),
        "facts": facts(requests, dense, best, windows),
    }


def publish_sections(sections: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each section once and then the manifest: its rows and a sum of its rows' hashes, seen while it was written.

    Publishing to a path that is there fails. Trends are dealt by kind and key and lie in folders by kind.
    """
    found = []
    order = {"signals": ["id"], "trends": ["kind", "key", "date"]}
    spark = next(iter(sections.values())).sparkSession
    for name, rows in sections.items():
        seen = Observation()
        # 64-bit hashes are summed in parts, as their sum may not fit.
        digest = F.coalesce(F.sum(F.xxhash64(*rows.columns) % (1 << 40)), F.lit(0)).alias("content")
        if name == "trends":
            rows = rows.repartition("kind", "key").sortWithinPartitions(*order[name])
        elif name in order:
            rows = rows.sort(*order[name])
        # Seen last, as a sort looks at what is below it twice.
        out = rows.observe(seen, F.count("*").alias("rows"), digest).write
        (out.partitionBy("kind") if name == "trends" else out).parquet(f"{path}/{name}")
        found.append((name, seen.get["rows"], seen.get["content"]))
    spark.createDataFrame(found, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


class Sections:
    """Answers of the read interface from the tables of one version, as DataFrames."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        try:
            self.manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
            complete = {r["section"] for r in self.manifest.collect()} >= set(SECTIONS)
        except AnalysisException:
            complete = False
        if not complete:
            raise ArtifactUnavailable(f"there is no published version at {path.rsplit('/', 1)[-1]}")
        self.tables = {name: spark.read.parquet(f"{path}/{name}") for name in SECTIONS}

    @classmethod
    def newest(cls, spark: SparkSession, paths: list[str]) -> Sections:
        """The first of the paths, newest first, that is published."""
        for path in paths[:-1]:
            try:
                return cls(spark, path)
            except ArtifactUnavailable:
                continue
        return cls(spark, paths[-1])

    def facts(self, section: str | None = None) -> DataFrame:
        rows = self.tables["facts"]
        return rows.where(F.col("section") == section) if section else rows

    def health(self) -> DataFrame:
        return self.facts("meta").where("name = 'artifact_version'").select(F.lit("ok").alias("status"), F.col("value").alias("artifact"))

    def dimensions(self, kind: str | None = None) -> DataFrame:
        rows = self.tables["dimensions"]
        return rows.where(F.col("kind") == kind) if kind else rows

    def signals(self, limit: int = 50, offset: int = 0, **filters: str | None) -> DataFrame:
        """Signals by place whose fields equal the filters in any case; empty filters don't count."""
        if not 1 <= limit <= MOST_ROWS or offset < 0:
            raise InvalidRequest(f"limit must be from 1 to {MOST_ROWS} and offset not negative")
        if unknown := sorted(set(filters) - set(FILTERS)):
            raise InvalidRequest(f"unknown filters: {', '.join(unknown)}")
        if (filters.get("severity") or SEVERITIES[0]).lower() not in SEVERITIES:
            raise InvalidRequest(f"severity must be one of: {', '.join(SEVERITIES)}")
        rows = self.tables["signals"]
        for name, value in filters.items():
            if value:
                rows = rows.where(F.col(f"match_{name}") == value.lower())
        return rows.drop(*[f"match_{c}" for c in FILTERS]).orderBy("place").offset(offset).limit(limit)

    def signal(self, signal_id: str) -> DataFrame:
        """The row of one signal; fails if there is none."""
        rows = self.tables["signals"].where(F.col("id") == signal_id).drop(*[f"match_{c}" for c in FILTERS])
        if rows.isEmpty():
            raise NotFound(f"no signal has the id {signal_id}")
        return rows

    def _window(self, start: date | None, end: date | None) -> None:
        days = {r["name"]: date.fromisoformat(r["value"]) for r in self.facts("meta").where("name LIKE 'window%'").collect()}
        for name, day in (("start_date", start), ("end_date", end)):
            if day is not None and not days["window_start"] <= day <= days["window_end"]:
                raise InvalidRequest(f"{name} is not within the published days")
        if start and end and start > end:
            raise InvalidRequest("start_date must not be after end_date")

    def trends(self, signal_id: str | None = None, district: str | None = None, problem: str | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
        """Points of a signal, else of the best signal of a district and problem, else of either, else of all, by date."""
        self._window(start, end)
        kind, key = "city", ""
        if signal_id:
            kind, key = "signal", signal_id
        elif district and problem:
            best = self.tables["signals"].where((F.col("district") == district) & (F.col("problem") == problem)).orderBy("place").select("id").first()
            kind, key = "signal", best["id"] if best else ""
        elif district or problem:
            kind, key = ("district", district) if district else ("problem", problem)
        points = self.tables["trends"].where((F.col("kind") == kind) & (F.col("key") == key))
        if kind != "city" and points.isEmpty():
            raise NotFound("There is no trend for this district, problem or signal")
        columns = ["date", "observed", "baseline"] if kind == "signal" else ["date", "observed"]
        return ranked_views.between(points, start, end).select(*columns).orderBy("date")

    def map_values(self, metric: str = "severity") -> DataFrame:
        if metric not in ("requests", "severity"):
            raise InvalidRequest("metric must be requests or severity")
        return self.tables["map"].select("district", "borough", F.col(metric).cast("string").alias("value"))
