"""Registered queries: each operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.text import borough_of, canonical_hash, district_of_code, is_official, parse_district, signal_id, strip
from .operators import contracts, detectors, drift, episodes, features, marts, metrics, panel, ranked_views, refresh, review, survival
from .operators.settled import settled, shared_folder
from .plans import backtest, sections, synthetic
from .schemas import DISTRICTS, REQUEST, SAFE_FIELDS, SERIES, Gates, Thresholds, Windows
from .sources import files, parts, rest
from .sources.bindings import PANEL_END, PANEL_START, labelled_events, requests, shipments, table
from .sources.bindings import panel as dense
from .sources.service import TableService
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

#: Settings under which the small test panels have alerts.
ROBUST = Thresholds(min_baseline=1, min_delta=2, robust_z=2)
COUNTS = Thresholds(detector="nb_conformal", history=13, min_baseline=1, min_delta=2, min_ratio=1.2, prediction_z=2)
SPIKES = Thresholds(detector="nb_conformal", history=13, min_baseline=1, min_delta=2, min_ratio=1.2, prediction_z=3, spike_ratio=1.6, spike_min_baseline=2)
SHIFTS = Thresholds(detector="hybrid_nb_ewma", history=13, min_baseline=1, min_delta=1, min_ratio=1.4, prediction_z=2)

START, END = date(1997, 1, 1), date(1998, 12, 31)
AS_OF = date(1999, 6, 30)
REPORT_START = date(2001, 8, 1)

_QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _fct(s: SparkSession, d: str) -> DataFrame:
    return marts.facts(marts.staging(requests(s, d)))


# -- contract, staging, marts


@_query
def stg_normalize(s: SparkSession, d: str) -> DataFrame:
    return marts.staging(requests(s, d))


@_query
def fct_requests(s: SparkSession, d: str) -> DataFrame:
    return _fct(s, d)


@_query
def contract_valid(s: SparkSession, d: str) -> DataFrame:
    return contracts.valid(requests(s, d))


@_query
def contract_quarantine(s: SparkSession, d: str) -> DataFrame:
    return contracts.quarantine(requests(s, d)).select("unique_key", "created_date", "closed_date", F.array_join("broken_rules", ",").alias("broken_rules"))


@_query
def mart_daily_metrics(s: SparkSession, d: str) -> DataFrame:
    return marts.daily_metrics(_fct(s, d))


@_query
def mart_closure_cohorts(s: SparkSession, d: str) -> DataFrame:
    return marts.closure_cohorts(_fct(s, d))


@_query
def mart_open_age(s: SparkSession, d: str) -> DataFrame:
    return marts.open_age(_fct(s, d), AS_OF)


@_query
def mart_quality(s: SparkSession, d: str) -> DataFrame:
    return marts.quality(_fct(s, d))


@_query
def marts_refreshed(s: SparkSession, d: str) -> DataFrame:
    """Tables written with half of the requests, then refreshed with all of 1997: requests and closures by month."""
    out, rows = shared_folder(s, "marts"), requests(s, d)
    marts.refresh_marts(rows.where(F.col("unique_key").cast("long") % 2 == 0), out)
    marts.refresh_marts(rows.where((F.col("created_date") >= F.lit(date(1997, 1, 1)).cast("timestamp_ntz")) & (F.col("created_date") < F.lit(date(1998, 1, 1)).cast("timestamp_ntz"))), out)
    return refresh.read_refreshed(s, f"{out}/mart_daily_metrics").groupBy("part").agg(F.sum("request_count").alias("requests"), F.sum("closed_count").alias("closed"), F.count("*").alias("groups"))


@_query
def constraint_violations(s: SparkSession, d: str) -> DataFrame:
    return contracts.violations(_fct(s, d), ["request_id", "created_at_local", "problem_detail", "agency_name"], ["request_id", "problem"])


# -- counts, gates, rollups


@_query
def window_filter_count(s: SparkSession, d: str) -> DataFrame:
    return marts.inventory(requests(s, d), START, END).select("requests")


@_query
def open_as_of(s: SparkSession, d: str) -> DataFrame:
    return marts.inventory(requests(s, d), START, END).select("unresolved_as_of", "aged_open")


@_query
def global_counts(s: SparkSession, d: str) -> DataFrame:
    return marts.inventory(requests(s, d), START, END)


@_query
def coverage(s: SparkSession, d: str) -> DataFrame:
    return marts.coverage(requests(s, d), ["closed_date", "agency_name", "community_board"])


@_query
def top_problems(s: SparkSession, d: str) -> DataFrame:
    return marts.top_counts(requests(s, d), "complaint_type", 3)


@_query
def top_agencies(s: SparkSession, d: str) -> DataFrame:
    return marts.top_counts(requests(s, d), "agency", 50)


@_query
def channels(s: SparkSession, d: str) -> DataFrame:
    return marts.top_counts(requests(s, d), "open_data_channel_type")


def _selected(s: SparkSession, d: str) -> DataFrame:
    rows = requests(s, d)
    boards = rows.select("community_board").where(parse_district("community_board")["district"].rlike("0[1-9]$"))
    return panel.selected(rows, marts.top_counts(rows, "complaint_type", 3), boards)


@_query
def daily_sparse(s: SparkSession, d: str) -> DataFrame:
    return panel.daily_sparse(requests(s, d))


@_query
def selected_daily(s: SparkSession, d: str) -> DataFrame:
    return panel.daily_sparse(_selected(s, d))


@_query
def dense_panel(s: SparkSession, d: str) -> DataFrame:
    return dense(s, d)


@_query
def dense_districts(s: SparkSession, d: str) -> DataFrame:
    """Board and problem counts of two years as a dense panel of districts."""
    after = F.date_add(F.lit(END), 1).cast("timestamp_ntz")
    rows = requests(s, d).where((F.col("created_date") >= F.lit(START).cast("timestamp_ntz")) & (F.col("created_date") < after))
    return panel.densify(panel.as_panel(panel.daily_sparse(rows)), START, END)


@_query
def dup_row_gate(s: SparkSession, d: str) -> DataFrame:
    return panel.duplicate_rows(table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"))


@_query
def dup_key_gate(s: SparkSession, d: str) -> DataFrame:
    return panel.duplicate_rows(table(s, d, "lineitem"), ["l_orderkey", "l_returnflag"])


@_query
def coverage_gate(s: SparkSession, d: str) -> DataFrame:
    return panel.coverage_gate(panel.daily_sparse(requests(s, d)), START, END)


@_query
def reconcile(s: SparkSession, d: str) -> DataFrame:
    return panel.reconcile(shipments(s, d), table(s, d, "lineitem"))


@_query
def observed_counts(s: SparkSession, d: str) -> DataFrame:
    """Gates of the day counts, observed in the job that writes them."""
    return panel.write_counts(requests(s, d), shared_folder(s, "counts"))


@_query
def trend_rollups(s: SparkSession, d: str) -> DataFrame:
    """All rollups of a report by one aggregate over grouping sets."""
    return panel.rollups(dense(s, d), REPORT_START, PANEL_END)


@_query
def trend_city(s: SparkSession, d: str) -> DataFrame:
    return panel.rollup(dense(s, d))


@_query
def trend_district(s: SparkSession, d: str) -> DataFrame:
    return panel.rollup(dense(s, d).where(F.col("date") >= F.lit(REPORT_START)), "district")


@_query
def trend_problem(s: SparkSession, d: str) -> DataFrame:
    return panel.rollup(dense(s, d).where(F.col("date") >= F.lit(REPORT_START)), "problem")


@_query
def map_28d(s: SparkSession, d: str) -> DataFrame:
    return panel.district_totals(dense(s, d), PANEL_END)


@_query
def eligible_series(s: SparkSession, d: str) -> DataFrame:
    return panel.eligible_series(dense(s, d), 70, 1.0)


@_query
def official_dim(s: SparkSession, d: str) -> DataFrame:
    """Districts of all boards, and whether they are official; with the official list itself."""
    seen = requests(s, d).select(parse_district("community_board")["district"].alias("district")).distinct()
    listed = s.createDataFrame([(f"{b} {k:02d}",) for b, n in DISTRICTS.items() for k in range(1, n + 2)], "district string")
    return seen.union(listed).distinct().select("district", borough_of(F.col("district")).alias("borough"), is_official(F.col("district")).alias("official"))


@_query
def dimensions(s: SparkSession, d: str) -> DataFrame:
    rows = requests(s, d).select(F.col("agency").alias("agencies"), F.col("complaint_type").alias("problems"), F.trim("open_data_channel_type").alias("channels"), parse_district("community_board")["district"].alias("districts"))
    sets = rows.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in rows.columns])
    return sets.select(*[F.array_join(c, "|").alias(c) for c in rows.columns])


# -- functions


@_query
def parse_district_boards(s: SparkSession, d: str) -> DataFrame:
    odd = s.createDataFrame([(" 05 brooklyn ",), ("Unspecified BRONX",), ("0 Unspecified",), ("QUEENS",), ("7  STATEN ISLAND",), ("012 QUEENS",), ("A1 BRONX",)], "community_board string")
    boards = requests(s, d).select("community_board").distinct().union(odd)
    return boards.select("community_board", parse_district("community_board").alias("x")).select("community_board", "x.district", "x.borough")


@_query
def signal_ids(s: SparkSession, d: str) -> DataFrame:
    return dense(s, d).select("date", *SERIES, signal_id(F.lit("volume_surge"), F.col("district"), F.col("problem"), F.col("date")).alias("id"))


@_query
def strip_text(s: SparkSession, d: str) -> DataFrame:
    return requests(s, d).select("unique_key", strip(F.concat(F.lit(" \t"), "agency_name", F.lit("\n "))).alias("agency_name"), strip("descriptor").alias("descriptor"))


# -- history, detectors


@_query
def robust_baseline(s: SparkSession, d: str) -> DataFrame:
    return features.robust_history(features.prepared(dense(s, d)), 8).select("date", *SERIES, "observed", "expected", "scale")


@_query
def nb_baseline(s: SparkSession, d: str) -> DataFrame:
    rows = features.count_history(features.prepared(dense(s, d)))
    return rows.select("date", *SERIES, "past_n", *[F.round(c, 6).alias(c) for c in ("expected", "alpha", "scale")], "past_median")


@_query
def trend_baseline(s: SparkSession, d: str) -> DataFrame:
    return features.display_baseline(dense(s, d))


@_query
def trend_long(s: SparkSession, d: str) -> DataFrame:
    """Observed and baseline as rows of their own, without missing values."""
    wide = features.display_baseline(dense(s, d)).withColumn("observed", F.col("observed").cast("double"))
    return wide.unpivot(["date", *SERIES], ["observed", "baseline"], "kind", "value").where(F.col("value").isNotNull())


def _rounded(alerts: DataFrame) -> DataFrame:
    return alerts.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in alerts.dtypes])


@_query
def robust_alerts(s: SparkSession, d: str) -> DataFrame:
    return _rounded(detectors.detect(dense(s, d), ROBUST))


@_query
def robust_as_of(s: SparkSession, d: str) -> DataFrame:
    return _rounded(detectors.detect(dense(s, d), ROBUST, AS_OF))


@_query
def nb_alerts(s: SparkSession, d: str) -> DataFrame:
    return _rounded(detectors.detect(dense(s, d), COUNTS))


@_query
def nb_spike_alerts(s: SparkSession, d: str) -> DataFrame:
    return _rounded(detectors.detect(dense(s, d), SPIKES))


@_query
def shift_alerts(s: SparkSession, d: str) -> DataFrame:
    return _rounded(detectors.detect_shifts(dense(s, d), SHIFTS))


@_query
def hybrid_alerts(s: SparkSession, d: str) -> DataFrame:
    return _rounded(detectors.detect(dense(s, d), SHIFTS))


# -- episodes, ranking, views


def _episodes(s: SparkSession, d: str) -> DataFrame:
    return episodes.merge_episodes(detectors.detect(dense(s, d), ROBUST))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return episodes.rank_episodes(_episodes(s, d))


@_query
def merged_episodes(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_episodes(s, d))


@_query
def ranked_signals(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_ranked(s, d))


@_query
def top_signals(s: SparkSession, d: str) -> DataFrame:
    return _rounded(episodes.top_ranked(_ranked(s, d), 24)).select("place", "id", "date", *SERIES, "priority_score", "severity")


@_query
def recent_candidates(s: SparkSession, d: str) -> DataFrame:
    return _rounded(episodes.recent_candidates(_episodes(s, d), PANEL_END, 200, 40, 80))


@_query
def summary(s: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(s, d)
    return ranked.agg(F.count("*").alias("signals"), F.count_if(F.col("severity") == "high").alias("high_signals"), F.countDistinct("district").alias("districts"))


@_query
def signal_trends(s: SparkSession, d: str) -> DataFrame:
    return ranked_views.signal_trends(episodes.top_ranked(_ranked(s, d), 24), features.display_baseline(dense(s, d)), 180)


@_query
def trend_lookup(s: SparkSession, d: str) -> DataFrame:
    """The trend of the best ranked signal of one series."""
    top = episodes.top_ranked(_ranked(s, d), 24)
    found = top.where((F.col("district") == "R") & (F.col("problem") == "F")).orderBy("place").limit(1)
    return ranked_views.signal_trends(found, features.display_baseline(dense(s, d)), 180)


@_query
def trend_range(s: SparkSession, d: str) -> DataFrame:
    return ranked_views.between(panel.rollup(dense(s, d), "district").where(F.col("district") == "A"), date(1998, 1, 1), date(1998, 3, 31))


@_query
def map_severity(s: SparkSession, d: str) -> DataFrame:
    return ranked_views.map_rows(panel.district_totals(dense(s, d), PANEL_END), episodes.top_ranked(_ranked(s, d), 2))


@_query
def signals_filtered(s: SparkSession, d: str) -> DataFrame:
    rows = ranked_views.filtered(_ranked(s, d).withColumn("agency", F.lit(None).cast("string")), {"district": "r", "severity": "WATCH", "agency": "none", "problem": ""})
    return _rounded(ranked_views.page(rows, 20, 5)).select("id", "date", *SERIES, "priority_score", "severity")


@_query
def signal_detail(s: SparkSession, d: str) -> DataFrame:
    rows = _ranked(s, d)
    return _rounded(rows.where(F.col("id") == signal_id(F.lit("volume_surge"), F.lit("R"), F.lit("F"), F.lit("1995-03-20"))).limit(1))


@_query
def district_options(s: SparkSession, d: str) -> DataFrame:
    names = requests(s, d).select(parse_district("community_board")["district"].alias("district")).distinct()
    return names.where(F.col("district").startswith("A"))


# -- evaluation


@_query
def episode_match(s: SparkSession, d: str) -> DataFrame:
    rows = dense(s, d)
    return episodes.match_events(_episodes(s, d), labelled_events(rows)).select("event_id", *SERIES, "scenario", "matched", "delay_days")


def _matched(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = _episodes(s, d)
    return episodes.match_events(found, labelled_events(dense(s, d))), found


@_query
def scenario_recall(s: SparkSession, d: str) -> DataFrame:
    return metrics.scenario_recall(_matched(s, d)[0])


@_query
def episode_metrics(s: SparkSession, d: str) -> DataFrame:
    matched, found = _matched(s, d)
    return _rounded(metrics.episode_metrics(matched, found, PANEL_START, PANEL_END))


@_query
def by_series_counts(s: SparkSession, d: str) -> DataFrame:
    return metrics.counts_by_series(*_matched(s, d))


@_query
def control_fp_rate(s: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.control_rate(_episodes(s, d), dense(s, d)))


@_query
def gate_eval(s: SparkSession, d: str) -> DataFrame:
    matched, found = _matched(s, d)
    weakest = metrics.scenario_recall(matched).agg(F.min("recall").alias("weakest"))
    return metrics.gates(metrics.episode_metrics(matched, found, PANEL_START, PANEL_END), weakest)


@_query
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap_by_hash(metrics.counts_by_series(*_matched(s, d)))


def _closures(s: SparkSession, d: str) -> DataFrame:
    rows = _fct(s, d).where(~(F.col("resolution_days") < 0) | ~F.col("is_closed"))
    age = F.datediff(F.lit(date(2003, 1, 1)), F.col("created_date")).cast("double")
    return rows.select("agency", F.when(F.col("is_closed"), F.col("resolution_days")).otherwise(age).alias("duration"), F.col("is_closed").alias("event"))


@_query
def km_closure(s: SparkSession, d: str) -> DataFrame:
    return survival.closure_probability(_closures(s, d), 400.0, ["agency"])


@_query
def km_closure_all(s: SparkSession, d: str) -> DataFrame:
    """The same over all agencies at once."""
    return survival.closure_probability(_closures(s, d), 400.0)


@_query
def series_template(s: SparkSession, d: str) -> DataFrame:
    return synthetic.series_templates(dense(s, d), 5.0).select(*SERIES, F.round("level", 6).alias("level"), F.round("alpha", 6).alias("alpha"), *[F.col("weekday_level")[k].alias(f"day_{k}") for k in range(7)])


@_query
def winsorize(s: SparkSession, d: str) -> DataFrame:
    return _rounded(synthetic.clipped(dense(s, d)).select("date", *SERIES, "low", "high", "clipped"))


@_query
def quiet_offsets(s: SparkSession, d: str) -> DataFrame:
    return synthetic.quiet_days(dense(s, d), synthetic.series_templates(dense(s, d), 5.0)).select("date", *SERIES)


@_query
def strata_plan(s: SparkSession, d: str) -> DataFrame:
    return synthetic.strata(panel.eligible_series(dense(s, d), 70, 1.0).select(*SERIES), 60)


@_query
def synthetic_panel(s: SparkSession, d: str) -> DataFrame:
    rows, _ = synthetic.make_panel(dense(s, d), seed=311, events=60, min_median=1.0)
    return rows


@_query
def candidate_backtest(s: SparkSession, d: str) -> DataFrame:
    return backtest.candidate_rows(dense(s, d), seed=311, events=60, min_median=1.0)


@_query
def injected_effects(s: SparkSession, d: str) -> DataFrame:
    """Labelled events put into the panel, each scenario with its middle strength."""
    rows = dense(s, d)
    strength = F.when(F.col("scenario") == "spike", 3.5).when(F.col("scenario") == "level_shift", 2.0).otherwise(2.25)
    return _rounded(synthetic.with_effects(rows, synthetic.series_templates(rows, 5.0), labelled_events(rows).withColumn("strength", strength)))


@_query
def candidate_choice(s: SparkSession, d: str) -> DataFrame:
    """Nations stand for candidates: the best of those that meet the gates."""
    k = F.col("n_nationkey")
    rows = table(s, d, "nation").select(
        k.cast("long").alias("place"), "n_name", (0.7 + (k * 7 % 25) / 80.0).alias("f1"), (k * 3 % 8).cast("double").alias("false_alerts_per_week"),
        (k % 4).cast("double").alias("median_detection_delay_days"), (0.5 + (k % 10) / 20.0).alias("weakest"), (k % 3).cast("long").alias("complexity"),
    )
    return backtest.choose_row(rows, Gates()).select("place", "n_name", "passes")


# -- published sections


def _published(s: SparkSession, d: str) -> sections.Sections:
    """All sections of the test tables, published as tables."""
    rows, path = dense(s, d), shared_folder(s, "sections")
    best = settled(episodes.top_ranked(_ranked(s, d), 24))
    windows = Windows(start=START, end=PANEL_END, report_start=REPORT_START)
    sections.publish_sections(sections.build_sections(requests(s, d), rows, best, ROBUST, windows), path)
    return sections.Sections(s, path)


@_query
def served_signals(s: SparkSession, d: str) -> DataFrame:
    found = _published(s, d).signals(20, 1, district="r", severity="WATCH", agency="None", problem="")
    return found.select("id", "place", *SERIES, "borough", "as_of", "severity", "title")


@_query
def served_signal(s: SparkSession, d: str) -> DataFrame:
    """The best signal, looked up by its id; no row where the tables have no signals."""
    version = _published(s, d)
    best = version.signals(1).first()
    return (version.signal(best["id"]) if best else version.signals(1)).select("id", "type", *SERIES, "as_of", "persistence", "episode_start", "episode_end", F.size("evidence").alias("evidence"))


@_query
def served_trends(s: SparkSession, d: str) -> DataFrame:
    return _published(s, d).trends(district="A", start=date(2001, 9, 1), end=date(2001, 10, 15))


@_query
def served_signal_trend(s: SparkSession, d: str) -> DataFrame:
    """The trend of the best signal of the best signal's series; no row where the tables have no signals."""
    version = _published(s, d)
    best = version.signals(1).first()
    if best:
        return version.trends(district=best["district"], problem=best["problem"])
    return version.tables["trends"].where("kind = 'signal'").select("date", "observed", "baseline")


@_query
def served_map(s: SparkSession, d: str) -> DataFrame:
    return _published(s, d).map_values("severity")


@_query
def served_dimensions(s: SparkSession, d: str) -> DataFrame:
    return _published(s, d).dimensions()


@_query
def served_facts(s: SparkSession, d: str) -> DataFrame:
    return _published(s, d).facts()


@_query
def served_health(s: SparkSession, d: str) -> DataFrame:
    return _published(s, d).health()


@_query
def published_manifest(s: SparkSession, d: str) -> DataFrame:
    return _published(s, d).manifest.select("section", "rows")


# -- files


@_query
def csv_export(s: SparkSession, d: str) -> DataFrame:
    """Suppliers exported with every value quoted, and read back."""
    out = shared_folder(s, "csv")
    name = F.concat(F.lit('say "'), "s_name", F.lit('", again'))
    rows = table(s, d, "supplier").select("s_suppkey", name.alias("name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")).alias("nation"))
    files.export_csv(rows, out, order=["s_suppkey"])
    return s.read.option("header", True).option("escape", '"').schema("s_suppkey long, name string, nation string").csv(out)


@_query
def boundary_files(s: SparkSession, d: str) -> DataFrame:
    """A feature collection, made with the customers of each code, read behind the gate of 59 boundaries."""
    out = shared_folder(s, "boundaries")
    code = ((F.col("c_custkey") % 5 + 1) * 100 + F.col("c_custkey") % 20).cast("int")
    counts = table(s, d, "customer").groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    shapes = counts.join(F.broadcast(files.official_codes(s)), "code", "full")  # 59 rows
    properties = F.struct(F.col("code").cast("string").alias("boro_cd"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.coalesce("n", F.lit(0)).alias("customers")).alias("geometry"))
    document = shapes.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    document.write.text(out)
    return files.read_boundaries(s, out).select("code", "district", F.get_json_object("geometry", "$.customers").cast("long").alias("customers"))


@_query
def label_files(s: SparkSession, d: str) -> DataFrame:
    """Labels of all orders written as one JSON list and read back: cases and evidence by label."""
    out = shared_folder(s, "labels")
    label = F.element_at(F.array(*[F.lit(x) for x in review.LABELS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    evidence = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    row = F.struct(F.col("o_orderkey").cast("string").alias("case_id"), label.alias("label"), evidence.alias("external_evidence"))
    table(s, d, "orders").groupBy((F.col("o_orderkey") % 16).alias("part")).agg(F.to_json(F.collect_list(row)).alias("value")).write.partitionBy("part").text(out)
    return files.read_labels(s, out).groupBy("label").agg(F.countDistinct("case_id").alias("cases"), F.sum(F.size("external_evidence")).alias("evidence"))


@_query
def configured_alerts(s: SparkSession, d: str) -> DataFrame:
    """Alerts of three registered settings with the name and plainness that each one's setting has."""
    settings = [ROBUST, COUNTS, SHIFTS]
    known = s.createDataFrame([(t.detector, backtest.configuration_name(t), backtest.COMPLEXITY[t.detector]) for t in settings], "detector string, configuration string, complexity int")
    every = [detectors.detect(dense(s, d), t).select("detector", *SERIES) for t in settings]
    alerts = every[0].unionByName(every[1]).unionByName(every[2])
    return alerts.join(F.broadcast(known), "detector").groupBy("configuration", "complexity").agg(F.count("*").alias("alerts"))  # three rows


# -- the service, drift


@_query
def service_filtered(s: SparkSession, d: str) -> DataFrame:
    """Requests of a service (answered from the orders): what it can filter it does, the rest is Spark's."""
    rows = rest.read_api(s, TableService(f"{d}/orders.parquet"), ["unique_key", "created_date", "complaint_type", "descriptor"], page_size=20_000)
    when = F.col("created_date") >= F.lit(START).cast("timestamp_ntz")
    kept = rows.where(when & F.col("complaint_type").isin("1-URGENT", "5-LOW") & F.col("descriptor").isNotNull() & (F.length("descriptor") > 2))
    return kept.select("unique_key", "created_date", "complaint_type", "descriptor")


@_query
def service_parts(s: SparkSession, d: str) -> DataFrame:
    """The same service read as a stream of pages and committed part by part: committed requests by kind."""
    out = shared_folder(s, "parts")
    s.dataSource.register(rest.source(TableService(f"{d}/orders.parquet"), "requests_pages"))
    query = parts.stream_parts(s.readStream.format("requests_pages").option("page_size", 40_000).option("batch_pages", 64).load(), out, f"{out}-checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return parts.read_parts(s, out, REQUEST).groupBy("complaint_type", "status").agg(F.count("*").alias("requests"), F.countDistinct("unique_key").alias("keys"))


@_query
def service_cached(s: SparkSession, d: str) -> DataFrame:
    """Day counts that the service groups, asked for once and kept; read twice from what was kept."""
    params = {"$select": "created_date::DATE as day,community_board,count(*) as requests", "$group": "day,community_board", "$order": "day,community_board"}
    folder, service = shared_folder(s, "answers"), TableService(f"{d}/orders.parquet")
    for _ in range(2):
        rows = rest.cached_query(s, service, params, folder, "day date, community_board string, requests string", d)
    return rows.withColumn("requests", F.col("requests").cast("long"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Orders as raw JSON lines, some with a new field, a status that is a number, or cut off."""
    key = F.col("o_orderkey")
    record = F.struct(
        key.cast("string").alias("unique_key"), F.col("o_orderdate").cast("string").alias("created_date"),
        F.when(key % 3 > 0, F.col("o_orderpriority")).alias("complaint_type"), F.when(key % 10 == 0, key).alias("sla_days"),
    )
    status = F.when(key % 25 == 0, F.concat(F.lit(',"status":'), (key % 4).cast("string"))).otherwise(F.concat(F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"')))
    text = F.to_json(record)
    whole = F.concat(F.substr(text, F.lit(1), F.length(text) - 1), status, F.lit("}"))
    return table(s, d, "orders").select(F.when(key % 50 == 1, F.substr(whole, F.lit(1), F.lit(30))).otherwise(whole).alias("value"))


@_query
def schema_drift(s: SparkSession, d: str) -> DataFrame:
    return drift.field_kinds(_lines(s, d))


@_query
def status_drift(s: SparkSession, d: str) -> DataFrame:
    return drift.unseen_values(requests(s, d), "status", ["o", "F"])


@_query
def column_difference(s: SparkSession, d: str) -> DataFrame:
    """Columns that tables lack of a panel's, by the guard's own rule."""
    found = [(name, c) for name in ("orders", "lineitem", "events") for c in panel.missing(table(s, d, name), ["l_orderkey", "o_orderkey", "event_id"])]
    return s.createDataFrame(found, "table_name string, missing string")


# -- boundaries, hashes


@_query
def district_codes(s: SparkSession, d: str) -> DataFrame:
    """Customers by the district that their keys give as a boundary code; codes that are not official have none."""
    code = (F.col("c_custkey") % 6 + 1) * 100 + F.col("c_custkey") % 23
    known = table(s, d, "customer").select(code.cast("int").alias("code")).join(F.broadcast(files.official_codes(s)), "code", "left")  # 59 rows
    return known.groupBy("code", "district").agg(F.count("*").alias("customers"))


@_query
def boundary_map(s: SparkSession, d: str) -> DataFrame:
    """Boundaries with the customers of each district, whose codes come from their keys; some codes are not official."""
    code = (F.col("c_custkey") % 5 + 1) * 100 + F.col("c_custkey") % 20
    counts = table(s, d, "customer").groupBy(district_of_code(code).alias("district")).agg(F.count("*").alias("requests"))
    shapes = files.official_codes(s).withColumn("geometry", F.concat(F.lit("g"), F.col("code").cast("string")))
    return files.join_boundaries(shapes, counts.withColumn("severity", F.when(F.col("requests") % 2 == 0, "watch").otherwise("high")))


@_query
def canonical_hashes(s: SparkSession, d: str) -> DataFrame:
    row = {"name": F.col("n_name"), "key": F.col("n_nationkey"), "comment": F.lit(None).cast("string"), "area": F.struct(F.col("n_regionkey").alias("region"))}
    return table(s, d, "nation").select("n_nationkey", canonical_hash(row).alias("sha256"))


# -- streams: each reads what a stream of files has now, and stops


def _streamed(s: SparkSession, source: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stream over the Parquet files of source has put out when it has read all of them."""
    # A pattern, as a stream's path must be a folder or a pattern, and source may be one file.
    rows = change(s.readStream.schema(s.read.parquet(source).schema).parquet(f"{source[:-1]}[{source[-1]}]"))
    out = shared_folder(s, "stream")
    rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return s.read.schema(rows.schema).parquet(out)


@_query
def stream_daily_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts of the days that the watermark has closed."""
    names = {"o_orderdate": "created_date", "o_orderstatus": "community_board", "o_orderpriority": "complaint_type"}
    return _streamed(s, f"{d}/orders.parquet", lambda rows: ingest.daily_counts(rows.withColumnsRenamed(names)))


@_query
def stream_deduplicated(s: SparkSession, d: str) -> DataFrame:
    names = {"l_shipdate": "created_date", "l_orderkey": "unique_key"}
    return _streamed(s, f"{d}/lineitem.parquet", lambda rows: ingest.deduplicated(rows.withColumnsRenamed(names))).select("unique_key")


@_query
def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    """Episodes of a stream of alerts that the watermark has closed."""
    source = shared_folder(s, "alerts")
    detectors.detect(dense(s, d), ROBUST).write.parquet(source)
    return _rounded(_streamed(s, source, ingest.episode_sessions))


@_query
def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    """Requests written as JSON lines and ingested as a stream: how many were kept, and why the others were not."""
    source, out = shared_folder(s, "requests"), shared_folder(s, "ingested")
    files.write_requests(requests(s, d), source)
    ingest.ingest(files.stream_requests(s, source), out, f"{out}-checkpoint").awaitTermination()
    kept = s.read.schema(", ".join(f"{c} string" for c in SAFE_FIELDS)).json(f"{out}/valid/*").agg(F.lit("kept").alias("outcome"), F.count("*").alias("requests"))
    bad = s.read.schema("broken_rules array<string>").json(f"{out}/quarantine/*").groupBy(F.array_join("broken_rules", ",").alias("outcome")).agg(F.count("*").alias("requests"))
    return kept.union(bad)


@_query
def replayed_episodes(s: SparkSession, d: str) -> DataFrame:
    """What was known at the end of each day of a year."""
    return _rounded(ingest.replay(dense(s, d), ROBUST, [AS_OF - timedelta(days=k) for k in range(365)]))


# -- review


@_query
def control_pool(s: SparkSession, d: str) -> DataFrame:
    return review.control_pool(dense(s, d), detectors.detect(dense(s, d), ROBUST), date(2001, 3, 14))


@_query
def review_points(s: SparkSession, d: str) -> DataFrame:
    cases = episodes.top_ranked(_ranked(s, d), 20).select("id", *SERIES, F.col("date").alias("index_date"))
    return review.case_points(cases, dense(s, d)).select("id", *SERIES, "index_date", "date", "observed")


@_query
def review_cases(s: SparkSession, d: str) -> DataFrame:
    cases = episodes.top_ranked(_ranked(s, d), 40)
    named = cases.select(*SERIES, F.col("date").alias("index_date"), F.when(F.col("place") <= 20, "top20").otherwise("near_threshold").alias("group"))
    return review.with_case_ids(named, 311).select("case_id", "group_token", *SERIES, "index_date")


@_query
def review_score(s: SparkSession, d: str) -> DataFrame:
    """Orders stand for cases and labels: the first twenty are the top group."""
    cases = table(s, d, "orders").orderBy("o_orderkey").limit(60).select(F.col("o_orderkey").cast("string").alias("case_id"), F.when(F.row_number().over(W.orderBy("o_orderkey")) <= 20, "top").otherwise("rest").alias("group_token"))
    label = F.element_at(F.array(*[F.lit(x) for x in review.LABELS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    labels = table(s, d, "orders").orderBy("o_orderkey").limit(60).select(F.col("o_orderkey").cast("string").alias("case_id"), label.alias("label"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("external_evidence"))
    return review.score(cases, labels, "top")
