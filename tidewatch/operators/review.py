"""Blind review: controls, cases, packets and scores."""

from __future__ import annotations

import hashlib
import json
from datetime import date

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GateError
from ..schemas import SERIES, Gates
from .episodes import top_ranked
from .panel import numbered_series

#: Labels of reviewers; the first two are positive.
LABELS = ["clear_anomaly", "plausible_anomaly", "unsupported", "uncertain"]
POSITIVE = LABELS[:2]
#: Cases of each group, and days that a case shows.
GROUP_CASES = 20
CASE_DAYS = 42


def control_pool(panel: DataFrame, alerts: DataFrame, day: date) -> DataFrame:
    """Series without an alert on a day, with that day's count."""
    there = panel.where(F.col("date") == F.lit(day)).select(*SERIES, "date", F.col("requests").alias("observed"))
    return there.join(alerts.select(*SERIES, "date").distinct(), [*SERIES, "date"], "left_anti")


def case_points(cases: DataFrame, panel: DataFrame) -> DataFrame:
    """Cases with each day of their series from 41 days before index_date to it."""
    series = panel.select(*SERIES, "date", F.col("requests").alias("observed"))
    inside = (F.col("date") > F.date_sub("index_date", CASE_DAYS)) & (F.col("date") <= F.col("index_date"))
    return cases.join(series, SERIES).where(inside)


def with_case_ids(cases: DataFrame, seed: int) -> DataFrame:
    """Adds case_id and the token of the case's group."""
    identity = F.concat_ws("|", F.lit(str(seed)), "group", *SERIES, F.col("index_date").cast("string"))
    token = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "group"), 256), 1, 12)
    return cases.withColumn("case_id", F.concat(F.lit("REV-"), F.upper(F.substring(F.sha2(identity, 256), 1, 10)))).withColumn("group_token", token)


def build_packet(panel: DataFrame, ranked: DataFrame, alerts: DataFrame, day: date, seed: int = 311) -> dict:
    """Twenty top, twenty next and twenty control cases in an order that tells nothing.

    Cases are chosen in Spark; the sample of controls and the order are drawn on the driver from one
    generator, as the packet of a seed must be the same everywhere.
    """
    spark, rng = panel.sparkSession, np.random.default_rng(seed)
    top = top_ranked(ranked, 2 * GROUP_CASES).orderBy("place").select(*SERIES, "date").collect()
    chosen = [(r["district"], r["problem"], r["date"], "top20" if k < GROUP_CASES else "near_threshold") for k, r in enumerate(top)]
    pool = control_pool(panel, alerts, day).select(*SERIES, "date")
    n = pool.count()
    if n < GROUP_CASES:
        raise GateError(f"A blind review needs {GROUP_CASES} series without an alert; there are {n}")
    # Places are drawn, and only the series at these places leave Spark.
    picked = [int(k) for k in rng.choice(n, size=GROUP_CASES, replace=False)]
    controls = {r["place"]: r for r in numbered_series(pool).where(F.col("place").isin(picked)).collect()}
    chosen += [(controls[k]["district"], controls[k]["problem"], controls[k]["date"], "matched_control") for k in picked]
    if len(chosen) != 3 * GROUP_CASES:
        raise GateError(f"{len(chosen)} cases were found for a packet of {3 * GROUP_CASES}")
    given = [(k, *c) for k, c in enumerate(chosen)]
    cases = with_case_ids(spark.createDataFrame(given, "k int, district string, problem string, index_date date, `group` string"), seed)
    points = case_points(cases, panel).groupBy("k", "case_id", "group_token", *SERIES, "index_date")
    found = points.agg(F.sort_array(F.collect_list(F.struct("date", "observed"))).alias("points")).orderBy("k").collect()
    rows = [
        {"case_id": r["case_id"], "group_token": r["group_token"], "district": r["district"], "problem": r["problem"], "index_date": str(r["index_date"]), "points": [{"date": str(p["date"]), "observed": p["observed"]} for p in r["points"]], "label": None, "external_evidence": []}
        for r in found
    ]
    shuffled = [rows[int(k)] for k in rng.permutation(len(rows))]
    key = {c["case_id"]: c["group_token"] for c in shuffled}
    return {"protocol_version": "2.0.0", "seed": seed, "labels": LABELS, "cases": shuffled, "key_sha256": hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()}


def score(cases: DataFrame, labels: DataFrame, top_token: str, gates: Gates | None = None) -> DataFrame:
    """One row: positives of the top group, precision, rate of external evidence, status.

    Fails unless labels hold each case exactly once, with a known label.
    """
    want = (gates or Gates()).min_review_precision
    n = 3 * GROUP_CASES
    both = cases.select("case_id", "group_token").join(labels.withColumnRenamed("case_id", "label_id"), F.col("case_id") == F.col("label_id"), "full_outer")
    row = both.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("case_id").isNull() | F.col("label_id").isNull()).alias("apart"),
        F.count_if(~F.coalesce(F.col("label").isin(LABELS), F.lit(False))).alias("unknown"),
        F.count_if((F.col("group_token") == top_token) & F.col("label").isin(POSITIVE)).alias("top20_positive"),
        F.count_if(F.size(F.coalesce("external_evidence", F.array().cast("array<string>"))) > 0).alias("with_evidence"),
    )
    checked = row.select("*", F.when((F.col("n") != n) | (F.col("apart") > 0), F.raise_error(F.lit(f"a label is needed for every one of the {n} cases, once, and for no other"))).when(F.col("unknown") > 0, F.raise_error(F.lit(f"a case has a label other than {', '.join(sorted(LABELS))}"))).otherwise(F.lit(True)).cast("boolean").alias("ok"))
    precision = F.col("top20_positive") / float(GROUP_CASES)
    return checked.where("ok").select(F.when(precision >= want, "passed").otherwise("failed").alias("status"), F.col("n").alias("sample_size"), "top20_positive", F.round(precision, 3).alias("precision_at_20"), F.round(F.col("with_evidence") / float(n), 3).alias("externally_correlated_rate"))


def apply_review(snapshot: dict, result: dict) -> dict:
    """A new version of a snapshot with the review's result; the given one stays as it is."""
    out = json.loads(json.dumps(snapshot))
    passed = result["status"] == "passed" and out["evaluation"]["locked_test"]["passed"]
    status = "validated" if passed else "revalidation_required"
    out["evaluation"] |= {"human_review": result, "status": status}
    out["meta"] |= {"model_status": status, "readiness": status}
    out["backtest"]["status"] = status
    for signal in out["signals"]:
        signal["severity"] = "research_flag" if not passed else "high" if signal["calibrated_score"] >= 5 else "watch"
    out["summary"]["high_signals"] = sum(s["severity"] == "high" for s in out["signals"])
    return out
