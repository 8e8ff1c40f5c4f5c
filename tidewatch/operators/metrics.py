"""Scores of detectors on labelled events, release gates and bootstrap intervals."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import NORMAL_SERIES, SERIES, Gates
from .panel import numbered_series


def _precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision = tp / F.greatest(tp + fp, F.lit(1))
    recall = tp / F.greatest(tp + fn, F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def episode_metrics(matched: DataFrame, episodes: DataFrame, start: date, end: date) -> DataFrame:
    """One row: counts, precision, recall, F1, false episodes a week (normalised), median delay."""
    events = matched.agg(F.count("*").alias("events"), F.count("matched").alias("true_positive"), F.coalesce(F.percentile("delay_days", F.lit(0.5)), F.lit(0.0)).alias("median_detection_delay_days"), F.countDistinct(*SERIES).alias("series"))
    found = episodes.agg(F.count("*").alias("episodes"))
    # One row each; the constant key keeps this an equi-join.
    one = events.withColumn("k", F.lit(1)).join(found.withColumn("k", F.lit(1)), "k").drop("k")
    weeks = max((end - start).days / 7, 1)
    one = one.withColumn("false_positive", F.col("episodes") - F.col("true_positive")).withColumn("false_negative", F.col("events") - F.col("true_positive"))
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    rate = fp / F.greatest(F.greatest("series", F.lit(1)) * weeks, F.lit(1)) * NORMAL_SERIES
    return one.select(*_precision_recall(tp, fp, fn), rate.alias("false_alerts_per_week"), "median_detection_delay_days", tp, fp, fn)


def scenario_recall(matched: DataFrame) -> DataFrame:
    return matched.groupBy("scenario").agg((F.count("matched") / F.count("*")).alias("recall"))


def control_rate(episodes: DataFrame, control: DataFrame) -> DataFrame:
    """One row: false episodes a week on a panel without events, normalised."""
    panel = control.agg(F.countDistinct(*SERIES).alias("series"), F.datediff(F.max("date"), F.min("date")).alias("days")).withColumn("k", F.lit(1))
    found = episodes.agg(F.count("*").alias("episodes")).withColumn("k", F.lit(1))
    weeks = F.greatest(F.col("days") / 7, F.lit(1.0))
    rate = F.col("episodes") / (F.greatest("series", F.lit(1)) * weeks) * NORMAL_SERIES
    return panel.join(found, "k").select("episodes", "series", rate.alias("false_alerts_per_week"))


def counts_by_series(matched: DataFrame, episodes: DataFrame) -> DataFrame:
    """True and false positives and false negatives of each series with events."""
    own = matched.groupBy(*SERIES).agg(F.count("*").alias("events"), F.count("matched").alias("tp"))
    found = episodes.groupBy(*SERIES).agg(F.count("*").alias("episodes"))
    out = own.join(found, SERIES, "left")
    return out.select(*SERIES, "tp", (F.coalesce("episodes", F.lit(0)) - F.col("tp")).alias("fp"), (F.col("events") - F.col("tp")).alias("fn"))


def bootstrap_intervals(by_series: DataFrame, seed: int = 311, draws: int = 500) -> dict[str, list[float]]:
    """2.5 and 97.5 percent bounds of precision, recall and F1 over draws of series.

    The counts of evaluation series (1,200 in the published protocol) are drawn on the driver, as
    the protocol's results depend on one sequence of random numbers.
    """
    rows = np.array([r[:] for r in by_series.orderBy(*SERIES).select("tp", "fp", "fn").collect()], float).reshape(-1, 3)
    if not len(rows):
        return {m: [0.0, 0.0] for m in ("precision", "recall", "f1")}
    rng = np.random.default_rng(seed)
    sums = np.stack([rows[rng.integers(0, len(rows), len(rows))].sum(axis=0) for _ in range(draws)])
    tp, fp, fn = sums.T
    precision, recall = tp / np.maximum(tp + fp, 1), tp / np.maximum(tp + fn, 1)
    f1 = 2 * precision * recall / np.maximum(precision + recall, 1e-12)
    return {name: [round(float(q), 3) for q in np.quantile(v, [0.025, 0.975])] for name, v in (("precision", precision), ("recall", recall), ("f1", f1))}


def bootstrap_by_hash(by_series: DataFrame, seed: int = 311, draws: int = 500) -> DataFrame:
    """metric, low and high: 2.5 and 97.5 percent bounds over draws of series, made in Spark.

    Each draw takes as many series as there are, the k-th one by a hash of seed, draw and k; draws are
    joined to series by place and summed, so only the sums of the draws meet. Without series all is 0.
    """
    spark = by_series.sparkSession
    placed = numbered_series(by_series)
    n = placed.count()
    name = F.concat_ws("|", F.lit(seed), "draw", "k")
    picked = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("k"))
    picked = picked.select("draw", (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") % max(n, 1)).cast("int").alias("place"))
    sums = picked.join(placed, "place").groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    shares = sums.select(*_precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))).unpivot([], ["precision", "recall", "f1"], "metric", "value")
    # So many values a metric as there are draws.
    bounds = shares.groupBy("metric").agg(*[F.round(F.percentile("value", F.lit(p)), 3).alias(c) for c, p in (("low", 0.025), ("high", 0.975))])
    every = spark.createDataFrame([(m,) for m in ("precision", "recall", "f1")], "metric string")
    return every.join(bounds, "metric", "left").select("metric", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("low", "high")])


def gates(metrics: DataFrame, weakest_recall: DataFrame, bounds: Gates | None = None) -> DataFrame:
    """One row: whether each gate holds, and all of them. weakest_recall has one row with `weakest`."""
    g = bounds or Gates()
    one = metrics.withColumn("k", F.lit(1)).join(weakest_recall.select(F.coalesce("weakest", F.lit(0.0)).alias("weakest")).withColumn("k", F.lit(1)), "k")
    checks = {
        "f1_ok": F.col("f1") >= g.min_f1,
        "false_ok": F.col("false_alerts_per_week") <= g.max_false_per_week,
        "delay_ok": F.col("median_detection_delay_days") <= g.max_delay_days,
        "scenario_ok": F.col("weakest") >= g.min_scenario_recall,
    }
    every = checks["f1_ok"] & checks["false_ok"] & checks["delay_ok"] & checks["scenario_ok"]
    return one.select(*[c.alias(n) for n, c in checks.items()], every.alias("passed"))
