"""Volume detectors, as conditions on the shared history features."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import signal_id
from ..schemas import SERIES, Thresholds
from .features import count_history, prepared, robust_history

ALERT_TYPE = "volume_surge"
#: Columns of an alert. Numbers are unrounded; publishing rounds them.
ALERT_COLUMNS = [
    "id", "type", "date", "district", "problem", "observed", "expected", "effect", "anomaly_score", "calibrated_score",
    "upper_bound", "excess_count", "detector", "affected_count",
]


def _alerts(rows: DataFrame, t: Thresholds, effect: Column, score: Column, upper: Column, excess: Column, affected: Column) -> DataFrame:
    kind = F.lit(ALERT_TYPE)
    return rows.select(
        signal_id(kind, F.col("district"), F.col("problem"), F.col("date")).alias("id"), kind.alias("type"), "date", *SERIES, "observed", "expected",
        effect.alias("effect"), score.alias("anomaly_score"), score.alias("calibrated_score"), upper.alias("upper_bound"), excess.alias("excess_count"),
        F.lit(t.detector).alias("detector"), affected.cast("long").alias("affected_count"),
    )


def _ratio() -> Column:
    return F.col("observed") / F.greatest("expected", F.lit(1.0))


def _large_enough(t: Thresholds) -> Column:
    return (F.col("expected") >= t.min_baseline) & (F.col("observed") - F.col("expected") >= t.min_delta) & (_ratio() >= t.min_ratio)


def robust_from(features: DataFrame, t: Thresholds) -> DataFrame:
    delta = F.col("observed") - F.col("expected")
    score = delta / F.col("scale")
    hit = features.where(_large_enough(t) & (score >= t.robust_z))
    return _alerts(hit, t, _ratio(), score, F.col("expected") + t.robust_z * F.col("scale"), delta, F.col("observed"))


def counts_from(features: DataFrame, t: Thresholds) -> DataFrame:
    delta = F.col("observed") - F.col("expected")
    upper = F.col("expected") + t.prediction_z * F.col("scale")
    above = F.col("observed") > upper
    if t.spike_ratio is not None:
        above |= (F.col("expected") >= t.spike_min_baseline) & (_ratio() >= t.spike_ratio)
    hit = features.where((F.col("past_n") >= t.history) & _large_enough(t) & above)
    return _alerts(hit, t, _ratio(), delta / F.col("scale"), upper, delta, F.col("observed"))


def shifts_from(features: DataFrame, t: Thresholds) -> DataFrame:
    """Days that end a run of shift_window rows that are all high against their medians."""
    rows = features.withColumn("base", F.when(F.col("past_n") >= t.history, F.col("past_median")))
    w = W.partitionBy(*SERIES).orderBy("date").rowsBetween(1 - t.shift_window, 0)
    least = max(1.25, t.min_ratio - 0.2)
    rows = rows.select(
        "date", *SERIES, "observed", F.col("base").alias("expected"),
        F.count("base").over(w).alias("n"), F.sum("base").over(w).alias("base_sum"), F.sum("observed").over(w).alias("observed_sum"),
        F.count_if(F.col("observed") >= F.col("base") * 1.25).over(w).alias("high_days"),
    )
    delta = F.col("observed_sum") - F.col("base_sum")
    ratio = F.col("observed_sum") / F.greatest("base_sum", F.lit(1.0))
    hit = rows.where(
        (F.col("n") == t.shift_window)
        & (F.col("base_sum") / t.shift_window >= t.min_baseline)
        & (F.col("high_days") >= max(2, t.shift_window - 1))
        & (ratio >= least)
        & (delta >= t.min_delta * t.shift_window)
    )
    return _alerts(hit, t, ratio, delta / F.greatest(F.sqrt("base_sum"), F.lit(1.0)), F.col("expected") * least, delta, F.col("observed_sum"))


def detect_robust(panel: DataFrame, t: Thresholds, as_of: date | None = None) -> DataFrame:
    """Days far above the median of exactly `history` prior same weekdays."""
    return robust_from(robust_history(prepared(panel, as_of), t.history), t)


def detect_counts(panel: DataFrame, t: Thresholds, as_of: date | None = None) -> DataFrame:
    """Days above the prediction interval of over-dispersed counts."""
    return counts_from(count_history(prepared(panel, as_of)), t)


def detect_shifts(panel: DataFrame, t: Thresholds, as_of: date | None = None) -> DataFrame:
    return shifts_from(count_history(prepared(panel, as_of)), t)


def hybrid_from(features: DataFrame, t: Thresholds) -> DataFrame:
    """Spikes and shifts; a shift takes the place of a spike on the same day of a series."""
    both = counts_from(features, t).withColumn("rank", F.lit(1)).union(shifts_from(features, t).withColumn("rank", F.lit(0)))
    best = both.groupBy(*SERIES, "date").agg(F.min_by(F.struct(*ALERT_COLUMNS), "rank").alias("x"))
    return best.select("x.*")


def detect_hybrid(panel: DataFrame, t: Thresholds, as_of: date | None = None) -> DataFrame:
    return hybrid_from(count_history(prepared(panel, as_of)), t)


#: Detectors by name; more can be registered.
DETECTORS: dict[str, Callable[..., DataFrame]] = {"robust_seasonal": detect_robust, "nb_conformal": detect_counts, "hybrid_nb_ewma": detect_hybrid}


def detect(panel: DataFrame, t: Thresholds, as_of: date | None = None) -> DataFrame:
    if t.detector not in DETECTORS:
        raise ValueError(f"Unknown detector: {t.detector}")
    return DETECTORS[t.detector](panel, t, as_of)
