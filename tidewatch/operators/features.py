"""Same-weekday history of each day of a panel, in one pass for all detectors.

Rows are first dealt by series, so that the weekday windows here and the series windows of the shift
rule need no second shuffle. Frames are bounded numbers of rows, so a series of any length costs its
length times a constant. Moments come from sums of whole numbers, which are exact in any order.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import PANEL_COLUMNS, SERIES
from .panel import require

#: Rows of history that the count detectors look back at most.
LONG_HISTORY = 26
#: Scale of the median absolute deviation for a normal distribution.
MAD_SCALE = 1.4826


def median_of(values: Column) -> Column:
    """Median of an array of doubles."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def _history(rows: int) -> W:
    return W.partitionBy(*SERIES, F.weekday("date")).orderBy("date").rowsBetween(-rows, -1)


def prepared(panel: DataFrame, as_of: date | None = None) -> DataFrame:
    """Panel rows up to as_of, dealt by series, counts as doubles; rows with a null key are left out."""
    require(panel, PANEL_COLUMNS)
    kept = panel.where(F.col("district").isNotNull() & F.col("problem").isNotNull() & F.col("date").isNotNull())
    if as_of is not None:
        kept = kept.where(F.col("date") <= F.lit(as_of))
    return kept.select("date", *SERIES, F.col("requests").cast("double").alias("observed")).repartition(*SERIES)


def robust_history(rows: DataFrame, history: int) -> DataFrame:
    """Median and scale of exactly `history` prior same-weekday rows; others get nulls."""
    w = _history(history)
    seen = rows.withColumn("past", F.collect_list("observed").over(w))
    full = F.size("past") == history
    middle = seen.withColumn("expected", F.when(full, median_of(F.col("past"))))
    spread = median_of(F.transform("past", lambda v: F.abs(v - F.col("expected"))))
    return middle.withColumn("scale", F.when(full, F.greatest(MAD_SCALE * spread, F.lit(1.0)))).drop("past")


def count_history(rows: DataFrame) -> DataFrame:
    """past_n, expected (mean), alpha, scale and past_median of up to 26 prior same-weekday rows."""
    w = _history(LONG_HISTORY)
    n, total, squares = F.count("observed").over(w), F.sum("observed").over(w), F.sum(F.col("observed") * F.col("observed")).over(w)
    seen = rows.select("*", n.alias("past_n"), total.alias("past_sum"), squares.alias("past_squares"), F.percentile("observed", F.lit(0.5)).over(w).alias("past_median"))
    return with_dispersion(seen).drop("past_sum", "past_squares")


def with_dispersion(moments: DataFrame) -> DataFrame:
    """Adds mean, over-dispersion and predictive scale to past_n, past_sum and past_squares."""
    out = moments.withColumn("expected", F.col("past_sum") / F.nullif("past_n", F.lit(0)))
    sample = (F.col("past_squares") - F.col("past_sum") * F.col("past_sum") / F.col("past_n")) / F.nullif(F.col("past_n") - 1, F.lit(0))
    spread = F.when(F.col("past_n") > 1, F.greatest(sample, F.lit(0.0))).otherwise(F.col("expected"))
    excess = (spread - F.greatest("expected", F.lit(1.0))) / F.greatest(F.col("expected") * F.col("expected"), F.lit(1.0))
    out = out.withColumn("alpha", F.when(F.col("past_n") > 0, F.least(F.greatest(excess, F.lit(0.0)), F.lit(1.0))))
    deviation = F.sqrt(F.col("expected") + F.col("alpha") * F.col("expected") * F.col("expected"))
    return out.withColumn("scale", F.when(F.col("past_n") > 0, F.greatest(deviation, F.lit(1.0))))


def display_baseline(panel: DataFrame, history: int = 8) -> DataFrame:
    """date, series, observed and baseline: the median of eight prior same-weekday rows, or null."""
    return robust_history(prepared(panel), history).select("date", *SERIES, F.col("observed").cast("long").alias("observed"), F.col("expected").alias("baseline"))
