"""Views of ranked signals: trends, map rows, filters and pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import borough_of
from ..schemas import SERIES
from .episodes import priority_order


def last_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The latest n rows of each key by date."""
    w = W.partitionBy(*keys).orderBy(F.desc("date"))
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def signal_trends(signals: DataFrame, baselines: DataFrame, points: int = 180) -> DataFrame:
    """id, date, observed and baseline of the last points of each signal's series."""
    ids = signals.select("id", *SERIES)
    series = baselines.join(ids.select(*SERIES).distinct(), SERIES, "left_semi")
    return last_rows(series, SERIES, points).join(ids, SERIES).select("id", "date", "observed", "baseline")


def map_rows(totals: DataFrame, ranked: DataFrame) -> DataFrame:
    """Totals of districts with the severity of each one's best ranked signal, or `normal`."""
    best = ranked.groupBy("district").agg(F.min_by("severity", "place").alias("severity"))
    return totals.join(best, "district", "left").select("district", borough_of(F.col("district")).alias("borough"), "requests", F.coalesce("severity", F.lit("normal")).alias("severity"))


def filtered(signals: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """Rows whose columns equal the given values in any case; empty values don't filter, a null reads `None`."""
    for column, value in filters.items():
        if value:
            signals = signals.where(F.lower(F.coalesce(F.col(column).cast("string"), F.lit("None"))) == value.lower())
    return signals


def page(ranked: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit by priority."""
    return ranked.orderBy(*priority_order()).offset(offset).limit(limit)


def between(points: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    if start is not None:
        points = points.where(F.col("date") >= F.lit(start))
    if end is not None:
        points = points.where(F.col("date") <= F.lit(end))
    return points
