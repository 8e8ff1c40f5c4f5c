"""Order statistics of groups of any size, by ranges of values.

A group is never one task's or one buffer's: its rows are counted by value, values are gathered by ranges
of fixed width, and only ranges (with their counts) meet in the order of the group. The range that holds a
wanted place is known from the ranges before it, and its own few different values are walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histograms(df: DataFrame, keys: list[str], value: str, width: float, sums: dict[str, Column] | None = None) -> DataFrame:
    """keys, range, n, further sums, and values: (value, n, sums...) by rising value, of each range; a null value has the null range.

    Width is chosen so that a range has few different values: of durations in whole minutes, a day has 1,440.
    """
    named = {"n": F.count("*")} | (sums or {})
    per = df.groupBy(*keys, F.floor(F.col(value) / width).alias("range"), F.col(value).alias("value")).agg(*[c.alias(n) for n, c in named.items()])
    return per.groupBy(*keys, "range").agg(*[F.sum(n).alias(n) for n in named], F.sort_array(F.collect_list(F.struct("value", *named))).alias("values"))


def _at(place: Column, before: str = "before") -> Column:
    """The value at a place (from 0) of the group, where it lies in this range."""
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        here = acc["found"].isNull() & (F.col(before) + seen > place)
        return F.struct(seen.alias("seen"), F.when(here, x["value"].cast("double")).otherwise(acc["found"]).alias("found"))

    inside = (place >= F.col(before)) & (place < F.col(before) + F.col("n"))
    return F.when(inside, F.aggregate("values", zero, step)["found"])


def with_places(hist: DataFrame, keys: list[str]) -> DataFrame:
    """histograms with before (rows of lower ranges) and total (rows with a value) of the group."""
    filled = F.when(F.col("range").isNotNull(), F.col("n")).otherwise(0)
    w = W.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum(filled).over(w.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return hist.select("*", before.alias("before"), F.sum(filled).over(w).alias("total"))


def percentile_columns(points: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """Columns to add to with_places, and what then to aggregate by group: exact percentiles with linear interpolation."""
    rows, out = [], []
    for name, p in points.items():
        place = F.lit(p) * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        valued = F.col("range").isNotNull()
        rows += [F.when(valued, _at(low)).alias(f"{name} low"), F.when(valued, _at(high)).alias(f"{name} high"), F.when(valued, place - low).alias(f"{name} part")]
        least, most, part = F.max(f"{name} low"), F.max(f"{name} high"), F.max(f"{name} part")
        out.append(F.when(least == most, least).otherwise((1 - part) * least + part * most).alias(name))
    return rows, out


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], width: float = 1.0) -> DataFrame:
    """keys and, by name, exact percentiles of a numeric column; null values count for nothing (all null: null)."""
    rows, out = percentile_columns(points)
    placed = with_places(histograms(df, keys, value, width), keys).select("*", *rows)
    return placed.groupBy(*keys).agg(*out)
