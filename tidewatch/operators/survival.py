"""Probability of closure under right-censoring, by the product-limit estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import histograms


def closure_probability(observations: DataFrame, horizon: float = 7.0, by: list[str] | None = None, width: float = 1.0) -> DataFrame:
    """keys and closure_probability: the chance of an event up to horizon.

    observations(duration double, event boolean, *by): unresolved ones have event false and are
    retained as censored. Durations are counted, and gathered by ranges of `width`; only the ranges of a
    group meet in order, each with the number at risk after it, and each multiplies the factors of its own
    durations. So all observations without keys take no single task either.
    """
    keys = by or []
    hist = histograms(observations, keys, "duration", width, {"closed": F.count_if("event")})
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    later = hist.where(F.col("range").isNotNull()).withColumn("later", F.coalesce(F.sum("n").over(w), F.lit(0)))
    zero = F.struct(F.col("later").alias("at_risk"), F.lit(1.0).alias("stays"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        at_risk = acc["at_risk"] + x["n"]
        stays = F.when(x["value"] <= horizon, 1.0 - x["closed"] / at_risk).otherwise(1.0)
        return F.struct(at_risk.alias("at_risk"), (acc["stays"] * stays).alias("stays"))

    factor = F.aggregate(F.reverse("values"), zero, step)["stays"]
    return later.groupBy(*keys).agg(F.round(1.0 - F.product(factor), 6).alias("closure_probability"))


def checked(observations: DataFrame) -> DataFrame:
    """observations, after one pass that fails on none or on a null or negative duration."""
    row = observations.agg(F.count("*").alias("n"), F.count_if(F.col("duration").isNull() | F.col("event").isNull()).alias("nulls"), F.count_if(F.col("duration") < 0).alias("negative")).first()
    if not row["n"]:
        raise ValueError("there are no observations")
    if row["nulls"]:
        raise ValueError("every observation needs a duration and whether it is closed")
    if row["negative"]:
        raise ValueError("a duration is below zero")
    return observations
