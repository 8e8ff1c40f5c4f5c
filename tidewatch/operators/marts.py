"""From requests to the fact table and its marts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import minutes_between
from . import ranges, refresh

DIMENSIONS = ["community_district", "borough", "agency", "problem"]


def staging(requests: DataFrame) -> DataFrame:
    """Renamed and normalised columns of requests."""

    def upper(c: str) -> F.Column:
        return F.upper(F.trim(c))

    return requests.select(
        F.col("unique_key").cast("string").alias("request_id"),
        F.col("created_date").cast("timestamp_ntz").alias("created_at_local"),
        F.col("closed_date").cast("timestamp_ntz").alias("closed_at_local"),
        upper("agency").alias("agency"),
        F.trim("agency_name").alias("agency_name"),
        F.trim("complaint_type").alias("problem"),
        F.nullif(F.trim("descriptor"), F.lit("")).alias("problem_detail"),
        upper("status").alias("status"),
        upper("borough").alias("borough"),
        upper("community_board").alias("community_district"),
        upper("open_data_channel_type").alias("channel"),
    )


def materialise(requests: DataFrame, as_of: date, database: str = "default") -> dict[str, DataFrame]:
    """Staging as a temporary view, facts and marts as tables of the session's warehouse; each is read back by name.

    Tables are replaced. Marts are made from the stored facts, so these are computed once.
    """
    spark = requests.sparkSession
    staging(requests).createOrReplaceTempView("stg_requests")
    out = {"stg_requests": spark.table("stg_requests")}

    def keep(name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").saveAsTable(f"{database}.{name}")
        out[name] = spark.table(f"{database}.{name}")

    keep("fct_requests", facts(out["stg_requests"]))
    fct = out["fct_requests"]
    for name, rows in (("mart_daily_metrics", daily_metrics(fct)), ("mart_closure_cohorts", closure_cohorts(fct)), ("mart_open_age", open_age(fct, as_of)), ("mart_quality", quality(fct))):
        keep(name, rows)
    return out


def refresh_marts(requests: DataFrame, path: str) -> None:
    """Replaces the months of these requests in the tables path/fct_requests and path/mart_daily_metrics, by month of creation.

    Requests must be all of their months. The mart is made from the stored facts of those months alone.
    """
    spark = requests.sparkSession
    refresh.refresh(facts(staging(requests)), f"{path}/fct_requests", refresh.month_of("created_date"))
    months = requests.select(F.coalesce(refresh.month_of("created_date"), F.lit(refresh.NO_PART))).distinct()
    changed = [r[0] for r in months.collect()]
    stored = refresh.read_refreshed(spark, f"{path}/fct_requests").where(F.col("part").isin(changed))
    refresh.refresh(daily_metrics(stored), f"{path}/mart_daily_metrics", refresh.month_of("metric_date"))


def facts(staged: DataFrame) -> DataFrame:
    """Staging with dates, whether closed, and days to resolution (counted in minutes)."""
    minutes = minutes_between("created_at_local", "closed_at_local")
    return staged.select(
        "*",
        F.to_date("created_at_local").alias("created_date"),
        F.to_date("closed_at_local").alias("closed_date"),
        F.col("closed_at_local").isNotNull().alias("is_closed"),
        (minutes / F.lit(1440.0)).alias("resolution_days"),
    )


def daily_metrics(fct: DataFrame) -> DataFrame:
    """Counts and the median days to resolution by day, dimensions and channel; a hot group is split by days to resolution."""
    keys = ["metric_date", *DIMENSIONS, "channel"]
    rows = fct.select(F.col("created_date").alias("metric_date"), *keys[1:], "is_closed", F.when(F.col("is_closed"), F.col("resolution_days")).alias("value"))
    found, median = ranges.percentile_columns({"median_resolution_days": 0.5})
    placed = ranges.with_places(ranges.histograms(rows, keys, "value", 1.0, {"closed": F.count_if("is_closed")}), keys).select("*", *found)
    return placed.groupBy(*keys).agg(F.sum("n").alias("request_count"), F.sum("closed").alias("closed_count"), *median)


def closure_cohorts(fct: DataFrame, within_days: int = 7) -> DataFrame:
    """Requests by week of creation; unresolved ones are right-censored."""
    week = F.to_date(F.date_trunc("week", F.col("created_date")))
    return fct.groupBy(week.alias("cohort_week"), "community_district", "problem").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("is_closed") & (F.col("resolution_days") <= within_days)).alias("closed_within_7_days"),
        F.count_if(~F.col("is_closed")).alias("right_censored_requests"),
    )


def open_age(fct: DataFrame, as_of: date, aged_days: int = 30) -> DataFrame:
    """Unresolved requests, and those at least aged_days old at the start of as_of."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {aged_days} DAYS")
    waiting = ~F.col("is_closed")
    return fct.groupBy(*DIMENSIONS).agg(F.count_if(waiting).alias("unresolved_requests"), F.count_if(waiting & (F.col("created_at_local") <= cutoff)).alias("aged_30d_requests"))


def quality(fct: DataFrame) -> DataFrame:
    return fct.agg(
        F.count("*").alias("rows_checked"),
        F.countDistinct("request_id").alias("unique_request_ids"),
        F.count_if(F.col("community_district") == "UNSPECIFIED").alias("unspecified_district_rows"),
        F.count_if(F.col("closed_at_local") < F.col("created_at_local")).alias("invalid_date_rows"),
        F.count_if(F.col("problem").isNull() | (F.col("problem") == "")).alias("missing_problem_rows"),
    )


def inventory(requests: DataFrame, start: date, end: date, aged_days: int = 30) -> DataFrame:
    """One row: requests of the window, those open at its end, and those of these that are aged.

    The window is half open: up to, and without, the day after end.
    """
    after = F.date_add(F.lit(end), 1).cast("timestamp_ntz")
    inside = (F.col("created_date") >= F.lit(start).cast("timestamp_ntz")) & (F.col("created_date") < after)
    waiting = F.col("closed_date").isNull() | (F.col("closed_date") >= after)
    aged = F.col("created_date") < F.date_add(F.lit(end), 1 - aged_days).cast("timestamp_ntz")
    return requests.where(inside).agg(F.count("*").alias("requests"), F.count_if(waiting).alias("unresolved_as_of"), F.count_if(waiting & aged).alias("aged_open"))


def top_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Groups of a column by falling count, ties by value; the first n."""
    out = df.groupBy(column).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), column)
    return out if n is None else out.limit(n)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and for each column the filled percentage to one decimal, null without rows."""
    return df.agg(F.count("*").alias("rows_checked"), *[F.round(100 * F.count(c) / F.nullif(F.count("*"), F.lit(0)), 1).alias(f"{c}_coverage") for c in columns])
