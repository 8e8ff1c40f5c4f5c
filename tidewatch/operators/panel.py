"""Daily counts, the dense panel, integrity gates and rollups."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import GateError
from ..functions.text import parse_district
from ..schemas import PANEL_COLUMNS, SERIES


def missing(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that df lacks, in order."""
    return sorted(set(columns) - set(df.columns))


def require(df: DataFrame, columns: list[str]) -> None:
    """Fails at planning if columns are missing."""
    if lacking := missing(df, columns):
        raise ValueError(f"Missing columns: {', '.join(lacking)}")


def daily_sparse(requests: DataFrame) -> DataFrame:
    """Requests by day, board and problem."""
    return requests.groupBy(F.to_date("created_date").alias("day"), "community_board", "complaint_type").agg(F.count("*").alias("requests"))


def selected(requests: DataFrame, problems: DataFrame, boards: DataFrame) -> DataFrame:
    """Requests of listed problems and boards."""
    return requests.join(problems.select("complaint_type").distinct(), "complaint_type", "left_semi").join(boards.select("community_board").distinct(), "community_board", "left_semi")


def as_panel(sparse: DataFrame) -> DataFrame:
    """Sparse daily counts with districts parsed from boards."""
    return sparse.select(F.to_date("day").alias("date"), parse_district("community_board")["district"].alias("district"), F.col("complaint_type").alias("problem"), F.col("requests").cast("long").alias("requests"))


def densify(panel: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """One row for each day of each observed series, zeros where nothing was counted.

    Series are made to days by exploding a sequence, so there is no cross join. Rows with a null key
    are left out; several counts of one series and day are summed. Both shuffles are on the series.
    """
    require(panel, PANEL_COLUMNS)
    kept = panel.where(F.col("district").isNotNull() & F.col("problem").isNotNull() & F.col("date").isNotNull())
    if start is None or end is None:
        low, high = kept.agg(F.min("date"), F.max("date")).first()
        start, end = start or low, end or high
    if start is None:
        return kept.select(*PANEL_COLUMNS).limit(0)
    days = F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 1 DAY")))
    counts = kept.groupBy(*SERIES, "date").agg(F.sum("requests").alias("requests"))
    grid = counts.select(*SERIES).distinct().select(*SERIES, days.alias("date"))
    return grid.join(counts, [*SERIES, "date"], "left").select("date", *SERIES, F.coalesce("requests", F.lit(0)).cast("long").alias("requests"))


def duplicate_rows(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys (all columns by default) that occur more than once, with their number."""
    return df.groupBy(*(keys or df.columns)).agg(F.count("*").alias("n")).where("n > 1")


def gate_unique(df: DataFrame, keys: list[str] | None = None) -> None:
    """Fails if any key is duplicate."""
    if not duplicate_rows(df, keys).isEmpty():
        raise GateError(f"duplicate {'keys ' + ', '.join(keys) if keys else 'rows'}")


def coverage_gate(sparse: DataFrame, start: date, end: date) -> DataFrame:
    """One row: first and last day, and whether they are those expected."""
    return sparse.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).select("*", F.coalesce((F.col("first_day") == F.lit(start)) & (F.col("last_day") == F.lit(end)), F.lit(False)).alias("complete"))


def reconcile(sparse: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: sum of grouped counts, independent count, and whether they agree."""
    grouped = sparse.agg(F.coalesce(F.sum("requests"), F.lit(0)).cast("long").alias("n")).select(F.lit("grouped").alias("side"), "n")
    counted = requests.agg(F.count("*").alias("n")).select(F.lit("source").alias("side"), "n")
    both = grouped.union(counted).agg(F.max(F.when(F.col("side") == "grouped", F.col("n"))).alias("grouped"), F.max(F.when(F.col("side") == "source", F.col("n"))).alias("source"))
    return both.select("*", (F.col("grouped") == F.col("source")).alias("reconciled"))


def gate(checked: DataFrame, flag: str, message: str) -> None:
    """Fails unless the one row's flag is true."""
    row = checked.first()
    if row is None or not row[flag]:
        raise GateError(f"{message}: {row.asDict() if row else 'no rows'}")


def rollup(panel: DataFrame, *keys: str) -> DataFrame:
    """Counts by date and keys."""
    return panel.groupBy("date", *keys).agg(F.sum("requests").cast("long").alias("observed"))


def rollups(panel: DataFrame, report_start: date, end: date, days: int = 28) -> DataFrame:
    """kind, date, district, problem and observed: all rollups of a report by one Expand and one aggregate.

    Kinds are `city` (by date), `district` and `problem` (by date, from report_start) and `map` (by
    district, of the last days). Columns that a kind doesn't group by are null.
    """
    recent = (F.col("date") > F.date_sub(F.lit(end), days)) & (F.col("date") <= F.lit(end))
    rows = panel.select("date", *SERIES, recent.alias("recent"), "requests")
    sets = [["date"], ["date", "district"], ["date", "problem"], ["recent", "district"]]
    sums = rows.groupingSets(sets, "date", "district", "problem", "recent").agg(F.sum("requests").cast("long").alias("observed"), *[F.grouping(c).alias(f"all_{c}") for c in ("date", "district", "problem", "recent")])
    # The first that is true counts, so a null there leaves the row out.
    kind = F.when(F.col("all_recent") == 0, F.when(F.col("recent"), "map"))
    kind = kind.when((F.col("all_district") == 1) & (F.col("all_problem") == 1), "city")
    kind = kind.when(F.col("date") < F.lit(report_start), None)
    kind = kind.when(F.col("all_district") == 0, "district").otherwise("problem")
    return sums.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("kind", "date", "district", "problem", "observed")


def write_counts(requests: DataFrame, path: str, start: date | None = None, end: date | None = None, filled: tuple[str, ...] = ("closed_date", "community_board")) -> DataFrame:
    """Writes the day counts of requests to path/rows and returns the one row of what was seen meanwhile.

    source and grouped (requests read, and their sum by day, board and problem), reconciled, first_day, last_day,
    complete, and a filled share of each column: all observed in the job that writes, without another scan.
    If the sums disagree, or the first or last day is not the one expected (if it is given), it fails, and path/checked, which read_counts asks for, is
    not written. Metrics of a stage that is run again after a loss may count twice: then the gate fails, it
    never passes for it.
    """
    spark = requests.sparkSession
    kinds = "source long, grouped long, first_day date, last_day date, reconciled boolean, complete boolean" + "".join(f", {c}_coverage double" for c in filled)
    spark.createDataFrame([], kinds).write.mode("overwrite").parquet(f"{path}/checked")  # what was checked before no longer counts
    read, made = Observation(), Observation()
    seen = requests.observe(read, F.count("*").alias("source"), *[F.count(c).alias(f"{c}_filled") for c in filled])
    sparse = daily_sparse(seen).observe(made, F.coalesce(F.sum("requests"), F.lit(0)).cast("long").alias("grouped"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    sparse.write.mode("overwrite").parquet(f"{path}/rows")
    got = read.get | made.get
    reconciled, complete = got["source"] == got["grouped"], got["first_day"] == (start or got["first_day"]) and got["last_day"] == (end or got["last_day"])
    if not reconciled:
        raise GateError(f"the day counts do not add up to the requests (reconciliation): {got}")
    if not complete:
        raise GateError(f"the day counts are incomplete: {got}")
    values = {k: got[k] for k in ("source", "grouped", "first_day", "last_day")} | {"reconciled": reconciled, "complete": complete}
    values |= {f"{c}_coverage": round(100 * got[f"{c}_filled"] / max(got["source"], 1), 1) for c in filled}
    row = spark.createDataFrame([tuple(values.values())], kinds)
    row.write.mode("overwrite").parquet(f"{path}/checked")
    return spark.read.schema(row.schema).parquet(f"{path}/checked")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The day counts that write_counts has written and checked; fails if there are none."""
    try:
        checked = not spark.read.parquet(f"{path}/checked").isEmpty()
    except AnalysisException:
        checked = False
    if not checked:
        raise GateError(f"there are no checked day counts at {path}")
    return spark.read.parquet(f"{path}/rows")


def district_totals(panel: DataFrame, end: date, days: int = 28) -> DataFrame:
    """Counts of each district over the last days."""
    recent = panel.where((F.col("date") > F.date_sub(F.lit(end), days)) & (F.col("date") <= F.lit(end)))
    return recent.groupBy("district").agg(F.sum("requests").cast("long").alias("requests"))


def eligible_series(panel: DataFrame, min_days: int = 70, min_median: float = 10.0) -> DataFrame:
    """Series that are long and busy enough to be evaluated."""
    found = panel.groupBy(*SERIES).agg(F.count("*").alias("days"), F.percentile("requests", F.lit(0.5)).alias("median_requests"))
    return found.where((F.col("days") >= min_days) & (F.col("median_requests") >= min_median))


def numbered_series(series: DataFrame) -> DataFrame:
    """series with place, from 0 in the order of district and problem.

    Places are counted within districts, and one task orders only the districts.
    """
    before = series.groupBy("district").agg(F.count("*").alias("n"))
    before = before.select("district", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("district").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = series.withColumn("within", F.row_number().over(W.partitionBy("district").orderBy("problem")))
    return within.join(before, "district").withColumn("place", (F.col("before") + F.col("within") - 1).cast("int")).drop("before", "within")
