"""The row contract: requests that hold it, and those in quarantine with the rules they break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import SAFE_FIELDS

#: Text fields that may not be blank and are stripped, and those that only may not be empty.
STRIPPED = ["agency", "complaint_type", "status", "borough", "community_board"]
NOT_EMPTY = ["unique_key", "open_data_channel_type"]


def broken_rules() -> Column:
    """Names of the rules that a row breaks, in order."""
    rules = [(f"{c}_missing", F.coalesce(F.length(c) < 1, F.lit(True))) for c in NOT_EMPTY]
    rules += [(f"{c}_blank", F.coalesce(strip(c) == "", F.lit(True))) for c in STRIPPED]
    rules += [("created_date_missing", F.col("created_date").isNull()), ("closed_before_created", F.coalesce(F.col("closed_date") < F.col("created_date"), F.lit(False)))]
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())


def judge(requests: DataFrame) -> DataFrame:
    """The safe fields with `broken_rules`; a record that could not be parsed breaks `corrupt_record`."""
    rules = broken_rules()
    if "_corrupt" in requests.columns:
        rules = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("corrupt_record"))).otherwise(rules)
    return requests.select(*SAFE_FIELDS, rules.alias("broken_rules"))


def valid(requests: DataFrame) -> DataFrame:
    """Rows that hold the contract, required texts stripped. Unknown statuses are kept."""
    kept = judge(requests).where(F.size("broken_rules") == 0)
    return kept.select(*[strip(c).alias(c) if c in STRIPPED else F.col(c) for c in SAFE_FIELDS])


def quarantine(requests: DataFrame) -> DataFrame:
    """Rows that break the contract, as they came, with the rules they break."""
    return judge(requests).where(F.size("broken_rules") > 0)


def violations(df: DataFrame, not_null: list[str], unique: list[str]) -> DataFrame:
    """Constraint checks: check, column and n_violations, one row for each constraint."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
    out = nulls.unpivot([], not_null, "column", "n_violations").select(F.lit("not_null").alias("check"), "column", F.col("n_violations").cast("long"))
    for c in unique:
        repeated = df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").agg(F.count("*").alias("n_violations"))
        out = out.union(repeated.select(F.lit("unique").alias("check"), F.lit(c).alias("column"), "n_violations"))
    return out
