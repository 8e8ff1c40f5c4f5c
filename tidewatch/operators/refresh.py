"""Tables that are refreshed by partition: readers see the old or the new state, never a part of one.

A refresh writes the partitions that its rows belong to under a version of its own, then one manifest file
that says which version of each partition counts; others keep theirs. Readers follow the newest manifest.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GateError

_MANIFEST = "number long, part string, version string"
#: Name of the partition of rows whose partition value is null.
NO_PART = "none"


def month_of(day: str) -> Column:
    """The month of a date as text, such as 2026-07."""
    return F.date_format(day, "yyyy-MM")


def current(spark: SparkSession, path: str) -> DataFrame:
    """number, part and version of the newest manifest; no rows if nothing was written yet."""
    try:
        every = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/*")
        newest = every.agg(F.max("number")).first()[0]
    except AnalysisException:
        return spark.createDataFrame([], _MANIFEST)
    return every.where(F.col("number") == newest)


def refresh(rows: DataFrame, path: str, part: Column) -> int:
    """Replaces the partitions of path that rows belong to; returns the number of the new state.

    One writer at a time: of two, the one whose manifest comes second fails, as its number is taken.
    """
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    rows.withColumn("part", F.coalesce(part, F.lit(NO_PART))).repartition("part").write.partitionBy("part").parquet(f"{path}/data/{version}")
    before = {r["part"]: (r["number"], r["version"]) for r in current(spark, path).collect()}
    number = 1 + max((n for n, _ in before.values()), default=0)
    try:
        written = [r[0] for r in spark.read.parquet(f"{path}/data/{version}").select(F.col("part").cast("string")).distinct().collect()]
    except AnalysisException:  # no rows, no files
        written = []
    state = {p: v for p, (_, v) in before.items()} | dict.fromkeys(written, version)
    manifest = spark.createDataFrame([(number, p, v) for p, v in sorted(state.items())], _MANIFEST)
    manifest.coalesce(1).write.mode("error").parquet(f"{path}/manifests/{number:09d}")
    return number


def read_refreshed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest state, with their partition as part."""
    found = current(spark, path).collect()
    if not found:
        raise GateError(f"nothing was written to {path} yet")
    tables = [spark.read.parquet(f"{path}/data/{v}").where(F.col("part").isin([r["part"] for r in found if r["version"] == v])) for v in sorted({r["version"] for r in found})]
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
