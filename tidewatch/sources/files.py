"""File sources and sinks: requests as newline-delimited JSON, boundaries as GeoJSON, labels, CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GateError
from ..functions.text import district_of_code
from ..schemas import BOROUGH_CODES, DISTRICTS, REQUEST, SAFE_FIELDS

_CORRUPT = T.StructType([*REQUEST.fields, T.StructField("_corrupt", T.StringType())])


def read_requests(spark: SparkSession, glob: str) -> DataFrame:
    """Requests of all files that glob names. Only the safe fields are read; what can't be parsed is in _corrupt."""
    return spark.read.schema(_CORRUPT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(glob)


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(_CORRUPT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def official_codes(spark: SparkSession) -> DataFrame:
    """code and district of the 59 community districts."""
    rows = [(100 * k + n,) for k, name in BOROUGH_CODES.items() for n in range(1, DISTRICTS[name] + 1)]
    return spark.createDataFrame(rows, "code int").withColumn("district", district_of_code(F.col("code")))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """code, district and geometry (JSON text) of the official features of a feature collection; fails unless all are there."""
    feature = "struct<properties: map<string, string>, geometry: string>"
    features = spark.read.option("multiLine", True).schema(f"features array<{feature}>").json(path).select(F.explode("features").alias("f"))
    codes = features.select(F.try_element_at("f.properties", F.lit("boro_cd")).try_cast("int").alias("code"), F.col("f.geometry").alias("geometry"))
    found = codes.join(F.broadcast(official_codes(spark)), "code")  # 59 rows
    n = found.select("code").distinct().count()
    if n != sum(DISTRICTS.values()):
        raise GateError(f"expected {sum(DISTRICTS.values())} boundaries, found {n}")
    return found.select("code", "district", "geometry")


def join_boundaries(boundaries: DataFrame, map_rows: DataFrame) -> DataFrame:
    """Boundaries with requests and severity; zero and `normal` where a district has none."""
    out = boundaries.join(map_rows.select("district", "requests", "severity"), "district", "left")
    return out.select("code", "district", "geometry", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("severity", F.lit("normal")).alias("severity"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """case_id, label and external_evidence of a JSON list, or of an object with a list `cases`."""
    row = "struct<case_id: string, label: string, external_evidence: array<string>>"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    listed = F.from_json("value", f"array<{row}>")
    held = F.from_json("value", f"struct<cases: array<{row}>>")["cases"]
    rows = F.when(F.startswith("value", F.lit("[")), listed).otherwise(held)
    return text.select(F.explode(rows).alias("r")).select("r.*")


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list | None = None) -> None:
    """Every value and name quoted, quotes doubled, nulls empty.

    With order (of a bounded view, such as a page of signals) one file is written with one header and
    its rows in that order. Without it, each part file has a header, and rows have no order.
    """
    rows = df.orderBy(*order).coalesce(1) if order else df
    out = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns or df.columns])
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_requests(requests: DataFrame, path: str) -> None:
    requests.select(*SAFE_FIELDS).write.mode("append").json(path)
