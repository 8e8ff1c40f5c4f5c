"""Drift of raw records against the request schema: what fields, kinds of values and statuses came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SAFE_FIELDS

#: Kinds that a field of a request may have: all values are texts, some are missing.
EXPECTED = ("STRING", "VOID")


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """record: each line as a variant, or null if it is no JSON object."""
    variant = F.try_parse_json(column)
    return lines.select(F.when(F.schema_of_variant(variant).startswith("OBJECT"), variant).alias("record"))


def field_kinds(lines: DataFrame, column: str = "value") -> DataFrame:
    """field, kind, records and verdict of every field that the records have, whatever schema is expected.

    kind is Spark's type of the value, without precision. The verdict is `known`, `changed` (a field of
    the schema with values that are no texts) or `new`. Lines that are no record are one row with a null field
    and kind, and the verdict `corrupt`. Only field and kind of a value are shuffled, after counting.
    """
    spark = lines.sparkSession
    rows = parsed(lines, column)
    fields = rows.where(F.col("record").isNotNull()).lateralJoin(spark.tvf.variant_explode(F.col("record").outer()))
    kind = F.regexp_replace(F.schema_of_variant("value"), r"[<(].*$", "")
    counts = fields.groupBy(F.col("key").alias("field"), kind.alias("kind")).agg(F.count("*").alias("records"))
    verdict = F.when(~F.col("field").isin(SAFE_FIELDS), "new").when(F.col("kind").isin(*EXPECTED), "known").otherwise("changed")
    bad = rows.agg(F.count_if(F.col("record").isNull()).alias("records")).where("records > 0")
    nothing = F.lit(None).cast("string")
    return counts.select("field", "kind", "records", verdict.alias("verdict")).unionByName(bad.select(nothing.alias("field"), nothing.alias("kind"), "records", F.lit("corrupt").alias("verdict")))


def seen_schema(lines: DataFrame, column: str = "value") -> str:
    """One schema that holds all records, as Spark writes it: an aggregate of the records' own schemas."""
    return parsed(lines, column).agg(F.schema_of_variant_agg("record")).first()[0]


def unseen_values(requests: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Values of a column, stripped and upper-cased, that are not known, with their number; nulls are missing, not new."""
    value = F.upper(F.trim(column))
    return requests.where(~value.isin([k.upper() for k in known])).groupBy(value.alias(column)).agg(F.count("*").alias("requests"))
