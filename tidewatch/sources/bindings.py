"""The star-schema test tables as requests, as a panel and as labelled events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import densify
from ..schemas import SAFE_FIELDS

#: Days of the panel of shipments.
PANEL_START, PANEL_END = date(1995, 1, 2), date(2001, 11, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as service requests; an order closes with its first shipment unless it is open."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    key = F.col("o_orderkey")
    joined = table(spark, sf_dir, "orders").join(customers, "o_custkey").join(nations, "n_nationkey").join(regions, "r_regionkey").join(shipped, "o_orderkey", "left")
    return joined.select(
        key.cast("string").alias("unique_key"),
        F.col("o_orderdate").alias("created_date"),
        F.when(F.col("o_orderstatus") != "O", F.col("shipped")).alias("closed_date"),
        F.col("c_mktsegment").alias("agency"),
        F.when(key % 7 != 0, F.concat("c_mktsegment", F.lit(" agency "))).alias("agency_name"),
        F.col("o_orderpriority").alias("complaint_type"),
        F.when(key % 5 == 0, " ").otherwise(F.lower("o_orderpriority")).alias("descriptor"),
        F.col("o_orderstatus").alias("status"),
        F.when(key % 97 == 0, "  ").otherwise(F.col("r_name")).alias("borough"),
        F.concat(F.lpad((F.col("n_nationkey") % 18 + 1).cast("string"), 2, "0"), F.lit(" "), F.col("r_name")).alias("community_board"),
        F.when(key % 3 == 0, "online").when(key % 3 == 1, " mobile ").otherwise("PHONE").alias("open_data_channel_type"),
    ).select(*SAFE_FIELDS)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by day of shipment, return flag and line status: sparse daily counts."""
    keys = [F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("district"), F.col("l_linestatus").alias("problem")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("requests"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(shipments(spark, sf_dir), PANEL_START, PANEL_END)


def labelled_events(panel_rows: DataFrame) -> DataFrame:
    """Events of a week at the start of every third month of each series of a panel."""
    starts = panel_rows.where((F.dayofmonth("date") == 1) & (F.month("date") % 3 == 1))
    name = F.concat_ws("-", F.lit("EV"), "district", "problem", F.col("date").cast("string"))
    kind = F.element_at(F.array(F.lit("spike"), F.lit("level_shift"), F.lit("gradual_ramp")), (F.year("date") % 3 + 1).cast("int"))
    return starts.select(name.alias("event_id"), "district", "problem", F.col("date").alias("start"), F.date_add("date", 6).alias("end"), kind.alias("scenario"), F.lit("none").alias("generator"))
