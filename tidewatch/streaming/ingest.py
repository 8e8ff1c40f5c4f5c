"""Streams: contract-checked ingestion, deduplication, and alert episodes as sessions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contracts import quarantine, valid
from ..operators.detectors import detect
from ..operators.episodes import EPISODE_COLUMNS, episode_aggregates, episode_states, session_columns
from ..schemas import SERIES, Thresholds


def ingest(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what a stream of requests has now: kept rows to path/valid, others to path/quarantine.

    A batch overwrites its own folder, so one that is tried again after a failure leaves no copies.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        valid(batch).write.mode("overwrite").json(f"{path}/valid/batch={number}")
        quarantine(batch).write.mode("overwrite").json(f"{path}/quarantine/batch={number}")
        batch.unpersist()

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(requests: DataFrame, delay: str = "7 days") -> DataFrame:
    """One row a key among rows that come within the delay."""
    timed = requests.withColumn("created_at", F.col("created_date").cast("timestamp")).withWatermark("created_at", delay)
    return timed.dropDuplicatesWithinWatermark(["unique_key"])


def daily_counts(requests: DataFrame, delay: str = "2 days") -> DataFrame:
    """Counts by day, board and problem; a day closes when the watermark has passed it."""
    timed = requests.withColumn("created_at", F.col("created_date").cast("timestamp")).withWatermark("created_at", delay)
    day = F.window("created_at", "1 day")
    counts = timed.groupBy(day, "community_board", "complaint_type").agg(F.count("*").alias("requests"))
    return counts.select(F.to_date("window.start").alias("day"), "community_board", "complaint_type", "requests")


def episode_sessions(alerts: DataFrame, cooldown_days: int = 7, delay: str = "0 days") -> DataFrame:
    """Episodes of a stream (or table) of alerts as sessions, with all columns of the batch rule.

    For alerts within the delay they are those of merge_episodes: the session's state is the first and
    the strongest alert so far, so it doesn't grow with the session. A session is put out when the
    watermark has passed its last alert and the cooldown; alerts later than the delay are left out.
    """
    timed = alerts.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", delay)
    return session_columns(timed.groupBy(F.session_window("at", f"{cooldown_days} days"), *SERIES).agg(*episode_aggregates()))


def replay(panel: DataFrame, t: Thresholds, days: list[date]) -> DataFrame:
    """known_on and the episodes that were known at the end of each of the days, in one pass.

    A day's alert needs no later day, so the alerts known on a day are those up to it, and an episode
    known on a day is its state after its latest alert till then. Alerts are made once; each is a state
    that holds until the day before the series' next alert of that episode (of a closed one, for ever), and
    is given out for every listed day in between.
    """
    last = max(days)
    states = episode_states(detect(panel, t, last), t.cooldown_days)
    until = F.coalesce(F.date_sub("replaced", 1), F.lit(last))
    held = F.filter(F.lit(sorted(set(days))), lambda d: (d >= F.col("episode_end")) & (d <= until))
    return states.select(F.explode(held).alias("known_on"), *EPISODE_COLUMNS)
