"""Alerts merged to episodes, ranked, and matched with labelled events."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import among, halvings, let
from ..schemas import SERIES
from .detectors import ALERT_COLUMNS
from .settled import settled

#: Fields that an episode takes from its strongest alert; the others are its first alert's.
STRONGEST = ["observed", "expected", "effect", "anomaly_score", "calibrated_score", "upper_bound"]
EPISODE_COLUMNS = [*ALERT_COLUMNS, "episode_start", "episode_end", "persistence"]


_FIRST = [c for c in ALERT_COLUMNS if c not in STRONGEST and c not in SERIES]


def _strength() -> F.Column:
    """Order of alerts by score, of equal ones the first highest."""
    return F.struct("anomaly_score", -F.unix_date("date"))


def episode_aggregates() -> list[F.Column]:
    """What is kept of an episode's alerts: the first (f), the strongest (s), first and last day, number."""
    return [
        F.min_by(F.struct(*_FIRST), "date").alias("f"),
        F.max_by(F.struct(*STRONGEST), _strength()).alias("s"),
        F.min("date").alias("episode_start"),
        F.max("date").alias("episode_end"),
        F.count("*").alias("persistence"),
    ]


def session_columns(grouped: DataFrame) -> DataFrame:
    """The columns of an episode, of groups with episode_aggregates."""
    return grouped.select(*SERIES, "f.*", "s.*", "episode_start", "episode_end", "persistence").select(*EPISODE_COLUMNS)


def _numbered(alerts: DataFrame, cooldown_days: int) -> DataFrame:
    """alerts with the number of their episode in the series."""
    w = W.partitionBy(*SERIES).orderBy("date")
    begins = F.coalesce(F.datediff("date", F.lag("date").over(w)) > cooldown_days, F.lit(True))
    return alerts.withColumn("begins", begins.cast("int")).withColumn("episode", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("begins")


def merge_episodes(alerts: DataFrame, cooldown_days: int = 7) -> DataFrame:
    """Alerts of a series with gaps of at most cooldown_days as one episode; of equal scores the first counts."""
    return session_columns(_numbered(alerts, cooldown_days).groupBy(*SERIES, "episode").agg(*episode_aggregates()))


def episode_states(alerts: DataFrame, cooldown_days: int = 7) -> DataFrame:
    """The episode of each alert as it was after that alert, and `replaced`, the day of the episode's next one."""
    w = W.partitionBy(*SERIES, "episode").orderBy("date")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    seen = _numbered(alerts, cooldown_days).select(
        *SERIES,
        F.first(F.struct(*_FIRST)).over(so_far).alias("f"),
        F.max(F.struct("anomaly_score", (-F.unix_date("date")).alias("early"), F.struct(*STRONGEST).alias("x"))).over(so_far)["x"].alias("s"),
        F.first("date").over(so_far).alias("episode_start"),
        F.col("date").alias("episode_end"),
        F.row_number().over(w).cast("long").alias("persistence"),
        F.lead("date").over(w).alias("replaced"),
    )
    return seen.select(*SERIES, "f.*", "s.*", "episode_start", "episode_end", "persistence", "replaced").select(*EPISODE_COLUMNS, "replaced")


#: Rows of a range of values that percent ranks are computed in, and how many ranges there are at least and at most.
RANGE_ROWS, RANK_RANGES = 100_000, (16, 10_000)


def _range(bounds: F.Column, value: F.Column) -> F.Column:
    """How many of the sorted bounds are not above the value, found by halving."""
    return F.aggregate(halvings(bounds), F.lit(-1), lambda at, step: F.when(F.get(bounds, at + step) <= value, at + step).otherwise(at)) + 1


def rank_by_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds percent ranks (ties at their mean place) without a window over all rows.

    Rows are counted by value, and values are dealt to ranges between approximate quantiles, so many that
    a range has about RANGE_ROWS rows whatever their number. A value's rank is the total of the ranges
    before its own, plus its place in it; a range is ordered in one task. Values that are null have no rank.
    """
    out = df
    n = min(max(RANK_RANGES[0], -(-df.count() // RANGE_ROWS)), RANK_RANGES[1])
    every = df.agg(*[F.count(c).alias(c) for c in columns], *[F.percentile_approx(c, [k / n for k in range(1, n)], 4 * n).alias(f"{c} bounds") for c in columns]).first()
    for source, target in columns.items():
        bounds = sorted(set(every[f"{source} bounds"] or []))
        kind = df.schema[source].dataType
        counts = df.where(F.col(source).isNotNull()).groupBy(source).agg(F.count("*").alias("ties"))
        counts = counts.withColumn("range", _range(F.lit(bounds).cast(f"array<{kind.simpleString()}>"), F.col(source)) if bounds else F.lit(0))
        w = W.partitionBy("range").orderBy(source).rowsBetween(W.unboundedPreceding, -1)
        totals = counts.groupBy("range").agg(F.sum("ties").alias("n"))
        # At most 10,000 rows, so one task orders them and they can be broadcast.
        before = totals.select("range", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        placed = counts.withColumn("below", F.coalesce(F.sum("ties").over(w), F.lit(0))).join(F.broadcast(before), "range")
        ranks = placed.select(source, ((F.col("before") + F.col("below") + (F.col("ties") + 1) / 2.0) / F.lit(every[source])).alias(target))
        out = out.join(ranks, source, "left")
    return out


def rank_episodes(episodes: DataFrame) -> DataFrame:
    """Adds the three percent ranks, the priority score and the severity."""
    rows = episodes if "persistence" in episodes.columns else episodes.withColumn("persistence", F.lit(1))
    rows = rows.withColumn("persistence", F.coalesce("persistence", F.lit(1)))
    rows = settled(rows)  # read once for the bounds and once for each rank
    ranked = rank_by_counts(rows, {"anomaly_score": "strength_pct", "affected_count": "impact_pct", "persistence": "persistence_pct"})
    score = 0.5 * F.col("strength_pct") + 0.3 * F.col("impact_pct") + 0.2 * F.col("persistence_pct")
    return ranked.select(*rows.columns, "strength_pct", "impact_pct", "persistence_pct", score.alias("priority_score"), F.when(score >= 0.9, "high").otherwise("watch").alias("severity"))


def priority_order() -> list[F.Column]:
    return [F.desc("priority_score"), F.desc("date"), F.asc("district"), F.asc("problem")]


def top_ranked(ranked: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Rows `offset` to `offset + n` by priority, with their place from 1."""
    rows = ranked.orderBy(*priority_order()).limit(offset + n)
    return rows.withColumn("place", F.row_number().over(W.orderBy(*priority_order()))).where(F.col("place") > offset)


def recent_candidates(episodes: DataFrame, end: date, days: int = 20, least: int = 40, fallback: int = 80) -> DataFrame:
    """Episodes that began in the last days; if these are too few, the latest `fallback` episodes."""
    recent = episodes.where(F.col("date") >= F.lit(end - timedelta(days=days)))
    if recent.limit(least).count() >= least:
        return recent
    return episodes.orderBy(F.desc("date"), "district", "problem").limit(fallback)


#: Days of a bucket in which events and starts of episodes meet, and events of a run that are walked at once.
MATCH_DAYS, MATCH_BLOCK = 16, 512


def _bucket(day: str) -> F.Column:
    return F.floor(F.unix_date(day) / MATCH_DAYS)


def match_events(episodes: DataFrame, events: DataFrame, grace_days: int = 2) -> DataFrame:
    """events with the episode that each matches: event columns, matched (start of the episode) and delay_days.

    Events in the order of event_id take, each, the first episode of their series that no other has
    taken and that starts from the event's start to its end and the grace. Events and episodes meet by
    series and bucket of days. Only events that want a common episode, directly or by others between
    them, are gathered: such a run is walked by one fold, in blocks, all others have their first episode.
    """
    reach = events.select("event_id", *SERIES, F.col("start").alias("from"), F.date_add("end", grace_days).alias("until")).where("from <= until")
    spread = reach.withColumn("bucket", F.explode(F.sequence(_bucket("from"), _bucket("until"))))
    starts = episodes.select(*SERIES, "episode_start").distinct().withColumn("bucket", _bucket("episode_start"))
    near = spread.join(starts, [*SERIES, "bucket"]).where(F.col("episode_start").between(F.col("from"), F.col("until")))
    wanted = near.groupBy(*SERIES, "event_id").agg(F.sort_array(F.collect_list("episode_start")).alias("wanted"))
    # In the order of first wishes a run ends where the next first wish is after all wishes so far.
    w = W.partitionBy(*SERIES).orderBy(F.get("wanted", 0), "event_id")
    furthest = F.max(F.array_max("wanted")).over(w.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(F.get("wanted", 0) > furthest, F.lit(True))
    runs = wanted.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    gathered = runs.groupBy(*SERIES, "run").agg(F.sort_array(F.collect_list(F.struct("event_id", "wanted"))).alias("x"))
    kind = f"array<struct<event_id:{events.schema['event_id'].dataType.simpleString()},matched:date>>"

    def start(taken: str) -> F.Column:
        return F.struct(F.array().cast("array<date>").alias(taken), F.array().cast(kind).alias("given"))

    def block(acc: F.Column, x: F.Column) -> F.Column:
        """One block of events in order: days taken before are looked up in their sorted array, new ones are few."""

        def walk(steps: F.Column) -> F.Column:
            def event(own: F.Column, e: F.Column) -> F.Column:
                free = F.filter(e["wanted"], lambda day: ~F.array_contains(own["new"], day) & ~among(acc["taken"], steps, day))
                taken = F.struct(F.array_append(own["new"], F.get(free, 0)).alias("new"), F.array_append(own["given"], F.struct(e["event_id"].alias("event_id"), F.get(free, 0).alias("matched"))).alias("given"))
                return F.when(F.size(free) == 0, own).otherwise(taken)

            return F.aggregate(x, start("new"), event)

        return let(let(halvings(acc["taken"]), walk), lambda own: F.struct(F.sort_array(F.concat(acc["taken"], own["new"])).alias("taken"), F.concat(acc["given"], own["given"]).alias("given")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / MATCH_BLOCK).cast("int")), lambda k: F.slice("x", k * MATCH_BLOCK + 1, F.lit(MATCH_BLOCK)))
    first = F.transform("x", lambda e: F.struct(e["event_id"].alias("event_id"), F.get(e["wanted"], 0).alias("matched")))
    given = F.when(F.size("x") == 1, first).otherwise(F.aggregate(blocks, start("taken"), block)["given"])
    found = gathered.select(F.explode(given).alias("g")).select("g.event_id", "g.matched")
    return events.join(found, "event_id", "left").withColumn("delay_days", F.when(F.col("matched").isNotNull(), F.greatest(F.datediff("matched", "start"), F.lit(0))))
