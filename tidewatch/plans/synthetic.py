"""Semi-synthetic panels with known events: templates in Spark, draws from one seeded generator."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.panel import eligible_series, numbered_series
from ..schemas import SERIES

#: Fixed values of the protocol.
SCENARIOS = ("spike", "level_shift", "gradual_ramp")
STRENGTHS = {"spike": (2.75, 3.5, 5.0), "level_shift": (1.75, 2.0, 2.5), "gradual_ramp": (1.75, 2.25, 3.0)}
DURATIONS = (3, 7, 14)
GENERATORS = ("negative_binomial", "weekly_block_bootstrap")
START, DAYS = date(2026, 1, 1), 220
FIRST_OFFSET = 190
LEVEL_FLOOR = 10.0
LEAST_ALPHA, MOST_ALPHA = 0.02, 0.5
RAMP_START = 1.25
BLOCK_DAYS = 7
QUIET_RATIO, QUIET_DEVIATIONS = 1.5, 3.0

PANEL = "date date, district string, problem string, requests double"
EVENTS = "event_id string, district string, problem string, start date, end date, scenario string, generator string"


def series_templates(panel: DataFrame, level_floor: float = LEVEL_FLOOR) -> DataFrame:
    """district, problem, level, weekday_level (Monday first) and alpha of each series."""
    x = F.col("requests").cast("double")
    totals = panel.groupBy(*SERIES).agg(F.greatest(F.percentile("requests", F.lit(0.5)), F.lit(level_floor)).alias("level"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count("*").alias("n"))
    days = panel.groupBy(*SERIES, F.weekday("date").alias("weekday")).agg(F.greatest(F.percentile("requests", F.lit(0.5)), F.lit(1.0)).alias("m"))
    by_day = days.groupBy(*SERIES).agg(F.map_from_entries(F.collect_list(F.struct("weekday", "m"))).alias("by_day"))
    variance = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    alpha = F.least(F.greatest((variance - F.col("level")) / F.greatest(F.col("level") * F.col("level"), F.lit(1.0)), F.lit(LEAST_ALPHA)), F.lit(MOST_ALPHA))
    levels = F.array(*[F.coalesce(F.try_element_at("by_day", F.lit(k)), F.col("level")) for k in range(7)])
    return totals.join(by_day, SERIES).select(*SERIES, "level", levels.alias("weekday_level"), alpha.alias("alpha"))


def clipped(panel: DataFrame) -> DataFrame:
    """panel with low and high (5 and 95 percent points of the series) and the count between them."""
    bounds = panel.groupBy(*SERIES).agg(F.percentile("requests", F.array(F.lit(0.05), F.lit(0.95))).alias("b"))
    out = panel.join(bounds, SERIES).select("*", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
    return out.withColumn("clipped", F.least(F.greatest(F.col("requests").cast("double"), "low"), "high"))


def quiet_days(panel: DataFrame, templates: DataFrame) -> DataFrame:
    """Days whose seven days before were all near their weekday level."""
    mean = F.get("weekday_level", F.weekday("date"))
    calm = (F.col("requests") < QUIET_RATIO * mean) & (F.col("requests") < mean + QUIET_DEVIATIONS * F.sqrt(mean + F.col("alpha") * mean * mean))
    w = W.partitionBy(*SERIES).orderBy("date").rowsBetween(-7, -1)
    rows = panel.join(templates, SERIES).withColumn("calm", calm)
    return rows.withColumn("n", F.count_if("calm").over(w)).where("n = 7").select("date", *SERIES)


def strata(series: DataFrame, events: int) -> DataFrame:
    """The plan of `events` synthetic series: source series, scenario, duration, strength, generator by place."""
    numbered = numbered_series(series.select(*SERIES))
    n = max(1, numbered.count())  # without series the plan is empty
    k = F.col("i")

    def pick(values: tuple, at: F.Column) -> F.Column:
        return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))

    plan = series.sparkSession.range(events).select(F.col("id").cast("int").alias("i")).withColumn("place", k % n).join(numbered, "place")
    scenario = pick(SCENARIOS, k % len(SCENARIOS))
    strength = F.when(scenario == "spike", pick(STRENGTHS["spike"], F.floor(k / 9) % 3)).when(scenario == "level_shift", pick(STRENGTHS["level_shift"], F.floor(k / 9) % 3)).otherwise(pick(STRENGTHS["gradual_ramp"], F.floor(k / 9) % 3))
    return plan.select("i", *SERIES, scenario.alias("scenario"), F.when(scenario == "spike", 1).otherwise(pick(DURATIONS, F.floor(k / 3) % 3)).cast("int").alias("duration"), strength.alias("strength"), pick(GENERATORS, k % 2).alias("generator"))


@dataclass
class Source:
    """A source series: its counts by date, and its template."""

    days: np.ndarray  # weekdays of the counts
    counts: np.ndarray
    level: np.ndarray
    alpha: float


def background(source: Source, generator: str, weekdays: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Counts without an event. All random numbers of a synthetic series are drawn here."""
    mean = source.level[weekdays]
    if generator == GENERATORS[0]:
        shape = 1.0 / source.alpha
        return rng.negative_binomial(shape, shape / (shape + mean)).astype(float)
    low, high = np.quantile(source.counts, [0.05, 0.95])
    rest = np.clip(source.counts, low, high) - source.level[source.days]
    blocks = rng.integers(0, max(len(rest) - BLOCK_DAYS, 1), -(-len(weekdays) // BLOCK_DAYS))
    drawn = np.concatenate([rest[b : b + BLOCK_DAYS] for b in blocks])[: len(weekdays)]
    return np.maximum(0, np.rint(mean + drawn))


def event_offset(counts: np.ndarray, mean: np.ndarray, alpha: float, duration: int, index: int) -> int:
    """Where an event begins: a day after a calm week if there is one."""
    calm = (counts < QUIET_RATIO * mean) & (counts < mean + QUIET_DEVIATIONS * np.sqrt(mean + alpha * mean * mean))
    every = range(FIRST_OFFSET, max(FIRST_OFFSET + 1, len(counts) - duration - 2))
    quiet = [d for d in every if calm[d - 7 : d].all()]
    usable = quiet or list(every)
    return usable[index % len(usable)]


def inject(counts: np.ndarray, mean: np.ndarray, at: int, duration: int, scenario: str, strength: float) -> np.ndarray:
    """Counts with an event of the declared effect over count and mean alike."""
    factor = np.full(duration, strength)
    if scenario == "gradual_ramp":
        factor = RAMP_START + (strength - RAMP_START) * np.arange(duration) / max(duration - 1, 1)
    out = counts.copy()
    span = slice(at, at + duration)
    out[span] = np.ceil(np.maximum(counts[span] * factor, mean[span] * factor))
    return out


def with_effects(panel: DataFrame, templates: DataFrame, events: DataFrame) -> DataFrame:
    """panel with declared events put into it, as columns: date, district, problem, requests, factor.

    events(district, problem, start, end, scenario, strength) don't overlap in a series. Within an event
    counts and weekday levels are multiplied by its strength, which a gradual ramp reaches on its last
    day, and the larger is rounded up; elsewhere counts stay and factor is 1.
    """
    e = events.select(*[F.col(c).alias(f"_{c}") for c in SERIES], "start", "end", "scenario", "strength")
    same = (F.col("district") == F.col("_district")) & (F.col("problem") == F.col("_problem")) & F.col("date").between(F.col("start"), F.col("end"))
    rows = panel.select("date", *SERIES, "requests").join(e, same, "left")
    ramp = RAMP_START + (F.col("strength") - RAMP_START) * F.datediff("date", "start") / F.greatest(F.datediff("end", "start"), F.lit(1))
    factor = F.when(F.col("start").isNull(), 1.0).when(F.col("scenario") == "gradual_ramp", ramp).otherwise(F.col("strength"))
    mean = F.get("weekday_level", F.weekday("date"))
    counted = rows.join(templates.select(*SERIES, "weekday_level"), SERIES).withColumn("factor", factor)
    raised = F.ceil(F.greatest(F.col("requests") * F.col("factor"), mean * F.col("factor"))).cast("double")
    return counted.select("date", *SERIES, F.when(F.col("start").isNull(), F.col("requests").cast("double")).otherwise(raised).alias("requests"), "factor")


def make_panels(panel: DataFrame, *, seed: int, events: int = 1200, start: date = START, days: int = DAYS, min_median: float = 10.0, level_floor: float = LEVEL_FLOOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel with events, the same panel without, events).

    Sources and templates are made in Spark. The draws of all series come from one generator in the
    order of the plan, so they run on the driver; their size is events times days, whatever the
    size of the history. Events use no random numbers, so both panels share their background.
    """
    spark = panel.sparkSession
    chosen = eligible_series(panel, 70, min_median).select(*SERIES)
    plan = strata(chosen, events).orderBy("i").collect()
    if not plan:
        raise ValueError("No series is long and busy enough to make synthetic panels from")
    history = panel.join(chosen, SERIES, "left_semi").groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("date", F.col("requests").cast("double").alias("n")))).alias("x"))
    used = sorted({(r["district"], r["problem"]) for r in plan})
    wanted = spark.createDataFrame(used, "district string, problem string")
    sources = {}
    for r in history.join(wanted, SERIES, "left_semi").join(series_templates(panel, level_floor), SERIES).toLocalIterator():
        sources[r["district"], r["problem"]] = Source(np.array([p["date"].weekday() for p in r["x"]]), np.array([p["n"] for p in r["x"]]), np.array(r["weekday_level"]), r["alpha"])
    dates = [start + timedelta(days=k) for k in range(days)]
    weekdays = np.array([d.weekday() for d in dates])
    rng = np.random.default_rng(seed)
    with_events, without, labels = [], [], []
    for r in plan:
        source = sources[r["district"], r["problem"]]
        mean = source.level[weekdays]
        counts = background(source, r["generator"], weekdays, rng)
        at = event_offset(counts, mean, source.alpha, r["duration"], r["i"])
        name = f"SYN-{r['i']:04d}-{r['district']}"
        frame = {"date": dates, "district": name, "problem": r["problem"]}
        with_events.append(pd.DataFrame(frame | {"requests": inject(counts, mean, at, r["duration"], r["scenario"], r["strength"])}))
        without.append(pd.DataFrame(frame | {"requests": counts}))
        labels.append((f"EV-{seed}-{r['i']:04d}", name, r["problem"], dates[at], dates[at] + timedelta(days=r["duration"] - 1), r["scenario"], r["generator"]))
    made = [spark.createDataFrame(pd.concat(x, ignore_index=True), PANEL) for x in (with_events, without)]
    return made[0], made[1], spark.createDataFrame(labels, EVENTS)


def make_panel(panel: DataFrame, *, seed: int, events: int = 1200, inject_events: bool = True, **more) -> tuple[DataFrame, DataFrame]:
    """A panel and its events; with inject_events false the panel without them."""
    with_events, without, labels = make_panels(panel, seed=seed, events=events, **more)
    return (with_events if inject_events else without), labels
