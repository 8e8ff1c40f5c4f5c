"""Choice of a detector on a validation panel, and one test on a locked panel."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators.detectors import counts_from, detect, hybrid_from, robust_from
from ..operators.episodes import match_events, merge_episodes
from ..operators.features import count_history, prepared, robust_history
from ..operators.panel import eligible_series
from ..schemas import Gates, Thresholds
from .synthetic import make_panels

#: The registered candidates, as differences from the defaults.
CANDIDATES = [
    Thresholds(history=8, robust_z=4.0),
    Thresholds(history=13, robust_z=4.0),
    Thresholds(history=26, robust_z=4.0),
    Thresholds(detector="nb_conformal", history=13, min_ratio=1.4),
    Thresholds(detector="nb_conformal", history=26, min_ratio=1.4, prediction_z=3.0),
    Thresholds(detector="nb_conformal", history=26, min_ratio=1.4, prediction_z=3.0, min_delta=12),
    Thresholds(detector="nb_conformal", history=26, min_ratio=1.4),
    Thresholds(detector="nb_conformal", history=26, min_ratio=1.4, min_delta=15, spike_ratio=1.95, spike_min_baseline=40),
    Thresholds(detector="hybrid_nb_ewma", history=13, min_ratio=1.4),
]
#: How plain a detector is, for ties; what is added to the seed of the locked panel.
COMPLEXITY = {"robust_seasonal": 0, "nb_conformal": 1, "hybrid_nb_ewma": 2}
LOCKED_SEED = 24000
METRICS = ["precision", "recall", "f1", "false_alerts_per_week", "median_detection_delay_days"]


def configuration_name(t: Thresholds) -> str:
    z = t.robust_z if t.detector == "robust_seasonal" else t.prediction_z
    name = f"{t.detector}-h{t.history}-z{z:g}-d{t.min_delta:g}"
    return name if t.spike_ratio is None else f"{name}-sr{t.spike_ratio:g}-b{t.spike_min_baseline:g}"


def protocol_hash(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Features:
    """History features of one panel, computed once for all candidates."""

    def __init__(self, panel: DataFrame) -> None:
        self.panel = panel
        self.rows = prepared(panel).cache()
        self.counts: DataFrame | None = None
        self.robust: dict[int, DataFrame] = {}

    def alerts(self, t: Thresholds) -> DataFrame:
        if t.detector == "robust_seasonal":
            if t.history not in self.robust:
                self.robust[t.history] = robust_history(self.rows, t.history).cache()
            return robust_from(self.robust[t.history], t)
        if t.detector in ("nb_conformal", "hybrid_nb_ewma"):
            if self.counts is None:
                self.counts = count_history(self.rows).cache()
            return (counts_from if t.detector == "nb_conformal" else hybrid_from)(self.counts, t)
        return detect(self.panel, t)

    def release(self) -> None:
        for df in (self.rows, self.counts, *self.robust.values()):
            if df is not None:
                df.unpersist()


def evaluate(panel: Features, control: Features, events: DataFrame, t: Thresholds) -> dict:
    """Metrics of one configuration: a few rows reach the driver."""
    start, end = panel.rows.agg(F.min("date"), F.max("date")).first()
    found = merge_episodes(panel.alerts(t), t.cooldown_days).cache()
    matched = match_events(found, events).cache()
    row = m.episode_metrics(matched, found, start, end).first().asDict()
    row["scenario_recall"] = {r["scenario"]: round(r["recall"], 3) for r in m.scenario_recall(matched).orderBy("scenario").collect()}
    quiet = merge_episodes(control.alerts(t), t.cooldown_days)
    row["false_alerts_per_week"] = m.control_rate(quiet, control.rows).first()["false_alerts_per_week"]
    intervals = m.bootstrap_intervals(m.counts_by_series(matched, found))
    found.unpersist()
    matched.unpersist()
    row = {k: round(v, 2 if k in METRICS[3:] else 3) if isinstance(v, float) else v for k, v in row.items()}
    return {"name": configuration_name(t), "detector": t.detector, "history": t.history, "metrics": row, "confidence_intervals": intervals}


def meets(row: dict, g: Gates) -> bool:
    x = row["metrics"]
    weakest = min(x["scenario_recall"].values(), default=0)
    return x["f1"] >= g.min_f1 and x["false_alerts_per_week"] <= g.max_false_per_week and x["median_detection_delay_days"] <= g.max_delay_days and weakest >= g.min_scenario_recall


def choose(rows: list[dict], g: Gates) -> int:
    """Place of the best candidate of those that meet the gates (of all, if none does); the first of equals."""

    def value(i: int) -> tuple:
        x = rows[i]["metrics"]
        return (x["f1"], -x["false_alerts_per_week"], min(x["scenario_recall"].values(), default=0), -COMPLEXITY.get(rows[i]["detector"], 3))

    usable = [i for i, r in enumerate(rows) if meets(r, g)] or list(range(len(rows)))
    return max(usable, key=value)


def choose_row(rows: DataFrame, g: Gates) -> DataFrame:
    """The chosen one of rows(place, f1, false_alerts_per_week, median_detection_delay_days, weakest, complexity), by the rule of choose()."""
    passes = (F.col("f1") >= g.min_f1) & (F.col("false_alerts_per_week") <= g.max_false_per_week) & (F.col("median_detection_delay_days") <= g.max_delay_days) & (F.col("weakest") >= g.min_scenario_recall)
    return rows.withColumn("passes", passes).orderBy(F.desc("passes"), F.desc("f1"), "false_alerts_per_week", F.desc("weakest"), "complexity", "place").limit(1)


def _run(panel: DataFrame, seed: int, events: int, configurations: list[Thresholds], **more) -> list[dict]:
    with_events, without, labels = make_panels(panel, seed=seed, events=events, **more)
    a, b = Features(with_events), Features(without)
    rows = [evaluate(a, b, labels, t) for t in configurations]
    a.release()
    b.release()
    return rows


def candidate_rows(panel: DataFrame, seed: int = 311, events: int = 60, configurations: list[Thresholds] | None = None, **more) -> DataFrame:
    """One row a candidate: its metrics on the validation panel, and whether it is chosen."""
    rows = _run(panel, seed, events, configurations or CANDIDATES, **more)
    best = choose(rows, Gates())
    flat = [(r["name"], r["detector"], *[float(r["metrics"][k]) for k in METRICS], r["metrics"]["scenario_recall"], i == best) for i, r in enumerate(rows)]
    return panel.sparkSession.createDataFrame(flat, "name string, detector string, " + ", ".join(f"{k} double" for k in METRICS) + ", scenario_recall map<string,double>, chosen boolean")


@dataclass(frozen=True)
class Splits:
    """Date ranges of training, validation and locked data. With dates_apart, each panel's templates
    come from history before its own range; without, both panels use the whole history and differ by seed."""

    train: tuple[date, date] = (date(2024, 8, 1), date(2025, 12, 31))
    validation: tuple[date, date] = (date(2026, 1, 1), date(2026, 4, 30))
    locked: tuple[date, date] = (date(2026, 5, 1), date(2026, 7, 31))
    dates_apart: bool = False


def run_backtest(panel: DataFrame, seed: int = 311, events: int | None = None, splits: Splits | None = None, gates: Gates | None = None, **more) -> dict:
    """Chooses a candidate on the validation panel and tests it once on the locked panel."""
    s, g = splits or Splits(), gates or Gates()
    eligible = eligible_series(panel, 70, more.get("min_median", 10.0)).count()
    if not eligible:
        return dict.fromkeys(METRICS, 0.0) | {"injections": 0, "scenario_recall": {}, "confidence_intervals": {}, "selected_model": "", "candidates": [], "protocol_sha256": "", "passed": False}
    n = events or min(1200, max(60, 4 * eligible))
    first = panel.where(F.col("date") <= F.lit(s.train[1])) if s.dates_apart else panel
    second = panel.where(F.col("date") <= F.lit(s.validation[1])) if s.dates_apart else panel
    rows = _run(first, seed, n, CANDIDATES, **more)
    best = choose(rows, g)
    locked = _run(second, seed + LOCKED_SEED, n, [CANDIDATES[best]], **more)[0]
    protocol = {
        "version": "2.0.0", "splits": {k: [str(d) for d in v] for k, v in (("train", s.train), ("validation", s.validation), ("locked_test", s.locked))},
        "dates_apart": s.dates_apart, "seeds": [seed, seed + LOCKED_SEED], "events": n, "candidates": [asdict(t) for t in CANDIDATES], "selected": rows[best]["name"],
    }
    out = {k: locked["metrics"][k] for k in [*METRICS, "scenario_recall"]}
    return out | {"injections": n, "confidence_intervals": locked["confidence_intervals"], "selected_model": rows[best]["name"], "selected": CANDIDATES[best], "candidates": rows, "protocol_sha256": protocol_hash(protocol), "passed": meets(locked, g)}
