"""Schemas and settings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import types as T

_S, _TS = T.StringType(), T.TimestampNTZType()

#: The eleven fields of a service request; a source's other fields are never read.
REQUEST = T.StructType(
    [
        T.StructField("unique_key", _S),
        T.StructField("created_date", _TS),
        T.StructField("closed_date", _TS),
        T.StructField("agency", _S),
        T.StructField("agency_name", _S),
        T.StructField("complaint_type", _S),
        T.StructField("descriptor", _S),
        T.StructField("status", _S),
        T.StructField("borough", _S),
        T.StructField("community_board", _S),
        T.StructField("open_data_channel_type", _S),
    ]
)
SAFE_FIELDS = REQUEST.fieldNames()

#: Columns that identify a series of daily counts.
SERIES = ["district", "problem"]
PANEL_COLUMNS = ["date", "district", "problem", "requests"]


@dataclass(frozen=True)
class Thresholds:
    """Settings of a detector. Defaults are the published ones."""

    detector: str = "robust_seasonal"
    history: int = 8
    min_baseline: float = 5.0
    min_delta: float = 10.0
    min_ratio: float = 1.5
    robust_z: float = 3.5
    prediction_z: float = 3.5
    shift_window: int = 3
    spike_ratio: float | None = None
    spike_min_baseline: float = 0.0
    cooldown_days: int = 7


@dataclass(frozen=True)
class Windows:
    """Dates of an artifact: the analysis window, the end of training data and the report cutoffs."""

    start: date = date(2024, 8, 1)
    end: date = date(2026, 7, 31)
    train_end: date = date(2025, 12, 31)
    report_start: date = date(2026, 5, 1)
    inventory_as_of: date = date(2026, 8, 21)


@dataclass(frozen=True)
class Gates:
    """Bounds that a detector meets to be released."""

    min_f1: float = 0.80
    max_false_per_week: float = 5.0
    max_delay_days: float = 2.0
    min_scenario_recall: float = 0.70
    min_review_precision: float = 0.65


#: Community districts of each borough, and its number in boundary codes.
DISTRICTS = {"Manhattan": 12, "Bronx": 12, "Brooklyn": 18, "Queens": 14, "Staten Island": 3}
BOROUGH_CODES = {1: "Manhattan", 2: "Bronx", 3: "Brooklyn", 4: "Queens", 5: "Staten Island"}
#: Series that false alarms are normalised to: 59 districts by 12 problems.
NORMAL_SERIES = 708
