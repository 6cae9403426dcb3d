"""Column helpers: dates, money, contact handles, labels, scoring curves."""

from .contact import normalize_email, normalize_phone
from .dates import day_gap, month_gap, month_of, parse_time, seconds_between, whole_days
from .labels import churn_band, lifecycle_at_month_end, lifecycle_now, rfm_segment, score_band
from .money import money, to_paise
from .scoring import clamp, linear, mean_observed, py_round

__all__ = [
    "churn_band", "clamp", "day_gap", "lifecycle_at_month_end", "lifecycle_now", "linear",
    "mean_observed", "money", "month_gap", "month_of", "normalize_email",
    "normalize_phone", "parse_time", "py_round", "rfm_segment", "score_band",
    "seconds_between", "to_paise", "whole_days",
]
