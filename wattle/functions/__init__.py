"""Column expressions: every function takes and returns ``Column``s and stays
inside whole-stage codegen (no Python UDFs)."""

from wattle.functions.arith import clip_zero, safe_ratio, unit_convert, when_set
from wattle.functions.calendar import (
    calendar_columns, holiday_flag, month_bucket, season, third_of_year,
    weekday_collapse, weekday_monday0, weekend_flag,
)
from wattle.functions.target import expm1_safe, log1p_safe
from wattle.functions.weather import feels_like, humidity_base10, humidity_magnus

__all__ = [
    "clip_zero", "safe_ratio", "unit_convert", "when_set",
    "calendar_columns", "holiday_flag", "month_bucket", "season", "third_of_year",
    "weekday_collapse", "weekday_monday0", "weekend_flag",
    "expm1_safe", "log1p_safe",
    "feels_like", "humidity_base10", "humidity_magnus",
]
