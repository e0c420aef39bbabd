"""Calendar helpers (Monday = 0, as the scheduler's weekday test)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


def previous_weekday(d: Column) -> Column:
    """Latest weekday strictly before ``d``."""
    back = F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1)
    return F.date_sub(d, back)


def whole_seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, truncated; 0 when end is not after start."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(F.lit(0).cast("bigint"), F.floor(micros / F.lit(1_000_000)).cast("bigint"))
