"""Date helpers for target periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyman.functions.money import col


def period_end(period_type: str | Column, period_start: str | Column) -> Column:
    """daily → start; weekly → start + 6 days; monthly → start + 1 month − 1 day
    (month end clamps: Jan 31 → Feb 28 → Feb 27, as date + interval does)."""
    t, s = col(period_type), col(period_start)
    return (F.when(t == "daily", s)
            .when(t == "weekly", F.date_add(s, 6))
            .when(t == "monthly", F.date_sub(F.add_months(s, 1), 1)))


def period_days(period_type: str | Column, period_start: str | Column) -> Column:
    """All days of a target period as an array (at most 31 entries)."""
    return F.sequence(col(period_start), period_end(period_type, period_start))
