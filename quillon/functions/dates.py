"""Dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Opening hours by day, Sunday first.
HOURS = (
    "Closed", "7:00 AM to 8:00 PM", "7:00 AM to 8:00 PM", "7:00 AM to 8:00 PM", "7:00 AM to 8:00 PM", "7:00 AM to 8:00 PM",
    "9:00 AM to 5:00 PM",
)


def day_index(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def hours_of(day: Column) -> Column:
    return F.get(F.array(*map(F.lit, HOURS)), day_index(day))


def this_year() -> Column:
    return F.year(F.current_date())
