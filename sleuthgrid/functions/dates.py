"""Dates in the forms that filings and feeds use; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filing_date(text: Column) -> Column:
    """MMDDYYYY."""
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("MMddyyyy")).cast("date"))


def any_date(text: Column) -> Column:
    """The first form that fits: ISO, MM/DD/YYYY, YYYYMMDD."""
    forms = [(r"^\d{4}-\d{2}-\d{2}", "yyyy-MM-dd", 10), (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy", 10), (r"^\d{8}$", "yyyyMMdd", 8)]
    return F.coalesce(*(F.when(text.rlike(p), F.try_to_timestamp(F.substring(text, 1, n), F.lit(f)).cast("date")) for p, f, n in forms))


def expired(day: Column, on: Column) -> Column:
    """Whether the day has passed; null when it isn't known."""
    return day < on


def age_days(day: Column, on: Column) -> Column:
    return F.datediff(on, day)
