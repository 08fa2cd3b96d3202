"""Date expressions: report periods (F3) and the Monday-week label (K3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def monday_week_label(ts: Column) -> Column:
    """'YYYY-Www' with Monday weeks and a week 00 before the year's first Monday.

    Week number = floor((day_of_year + 6 - weekday) / 7) with weekday 0 =
    Monday, which equals the C library's %W.
    """
    d = F.to_date(ts)
    week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def period_label(ts: Column, period: str) -> Column:
    """Label of the reporting period an order falls in ('daily' is the default)."""
    if period == "weekly":
        return monday_week_label(ts)
    if period == "monthly":
        return F.date_format(ts, "yyyy-MM")
    return F.date_format(ts, "yyyy-MM-dd")


def sql_period_label(col_sql: str, period: str) -> str:
    if period == "weekly":
        return f"strftime({col_sql}, '%Y-W%W')"
    if period == "monthly":
        return f"strftime({col_sql}, '%Y-%m')"
    return f"strftime({col_sql}, '%Y-%m-%d')"
