"""Calendar keys as plain date expressions, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_end(day: Column, minus_quarters: Column | int = 0) -> Column:
    """Last day of the quarter holding ``day``, moved back by whole quarters."""
    back = minus_quarters if isinstance(minus_quarters, Column) else F.lit(minus_quarters)
    months = (F.lit(2) - F.lit(3) * back).cast("int")
    return F.last_day(F.add_months(F.trunc(day, "quarter"), months))


def quarter_index(day: Column) -> Column:
    """Running quarter number; consecutive quarters differ by one."""
    return F.year(day) * 4 + F.quarter(day)


def quarter_of_index(index: Column) -> Column:
    """Last day of the quarter with this running number."""
    year = F.floor((index - 1) / 4).cast("int")
    return F.last_day(F.make_date(year, ((index - 4 * year) * 3).cast("int"), F.lit(1)))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def quarter_days(day: Column) -> Column:
    return F.datediff(quarter_end(day), F.trunc(day, "quarter")) + 1


def friday_week(day: Column) -> Column:
    """The Friday closing the Saturday-to-Friday week of ``day``."""
    return F.date_add(F.trunc(F.date_add(day, 2), "week"), 4)


def rebalance_period(day: Column, frequency: str) -> Column:
    if frequency == "weekly":
        return friday_week(day)
    if frequency == "monthly":
        return F.last_day(day)
    raise ValueError("frequency is weekly or monthly")


def last_completed_month_end(day: Column) -> Column:
    return F.when(day == F.last_day(day), day).otherwise(F.last_day(F.add_months(day, -1)))
