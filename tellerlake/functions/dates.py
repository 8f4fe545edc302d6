"""Calendar rules: whole years, month differences, date repair, fiscal attributes, US holidays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def date_key(value: Column) -> Column:
    """YYYYMMDD as int."""
    return (F.year(value) * 10000 + F.month(value) * 100 + F.dayofmonth(value)).cast("int")


def whole_years(since: Column, asof: Column) -> Column:
    """Completed years; compares (month, day), so Feb 29 counts from Mar 1 in common years."""
    not_reached = (F.month(asof) * 100 + F.dayofmonth(asof)) < (F.month(since) * 100 + F.dayofmonth(since))
    return F.year(asof) - F.year(since) - not_reached.cast("int")


def tenure_years(since: Column, asof: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), whole_years(since, asof)), F.lit(0))


def months_apart(since: Column, asof: Column) -> Column:
    """Month difference that ignores the day, at least 0, and 0 for a missing date."""
    months = (F.year(asof) - F.year(since)) * 12 + F.month(asof) - F.month(since)
    return F.coalesce(F.greatest(F.lit(0), months), F.lit(0))


def days_since(since: Column, asof: Column) -> Column:
    return F.datediff(asof, since)


def repair_date(text: Column) -> Column:
    """Strict yyyy-MM-dd; Feb 29 of a common year becomes Feb 28, anything else invalid null."""
    text = text.cast("string")
    parsed = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))
    repaired = F.when(text.rlike(r"^\d{4}-02-29$"), F.concat(F.substring(text, 1, 4), F.lit("-02-28")).try_cast("date"))
    return F.coalesce(parsed, repaired)


def fiscal(value: Column, start_month: int = 1) -> dict[str, Column]:
    """Fiscal year, quarter and month for a fiscal year that starts in ``start_month``."""
    if not 1 <= start_month <= 12:
        raise ValueError("start_month must be 1..12")
    month = (F.month(value) - start_month + 12) % 12 + 1
    return {
        "fiscal_year": F.year(value) - (F.month(value) < start_month).cast("int"),
        "fiscal_quarter": F.floor((month - 1) / 3).cast("int") + 1,
        "fiscal_month": month,
    }


def is_holiday(value: Column) -> Column:
    """New Year, Independence Day, Christmas, Memorial Day, Labor Day, Thanksgiving."""
    month, dom, weekday = F.month(value), F.dayofmonth(value), F.weekday(value)
    fixed = (month * 100 + dom).isin(101, 704, 1225)
    memorial = (month == 5) & (weekday == 0) & (dom >= 25)
    labor = (month == 9) & (weekday == 0) & (dom <= 7)
    thanks = (month == 11) & (weekday == 3) & dom.between(22, 28)
    return fixed | memorial | labor | thanks


def calendar_columns(value: Column, start_month: int = 1) -> dict[str, Column]:
    """The sixteen attributes of a calendar day."""
    return {
        "date_key": date_key(value),
        "date_value": value,
        "day_of_week": F.weekday(value) + 1,
        "day_name": F.date_format(value, "EEEE"),
        "day_of_month": F.dayofmonth(value),
        "day_of_year": F.dayofyear(value),
        "week_of_year": F.weekofyear(value),
        "month_number": F.month(value),
        "month_name": F.date_format(value, "MMMM"),
        "quarter": F.quarter(value),
        "year": F.year(value),
        "is_weekend": F.weekday(value) >= 5,
        "is_holiday": is_holiday(value),
        **fiscal(value, start_month),
    }
