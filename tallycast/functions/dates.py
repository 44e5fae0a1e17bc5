"""Date parsing, periods, labels and the holiday calendar as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallycast.config import DATE_FORMATS


SHAPES = {"yyyy": r"\d{4}", "MMMM": "[A-Za-z]{3,}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "dd": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}"}


def shape_of(spark_format: str) -> str:
    """Regular expression of the texts a format can read."""
    parts = re.findall(r"(y+|M+|d+)|(.)", spark_format)
    return "^" + "".join(SHAPES[token] if token else re.escape(sign) for token, sign in parts) + "$"


def to_date_with(text: Column, spark_format: str) -> Column:
    """Date read by one format, else null. A failed parse is dear, so the shape is tested first."""
    parsed = F.try_to_timestamp(text, F.lit(spark_format)).cast("date")
    return F.when(text.rlike(shape_of(spark_format)), parsed)


def parse_date(text: Column) -> Column:
    """First of the known formats that fits, else what the general cast understands.

    The many branches would make one generated method too large for the JVM to compile, so
    they sit in a lambda, which is evaluated branch by branch.
    """
    def first_fit(clean: Column) -> Column:
        tries = [to_date_with(clean, spark_format) for _, spark_format in DATE_FORMATS]
        return F.coalesce(*tries, clean.try_cast("timestamp").cast("date"))

    return F.get(F.transform(F.array(F.trim(text)), first_fit), F.lit(0))


def period_label(date: Column, period: str = "month") -> Column:
    year = F.year(date).cast("string")
    labels = {
        "week": F.concat(F.lit("Week "), F.weekofyear(date).cast("string"), F.lit(", "), year),
        "month": F.date_format(date, "MMMM yyyy"),
        "quarter": F.concat(F.lit("Q"), F.quarter(date).cast("string"), F.lit(" "), year),
        "year": year,
    }
    return labels.get(period, F.date_format(date, "yyyy-MM-dd"))


def date_text(value: Column) -> Column:
    """Date part of a date or of its text; empty text for null."""
    return F.coalesce(F.regexp_extract(value.cast("string"), r"^([^ T]*)", 1), F.lit(""))


def period_end(date: Column, freq: str) -> Column:
    """Label of the period holding the date: the day, the Sunday, or the month's last day."""
    if freq == "W":
        return F.date_add(F.date_trunc("week", date).cast("date"), 6)
    if freq == "M":
        return F.last_day(date)
    return date.cast("date")


def period_sequence(first: Column, last: Column, freq: str) -> Column:
    """All period labels from first to last (both are labels)."""
    if freq == "W":
        return F.sequence(first, last, F.expr("interval 7 days"))
    if freq == "M":
        months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
        return F.transform(months, F.last_day)
    return F.sequence(first, last, F.expr("interval 1 day"))


def step_date(last: Column, step: Column, freq: str) -> Column:
    """Label of the period ``step`` periods after ``last``."""
    if freq == "W":
        return F.date_add(last, step * 7)
    if freq == "M":
        return F.last_day(F.add_months(last, step))
    return F.date_add(last, step)


def horizon_periods(days: int, freq: str) -> int:
    return {"W": max(1, days // 7), "M": max(1, days // 30)}.get(freq, days)


def thanksgiving(year: Column) -> Column:
    """Fourth Thursday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "THU"), 21)


def holiday_dates(year: Column, veterans_day: bool = False) -> list[Column]:
    """US holidays of a year."""
    fixed = [(1, 1), (7, 4), (12, 25), (12, 31)] + ([(11, 11)] if veterans_day else [])
    feast = thanksgiving(year)
    return [*[F.make_date(year, F.lit(month), F.lit(day)) for month, day in fixed], feast, F.date_add(feast, 1)]


def holidays(year: Column, veterans_day: bool = False) -> Column:
    return F.array(*holiday_dates(year, veterans_day))


def is_holiday(date: Column) -> Column:
    return date.isin(*holiday_dates(F.year(date))).cast("int")


def days_to_holiday(date: Column) -> Column:
    """Days to the next holiday; 31 December is one, so the same year always has it."""
    return F.least(*[F.when(day >= date, F.datediff(day, date)) for day in holiday_dates(F.year(date))])
