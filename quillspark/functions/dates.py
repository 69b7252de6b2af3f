"""Date functions as Column expressions. Dates in tables are ISO strings; a bad one gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_iso(x: Column) -> Column:
    """The ISO date at the start, unchecked; empty if there is none."""
    return F.regexp_extract(F.trim(F.coalesce(x, F.lit(""))), r"^\d{4}-\d{2}-\d{2}", 0)


def strict(x: Column) -> Column:
    """A valid date or null; one digit will do for month and day."""
    return F.try_to_date(F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), x), "yyyy-M-d")


def long_form(x: Column) -> Column:
    """Like 7 May 2026; what is no date stays; null is empty."""
    return F.coalesce(F.date_format(strict(x), "d MMMM yyyy"), x, F.lit(""))


def week_ending(day: Column) -> Column:
    """The Saturday on or after; for a Sunday the day before."""
    return F.when(F.dayofweek(day) == 1, F.date_sub(day, 1)).otherwise(F.next_day(F.date_sub(day, 1), "SAT"))


def week_start(ending: Column) -> Column:
    return F.date_sub(ending, 6)


def slash_date(x: Column) -> Column:
    """2026/5/7 as 2026-05-07; empty if it is no such date."""
    part = lambda i: F.regexp_extract(x, r"(\d{4})/(\d{1,2})/(\d{1,2})", i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).otherwise("")


def days_covered(given: Column, start: Column, end: Column) -> Column:
    """The given number unless missing or 0; else the days from start to end, 1 at least; 0 for bad dates."""
    return F.coalesce(F.nullif(given, F.lit(0)), F.greatest(F.lit(1), F.datediff(strict(end), strict(start)) + 1), F.lit(0))


def coverage(start: Column, end: Column) -> Column:
    """Range as text: one day, within a month, within a year, or across years."""
    s, e = strict(start), strict(end)
    same = lambda f: F.date_format(s, f) == F.date_format(e, f)
    f = F.date_format
    return (
        F.when(s.isNull() | e.isNull(), F.concat_ws("–", start, end))
        .when(s == e, f(s, "d MMMM yyyy"))
        .when(same("yyyy-MM"), F.concat(f(s, "d"), F.lit("–"), f(e, "d MMMM yyyy")))
        .when(same("yyyy"), F.concat(f(s, "d MMMM"), F.lit(" – "), f(e, "d MMMM yyyy")))
        .otherwise(F.concat(f(s, "d MMMM yyyy"), F.lit(" – "), f(e, "d MMMM yyyy")))
    )
