"""Dates of trips, windows and mentions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_days(start: Column, end: Column) -> Column:
    """The (month, day) pairs of a window, both ends included, as ``MM-dd`` strings."""
    return F.transform(F.sequence(start, end), lambda d: F.date_format(d, "MM-dd"))


def trip_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def graph_window(start: Column, end: Column, margin: int = 2) -> tuple[Column, Column]:
    return F.date_sub(start, margin), F.date_add(end, margin)


def period_label(date: Column) -> Column:
    """early, mid or late, and the month's name."""
    part = F.when(F.dayofmonth(date) <= 10, "early").when(F.dayofmonth(date) <= 20, "mid").otherwise("late")
    return F.concat_ws(" ", part, F.date_format(date, "MMMM"))


def flex_shifts(start: Column, days: int, today: Column) -> Column:
    """Shifts in days around a departure, without 0 and without departures that aren't after today."""
    return F.filter(F.sequence(F.lit(-days), F.lit(days)), lambda n: (n != 0) & (F.date_add(start, n) > today))


def last_full_months(today: Column, months: int = 12) -> tuple[Column, Column]:
    """First and last day of the complete months before today's."""
    first = F.trunc(today, "MM")
    return F.add_months(first, -months), F.date_sub(first, 1)


def horizon_today(horizon: Column) -> Column:
    """The day a sixteen-day forecast was made, from its last day."""
    return F.date_sub(horizon, 15)


def utc_offset(country: Column, lon: Column, known: dict[str, int]) -> Column:
    """Hours from UTC by country, else by the sun."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else None
    guess = F.bround(F.coalesce(lon, F.lit(0.0)) / 15).cast("int")
    return guess if table is None else F.coalesce(table[F.lower(F.trim(country))], guess)


def compact(date: Column) -> Column:
    """yymmdd, as in links of flight searches."""
    return F.date_format(date, "yyMMdd")


def days_ago(text: Column, today: Column) -> Column:
    """Age in days that a date text tells: relative in English, Italian, German, French or Spanish (a month is 30 days), or absolute.

    Null where it tells none.
    """
    low = F.lower(F.trim(text))
    number = F.regexp_substr(low, F.lit("[0-9]+")).try_cast("int")
    units = [
        (r"\b(?:hours?|hrs?|minutes?|mins?|or[ae]|minut[oi]|stunden?|heures?|horas?)\b", 0),
        (r"\b(?:days?|giorn[oi]|tage?n?|jours?|d[ií]as?)\b", 1),
        (r"\b(?:weeks?|settiman[ae]|wochen?|semaines?|semanas?)\b", 7),
        (r"\b(?:months?|mes[ei]|monate?n?|mois|mes(?:es)?)\b", 30),
        (r"\b(?:years?|ann[oi]|jahre?n?|ans?|años?)\b", 365),
    ]
    relative = None
    for pattern, size in units:
        hit = number.isNotNull() & low.rlike(pattern)
        relative = F.when(hit, number * size) if relative is None else relative.when(hit, number * size)
    date = None
    for form in ("yyyy-MM-dd", "MMM d, yyyy", "d MMM yyyy", "dd/MM/yyyy"):
        found = F.try_to_timestamp(F.trim(text), F.lit(form)).cast("date")
        date = found if date is None else F.coalesce(date, found)
    return F.when(low.isin("today", "oggi", "heute", "hoy"), 0).when(low.isin("yesterday", "ieri", "gestern", "hier", "ayer"), 1).otherwise(F.coalesce(F.datediff(today, date), relative))


def mention_date(text: Column, today: Column) -> Column:
    return F.date_sub(today, days_ago(text, today))
