"""Date expressions: lenient parsing, interval keys, period grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar interval names and the text form of their key.
INTERVALS = {
    "daily": ("day", "yyyyMMdd"),
    "monthly": ("month", "yyyyMM"),
    "annually": ("year", "yyyy"),
}


def lenient_date(col: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(col, fmt)


def earliest_date(*cols: Column) -> Column:
    """Earliest of several text dates; texts that do not parse are ignored."""
    parsed = [lenient_date(c) for c in cols]
    return F.least(*parsed) if len(parsed) > 1 else parsed[0]


def earliest_year(*cols: Column) -> Column:
    """Year of the earliest date as text, 'Unknown' when no date parses."""
    return F.coalesce(F.year(earliest_date(*cols)).cast("string"), F.lit("Unknown"))


def year_bucket(year: Column, minimum: int, unknown: str = "Unknown") -> Column:
    return (
        F.when(year.isNull(), F.lit(unknown))
        .when(year < minimum, F.lit(f"<{minimum}"))
        .otherwise(year.cast("string"))
    )


def paper_year(paper_url: Column, fallback_date: Column) -> Column:
    """Year from a ``YYMM.NNNNN`` paper number, else from a date text."""
    yymm = F.regexp_extract(paper_url, r"(\d{2})(\d{2})\.\d{4,5}", 1)
    return F.when(yymm != "", F.lit(2000) + yymm.cast("int")).otherwise(
        F.year(lenient_date(fallback_date))
    )


def snapshot_time(file_name: Column) -> Column:
    """Timestamp from a ``yyyyMMddHHmmss.html`` file name."""
    return F.try_to_timestamp(F.substring(file_name, 1, 14), F.lit("yyyyMMddHHmmss"))


def interval_start(ts: Column, frequency: str) -> Column:
    return F.date_trunc(INTERVALS[frequency][0], ts)


def interval_key(ts: Column, frequency: str) -> Column:
    return F.date_format(ts, INTERVALS[frequency][1])


def year_month(date_text: Column) -> Column:
    return F.array_join(F.slice(F.split(date_text, "-"), 1, 2), "-")


def period_start(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("date")


def period_grid(first: Column, last: Column, unit: str) -> Column:
    """Array of period starts from the period of ``first`` to the period of ``last``."""
    step = F.expr(f"interval 1 {unit}")
    return F.sequence(period_start(first, unit), period_start(last, unit), step)


def next_periods(last: Column, n: int, unit: str = "month") -> Column:
    """The ``n`` period starts after the period of ``last``."""
    start = period_start(last, unit) + F.expr(f"interval 1 {unit}")
    stop = period_start(last, unit) + F.expr(f"interval {n} {unit}")
    return F.sequence(start.cast("date"), stop.cast("date"), F.expr(f"interval 1 {unit}"))
