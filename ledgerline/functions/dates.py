"""Calendar expressions (F8, F10-F15). Timestamps are zone-less
(TIMESTAMP_NTZ). Truncations go through DATE arithmetic, which never
consults the session time zone (``date_trunc`` on an NTZ value returns a
zoned TIMESTAMP and shifts day starts on daylight-saving dates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColOrName = Column | str


def _c(c: ColOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _trunc(unit: str, c: ColOrName) -> Column:
    return F.trunc(F.to_date(_c(c)), unit).cast("timestamp_ntz")


def month_start(c: ColOrName) -> Column:
    return _trunc("month", c)


def week_start(c: ColOrName) -> Column:
    """Monday of the ISO week."""
    return _trunc("week", c)


def day_start(c: ColOrName) -> Column:
    return F.to_date(_c(c)).cast("timestamp_ntz")


def to_date_only(c: ColOrName) -> Column:
    """``CONVERT(Date, ts)``: drop the time part."""
    return F.to_date(_c(c))


def parse_date(c: ColOrName, fmt: str = "M/d/yyyy") -> Column:
    """Text -> date; 1- or 2-digit month/day; unparsable -> NULL."""
    return F.try_to_date(_c(c), fmt)


def year_text(c: ColOrName) -> Column:
    """``SUBSTRING(date, 1, 4)`` of a rendered date."""
    return F.date_format(_c(c), "yyyy")


def year_month_text(c: ColOrName) -> Column:
    """``SUBSTRING(date, 1, 7)`` of a rendered date."""
    return F.date_format(_c(c), "yyyy-MM")


def seconds_between(later: ColOrName, earlier: ColOrName) -> Column:
    """``later - earlier`` as whole seconds. The NTZ difference is a day-time
    interval (wall-clock, zone-free), exposed as bigint seconds;
    ``timestamp_diff`` would go through the session zone and gain or lose
    an hour across daylight-saving changes."""
    return (_c(later) - _c(earlier)).cast("interval second").cast("bigint")


def shift_months(c: ColOrName, n: Column | int) -> Column:
    """``ts - n * interval '1 month'``."""
    months = n if isinstance(n, Column) else F.lit(n)
    return _c(c) - F.make_ym_interval(F.lit(0), months.cast("int"))
