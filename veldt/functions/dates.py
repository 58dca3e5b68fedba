"""Dates as sources write them: validity, arithmetic on days and months, and how they are shown in Shanghai.

A date is a text: yyyy-mm-dd (a day up to 31 of a shorter month runs over into the next), a year, a month, or a timestamp that
Spark can read. A timestamp without a zone is in the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"
MACHINE_READABLE = r"^\d{4}(-\d{2}(-\d{2})?)?$"
ZONE = "Asia/Shanghai"
#: What a list shows for an event of which only the day is known (fixed value).
ONLY_A_DAY = "仅披露日期"


def date_only(c: Column) -> Column:
    return c.rlike(DATE_ONLY)


def machine_readable(c: Column) -> Column:
    """A year, a month or a day, as digits and hyphens."""
    return c.rlike(MACHINE_READABLE)


def _day(c: Column) -> Column:
    """The date of a yyyy-mm-dd text, running over; null where the month is over 12 or the day is 0 or over 31."""
    day = F.substring(c, 9, 2).try_cast("int")
    first = F.concat(F.substring(c, 1, 7), F.lit("-01")).try_cast("date")
    return F.when(date_only(c) & day.between(1, 31), F.date_add(first, day - 1))


def is_date(c: Column) -> Column:
    """Whether a text is a date at all; null is none."""
    other = ~date_only(c) & c.rlike(r"^\d{4}") & F.try_to_timestamp(c).isNotNull()
    return F.coalesce(_day(c).isNotNull() | other, F.lit(False))


def day_after(c: Column, days: Column | int) -> Column:
    """The yyyy-mm-dd text some days after another; an error where that is no date."""
    day = _day(c)
    return F.when(day.isNotNull(), F.date_add(day, days).cast("string")).otherwise(F.raise_error(F.concat(F.lit("not a date: "), F.coalesce(c, F.lit("null")))).cast("string"))


def months_before(c: Column, months: int) -> Column:
    """The date some months before a yyyy-mm-dd text; a day that its month lacks runs over, which add_months would clamp."""
    day = _day(c)
    return F.date_add(F.add_months(F.trunc(day, "month"), -months), F.dayofmonth(day) - 1)


def in_year_of(c: Column, snapshot: Column) -> Column:
    """Whether a date's text begins with the year of another."""
    return c.startswith(F.concat(F.substring(snapshot, 1, 4), F.lit("-")))


def before_year_of(c: Column, snapshot: Column) -> Column:
    return c < F.concat(F.substring(snapshot, 1, 4), F.lit("-01-01"))


def _wall(c: Column) -> Column:
    """yyyy-mm-dd hh:mm:ss in Shanghai; null where the text is no date. A day alone is its midnight there.

    A year or a month alone is its first midnight in UTC.
    """
    full = F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01T00:00:00Z"))).when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01T00:00:00Z"))).otherwise(c)
    moved = F.convert_timezone(None, F.lit(ZONE), F.try_to_timestamp(full).cast("timestamp_ntz"))
    return F.when(date_only(c), F.concat(_day(c).cast("string"), F.lit(" 00:00:00"))).when(is_date(c), moved.cast("string"))


def _month_day(wall: Column) -> Column:
    return F.concat_ws("/", F.substring(wall, 6, 2), F.substring(wall, 9, 2))


def shown_date(c: Column) -> Column:
    """Year, month and day; the text itself where it is no date."""
    w = _wall(c)
    part = lambda at, n: F.substring(w, at, n).cast("int").cast("string")
    return F.coalesce(F.concat(part(1, 4), F.lit("年"), part(6, 2), F.lit("月"), part(9, 2), F.lit("日")), c)


def shown_date_time(c: Column) -> Column:
    """mm/dd, with the time unless only the day is known; the text itself where it is no date."""
    w = _wall(c)
    return F.coalesce(F.when(w.isNotNull(), F.when(date_only(c), _month_day(w)).otherwise(F.concat_ws(" ", _month_day(w), F.substring(w, 12, 5)))), c)


def shown_list_time(c: Column) -> Column:
    """The time, or a note that only the day is known; the text itself where it is no date."""
    return F.when(date_only(c), ONLY_A_DAY).otherwise(F.coalesce(F.substring(_wall(c), 12, 5), c))


def shown_sidebar_time(c: Column) -> Column:
    """mm/dd of a day, the time of anything else; the text itself where it is no date."""
    w = _wall(c)
    return F.coalesce(F.when(w.isNotNull(), F.when(date_only(c), _month_day(w)).otherwise(F.substring(w, 12, 5))), c)
