"""Calendar functions. Instants are timestamps in a session that runs in UTC; wall clocks belong to a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"


def local_day(at: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def weekday(day: Column) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(day) - 1).cast("long")


def instant(day: Column, clock: Column, zone: str = ZONE) -> Column:
    """The instant of a wall clock "HH:MM". In the hour that spring skips it is an hour later than elsewhere."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock, F.lit(":00"))), zone)


def next_monday(day: Column) -> Column:
    """Strictly after day."""
    return F.next_day(day, "MON")


def slot_label(at: Column, zone: str = ZONE) -> Column:
    """"Mon, Jun 15, 9:00 AM PDT"."""
    local = F.from_utc_timestamp(at, zone)
    hours = (F.unix_timestamp(local) - F.unix_timestamp(at)) / 3600
    return F.concat(F.date_format(local, "EEE, MMM d, h:mm a"), F.when(hours == -7, " PDT").otherwise(" PST"))


def human_day(day: Column) -> Column:
    return F.date_format(day, "EEEE, MMMM d")


def utc_day(at: Column) -> Column:
    return F.to_date(at)


def deadline(at: Column, hours: int) -> Column:
    return at + F.expr(f"INTERVAL {hours} HOURS")


def week_days(monday: Column, n: int = 6) -> Column:
    """array<date> from Monday on."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_add(monday, i))
