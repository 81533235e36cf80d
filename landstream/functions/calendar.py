"""Calendar columns: leap years, pentads, eight-day slots, epochs and times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def days_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def pentad(ts: Column) -> Column:
    """1 to 73; the leap day joins pentad 12."""
    doy = F.dayofyear(ts)
    shift = F.when(is_leap_year(F.year(ts)) & (doy >= 59), 2).otherwise(1)
    return (F.floor((doy - shift) / 5) + 1).cast("int")


def eight_day_slot(ts: Column) -> Column:
    """1 to 46, each beginning on the same calendar date in all years: the leap day lengthens the slot it is in."""
    doy = F.dayofyear(ts) - F.when(is_leap_year(F.year(ts)) & (F.dayofyear(ts) >= 60), 1).otherwise(0)
    return (F.floor((doy - 1) / 8) + 1).cast("int")


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + (seconds.cast("double") * 1_000_000).cast("long"))


#: Seconds from 1970-01-01 00:00 UTC to the three J2000 epochs. TT12 runs 64.184 s ahead of UTC.
EPOCHS = {"UT12": 946728000.0, "TT12": 946727935.816, "UT00": 946684800.0}


def from_j2000(seconds: Column, epoch: str = "TT12") -> Column:
    """Seconds after an epoch to a timestamp, rounded to whole seconds."""
    return F.timestamp_seconds(F.round(seconds + F.lit(EPOCHS[epoch])).cast("long"))


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def tod_slot(ts: Column, n: int) -> Column:
    """Slot of the day, 1 to n, each centred on its nominal time."""
    step = 86400 // n
    return (F.floor((second_of_day(ts) + step // 2) / step) % (86400 // step) + 1).cast("int")


def diurnal_harmonics(ts: Column, n: int) -> list[Column]:
    """[1, cos wt, sin wt, cos 2wt, sin 2wt], the first n of them."""
    t = second_of_day(ts) * F.lit(2 * 3.141592653589793 / 86400)
    return [F.lit(1.0), F.cos(t), F.sin(t), F.cos(2 * t), F.sin(2 * t)][:n]


def window_end(ts: Column, seconds: int, offset: int = 0) -> Column:
    """End of the window (end - seconds, end] that holds ts; ends lie at multiples of `seconds` plus the offset."""
    return F.timestamp_seconds((F.ceil((F.unix_micros(ts) / 1_000_000 - offset) / seconds) * seconds + offset).cast("long"))
