"""Times. An engine has one time zone, given where it matters; nothing reads the machine's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts of imported times, in the order in which they are tried.
IMPORT_LAYOUTS = ["y-M-d H:m:s", "y/M/d H:m:s", "y-M-d'T'H:m:s", "y-M-d H:m", "y/M/d H:m"]

# Meal slots; both ends belong to a slot.
MEAL_SLOTS = [("breakfast", "05:00", "09:30"), ("lunch", "10:30", "13:30"), ("dinner", "17:00", "19:30"), ("late_night", "21:00", "23:59")]


def parsed_time(text: Column, layouts: list[str] = IMPORT_LAYOUTS) -> Column:
    """The first layout that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in layouts))


def time_of_day(at: Column) -> Column:
    """Microseconds since midnight of the session's time zone."""
    return (F.hour(at) * 3600 + F.minute(at) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def meal_slot(at: Column, slots: list[tuple[str, str, str]] = MEAL_SLOTS) -> Column:
    """The first slot that holds the time of day, ends included, to the microsecond."""
    micros = lambda t: (int(t[:2]) * 3600 + int(t[3:5]) * 60) * 1_000_000
    out = F.lit(None).cast("string")
    for name, start, end in reversed(slots):
        out = F.when(time_of_day(at).between(micros(start), micros(end)), F.lit(name)).otherwise(out)
    return out


def last_week(day: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the week before `day`."""
    monday = F.date_sub(F.trunc(day, "week"), 7)
    return monday, F.date_add(monday, 6)


def last_month(day: Column) -> tuple[Column, Column]:
    """First and last day of the month before `day`."""
    first = F.add_months(F.trunc(day, "month"), -1)
    return first, F.last_day(first)


def frame_time(start: Column, frame: Column, fps: Column) -> Column:
    """When a frame was taken; 25 frames a second where the rate is unknown or not positive."""
    rate = F.when(fps > 0, fps).otherwise(F.lit(25.0))
    return F.timestamp_micros((F.unix_micros(start) + F.round(frame / rate * 1_000_000)).cast("long"))


def utc_text(at: Column, zone: str) -> Column:
    """Local time of `zone` as 2024-01-31T23:59:59Z in UTC."""
    return F.date_format(F.to_utc_timestamp(at, zone), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def on_day(at: Column, day) -> Column:
    """Whether a time is on `day`, as a half-open range, so that scans can skip by it."""
    start = F.lit(day).cast("date")
    return (at >= start.cast("timestamp")) & (at < F.date_add(start, 1).cast("timestamp"))
