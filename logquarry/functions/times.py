"""Wall times, zones and instants. An instant is a long of milliseconds since 1970 UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
BIN_MS = 600_000
HISTOGRAM_BUCKETS = 72
MIN_BUCKET_MS = 1000


def month_number(name: Column) -> Column:
    """1 to 12 for a month's English short name, 0 otherwise."""
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")


def wall_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, fraction: Column | None = None) -> Column:
    """A time without a zone, or null if it isn't one; the fraction is cut or padded to microseconds."""
    micro = F.rpad(F.substring(F.coalesce(fraction, F.lit("")), 1, 6), 6, "0") if fraction is not None else F.lit("000000")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit("."), micro)
    return F.when(second.cast("int") < 60, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz"))


def stamp(day: Column, clock: Column) -> Column:
    """The wall time of a day, year first with or without separators, and a clock such as 15:40:43.971."""
    digits = F.translate(day, "-/", "")
    part = lambda text, k, n: F.substring(text, k, n)
    return wall_time(part(digits, 1, 4), part(digits, 5, 2), part(digits, 7, 2), part(clock, 1, 2), part(clock, 4, 2), part(clock, 7, 2), part(clock, 10, 6))


def offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC for ``Z``, ``+hh:mm`` or ``+hhmm``; null for other texts."""
    text = F.trim(zone)
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    minutes = F.substring(text, 2, 2).cast("int") * 60 + F.substring(F.translate(text, ":", ""), 4, 2).cast("int")
    return F.when(text == "Z", 0).when(text.rlike(r"^[+-]\d\d:?\d\d$"), sign * minutes).cast("int")


def wall_ms(wall: Column) -> Column:
    """The wall time read as if it were UTC."""
    return F.unix_millis(wall.cast("timestamp"))


def nearest_ms(wall: Column) -> Column:
    """The nearest millisecond, halves away from zero, of a wall time read as if it were UTC; ``wall_ms`` has the one it is in."""
    micros = F.unix_micros(wall.cast("timestamp"))
    return F.call_function("div", micros + F.when(micros < 0, -500).otherwise(500), F.lit(1000).cast("long"))


def local_offset(wall: Column, zone: str) -> Column:
    """Minutes east of UTC that a region's clock had at a wall time, summer time included."""
    return ((F.unix_seconds(wall.cast("timestamp")) - F.unix_seconds(F.to_utc_timestamp(wall.cast("timestamp"), zone))) / 60).cast("int")


def bin_of(ms: Column, size: int = BIN_MS) -> Column:
    """The bin of an instant in whole numbers; before 1970 it is counted towards zero, as ``/`` and ``//`` of SQL count."""
    return F.call_function("div", ms.cast("long"), F.lit(size).cast("long"))


def format_ms(ms: Column, offset: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` in the zone ``offset`` minutes east of UTC."""
    return F.date_format(F.timestamp_millis(ms + offset.cast("long") * 60_000), "yyyy-MM-dd HH:mm:ss.SSS")


def zone_text(offset: Column) -> Column:
    size = F.abs(offset)
    return F.concat(F.when(offset < 0, "-").otherwise("+"), F.format_string("%02d", F.floor(size / 60).cast("int")), F.lit(":"), F.format_string("%02d", (size % 60).cast("int")))
