"""Cleaning and small arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schemas import BOROUGHS

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
STAMP = r"^(\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2})"


def trim(c: Column) -> Column:
    """Without ASCII blanks at both ends."""
    return F.regexp_replace(c, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def lower(c: Column) -> Column:
    return F.lower(c)


def to_int(c: Column) -> Column:
    """A whole 32-bit number, or null; out of range is null."""
    return trim(c).try_cast("int")


def to_long(c: Column) -> Column:
    return trim(c).try_cast("bigint")


def to_double(c: Column) -> Column:
    """A finite decimal number, or null: no type suffixes, no hexadecimals, no words, no overflow."""
    t = trim(c)
    n = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def stamp_text(c: Column) -> Column:
    """Without a final Z and what follows the first dot."""
    return F.regexp_replace(F.regexp_replace(trim(c), r"Z$", ""), r"\..*$", "")


def to_epoch(c: Column) -> Column:
    """Seconds since 1970 of a date and time read as UTC, or null; text after the seconds is ignored, dates before 1970 are null."""
    text = F.regexp_extract(stamp_text(c), STAMP, 1)
    at = F.when(text != "", F.regexp_replace(text, "T", " ")).try_cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)
    return F.when(seconds >= 0, seconds)


def epoch_of(c: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def borough_code(c: Column) -> Column:
    """1 to 5 by name or short name, any case; -1 for others and null."""
    names = F.create_map(*[F.lit(x) for code, own in BOROUGHS.items() for name in own for x in (name, code)])
    return F.coalesce(names[F.lower(trim(c))], F.lit(-1)).cast("short")


def borough_code_of(name: str) -> int:
    key = name.strip().lower()
    return next((code for code, own in BOROUGHS.items() if key in own), -1)


def filled_code(code: Column, borough: Column) -> Column:
    """The code, or that of the text where it is unknown."""
    return F.when((F.coalesce(code, F.lit(-1)) < 0) & (F.coalesce(borough, F.lit("")) != ""), borough_code(borough)).otherwise(F.coalesce(code, F.lit(-1))).cast("short")


def valid_core(link_id: Column, speed: Column, travel: Column, epoch: Column) -> Column:
    """Whether a traffic row can be used."""
    ok = (link_id >= 0) & (speed >= 0) & ~F.isnan(speed) & (travel >= 0) & ~F.isnan(travel) & (epoch > 0)
    return F.coalesce(ok, F.lit(False))


def suspicious_speed(speed: Column) -> Column:
    return F.coalesce((speed < 0) | (speed > 120), F.lit(False))


def suspicious_travel(travel: Column) -> Column:
    return F.coalesce(travel < 0, F.lit(False))


def hour_bucket(epoch: str = "timestamp_epoch_seconds") -> Column:
    return F.expr(f"{epoch} div 3600")


def geo_point(lat: Column, lon: Column) -> Column:
    """A point where both numbers parse, else null."""
    a, b = to_double(lat), to_double(lon)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("latitude"), b.alias("longitude")))


def bad_number(c: Column) -> Column:
    """Text that is there but is no number."""
    return (F.coalesce(trim(c), F.lit("")) != "") & to_double(c).isNull()


def identified(license_number: Column, business_name: Column) -> Column:
    return (F.coalesce(license_number, F.lit("")) != "") | (F.coalesce(business_name, F.lit("")) != "")


def per_second(rows: Column, ms: Column) -> Column:
    """Rows a second; null where no time passed."""
    return F.when(ms > 0, rows / (ms / 1000.0))


def ratio(base: Column, other: Column) -> Column:
    """base / other; null where other is not positive."""
    return F.when(other > 0, base / other)


def nearly_equal(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) < tolerance
