"""Predicates over traffic rows. Each takes and returns a DataFrame."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import borough_code_of


def speed_below(traffic: DataFrame, threshold: float) -> DataFrame:
    return traffic.where(F.col("speed_mph") < threshold)


def in_borough(name: str) -> Column:
    """A known name compares codes; any other compares the text, case and all."""
    code = borough_code_of(name)
    return F.col("borough_code") == code if code > 0 else F.col("borough") == name


def borough_speed_below(traffic: DataFrame, borough: str, threshold: float) -> DataFrame:
    return traffic.where(in_borough(borough) & (F.col("speed_mph") < threshold))


def link(traffic: DataFrame, link_id: int) -> DataFrame:
    return traffic.where(F.col("link_id") == link_id)


def link_range(traffic: DataFrame, a: int, b: int) -> DataFrame:
    """Both ends included, in either order."""
    return traffic.where(F.col("link_id").between(min(a, b), max(a, b)))


#: Columns that hold the time once more, as a scan can use it: the stored timestamp, and the day that folders are named by.
STORED_TIME, STORED_DAY = "event_time", "event_day"


def between_epochs(columns: list[str], a: int, b: int) -> Column:
    """Whether the time is between two epoch seconds, both included, in either order.

    Epoch seconds are mostly made of a stored timestamp, and a scan knows nothing of them. Where ``columns`` have
    STORED_TIME or STORED_DAY, their bounds are asked for as well, and reach the scan. The day skips folders of
    a copy ``write_by_day``; by a stored timestamp Spark's reader skips row groups only if it has a time zone.
    """
    lo, hi = min(a, b), max(a, b)
    out = F.col("timestamp_epoch_seconds").between(lo, hi)
    if STORED_TIME in columns and max(abs(lo), abs(hi)) < _LATEST:
        out &= (F.col(STORED_TIME) >= _stamp(lo)) & (F.col(STORED_TIME) < _stamp(hi + 1))
    if STORED_DAY in columns and max(abs(lo), abs(hi)) < _LATEST:
        out &= F.col(STORED_DAY).between(_stamp(lo).cast("date"), _stamp(hi).cast("date"))
    return out


#: The last second of the year 9999.
_LATEST = 253402300799


def _stamp(epoch: int) -> Column:
    return F.lit(datetime(1970, 1, 1) + timedelta(seconds=epoch)).cast("timestamp_ntz")


def time_window(traffic: DataFrame, a: int, b: int) -> DataFrame:
    """Epoch seconds, both ends included, in either order; see ``between_epochs`` for what reaches the scan."""
    return traffic.where(between_epochs(traffic.columns, a, b))


def matching(traffic: DataFrame, predicate: Column) -> DataFrame:
    return traffic.where(predicate)


def link_in_window(traffic: DataFrame, link_id: int, a: int, b: int) -> DataFrame:
    return time_window(link(traffic, link_id), a, b)
