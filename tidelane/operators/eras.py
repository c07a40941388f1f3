"""Hotspots, peaks and comparisons of eras."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from .aggregates import link_speeds, summary
from .filters import in_borough, time_window
from .running import numbered

#: (name, first second, second after the last)
ERAS = (("2020-2022", 1577836800, 1640995200), ("2022-2024", 1640995200, 1704067200), ("2024-2026", 1704067200, 1767225600))


def slow_links(traffic: DataFrame, borough: str, threshold: float) -> DataFrame:
    """Links of a borough whose average speed is below the threshold."""
    return link_speeds(traffic.where(in_borough(borough))).where(F.col("average_speed_mph") < threshold)


def recurring_peaks(traffic: DataFrame, threshold: float, hours: tuple[int, ...] = (7, 8, 9, 16, 17, 18), min_days: int = 3) -> DataFrame:
    """(link_id, slow_days) of links below the threshold in a peak hour on at least ``min_days`` days (UTC)."""
    hour, day = F.expr("timestamp_epoch_seconds div 3600 % 24"), F.expr("timestamp_epoch_seconds div 86400")
    slow = traffic.where(hour.isin(*hours) & (F.col("speed_mph") < threshold)).select("link_id", day.alias("day")).distinct()
    return slow.groupBy("link_id").agg(F.count("*").alias("slow_days")).where(F.col("slow_days") >= min_days)


def in_eras(traffic: DataFrame, eras: DataFrame) -> DataFrame:
    """``traffic`` with column era, a row for each of ``eras`` (era, start_epoch, end_epoch; half open) that its time is in; rows in none are left out.

    Eras may overlap. They are laid out by day, so rows meet eras by an equal day before the bounds are tested,
    and a table of any number of eras can be joined.
    """
    day = F.expr("explode(sequence(start_epoch div 86400, (end_epoch - 1) div 86400))")
    days = eras.where("start_epoch < end_epoch").select("era", "start_epoch", "end_epoch", day.alias("era_day"))
    at = F.col("timestamp_epoch_seconds")
    met = (F.expr("timestamp_epoch_seconds div 86400") == F.col("era_day")) & (at >= F.col("start_epoch")) & (at < F.col("end_epoch"))
    return traffic.join(days, met).drop("era_day", "start_epoch", "end_epoch")


def with_era(traffic: DataFrame, eras: tuple[tuple[str, int, int], ...] = ERAS) -> DataFrame:
    """``traffic`` in the given eras, as ``in_eras``; the scan is asked for their whole span alone."""
    span = min((e[1] for e in eras), default=0), max((e[2] for e in eras), default=1) - 1
    table = traffic.sparkSession.createDataFrame(list(eras), "era string, start_epoch long, end_epoch long")
    return in_eras(time_window(traffic, *span), table)


def era_summary(traffic: DataFrame, eras: tuple[tuple[str, int, int], ...] = ERAS, places: int | None = None) -> DataFrame:
    return summary(with_era(traffic, eras), "era", places=places)


def corridor_by_era(traffic: DataFrame, eras: tuple[tuple[str, int, int], ...] = ERAS) -> DataFrame:
    """A row a corridor (link_name), a column of average speed an era."""
    return with_era(traffic, eras).groupBy("link_name").pivot("era", [e[0] for e in eras]).agg(F.avg("speed_mph"))


def era_changes(traffic: DataFrame, eras: tuple[tuple[str, int, int], ...] = ERAS) -> DataFrame:
    """(link_name, era, record_count, average_speed_mph, change): change against the corridor's era before."""
    by = with_era(traffic, eras).groupBy("link_name", "era").agg(F.count("*").alias("record_count"), F.avg("speed_mph").alias("average_speed_mph"))
    before = F.lag("average_speed_mph").over(Window.partitionBy("link_name").orderBy("era"))
    return by.withColumn("change", F.col("average_speed_mph") - before)


def hotspots(traffic: DataFrame) -> DataFrame:
    """Counts and average speeds by link, by borough, by corridor and by hour bucket, in one pass over grouping sets.

    grouped_by names the key of a row, so a null key is told from the keys that the row is not grouped by.
    """
    t = traffic.select("link_id", "borough", "link_name", F.expr("timestamp_epoch_seconds div 3600").alias("hour_bucket"), "speed_mph")
    keys = [F.col(c) for c in ("link_id", "borough", "link_name", "hour_bucket")]
    names = F.concat(*[F.when(F.grouping(k) == 0, k).otherwise("") for k in ("link_id", "borough", "link_name", "hour_bucket")])
    return t.groupingSets([[k] for k in keys], *keys).agg(names.alias("grouped_by"), F.count("*").alias("record_count"), F.avg("speed_mph").alias("average_speed_mph"))


def hotspot_share(traffic: DataFrame, threshold: float, key: str = "link_name") -> DataFrame:
    """(key, slow_share, rank): the share of rows below the threshold, the largest first; equal shares have one rank, and ranks are dense."""
    by = stored(traffic.groupBy(key).agg(F.round(F.avg((F.col("speed_mph") < threshold).cast("double")), 9).alias("slow_share")), "shares")
    ranks = numbered(by, "slow_share", "rank_", descending=True).withColumnRenamed("slow_share", "share_")
    return by.join(ranks, F.col("slow_share").eqNullSafe(F.col("share_"))).select(key, "slow_share", (F.col("rank_") + 1).cast("int").alias("rank"))


def hour_profile(traffic: DataFrame) -> DataFrame:
    """(hour, record_count, average_speed_mph) by hour of day, UTC."""
    return traffic.groupBy(F.expr("timestamp_epoch_seconds div 3600 % 24").alias("hour")).agg(F.count("*").alias("record_count"), F.avg("speed_mph").alias("average_speed_mph"))
