"""Summaries, counts by key and the slowest recurring links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hour_bucket
from .running import numbered


def mean(c: str, places: int | None = None) -> Column:
    """Average, 0 for no rows; rounded if asked."""
    out = F.coalesce(F.avg(c), F.lit(0.0))
    return out if places is None else F.round(out, places)


def summary(rows: DataFrame, *keys: str, places: int | None = None) -> DataFrame:
    """Count and averages of any rows, over all or a key: one row with zeros for none."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("record_count"), mean("speed_mph", places).alias("average_speed_mph"), mean("travel_time_seconds", places).alias("average_travel_time_seconds")
    )


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("record_count"))


def count_by(rows: DataFrame, key: str | Column, name: str) -> DataFrame:
    return rows.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias("record_count"))


def count_by_link(traffic: DataFrame) -> DataFrame:
    return count_by(traffic, "link_id", "link_id")


def count_by_borough(traffic: DataFrame) -> DataFrame:
    return count_by(traffic, "borough_code", "borough_code")


def count_by_hour(traffic: DataFrame) -> DataFrame:
    return count_by(traffic, hour_bucket(), "hour_bucket")


def count_by_parcel(rows: DataFrame, key: str = "bbl") -> DataFrame:
    """Rows a parcel; empty parcel numbers are left out."""
    return count_by(rows.where(F.col(key) != ""), key, key)


def link_speeds(traffic: DataFrame, min_samples: int = 1, *groups: str) -> DataFrame:
    """Count and average speed a link (and group) with at least ``min_samples`` rows."""
    by = traffic.groupBy(*groups, "link_id").agg(F.count("*").alias("record_count"), F.avg("speed_mph").alias("average_speed_mph"))
    return by.where(F.col("record_count") >= min_samples)


def top_slowest(traffic: DataFrame, n: int, min_samples: int = 1) -> DataFrame:
    """The n slowest links with their rank; ties go by link_id."""
    if n <= 0:
        raise ValueError("n must be positive")
    top = link_speeds(traffic, min_samples).orderBy("average_speed_mph", "link_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("average_speed_mph", "link_id")))


def top_slowest_by(traffic: DataFrame, group: str, n: int, min_samples: int = 1) -> DataFrame:
    """The n slowest links of each group: links are ranked, not rows, so a group is as large as its links."""
    order = Window.partitionBy(group).orderBy("average_speed_mph", "link_id")
    return link_speeds(traffic, min_samples, group).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def key_counts(**keys: tuple[DataFrame, str | Column]) -> DataFrame:
    """One row: how many distinct values each key has; empty text is none.

    Keys of one DataFrame are counted in one pass over it, as distinct (name, value).
    """
    tables: list[tuple[DataFrame, list[Column]]] = []
    for name, (df, key) in keys.items():
        c = F.struct(F.lit(name).alias("name"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("value"))
        own = next((cs for d, cs in tables if d is df), None)
        if own is None:
            tables.append((df, [c]))
        else:
            own.append(c)
    each = [df.select(F.explode(F.array(*cs)).alias("k")).select("k.name", "k.value").where("value <> ''").distinct() for df, cs in tables]
    counts = reduce(DataFrame.unionAll, each).groupBy("name").agg(F.count("*").alias("n"))
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for name in keys])


def time_bounds(traffic: DataFrame) -> DataFrame:
    return traffic.agg(F.min("timestamp_epoch_seconds").alias("min_epoch"), F.max("timestamp_epoch_seconds").alias("max_epoch"))


def link_names(traffic: DataFrame) -> DataFrame:
    """(link_name, link_name_id): dense ids by name, from 0; a null name has the least."""
    return numbered(traffic, "link_name", "link_name_id").withColumn("link_name_id", F.col("link_name_id").cast("int"))


def dictionary_encoded(traffic: DataFrame) -> DataFrame:
    """``traffic`` plus link_name_id; a null name has an id of its own, the least."""
    names = link_names(traffic).withColumnRenamed("link_name", "name_")
    return traffic.join(names, traffic.link_name.eqNullSafe(names.name_)).drop("name_")
