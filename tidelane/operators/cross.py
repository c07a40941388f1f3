"""Joins across traffic, garages and buildings: counts are taken before they are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import count_by, count_by_parcel


def shared_parcels(garages: DataFrame, buildings: DataFrame, key: str = "bbl") -> DataFrame:
    """Parcels that both have, with their counts, by parcel."""
    g, b = count_by_parcel(garages, key).withColumnRenamed("record_count", "garage_count"), count_by_parcel(buildings, key).withColumnRenamed("record_count", "building_count")
    return g.join(b, key).orderBy(key)


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).cast("string") != "").select(key).distinct()


def shared_parcel_count(garages: DataFrame, buildings: DataFrame, key: str = "bbl") -> DataFrame:
    return _keys(garages, key).join(_keys(buildings, key), key, "left_semi").agg(F.count("*").alias("shared_keys"))


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return _keys(a, key).union(_keys(b, key)).distinct()


def key_intersection_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return _keys(a, key).intersect(_keys(b, key)).agg(F.count("*").alias("shared_keys"))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def borough_rollup(traffic: DataFrame, garages: DataFrame) -> DataFrame:
    """Rows of both by borough, 0 where one has none, by code; unknown boroughs are a group."""
    t, g = count_by(traffic, "borough_code", "borough_code"), count_by(garages, "borough_code", "borough_code").withColumnRenamed("record_count", "garages")
    out = t.join(g, "borough_code", "full_outer")
    zero = F.lit(0).cast("bigint")
    return out.select("borough_code", F.coalesce("record_count", zero).alias("traffic_record_count"), F.coalesce("garages", zero).alias("garage_record_count")).orderBy("borough_code")
