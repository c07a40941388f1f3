"""Lookups in count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(counts: DataFrame, key: str, value) -> DataFrame:
    """One row: the count of a key, 0 if it is not there."""
    return counts.where(F.col(key) == F.lit(value)).agg(F.coalesce(F.max("record_count"), F.lit(0)).alias("record_count"))


def bulk_lookup(keys: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """The count of each of ``keys``, 0 for those that are not there. The optimiser broadcasts the smaller side if its size allows."""
    return keys.join(counts, key, "left").select(key, F.coalesce("record_count", F.lit(0)).alias("record_count"))


def audit(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: the sum of all counts, the rows of a scan, and whether they agree."""
    a, b = counts.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("lookup_hits")), rows.agg(F.count("*").alias("scan_rows"))
    return a.crossJoin(b).withColumn("agree", F.col("lookup_hits") == F.col("scan_rows"))


def index_families(traffic: DataFrame, garages: DataFrame | None = None, buildings: DataFrame | None = None, families: tuple[str, ...] = ("link", "bbl", "borough")) -> dict[str, DataFrame]:
    """The asked count tables by name; lazy, so one that is not used costs nothing."""
    from . import aggregates as A

    out: dict[str, DataFrame] = {}
    if "link" in families:
        out["link"] = A.count_by_link(traffic)
    if "borough" in families:
        out["borough"] = A.count_by_borough(traffic)
    if "bbl" in families and garages is not None and buildings is not None:
        out |= {"garage_bbl": A.count_by_parcel(garages), "building_bbl": A.count_by_parcel(buildings)}
    return out
