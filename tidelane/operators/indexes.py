"""Count tables that are kept: bucketed and sorted by key, looked up by one bucket, refreshed by merging in new rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch
from . import aggregates as A

#: Buckets of a kept table. A lookup reads one of them, so their size is what a lookup costs.
BUCKETS = 64


class KeptCounts:
    """(key, record_count) of rows, as a table of the session's catalog whose files stay in the shared folder."""

    def __init__(self, spark: SparkSession, key: str, buckets: int, table: str):
        self.spark, self.key, self.buckets, self.table = spark, key, buckets, table

    @classmethod
    def of(cls, counts: DataFrame, key: str, buckets: int = BUCKETS) -> KeptCounts:
        """Keep ``counts`` (key, record_count)."""
        kept = cls(counts.sparkSession, key, buckets, "")
        kept._write(counts)
        return kept

    def _write(self, counts: DataFrame) -> None:
        name = f"tidelane_counts_{uuid.uuid4().hex}"
        # dealt by key first, so that a bucket is one file
        dealt = counts.select(self.key, "record_count").repartition(self.buckets, self.key)
        dealt.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", scratch(self.spark, name)).saveAsTable(name)
        self.table = name

    def counts(self) -> DataFrame:
        return self.spark.table(self.table)

    def lookup(self, value) -> DataFrame:
        """One row: the count of a key, 0 if it is not there. One bucket is read."""
        return self.counts().where(F.col(self.key) == F.lit(value)).agg(F.coalesce(F.max("record_count"), F.lit(0)).alias("record_count"))

    def lookup_all(self, keys: DataFrame) -> DataFrame:
        """The count of each of ``keys``, 0 for those that are not there. The table itself is not moved."""
        return keys.join(self.counts(), self.key, "left").select(self.key, F.coalesce("record_count", F.lit(0)).alias("record_count"))

    def refresh(self, more: DataFrame) -> None:
        """Add ``more`` (key, record_count), counts of new rows; keys whose count falls to 0 go. Readers of the table as it was keep its files until it is dropped."""
        merged = self.counts().unionByName(more.select(self.key, "record_count")).groupBy(self.key).agg(F.sum("record_count").alias("record_count"))
        old = self.table
        self._write(merged.where("record_count <> 0"))
        self.spark.sql(f"drop table {old}")

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")


def keep_families(traffic: DataFrame | None = None, garages: DataFrame | None = None, buildings: DataFrame | None = None, families: tuple[str, ...] = ("link", "bbl", "borough"), buckets: int = BUCKETS) -> dict[str, KeptCounts]:
    """The asked families as kept tables: link, borough and hour of ``traffic``, bbl of ``garages`` and ``buildings``. What is not asked for is not read."""
    counted: dict[str, tuple[DataFrame, str]] = {}
    if traffic is not None:
        for family, key, count in (("link", "link_id", A.count_by_link), ("borough", "borough_code", A.count_by_borough), ("hour", "hour_bucket", A.count_by_hour)):
            if family in families:
                counted[family] = count(traffic), key
    if "bbl" in families:
        counted |= {name: (A.count_by_parcel(df), "bbl") for name, df in (("garage_bbl", garages), ("building_bbl", buildings)) if df is not None}
    return {name: KeptCounts.of(counts, key, buckets) for name, (counts, key) in counted.items()}
