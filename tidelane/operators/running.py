"""Running sums, ranks and exact medians over ranges of an order, so that no task gets all rows of a table or group."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored

#: Error of the approximate percentiles that bracket a median, as a share of the rows.
BRACKET_ERROR = 0.001


def with_running_sum(df: DataFrame, weight: str, name: str, order: list[Column], *keys: str) -> DataFrame:
    """``df`` plus ``name``: the sum of ``weight`` over the earlier rows of the same ``keys`` by ``order``, stored.

    Rows are dealt to ranges of keys and order, summed a range, and each range starts from the sum of those
    before it: what stands in one window is a range, or one row a range. Rows of one place in the order should
    be one row, as they share a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).withColumn("range_", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    sums = dealt.groupBy("range_", *keys).agg(F.sum(weight).alias("sum_"))
    if keys:
        earlier = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(F.col("range_").alias("r_"), *[F.col(k).alias(f"{k}_k") for k in keys], F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("start_"))
    else:  # a row a range, spark.sql.shuffle.partitions of them at most
        found = sorted((r["range_"], r["sum_"]) for r in sums.collect())
        before = accumulate((s for _, s in found), initial=0)
        starts = df.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(found, before)], "r_ int, start_ long")
    inside = Window.partitionBy("range_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("before_", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"{k}_k")), keys, F.col("range_") == F.col("r_"))
    return own.join(starts, same).withColumn(name, F.col("start_") + F.col("before_")).drop("range_", "r_", "start_", "before_", *[f"{k}_k" for k in keys])


def numbered(df: DataFrame, column: str, name: str, descending: bool = False) -> DataFrame:
    """(column, name): the distinct values of ``column``, null among them, and their place in rising or falling order, from 0; null comes first, or last if falling."""
    order = F.col(column).desc() if descending else F.col(column).asc()
    return with_running_sum(df.select(column).distinct().withColumn("one_", F.lit(1)), "one_", name, [order]).drop("one_")


def medians(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(*keys, *metrics): the exact median of each metric a group, null for none; of an even number the mean of the middle two. NaN counts as the largest.

    Approximate percentiles, whose state is bounded, bracket the middle; rows below the bracket are counted, and
    only the values inside are counted one by one and summed up in their order. A middle that lies outside its
    bracket is sought again between the least and the largest value, so the result is exact.
    """
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric_"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x_")).select(*keys, "x_.metric_", "x_.v").where("v is not null")
    by = [*keys, "metric_"]
    near = F.percentile_approx("v", F.array(F.lit(0.5 - 3 * BRACKET_ERROR), F.lit(0.5 + 3 * BRACKET_ERROR)), F.lit(round(1 / BRACKET_ERROR)))
    bounds = long.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), near.alias("near"))
    few = F.col("n") < round(4 / BRACKET_ERROR)
    bounds = stored(bounds.select(*by, "n", "least", "most", F.when(few, F.col("least")).otherwise(F.col("near")[0]).alias("lo"), F.when(few, F.col("most")).otherwise(F.col("near")[1]).alias("hi")), "brackets")
    found = _middles(long, by, bounds)
    missed = bounds.join(found.select(*[F.col(k).alias(f"{k}_f") for k in by]), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_f")) for k in by]), "left_anti")
    if not missed.isEmpty():
        found = found.unionByName(_middles(long, by, missed.withColumns({"lo": F.col("least"), "hi": F.col("most")})))
    return found.groupBy(*keys).pivot("metric_", metrics).agg(F.max("median"))


def _middles(long: DataFrame, by: list[str], bounds: DataFrame) -> DataFrame:
    """(*by, median) of the groups of ``bounds`` whose middle lies from lo to hi."""
    b = bounds.select(*[F.col(k).alias(f"{k}_b") for k in by], "n", "lo", "hi")
    at = long.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in by])).select(*by, "n", "lo", "hi", "v")
    # one row for all values below, one for each inside
    place = F.when(F.col("v") < F.col("lo"), F.lit(None)).otherwise(F.col("v"))
    counts = at.where(F.col("v") <= F.col("hi")).groupBy(*by, "n", place.alias("v")).agg(F.count("*").alias("count_"))
    summed = with_running_sum(counts, "count_", "below", [F.col("v").asc_nulls_first()], *by)
    end = F.col("below") + F.col("count_")
    lower, upper = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    hit = summed.groupBy(*by).agg(*[F.max(F.when((F.col("below") < p) & (p <= end), F.col("v"))).alias(name) for name, p in (("lower_", lower), ("upper_", upper))])
    return hit.where("lower_ is not null and upper_ is not null").select(*by, ((F.col("lower_") + F.col("upper_")) / 2).alias("median"))
