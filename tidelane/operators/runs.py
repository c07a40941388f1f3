"""Roll-ups and checks of a table of repeated measurement runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nearly_equal, per_second, ratio
from .running import medians


def grouped_stats(runs: DataFrame, keys: list[str], metrics: list[str], population: bool = False, places: int | None = None) -> DataFrame:
    """n and, for each metric, mean, median, min, max and standard deviation (0 for one run) a group.

    Medians are exact, by selection: no task holds a group's values.
    """

    def show(c: Column) -> Column:
        return c if places is None else F.round(c, places)

    out = [F.count("*").alias("n")]
    for m in metrics:
        dev = F.stddev_pop(m) if population else F.coalesce(F.stddev_samp(m), F.lit(0.0))
        out += [show(F.avg(m)).alias(f"{m}_mean"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), show(dev).alias(f"{m}_stddev")]
    stats = runs.groupBy(*keys).agg(*out)
    middle = medians(runs, keys, metrics).select(*[F.col(k).alias(f"{k}_m") for k in keys], *[show(F.col(m)).alias(f"{m}_median") for m in metrics])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_m")) for k in keys], F.lit(True))
    return stats.join(middle, same, "left").select(*keys, "n", *[f"{m}_{x}" for m in metrics for x in ("mean", "median", "min", "max", "stddev")])


def ratio_to_baseline(stats: DataFrame, on: list[str], metric: str, baseline: Column) -> DataFrame:
    """``stats`` plus speedup: the metric of the baseline row with the same ``on``, over its own."""
    base = stats.where(baseline).select(*on, F.col(metric).alias("baseline_"))
    return stats.join(base, on, "left").withColumn("speedup", ratio(F.col("baseline_"), F.col(metric))).drop("baseline_")


def with_throughput(runs: DataFrame) -> DataFrame:
    return runs.withColumn("records_per_second", per_second(F.col("rows_accepted"), F.col("total_ms")))


def enriched(rows: DataFrame, probes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with the columns of ``probes`` that has the same keys; of several the last by ``order``."""
    more = [c for c in probes.columns if c not in keys]
    one = probes.groupBy(*keys).agg(F.max_by(F.struct(*more), F.struct(F.col(order).isNotNull(), order)).alias("last_"))  # combined before rows move
    return rows.join(one.select(*keys, "last_.*"), keys, "left")


def latest_batch(runs: DataFrame, batch: str = "batch_utc") -> DataFrame:
    """The rows of the largest batch name."""
    newest = runs.agg(F.max(batch).alias("newest_"))
    return runs.join(F.broadcast(newest), F.col(batch) == F.col("newest_")).drop("newest_")  # one row


def only_batch(runs: DataFrame, asked: str | None = None, batch: str = "batch_utc") -> DataFrame:
    """The rows of the asked batch, or of the only one; raises if it is not there or there are several."""
    if asked is None:
        names = [r[0] for r in runs.select(batch).distinct().limit(2).collect()]
        if len(names) != 1:
            raise ValueError(f"{'several' if names else 'no'} batches; name one")
        asked = names[0]
    rows = runs.where(F.col(batch) == asked)
    if rows.isEmpty():
        raise ValueError(f"no batch {asked}")
    return rows


def completeness(runs: DataFrame, keys: list[str], threads: list[int], runs_each: int) -> DataFrame:
    """(keys, thread_count, expected, actual) of groups that do not have the expected number of runs."""
    want = runs.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(t) for t in threads])).alias("thread_count"))
    got = runs.groupBy(*keys, "thread_count").agg(F.count("*").alias("actual"))
    out = want.join(got, [*keys, "thread_count"], "left").select(*keys, "thread_count", F.lit(runs_each).cast("bigint").alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return out.where("actual <> expected")


def stability(runs: DataFrame, keys: list[str], result: str = "result_count", metric: str = "average_speed_mph", parity: Column | None = None) -> DataFrame:
    """A row a group: distinct results, range of the metric, share of runs in parity, PASS or FAIL and why."""
    ok = F.lit(1.0) if parity is None else parity.cast("double")
    out = runs.groupBy(*keys).agg(
        F.count_distinct(result).alias("distinct_results"), F.count_if(F.col(metric).isNull()).alias("nulls_"), F.min(metric).alias("metric_min"), F.max(metric).alias("metric_max"), F.avg(ok).alias("parity_rate")
    )
    reason = F.when(F.col("distinct_results") != 1, "results differ").when((F.col("nulls_") > 0) | ~nearly_equal(F.col("metric_min"), F.col("metric_max")), "averages differ").when(F.col("parity_rate") < 1, "parity failed")
    return out.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("status", F.when(F.col("reason") == "", "PASS").otherwise("FAIL")).drop("nulls_")


def parity(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows that differ: keys that one side lacks, or values further apart than the tolerance."""
    x = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(1).alias("in_a"))
    y = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(1).alias("in_b"))
    same = F.lit(True)
    for v in values:
        same = same & F.coalesce((F.col(f"{v}_a").isNull() & F.col(f"{v}_b").isNull()) | nearly_equal(F.col(f"{v}_a").cast("double"), F.col(f"{v}_b").cast("double"), tolerance), F.lit(False))
    j = x.join(y, keys, "full_outer")
    return j.where(F.col("in_a").isNull() | F.col("in_b").isNull() | ~same).drop("in_a", "in_b")


def topn_signatures(ranked: DataFrame, run: str = "run_number") -> DataFrame:
    """(run, signature): a run's ranked rows as one text; lists are as long as n."""
    part = F.concat_ws("|", "rank", "link_id", "record_count", F.format_string("%.6f", "average_speed_mph"))
    sig = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("s")))), lambda x: x["s"]), ";")
    return ranked.groupBy(run).agg(sig.alias("signature"))


def pivot_modes(stats: DataFrame, modes: list[str], value: str, *keys: str) -> DataFrame:
    return stats.groupBy(*keys).pivot("mode", modes).agg(F.first(value))


def thread_series(stats: DataFrame, subset: str, mode: str, value: str) -> DataFrame:
    """(thread_count, value) by number of threads."""
    rows = stats.where((F.col("subset_label") == subset) & (F.col("mode") == mode))
    return rows.select(F.col("thread_count").cast("int").alias("thread_count"), value).orderBy("thread_count")


def quality_constant(logs: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """A row a group: whether each counter has one value over all repeats."""
    return logs.groupBy(*keys).agg(*[(F.count_distinct(c) == 1).alias(f"{c}_constant") for c in counters])
