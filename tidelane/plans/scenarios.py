"""Runs of named queries from a table of parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P

SCHEMA = "scenario_name string, query_type string, threshold double, start_epoch long, end_epoch long, borough string, top_n int, min_link_samples int"
QUERIES = ("ingest_only", "summary", "speed_below", "time_window", "borough_speed_below", "link_id", "link_range", "top_n_slowest")


def _needed(given: dict, *names: str) -> list:
    missing = [n for n in names if given.get(n) is None]
    if missing:
        raise ValueError(f"{given.get('query_type')}: {', '.join(missing)} missing")
    return [given[n] for n in names]


def predicate(columns: list[str], query_type: str, **given) -> Column | None:
    """Which rows of traffic with ``columns`` a named query counts, None for all; unknown names and missing parameters raise ValueError."""
    given = {**given, "query_type": query_type}
    if query_type in ("ingest_only", "summary", "top_n_slowest"):
        return None
    if query_type == "speed_below":
        return F.col("speed_mph") < _needed(given, "threshold")[0]
    if query_type == "time_window":
        return P.between_epochs(columns, *_needed(given, "start_epoch", "end_epoch"))
    if query_type == "borough_speed_below":
        borough, threshold = _needed(given, "borough", "threshold")
        return P.in_borough(borough) & (F.col("speed_mph") < threshold)
    if query_type == "link_id":
        return F.col("link_id") == _needed(given, "link_id")[0]
    if query_type == "link_range":
        a, b = _needed(given, "link_start", "link_end")
        return F.col("link_id").between(min(a, b), max(a, b))
    raise ValueError(f"unknown query {query_type}")


def query(traffic: DataFrame, query_type: str, places: int | None = None, **given) -> DataFrame:
    """Count and averages of the rows that a named query selects, or the slowest links; unknown names and missing parameters raise ValueError."""
    wanted = predicate(traffic.columns, query_type, **given)
    if query_type == "ingest_only":
        return A.count(traffic)
    if query_type == "top_n_slowest":
        n, least = _needed({**given, "query_type": query_type}, "top_n", "min_link_samples")
        return A.top_slowest(traffic, n, least)
    return A.summary(traffic if wanted is None else traffic.where(wanted), places=places)


def read_scenarios(spark: SparkSession, path: str) -> list[dict]:
    """The rows of a parameter file; blanks are unset. Columns are found by their names, and those of SCHEMA that a file lacks are unset."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    fields = [f.split() for f in SCHEMA.split(", ")]
    found = {c.strip().lower(): c for c in rows.columns}
    picked = [(F.trim(F.col(f"`{found[n]}`")) if n in found else F.lit(None)).cast(t).alias(n) for n, t in fields]
    return [r.asDict() for r in rows.select(*picked).where("scenario_name is not null").collect()]


def run_scenarios(traffic: DataFrame, scenarios: list[dict], places: int | None = None) -> DataFrame:
    """(scenario_name, record_count, average_speed_mph, average_travel_time_seconds), a row a scenario; top_n_slowest counts its links.

    All scenarios are counted in one pass: each is a condition of its own aggregates, and rows that none of them
    wants are left out before. With top_n_slowest among them links are summed up first, then all of them.
    """
    if not scenarios:
        return traffic.sparkSession.createDataFrame([], "scenario_name string, record_count long, average_speed_mph double, average_travel_time_seconds double")
    given = [{k: v for k, v in s.items() if k not in ("query_type", "scenario_name")} for s in scenarios]
    wanted = [predicate(traffic.columns, s["query_type"], **g) for s, g in zip(scenarios, given)]
    if all(w is not None for w in wanted):
        traffic = traffic.where(reduce(lambda a, b: a | b, wanted))
    measures = ("speed_mph", "travel_time_seconds")
    parts, totals, out = [], [], []
    for i, (s, g, w) in enumerate(zip(scenarios, given, wanted)):
        held = F.lit(True) if w is None else w
        name, nothing = F.lit(s["scenario_name"]).alias("scenario_name"), [F.lit(None).cast("double")] * 2
        if s["query_type"] == "top_n_slowest":
            n, least = _needed({**g, "query_type": "top_n_slowest"}, "top_n", "min_link_samples")
            if n <= 0:
                raise ValueError("n must be positive")
            totals.append(F.least(F.count_if(F.col("rows_") >= least), F.lit(n)).alias(f"n{i}"))
            means = nothing
        else:
            parts += [F.count_if(held).alias(f"n{i}"), *[F.sum(F.when(held, F.col(m))).alias(f"{m}{i}") for m in measures], *[F.count(F.when(held, F.col(m))).alias(f"{m}_n{i}") for m in measures]]
            totals += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (f"n{i}", *[f"{m}{i}" for m in measures], *[f"{m}_n{i}" for m in measures])]
            means = [F.when(F.col(f"{m}_n{i}") > 0, F.col(f"{m}{i}") / F.col(f"{m}_n{i}")).otherwise(0.0) for m in measures]
            means = nothing if s["query_type"] == "ingest_only" else means if places is None else [F.round(m, places) for m in means]
        out.append(F.struct(name, F.col(f"n{i}").cast("bigint").alias("record_count"), means[0].alias("average_speed_mph"), means[1].alias("average_travel_time_seconds")))
    by_link = any(s["query_type"] == "top_n_slowest" for s in scenarios)
    sums = traffic.groupBy("link_id").agg(F.count("*").alias("rows_"), *parts).agg(*totals) if by_link else traffic.agg(*parts)
    return sums.select(F.explode(F.array(*out)).alias("s")).select("s.*")
