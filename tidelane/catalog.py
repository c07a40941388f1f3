"""Every query by name over the supplied tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import aggregates as A
from .operators import cross as X
from .operators import eras as E
from .operators import filters as P
from .operators import indexes as I
from .operators import lookups as L
from .operators import runs as R
from .plans import scenarios as S
from .sources import files as IO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as traffic: a part is a link, a region a borough."""
    line, supplier, nation, region, part = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region", "part"))
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    joined = joined.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_partkey").alias("link_id"),
        F.col("l_quantity").alias("speed_mph"),
        F.col("l_extendedprice").alias("travel_time_seconds"),
        C.epoch_of(F.col("l_shipdate")).alias("timestamp_epoch_seconds"),
        F.col("r_name").alias("borough"),
        (F.col("r_regionkey") + 1).cast("short").alias("borough_code"),
        F.col("p_name").alias("link_name"),
        F.col("l_shipdate").cast("timestamp_ntz").alias(P.STORED_TIME),
        "l_orderkey",
        "l_linenumber",
    )


def sensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traffic: a user is a link, an event type a borough."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("link_id"), F.col("value").alias("speed_mph"), C.epoch_of(F.col("ts")).alias("timestamp_epoch_seconds"), F.col("event_type").alias("borough"), "event_id", F.col("ts").cast("timestamp_ntz").alias(P.STORED_TIME)
    )


def garages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("bbl"), (F.col("o_custkey") % 4).cast("short").alias("borough_code"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("bbl"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as measurement runs: the flag is the subset, the status the mode, the line number the threads."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("subset_label"),
        F.col("l_linestatus").alias("mode"),
        F.col("l_linenumber").alias("thread_count"),
        F.col("l_orderkey").alias("run_number"),
        F.col("l_extendedprice").alias("query_ms"),
        F.col("l_quantity").alias("total_ms"),
        F.lit(1000).cast("bigint").alias("rows_accepted"),
        F.col("l_suppkey").alias("result_count"),
        F.date_format("l_shipdate", "yyyyMM").alias("batch_utc"),
    )


_TRAFFIC = """traffic as (select l_partkey as link_id, l_quantity as speed_mph, l_extendedprice as travel_time_seconds,
 cast(epoch_us(l_shipdate) // 1000000 as bigint) as timestamp_epoch_seconds, r_name as borough, cast(r_regionkey + 1 as smallint) as borough_code,
 p_name as link_name, l_orderkey, l_linenumber
 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey)"""
_EVENTS = "sensor as (select user_id as link_id, value as speed_mph, cast(epoch_us(ts) // 1000000 as bigint) as timestamp_epoch_seconds, event_type as borough, event_id from events)"
_GARAGES = "garages as (select cast(o_custkey as varchar) as bbl, cast(o_custkey % 4 as smallint) as borough_code from orders)"
_BUILDINGS = "buildings as (select cast(c_custkey as varchar) as bbl from customer)"
_RUNS = """runs as (select l_returnflag as subset_label, l_linestatus as mode, l_linenumber as thread_count, l_orderkey as run_number, l_extendedprice as query_ms,
 l_quantity as total_ms, cast(1000 as bigint) as rows_accepted, l_suppkey as result_count, strftime(l_shipdate, '%Y%m') as batch_utc from lineitem)"""
_MEANS = "count(*) as record_count, coalesce(round(avg(speed_mph), 6), 0.0::double) as average_speed_mph, coalesce(round(avg(travel_time_seconds), 6), 0.0::double) as average_travel_time_seconds"


def _add(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir), and its SQL after the views it names."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            views = [v for k, v in (("traffic", _TRAFFIC), ("sensor", _EVENTS), ("garages", _GARAGES), ("buildings", _BUILDINGS), ("runs", _RUNS)) if k in sql]
            ORACLES[name] = (f"with {', '.join(views)}" + (", " + sql[5:] if sql.startswith("with ") else " " + sql)) if views else sql
        return f

    return register


def _on_traffic(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, sql)(lambda spark, sf_dir: f(traffic(spark, sf_dir)))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in (cols or ("average_speed_mph",))})


# filters: the matching rows
_ROW = ("l_orderkey", "l_linenumber", "link_id", "speed_mph", "travel_time_seconds", "timestamp_epoch_seconds", "borough", "borough_code", "link_name")
_ROWS = "select " + ", ".join(_ROW) + " from traffic where "
_on_traffic("rows_speed_below", _ROWS + "speed_mph < 3", lambda t: P.speed_below(t, 3.0).select(*_ROW))
_on_traffic("rows_borough_speed_below", _ROWS + "borough_code = 3 and speed_mph < 5", lambda t: P.borough_speed_below(t, "Brooklyn", 5.0).select(*_ROW))
_on_traffic("rows_borough_text", _ROWS + "borough = 'ASIA' and speed_mph < 5", lambda t: P.borough_speed_below(t, "ASIA", 5.0).select(*_ROW))
_on_traffic("rows_link", _ROWS + "link_id = 42", lambda t: P.link(t, 42).select(*_ROW))
_on_traffic("rows_link_range", _ROWS + "link_id between 20 and 30", lambda t: P.link_range(t, 30, 20).select(*_ROW))
_on_traffic("rows_time_window", _ROWS + "timestamp_epoch_seconds between 820454400 and 821059200", lambda t: P.time_window(t, 821059200, 820454400).select(*_ROW))
_on_traffic("rows_predicate", _ROWS + "speed_mph > 49 and travel_time_seconds < 50000", lambda t: P.matching(t, (F.col("speed_mph") > 49) & (F.col("travel_time_seconds") < 50000)).select(*_ROW))
_on_traffic("link_in_window", _ROWS + "link_id = 42 and timestamp_epoch_seconds between 800000000 and 900000000", lambda t: P.link_in_window(t, 42, 800000000, 900000000).select(*_ROW))

# summaries, by name
_SUMMARIES = {
    "ingest_only": ("select count(*) as record_count from traffic", {}),
    "summary": (f"select {_MEANS} from traffic", {}),
    "speed_below": (f"select {_MEANS} from traffic where speed_mph < 15", {"threshold": 15.0}),
    "time_window": (f"select {_MEANS} from traffic where timestamp_epoch_seconds between 820454400 and 852076800", {"start_epoch": 852076800, "end_epoch": 820454400}),
    "borough_speed_below": (f"select {_MEANS} from traffic where borough_code = 3 and speed_mph < 15", {"borough": "bk", "threshold": 15.0}),
    "link_id": (f"select {_MEANS} from traffic where link_id = 42", {"link_id": 42}),
    "link_range": (f"select {_MEANS} from traffic where link_id between 100 and 150", {"link_start": 150, "link_end": 100}),
}
for _name, (_sql, _given) in _SUMMARIES.items():
    _on_traffic(_name, _sql, lambda t, n=_name, g=_given: S.query(t, n, PLACES, **g))
_on_traffic("empty_filter", f"select {_MEANS} from traffic where speed_mph < 0", lambda t: A.summary(P.speed_below(t, 0.0), places=PLACES))
_on_traffic("summary_by_borough", f"select borough_code, {_MEANS} from traffic group by borough_code", lambda t: A.summary(t, "borough_code", places=PLACES))
_on_traffic("count_speed_below", "select count(*) as record_count from traffic where speed_mph < 15", lambda t: A.count(P.speed_below(t, 15.0)))
_on_traffic("count_borough_speed_below", "select count(*) as record_count from traffic where borough_code = 4 and speed_mph < 15", lambda t: A.count(P.borough_speed_below(t, "Queens", 15.0)))
_on_traffic("count_time_window", "select count(*) as record_count from traffic where timestamp_epoch_seconds between 820454400 and 852076800", lambda t: A.count(P.time_window(t, 820454400, 852076800)))


@_add("time_window_days", "select count(*) as record_count, round(avg(speed_mph), 6) as average_speed_mph from sensor where timestamp_epoch_seconds between 1704326400 and 1704931199")
def _time_window_days(s: SparkSession, d: str) -> DataFrame:
    """A week of the copy with a folder a day; the others' folders are not read."""
    path = IO.scratch(s, "days")
    IO.write_by_day(sensor_events(s, d), path)
    week = P.time_window(s.read.parquet(path), 1704326400, 1704931199)
    return week.agg(F.count("*").alias("record_count"), F.round(F.avg("speed_mph"), PLACES).alias("average_speed_mph"))


_on_traffic("time_bounds", "select min(timestamp_epoch_seconds) as min_epoch, max(timestamp_epoch_seconds) as max_epoch from traffic", A.time_bounds)

# links
_LINKS = "select link_id, count(*) as record_count, round(avg(speed_mph), 6) as average_speed_mph from traffic group by link_id having count(*) >= "
_on_traffic("link_speeds", _LINKS + "20", lambda t: _rounded(A.link_speeds(t, 20)))
_on_traffic(
    "top_n_slowest",
    "select link_id, record_count, round(s, 6) as average_speed_mph, cast(row_number() over (order by s, link_id) as integer) as rank from (select link_id, count(*) as record_count, avg(speed_mph) as s"
    " from traffic group by link_id having count(*) >= 20 order by s, link_id limit 10)",
    lambda t: _rounded(A.top_slowest(t, 10, 20)),
)
_on_traffic(
    "topn_per_borough",
    "select borough, link_id, record_count, round(s, 6) as average_speed_mph, cast(rn as integer) as rank from (select *, row_number() over (partition by borough order by s, link_id) as rn"
    " from (select borough, link_id, count(*) as record_count, avg(speed_mph) as s from traffic group by borough, link_id having count(*) >= 3)) where rn <= 5",
    lambda t: _rounded(A.top_slowest_by(t, "borough", 5, 3)),
)
_on_traffic("dictionary_names", "select link_name, cast(dense_rank() over (order by link_name) - 1 as integer) as link_name_id from (select distinct link_name from traffic)", A.link_names)
_on_traffic(
    "dictionary_encode",
    "select link_id, min(link_name_id) as link_name_id, count(*) as record_count from traffic join (select link_name, cast(dense_rank() over (order by link_name) - 1 as integer) as link_name_id"
    " from (select distinct link_name from traffic)) using (link_name) group by link_id",
    lambda t: A.dictionary_encoded(t).groupBy("link_id").agg(F.min("link_name_id").alias("link_name_id"), F.count("*").alias("record_count")),
)

# counts by key and lookups
_on_traffic("count_by_link", "select link_id, count(*) as record_count from traffic group by link_id", A.count_by_link)
_on_traffic("count_by_borough", "select borough_code, count(*) as record_count from traffic group by borough_code", A.count_by_borough)
_add("count_by_hour", "select timestamp_epoch_seconds // 3600 as hour_bucket, count(*) as record_count from sensor group by 1")(lambda s, d: A.count_by_hour(sensor_events(s, d)))
_add("count_by_parcel", "select bbl, count(*) as record_count from garages where bbl <> '' group by bbl")(lambda s, d: A.count_by_parcel(garages(s, d)))
_add(
    "distinct_key_counts",
    "select (select count(distinct link_id) from traffic) as links, (select count(distinct borough_code) from traffic) as boroughs, (select count(distinct timestamp_epoch_seconds // 3600) from sensor) as hours,"
    " (select count(distinct bbl) from garages) as garage_parcels, (select count(distinct bbl) from buildings) as building_parcels",
)(
    lambda s, d: (lambda t: A.key_counts(links=(t, "link_id"), boroughs=(t, "borough_code"), hours=(sensor_events(s, d), C.hour_bucket()), garage_parcels=(garages(s, d), "bbl"), building_parcels=(buildings(s, d), "bbl")))(
        traffic(s, d)
    )
)
_on_traffic("lookup_link", "select count(*) as record_count from traffic where link_id = 42", lambda t: L.lookup(A.count_by_link(t), "link_id", 42))
_on_traffic("lookup_miss", "select count(*) as record_count from traffic where link_id = -5", lambda t: L.lookup(A.count_by_link(t), "link_id", -5))
_add("lookup_parcel", "select count(*) as record_count from garages where bbl = '17'")(lambda s, d: L.lookup(A.count_by_parcel(garages(s, d)), "bbl", "17"))
_add("lookup_hour", "select count(*) as record_count from sensor where timestamp_epoch_seconds // 3600 = 473400")(lambda s, d: L.lookup(A.count_by_hour(sensor_events(s, d)), "hour_bucket", 473400))
_add("lookup_bulk", "select bbl, coalesce(n, 0) as record_count from (select distinct bbl from buildings) left join (select bbl, count(*) as n from garages group by bbl) using (bbl)")(
    lambda s, d: L.bulk_lookup(buildings(s, d).distinct(), A.count_by_parcel(garages(s, d)), "bbl")
)
_on_traffic("lookup_audit", "select count(*) as lookup_hits, count(*) as scan_rows, true as agree from traffic", lambda t: L.audit(t, A.count_by_link(t)))
_add("kept_lookup_link", "select count(*) as record_count from traffic where link_id = 42")(lambda s, d: I.keep_families(traffic(s, d), families=("link",))["link"].lookup(42))
_add("kept_lookup_hour", "select count(*) as record_count from sensor where timestamp_epoch_seconds // 3600 = 473400")(lambda s, d: I.keep_families(sensor_events(s, d), families=("hour",))["hour"].lookup(473400))
_add("kept_lookup_miss", "select count(*) as record_count from garages where bbl = 'none'")(lambda s, d: I.keep_families(garages=garages(s, d), families=("bbl",))["garage_bbl"].lookup("none"))
_add("kept_lookup_bulk", "select bbl, coalesce(n, 0) as record_count from (select distinct bbl from buildings) left join (select bbl, count(*) as n from garages group by bbl) using (bbl)")(
    lambda s, d: I.keep_families(garages=garages(s, d), families=("bbl",))["garage_bbl"].lookup_all(buildings(s, d).distinct())
)


@_add("kept_refresh", "select link_id, count(*) as record_count from traffic group by link_id")
def _kept_refresh(s: SparkSession, d: str) -> DataFrame:
    """Slow rows are kept first, the others merged in."""
    t = traffic(s, d)
    kept = I.KeptCounts.of(A.count_by_link(t.where("speed_mph < 25")), "link_id")
    kept.refresh(A.count_by_link(t.where("speed_mph >= 25")))
    return kept.counts()


_add("index_family_link", "select link_id, count(*) as record_count from traffic group by link_id")(lambda s, d: I.keep_families(traffic(s, d), families=("link",))["link"].counts())
_add("index_family_garage_bbl", "select bbl, count(*) as record_count from garages where bbl <> '' group by bbl")(lambda s, d: I.keep_families(garages=garages(s, d), buildings=buildings(s, d), families=("bbl",))["garage_bbl"].counts())
_add("index_family_building_bbl", "select bbl, count(*) as record_count from buildings where bbl <> '' group by bbl")(lambda s, d: I.keep_families(garages=garages(s, d), buildings=buildings(s, d), families=("bbl",))["building_bbl"].counts())
_add("index_family_borough", "select borough_code, count(*) as record_count from traffic group by borough_code")(lambda s, d: L.index_families(traffic(s, d), families=("borough",))["borough"])

# across tables
_SHARED = "from (select bbl, count(*) as g from garages group by bbl) join (select bbl, count(*) as b from buildings group by bbl) using (bbl)"
_add("shared_key_stats", f"select bbl, g as garage_count, b as building_count {_SHARED} order by bbl")(lambda s, d: X.shared_parcels(garages(s, d), buildings(s, d)))
_add("shared_key_count", f"select count(*) as shared_keys {_SHARED}")(lambda s, d: X.shared_parcel_count(garages(s, d), buildings(s, d)))
_add("key_intersect", "select count(*) as shared_keys from (select bbl from garages intersect select bbl from buildings)")(lambda s, d: X.key_intersection_count(garages(s, d), buildings(s, d), "bbl"))
_add("key_union", "select bbl from garages union select bbl from buildings")(lambda s, d: X.key_union(garages(s, d), buildings(s, d), "bbl"))
_add("distinct_hours", "select distinct timestamp_epoch_seconds // 3600 as hour_bucket from sensor")(lambda s, d: X.distinct_keys(sensor_events(s, d).select(C.hour_bucket().alias("hour_bucket")), "hour_bucket"))
_add(
    "borough_rollup",
    "select borough_code, coalesce(t.n, 0) as traffic_record_count, coalesce(g.n, 0) as garage_record_count from (select borough_code, count(*) as n from traffic group by 1) t"
    " full join (select borough_code, count(*) as n from garages group by 1) g using (borough_code) order by borough_code",
)(lambda s, d: X.borough_rollup(traffic(s, d), garages(s, d)))

# hotspots and eras
_ERAS = (("1995-1996", 788918400, 852076800), ("1997-1998", 852076800, 915148800), ("1999-2001", 915148800, 1009843200))
_ERA = "(case when timestamp_epoch_seconds >= 788918400 and timestamp_epoch_seconds < 852076800 then '1995-1996' when timestamp_epoch_seconds >= 852076800 and timestamp_epoch_seconds < 915148800 then '1997-1998' when timestamp_epoch_seconds >= 915148800 and timestamp_epoch_seconds < 1009843200 then '1999-2001' end)"
_on_traffic("borough_slow_links", "select link_id, count(*) as record_count, round(avg(speed_mph), 6) as average_speed_mph from traffic where borough_code = 3 group by link_id having avg(speed_mph) < 20", lambda t: _rounded(E.slow_links(t, "Brooklyn", 20.0)))
_add(
    "recurring_peak",
    "select link_id, count(distinct timestamp_epoch_seconds // 86400) as slow_days from sensor where timestamp_epoch_seconds // 3600 % 24 in (7, 8, 9, 16, 17, 18) and speed_mph < 30 group by link_id having count(distinct timestamp_epoch_seconds // 86400) >= 2",
)(lambda s, d: E.recurring_peaks(sensor_events(s, d), 30.0, min_days=2))
_on_traffic(
    "era_compare",
    f"select link_name, round(avg(speed_mph) filter (where era = '1995-1996'), 6) as \"1995-1996\", round(avg(speed_mph) filter (where era = '1997-1998'), 6) as \"1997-1998\", round(avg(speed_mph) filter (where era = '1999-2001'), 6) as \"1999-2001\""
    f" from (select *, {_ERA} as era from traffic) where era is not null group by link_name",
    lambda t: _rounded(E.corridor_by_era(t, _ERAS), *[f"{e[0]}" for e in _ERAS]),
)
_on_traffic(
    "era_overlap",
    f"select era, {_MEANS} from traffic join (values ('1995-1996', 788918400, 852076800), ('summer 1996', 833587200, 841536000), ('from 1996', 820454400, 1009843200)) as e(era, a, b)"
    " on timestamp_epoch_seconds >= a and timestamp_epoch_seconds < b group by era",
    lambda t: E.era_summary(t, (("1995-1996", 788918400, 852076800), ("summer 1996", 833587200, 841536000), ("from 1996", 820454400, 1009843200)), PLACES),
)
_on_traffic("era_summary", f"select era, {_MEANS} from (select *, {_ERA} as era from traffic) where era is not null group by era", lambda t: E.era_summary(t, _ERAS, PLACES))
_on_traffic(
    "era_changes",
    f"select link_name, era, n as record_count, round(s, 6) as average_speed_mph, round(s - lag(s) over (partition by link_name order by era), 6) as change from (select link_name, {_ERA} as era, count(*) as n, avg(speed_mph) as s from traffic group by 1, 2) where era is not null",
    lambda t: _rounded(E.era_changes(t, _ERAS), "average_speed_mph", "change"),
)
_on_traffic(
    "hotspot_sets",
    "select link_id, borough, link_name, hour_bucket, case when grouping(link_id) = 0 then 'link_id' when grouping(borough) = 0 then 'borough' when grouping(link_name) = 0 then 'link_name' else 'hour_bucket' end as grouped_by, count(*) as record_count, round(avg(speed_mph), 6) as average_speed_mph from (select *, timestamp_epoch_seconds // 3600 as hour_bucket from traffic)"
    " group by grouping sets ((link_id), (borough), (link_name), (hour_bucket))",
    lambda t: _rounded(E.hotspots(t)),
)
_on_traffic(
    "hotspot_share",
    "select link_name, slow_share, cast(dense_rank() over (order by slow_share desc) as integer) as rank from (select link_name, round(avg(case when speed_mph < 15 then 1.0::double else 0.0::double end), 9) as slow_share from traffic group by link_name)",
    lambda t: E.hotspot_share(t, 15.0),
)
_add("hour_profile", "select timestamp_epoch_seconds // 3600 % 24 as hour, count(*) as record_count, round(avg(speed_mph), 6) as average_speed_mph from sensor group by 1")(lambda s, d: _rounded(E.hour_profile(sensor_events(s, d))))
_add(
    "topn_per_hour",
    "select hour, link_id, record_count, round(s, 6) as average_speed_mph, cast(rn as integer) as rank from (select *, row_number() over (partition by hour order by s, link_id) as rn from (select timestamp_epoch_seconds // 3600 % 24 as hour, link_id, count(*) as record_count, avg(speed_mph) as s from sensor group by 1, 2)) where rn <= 3",
)(lambda s, d: _rounded(A.top_slowest_by(sensor_events(s, d).withColumn("hour", F.expr("timestamp_epoch_seconds div 3600 % 24")), "hour", 3)))

# runs
_STATS = "count(*) as n, round(avg(query_ms), 6) as query_ms_mean, round(median(query_ms), 6) as query_ms_median, min(query_ms) as query_ms_min, max(query_ms) as query_ms_max"
_add("grouped_stats", f"select subset_label, mode, {_STATS}, round(coalesce(stddev_samp(query_ms), 0.0), 6) as query_ms_stddev from runs group by subset_label, mode")(lambda s, d: R.grouped_stats(runs(s, d), ["subset_label", "mode"], ["query_ms"], places=PLACES))
_add("grouped_stats_pop", f"select subset_label, mode, {_STATS}, round(stddev_pop(query_ms), 6) as query_ms_stddev from runs group by subset_label, mode")(lambda s, d: R.grouped_stats(runs(s, d), ["subset_label", "mode"], ["query_ms"], True, PLACES))
_add(
    "baseline_ratio",
    "with st as (select subset_label, mode, thread_count, avg(query_ms) as m from runs group by 1, 2, 3) select st.subset_label, st.mode, st.thread_count, round(st.m, 6) as query_ms_mean,"
    " round(b.m / st.m, 6) as speedup from st left join (select * from st where mode = 'F' and thread_count = 1) b on st.subset_label = b.subset_label",
)(
    lambda s, d: _rounded(
        R.ratio_to_baseline(
            runs(s, d).groupBy("subset_label", "mode", "thread_count").agg(F.avg("query_ms").alias("query_ms_mean")), ["subset_label"], "query_ms_mean", (F.col("mode") == "F") & (F.col("thread_count") == 1)
        ),
        "query_ms_mean",
        "speedup",
    )
)
_add("throughput", "select run_number, thread_count, round(case when total_ms > 0 then rows_accepted / (total_ms / 1000.0) end, 6) as records_per_second from runs")(
    lambda s, d: _rounded(R.with_throughput(runs(s, d)), "records_per_second").select("run_number", "thread_count", "records_per_second")
)
_add(
    "enriched",
    "select subset_label, mode, n, newest from (select subset_label, mode, count(*) as n from runs group by 1, 2) left join (select subset_label, mode, batch_utc as newest from (select *, row_number() over (partition by subset_label, mode order by batch_utc desc) as rn from runs) where rn = 1) using (subset_label, mode)",
)(
    lambda s, d: R.enriched(
        runs(s, d).groupBy("subset_label", "mode").agg(F.count("*").alias("n")), runs(s, d).select("subset_label", "mode", F.col("batch_utc").alias("newest")), ["subset_label", "mode"], "newest"
    )
)
_add("latest_batch", "select run_number, thread_count, batch_utc from runs where batch_utc = (select max(batch_utc) from runs)")(lambda s, d: R.latest_batch(runs(s, d)).select("run_number", "thread_count", "batch_utc"))
_add(
    "completeness",
    "select k.subset_label, k.mode, k.thread_count, cast(1500 as bigint) as expected, coalesce(n, 0) as actual from (select * from (select distinct subset_label, mode from runs), (select unnest([1, 2, 4, 8, 16]) as thread_count)) k"
    " left join (select subset_label, mode, thread_count, count(*) as n from runs group by 1, 2, 3) c using (subset_label, mode, thread_count) where coalesce(n, 0) <> 1500",
)(lambda s, d: R.completeness(runs(s, d), ["subset_label", "mode"], [1, 2, 4, 8, 16], 1500))
_add(
    "stability",
    "select *, case when reason = '' then 'PASS' else 'FAIL' end as status from (select run_number, count(distinct thread_count) as distinct_results, min(query_ms) as metric_min, max(query_ms) as metric_max, avg(case when total_ms < 45 then 1.0::double else 0.0::double end) as parity_rate,"
    " case when count(distinct thread_count) <> 1 then 'results differ' when not abs(min(query_ms) - max(query_ms)) < 1e-9 then 'averages differ' when avg(case when total_ms < 45 then 1.0 else 0.0 end) < 1 then 'parity failed' else '' end as reason from runs group by run_number)",
)(lambda s, d: R.stability(runs(s, d), ["run_number"], "thread_count", "query_ms", F.col("total_ms") < 45))
_add(
    "parity",
    "select link_id, a.n as n_a, b.n as n_b from (select link_id, count(*) as n from traffic where speed_mph < 25 group by 1) a full join (select link_id, count(*) as n from traffic where speed_mph >= 25 group by 1) b using (link_id) where a.n is null or b.n is null or a.n <> b.n",
)(
    lambda s, d: R.parity(
        A.count_by_link(traffic(s, d).where("speed_mph < 25")).withColumnRenamed("record_count", "n"), A.count_by_link(traffic(s, d).where("speed_mph >= 25")).withColumnRenamed("record_count", "n"), ["link_id"], ["n"]
    )
)
_add("mode_pivot", "select subset_label, max(m) filter (where mode = 'F') as F, max(m) filter (where mode = 'O') as O from (select subset_label, mode, round(avg(query_ms), 6) as m from runs group by 1, 2) group by 1")(
    lambda s, d: R.pivot_modes(runs(s, d).groupBy("subset_label", "mode").agg(F.round(F.avg("query_ms"), PLACES).alias("m")), ["F", "O"], "m", "subset_label")
)
_add("thread_series", "select thread_count, round(avg(query_ms), 6) as query_ms_mean from runs where subset_label = 'A' and mode = 'F' group by 1 order by 1")(
    lambda s, d: R.thread_series(runs(s, d).groupBy("subset_label", "mode", "thread_count").agg(F.round(F.avg("query_ms"), PLACES).alias("query_ms_mean")), "A", "F", "query_ms_mean")
)
_add("quality_constant", "select run_number, count(distinct rows_accepted) = 1 as rows_accepted_constant, count(distinct result_count) = 1 as result_count_constant from runs group by 1")(
    lambda s, d: R.quality_constant(runs(s, d), ["run_number"], ["rows_accepted", "result_count"])
)
_add(
    "topn_signature",
    "with top as (select borough, link_id, n, round(s, 6) as s, row_number() over (partition by borough order by s, link_id) as rn from (select borough, link_id, count(*) as n, avg(speed_mph) as s from traffic group by 1, 2 having count(*) >= 3))"
    " select borough, string_agg(concat_ws('|', rn, link_id, n, printf('%.6f', s)), ';' order by rn) as signature from top where rn <= 5 group by borough",
)(lambda s, d: R.topn_signatures(_rounded(A.top_slowest_by(traffic(s, d), "borough", 5, 3)), "borough"))

# cleaning, over texts made of table columns
_TEXTS = (
    "select event_id, case event_id % 8 when 0 then cast(event_id as varchar) || '.5' when 1 then '  -' || cast(event_id as varchar) || ' ' when 2 then cast(event_id as varchar) || 'd' when 3 then '1e400' when 4 then '' when 5 then '+' || cast(event_id as varchar) || 'e1' when 6 then '0x1A' else '.25' end as t from events"
)


def _texts(s: SparkSession, d: str) -> DataFrame:
    i, m = F.col("event_id").cast("string"), F.col("event_id") % 8
    t = F.when(m == 0, F.concat(i, F.lit(".5"))).when(m == 1, F.concat(F.lit("  -"), i, F.lit(" "))).when(m == 2, F.concat(i, F.lit("d"))).when(m == 3, "1e400").when(m == 4, "").when(m == 5, F.concat(F.lit("+"), i, F.lit("e1"))).when(m == 6, "0x1A").otherwise(".25")
    return table(s, d, "events").select("event_id", t.alias("t"))


_add(
    "clean_numbers",
    f"select event_id, case when regexp_matches(trim(t), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') and isfinite(try_cast(trim(t) as double)) then try_cast(trim(t) as double) end as number,"
    f" case when regexp_matches(trim(t), '^[+-]?[0-9]+$') then try_cast(trim(t) as bigint) end as whole from ({_TEXTS})",
)(lambda s, d: _texts(s, d).select("event_id", C.to_double(F.col("t")).alias("number"), C.to_long(F.col("t")).alias("whole")))
_add(
    "clean_timestamps",
    "select event_id, case event_id % 5 when 0 then null when 1 then cast(epoch_us(ts) // 1000000 as bigint) when 2 then cast(epoch_us(ts) // 1000000 as bigint) when 3 then cast(epoch_us(ts) // 1000000 as bigint) else null end as epoch from events",
)(
    lambda s, d: table(s, d, "events")
    .withColumn("m", F.col("event_id") % 5)
    .select(
        "event_id",
        C.to_epoch(
            F.when(F.col("m") == 0, F.date_format("ts", "yyyy-MM-dd"))
            .when(F.col("m") == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.123Z'"))
            .when(F.col("m") == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+05:00'"))
            .when(F.col("m") == 3, F.date_format("ts", "' 'yyyy-MM-dd'T'HH:mm:ss' '"))
            .otherwise(F.lit("1969-12-31T23:59:59"))
        ).alias("epoch"),
    )
)
_add(
    "borough_codes",
    "select user_id as link_id, cast(case user_id % 7 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 5 when 5 then -1 else 1 end as smallint) as code, count(*) as record_count from events group by 1, 2",
)(
    lambda s, d: table(s, d, "events")
    .withColumn("m", F.col("user_id") % 7)
    .select(
        F.col("user_id").alias("link_id"),
        C.filled_code(
            F.lit(-1), F.when(F.col("m") == 0, "Manhattan").when(F.col("m") == 1, "BX").when(F.col("m") == 2, "k").when(F.col("m") == 3, " queens ").when(F.col("m") == 4, "Staten Island").when(F.col("m") == 5, "Jersey").otherwise("mn")
        ).alias("code"),
    )
    .groupBy("link_id", "code")
    .agg(F.count("*").alias("record_count"))
)
_add(
    "valid_rows",
    "select count(*) as record_count, count(*) filter (where value - 50 >= 0) as valid, count(*) filter (where value - 50 < 0 or (value - 50) * 3 > 120) as suspicious from events",
)(
    lambda s, d: table(s, d, "events")
    .select(F.col("user_id"), (F.col("value") - 50).alias("v"))
    .agg(
        F.count("*").alias("record_count"),
        F.count_if(C.valid_core(F.col("user_id"), F.col("v"), F.lit(1.0), F.lit(5))).alias("valid"),
        F.count_if(C.suspicious_speed(F.when(F.col("v") < 0, F.col("v")).otherwise(F.col("v") * 3))).alias("suspicious"),
    )
)

# subsets and samples
_on_traffic(
    "prefix_subsets",
    "select cast(n as integer) as subset_rows, l_orderkey, l_linenumber from (select *, row_number() over (order by l_orderkey, l_linenumber, link_id, speed_mph) as rn from traffic) join (select unnest([10, 100, 1000]) as n) on rn <= n",
    lambda t: IO.prefix_subsets(t, [10, 100, 1000], "l_orderkey", "l_linenumber", "link_id", "speed_mph").select("subset_rows", "l_orderkey", "l_linenumber"),
)
_on_traffic("sample_rows", "select l_orderkey, l_linenumber from traffic order by l_orderkey, l_linenumber limit 20", lambda t: IO.first_rows(t, 20, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber"))
_on_traffic(
    "subset_manifest",
    "select cast(n as integer) as requested_rows, least(n, (select count(*) from traffic)) as written_rows from (select unnest([10, 100, 1000]) as n)",
    lambda t: IO.subset_manifest(IO.prefix_subsets(t, [10, 100, 1000], "l_orderkey", "l_linenumber"), [10, 100, 1000]),
)
_on_traffic(
    "scenarios",
    f"select 'slow' as scenario_name, {_MEANS} from traffic where speed_mph < 15 union all select 'all', {_MEANS} from traffic union all select 'bk', {_MEANS} from traffic where borough_code = 3 and speed_mph < 15",
    lambda t: S.run_scenarios(
        t, [{"scenario_name": "slow", "query_type": "speed_below", "threshold": 15.0}, {"scenario_name": "all", "query_type": "summary"}, {"scenario_name": "bk", "query_type": "borough_speed_below", "borough": "Brooklyn", "threshold": 15.0}], PLACES
    ),
)




@_add(
    "scenario_file",
    f"select 'slow' as scenario_name, {_MEANS} from traffic where speed_mph < 15 union all select 'week', {_MEANS} from traffic where timestamp_epoch_seconds between 820454400 and 821059200 union all select 'all', {_MEANS} from traffic"
    f" union all select 'queens', {_MEANS} from traffic where borough_code = 4 and speed_mph < 30 union all select 'rows', count(*), null, null from traffic"
    " union all select 'top', least(7, (select count(*) from (select link_id from traffic group by link_id having count(*) >= 20))), null, null",
)
def _scenario_file(s: SparkSession, d: str) -> DataFrame:
    """A parameter file, written to the shared folder, read and run over all traffic in one pass."""
    path = IO.scratch(s, "scenarios")
    rows = [("slow", "speed_below", "15", None, None, None, None, None), ("week", "time_window", None, "821059200", "820454400", None, None, None), ("all", "summary", *[None] * 6),
            ("queens", "borough_speed_below", "30", None, None, "qn", None, None), ("rows", "ingest_only", *[None] * 6), ("top", "top_n_slowest", None, None, None, None, "7", "20")]
    IO.write_metrics(s.createDataFrame(rows, "scenario_name string, query_type string, threshold string, start_epoch string, end_epoch string, borough string, top_n string, min_link_samples string"), path)
    return S.run_scenarios(traffic(s, d), S.read_scenarios(s, path), PLACES)


# sources: events as the text columns of raw files
def _raw_traffic(s: SparkSession, d: str) -> DataFrame:
    """Events as the text columns of a raw traffic file, some of them spoiled."""
    i = F.col("event_id")
    return table(s, d, "events").select(
        F.col("user_id").cast("string").alias("link_id"),
        F.when(i % 11 == 0, "foo").when(i % 13 == 0, "-1").otherwise(F.col("value").cast("string")).alias("speed"),
        F.lit("60").alias("travel_time"),
        F.when(i % 17 == 0, None).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("data_as_of"),
        F.col("event_type").alias("borough"),
        F.lit("a, b").alias("link_name"),
    )


_add(
    "ingest_quality",
    "select count(*) as rows_read, count(*) filter (where ok) as rows_accepted, count(*) filter (where not ok) as rows_rejected, count(*) filter (where event_id % 11 = 0 or (event_id % 17 <> 0 and v < 0)) as malformed,"
    " count(*) filter (where event_id % 11 <> 0 and event_id % 17 = 0) as missing_timestamp, count(*) filter (where event_id % 11 <> 0 and event_id % 17 <> 0 and (v < 0 or v > 120)) as suspicious_speed, cast(0 as bigint) as suspicious_travel_time"
    " from (select *, event_id % 11 <> 0 and event_id % 17 <> 0 and v >= 0 as ok from (select event_id, case when event_id % 11 = 0 then null when event_id % 13 = 0 then -1.0::double else value end as v from events))",
)(lambda s, d: IO.quality(IO.judged_traffic(_raw_traffic(s, d))))
_add("ingest_rejects", "select reject_reason, count(*) as record_count from (select case when event_id % 11 = 0 then 'malformed' when event_id % 17 = 0 then 'missing_timestamp' when event_id % 13 = 0 then 'malformed' end as reject_reason from events) where reject_reason is not null group by 1")(
    lambda s, d: A.count_by(IO.rejected(IO.judged_traffic(_raw_traffic(s, d))), "reject_reason", "reject_reason")
)
_add("ingest_accepted", "select user_id as link_id, count(*) as record_count from events where event_id % 11 <> 0 and event_id % 17 <> 0 and event_id % 13 <> 0 group by 1")(
    lambda s, d: A.count_by_link(IO.accepted(IO.judged_traffic(_raw_traffic(s, d))))
)


# sources: tables written as CSV files to the shared folder and read back
def _csv_traffic(s: SparkSession, d: str) -> DataFrame:
    """The raw traffic in files of two kinds, with other names and another order of columns."""
    path, raw = IO.scratch(s, "traffic"), _raw_traffic(s, d)
    one, other = raw.where("cast(link_id as bigint) % 2 = 0"), raw.where("cast(link_id as bigint) % 2 = 1")
    IO.write_metrics(one, path)
    names = {"speed": "SPEED", "link_id": "Link ID", "data_as_of": "Datetime", "travel_time": "Travel Time", "link_name": "link name", "borough": "Borough"}
    IO.write_metrics(other.select(*[F.col(c).alias(n) for c, n in names.items()]), path, append=True)
    return IO.read_traffic(s, path)


_CSV_OK = "from events where event_id % 11 <> 0 and event_id % 17 <> 0 and event_id % 13 <> 0 and value >= 0"
_ROWS = f"select user_id as link_id, value as speed_mph, 60.0::double as travel_time_seconds, cast(epoch_us(ts) // 1000000 as bigint) as timestamp_epoch_seconds, event_type as borough, cast(-1 as smallint) as borough_code, 'a, b' as link_name {_CSV_OK}"
_add("csv_traffic", _ROWS)(lambda s, d: IO.accepted(_csv_traffic(s, d)))


@_add("csv_expected_count", _ROWS)
def _csv_expected(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "events").where("event_id % 11 <> 0 and event_id % 17 <> 0 and event_id % 13 <> 0 and value >= 0").count()
    return IO.expect_accepted(_csv_traffic(s, d), n)


@_add("ingest_once", "select coalesce(reject_reason, 'accepted') as outcome, count(*) as record_count from (select case when event_id % 11 = 0 then 'malformed' when event_id % 17 = 0 then 'missing_timestamp' when event_id % 13 = 0 or value < 0 then 'malformed' end as reject_reason from events) group by 1")
def _ingest_once(s: SparkSession, d: str) -> DataFrame:
    """Accepted and rejected rows of the files, parted in one pass."""
    ok, bad, _ = IO.ingest(_csv_traffic(s, d), IO.scratch(s, "ingest"))
    return A.count_by(ok.select(F.lit("accepted").alias("reject_reason")).unionAll(bad.select("reject_reason")), "reject_reason", "outcome")


@_add("file_prefix", "select cast(n as integer) as subset_rows, rn as row_number, event_id from (select event_id, row_number() over (order by event_id) as rn from events) join (select unnest([10, 100, 3000]) as n) on rn <= n")
def _file_prefix(s: SparkSession, d: str) -> DataFrame:
    """The first rows of files in their own order; events are written in five files by their number."""
    path = IO.scratch(s, "ordered")
    IO.write_metrics(table(s, d, "events").select("event_id", "event_type").repartitionByRange(5, "event_id").sortWithinPartitions("event_id"), path)
    return IO.file_prefixes(s, path, [10, 100, 3000]).select("subset_rows", F.col("row_number").cast("bigint").alias("row_number"), F.col("event_id").cast("bigint").alias("event_id"))


@_add(
    "csv_two_times",
    "select event_id as link_id, case when event_id % 2 = 0 then cast(epoch_us(ts) // 1000000 as bigint) end as timestamp_epoch_seconds, case when event_id % 2 = 1 then 'missing_timestamp' end as reject_reason from events",
)
def _csv_two_times(s: SparkSession, d: str) -> DataFrame:
    """A file with two names of the time: the first counts, also where it is blank and the second is not."""
    path, i = IO.scratch(s, "traffic"), F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    IO.write_metrics(table(s, d, "events").select(stamp.alias("timestamp"), i.alias("link_id"), F.lit("5").alias("speed"), F.lit("6").alias("travel_time"), F.when(i % 2 == 0, stamp).alias("data_as_of")), path)
    return IO.read_traffic(s, path).select("link_id", "timestamp_epoch_seconds", "reject_reason")


@_add(
    "csv_garages",
    "select case when k % 4 = 0 then '' else cast(k as varchar) end as license_number, case when k % 6 = 0 then 0 else cast(epoch_us(o_orderdate) // 1000000 as bigint) end as license_expiration_epoch_seconds, case when k % 9 = 0 then '' else 'Garage ' || k end as business_name,"
    " cast(o_custkey as varchar) as bbl, case o_custkey % 3 when 0 then 'Queens' when 1 then 'BK' else 'elsewhere' end as borough, cast(case o_custkey % 3 when 0 then 4 when 1 then 3 else -1 end as smallint) as borough_code,"
    " k % 5 <> 0 as has_location, case when k % 5 <> 0 then 40.5::double end as latitude from (select *, o_orderkey as k from orders) where (k % 7 <> 0 or k % 6 = 0) and (k % 4 <> 0 or k % 9 <> 0)",
)
def _csv_garages(s: SparkSession, d: str) -> DataFrame:
    """Orders as garages: every seventh has an unreadable date, every sixth none, every fifth an unreadable place, every fourth no licence, every ninth no name."""
    k, path = F.col("o_orderkey"), IO.scratch(s, "garages")
    day = F.when(k % 6 == 0, None).when(k % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    raw = table(s, d, "orders").select(
        F.when(k % 4 != 0, k.cast("string")).alias("license_number"),
        day.alias("expiration_date"),
        F.when(k % 9 != 0, F.concat(F.lit("Garage "), k.cast("string"))).alias("name"),
        F.col("o_custkey").cast("string").alias("bbl"),
        F.when(F.col("o_custkey") % 3 == 0, "Queens").when(F.col("o_custkey") % 3 == 1, "BK").otherwise("elsewhere").alias("borough"),
        F.when(k % 5 == 0, "north").otherwise("40.5").alias("lat"),
        F.lit("-73.8").alias("lng"),
    )
    IO.write_metrics(raw, path)
    found = IO.accepted(IO.read_garages(s, path))
    return found.select("license_number", "license_expiration_epoch_seconds", "business_name", "bbl", "borough", "borough_code", "has_location", F.col("location.latitude").alias("latitude"))


@_add(
    "csv_buildings",
    "select cast(c_custkey as varchar) as bbl, cast(case when c_custkey % 4 = 0 then 0 else c_custkey % 5 end as integer) as subgrade_level, c_acctbal as elevation_feet, 40.25::double as latitude, 0.0::double as longitude"
    " from customer where c_custkey % 6 <> 0 and c_custkey % 11 <> 0 and (c_custkey % 7 <> 0 or c_custkey % 4 = 0)",
)
def _csv_buildings(s: SparkSession, d: str) -> DataFrame:
    """Customers as buildings: every fourth has no level, every seventh one beyond 32 bits, every sixth an unreadable elevation, every eleventh an unreadable place."""
    k, path = F.col("c_custkey"), IO.scratch(s, "buildings")
    raw = table(s, d, "customer").select(
        k.cast("string").alias("bbl"),
        F.when(k % 4 == 0, None).when(k % 7 == 0, "3000000000").otherwise((k % 5).cast("string")).alias("subgrade"),
        F.when(k % 6 == 0, "high").otherwise(F.col("c_acctbal").cast("string")).alias("elevation_ft"),
        F.when(k % 11 == 0, "north").otherwise("40.25").alias("latitude"),
    )
    IO.write_metrics(raw, path)
    return IO.accepted(IO.read_buildings(s, path)).select("bbl", "subgrade_level", "elevation_feet", F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"))


@_add("columnar_copy", "select borough_code, count(*) as record_count, min(speed_mph) as slowest, max(link_id) as last_link from traffic where borough_code in (1, 3) group by 1")
def _columnar_copy(s: SparkSession, d: str) -> DataFrame:
    """Two boroughs of the Parquet copy; the others' folders are not read."""
    path = IO.scratch(s, "columnar")
    IO.write_columnar(traffic(s, d), path)
    kept = s.read.parquet(path).where("borough_code in (1, 3)")
    return kept.groupBy(F.col("borough_code").cast("short").alias("borough_code")).agg(F.count("*").alias("record_count"), F.min("speed_mph").alias("slowest"), F.max("link_id").alias("last_link"))


@_add(
    "csv_sink",
    "select l_returnflag as subset_label, l_linestatus as mode, cast(count(*) as varchar) as n, cast(max(l_suppkey) as varchar) as result_count from lineitem, (select unnest([1, 2])) group by 1, 2, l_linenumber",
)
def _csv_sink(s: SparkSession, d: str) -> DataFrame:
    """A summary of runs appended to one sink, a batch a line number (1 to 7), and read back as text under its header."""
    path = IO.scratch(s, "metrics")
    for threads in range(1, 8):
        part = runs(s, d).where(F.col("thread_count") == threads).groupBy("subset_label", "mode").agg((2 * F.count("*")).alias("n"), F.max("result_count").alias("result_count"))
        IO.write_metrics(part, path, append=threads > 1)
    return s.read.option("header", True).csv(path)
