import pytest
from pyspark.sql import functions as F

from tidelane.functions import columns as C
from tidelane.functions.schemas import TRAFFIC
from tidelane.operators import aggregates as A
from tidelane.operators import cross as X
from tidelane.operators import eras as E
from tidelane.operators import filters as P
from tidelane.operators import lookups as L
from tidelane.operators import runs as R
from tidelane.plans import scenarios as S


def links(df):
    return sorted(r.link_id for r in df.collect())


def test_filters(traffic):
    assert links(P.speed_below(traffic, 12.5)) == [31, 31, 90] and links(P.speed_below(traffic, 12.0)) == [31, 90]
    assert links(P.borough_speed_below(traffic, "Staten Island", 15.0)) == links(P.borough_speed_below(traffic, " SI ", 15.0)) == [31, 31]
    assert links(P.link(traffic, 58)) == [58, 58] and links(P.link(traffic, 59)) == []
    assert links(P.link_range(traffic, 80, 50)) == links(P.link_range(traffic, 58, 73)) == [58, 58, 73]
    assert links(P.time_window(traffic, 1653007200, 1653003600)) == links(P.time_window(traffic, 1653003600, 1653007200)) == [31, 58, 58]
    assert P.time_window(traffic, 1653007200, 1653007200).count() == 2 and P.time_window(traffic, 1653007201, 1653010799).count() == 0
    assert links(P.borough_speed_below(traffic, "Hoboken", 5.0)) == [90] and links(P.borough_speed_below(traffic, "hoboken", 5.0)) == []


def test_unknown_borough_compares_text(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0, 1, "Jersey", -1, ""), (2, 5.0, 1.0, 1, "Yonkers", -1, "")], TRAFFIC)
    assert links(P.borough_speed_below(df, "Jersey", 9.0)) == [1] and links(P.borough_speed_below(df, "jersey", 9.0)) == []


def test_summaries(traffic):
    s = A.summary(traffic).first()
    assert s.record_count == 7 and s.average_speed_mph == pytest.approx(121.5 / 7)
    s = A.summary(P.link(traffic, 31)).first()
    assert (s.record_count, s.average_speed_mph) == (3, 12.0) and s.average_travel_time_seconds == pytest.approx(740 / 3)
    assert tuple(A.summary(P.speed_below(traffic, 0.0)).first()) == (0, 0.0, 0.0)
    lo, hi = A.time_bounds(traffic).first()
    assert (lo, hi) == (1653000000, 1653093600) and P.time_window(traffic, lo, hi).count() == 7


@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_top_slowest(traffic, partitions):
    top = A.top_slowest(traffic.repartition(partitions), 3, 1).collect()
    assert [(r.rank, r.link_id) for r in top] == [(1, 90), (2, 31), (3, 58)]
    assert [r.link_id for r in A.top_slowest(traffic, 99, 2).collect()] == [31, 58]
    with pytest.raises(ValueError):
        A.top_slowest(traffic, 0)


def test_ties_go_by_link(spark):
    df = spark.createDataFrame([(i, 5.0, 1.0, 1, "", -1, "") for i in (9, 3, 7)], TRAFFIC)
    assert [r.link_id for r in A.top_slowest(df, 2).collect()] == [3, 7]


def test_counts_and_lookups(spark, traffic):
    find = lambda c, k, v: L.lookup(c, k, v).first().record_count
    assert [find(A.count_by_link(traffic), "link_id", v) for v in (31, 58, 73, 74)] == [3, 2, 1, 0]
    assert [find(A.count_by_borough(traffic), "borough_code", v) for v in (5, 2, -1, 3)] == [3, 2, 1, 0]
    hours = [1653000000 // 3600 + h for h in (0, 2, 25, 26, 27)]
    assert [find(A.count_by_hour(traffic), "hour_bucket", v) for v in hours] == [1, 2, 1, 1, 0]
    keys = spark.createDataFrame([(31,), (8,), (31,)], "link_id long")
    assert sorted(tuple(r) for r in L.bulk_lookup(keys, A.count_by_link(traffic), "link_id").collect()) == [(8, 0), (31, 3), (31, 3)]
    assert L.audit(traffic, A.count_by_link(traffic)).first().agree
    assert not L.audit(traffic.limit(6), A.count_by_link(traffic)).first().agree


def test_across_tables(spark):
    lots = [("K7", 3), ("K7", 3), ("K7", -1), ("Q2", 4), ("", 4), (None, 4), ("M1", 1)]
    g = spark.createDataFrame(lots, "bbl string, borough_code short")
    b = spark.createDataFrame([("M1",), ("K7",), ("K7",), ("Z9",), (None,), ("",)], "bbl string")
    t = spark.createDataFrame([(5, 3), (6, 3), (7, 2), (8, -1), (9, -1), (9, -1)], "link_id long, borough_code short")
    assert [tuple(r) for r in X.shared_parcels(g, b).collect()] == [("K7", 3, 2), ("M1", 1, 1)]
    assert X.shared_parcel_count(g, b).first()[0] == X.key_intersection_count(g, b, "bbl").first()[0] == 2
    assert {r.bbl for r in X.key_union(g, b, "bbl").collect()} == {"K7", "Q2", "M1", "Z9"}
    assert [tuple(r) for r in X.borough_rollup(t, g).collect()] == [(-1, 3, 1), (1, 0, 1), (2, 1, 0), (3, 2, 2), (4, 0, 3)]


def test_named_queries(traffic):
    assert S.query(traffic, "speed_below", threshold=1000.0).first().record_count == 7
    for bad in ({"query_type": "no_such"}, {"query_type": "speed_below"}, {"query_type": "time_window", "start_epoch": 1}, {"query_type": "top_n_slowest", "top_n": 0, "min_link_samples": 1}):
        with pytest.raises(ValueError):
            S.query(traffic, **bad)
        with pytest.raises(ValueError):
            S.run_scenarios(traffic, [{"scenario_name": "x", **bad}])


def test_scenario_files(spark, traffic, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("query_type,scenario_name,threshold,start_epoch,end_epoch,borough,top_n,min_link_samples,more\nspeed_below,slow,13,,,,,,\nborough_speed_below,bx,30,,,bx,,\ntop_n_slowest,top,,,,,9,2,x\ningest_only,rows,,,,,,\ntime_window,w,,1653007200,1653003600,,,\n")
    scenarios = S.read_scenarios(spark, str(p))
    got = {r.scenario_name: r for r in S.run_scenarios(traffic, scenarios).collect()}
    assert {k: r.record_count for k, r in got.items()} == {"slow": 3, "bx": 2, "top": 2, "rows": 7, "w": 3}
    assert got["slow"].average_speed_mph == 7.0 and got["rows"].average_speed_mph is None is got["top"].average_speed_mph
    for s in scenarios:  # each as it is by itself
        if s["query_type"] != "top_n_slowest":
            alone = S.query(traffic, s["query_type"], **{k: v for k, v in s.items() if k not in ("query_type", "scenario_name")}).first()
            assert alone.record_count == got[s["scenario_name"]].record_count
    assert S.run_scenarios(traffic, []).count() == 0
    p.write_text("scenario_name,query_type\nall,summary\n")
    assert S.read_scenarios(spark, str(p))[0]["top_n"] is None


def test_scenarios_share_one_scan(spark, scans):
    from tidelane import catalog

    t = catalog.traffic(spark, "/root/testdata/sf0.001")
    three = [{"scenario_name": str(x), "query_type": "speed_below", "threshold": x} for x in (3.0, 9.0, 27.0)]
    df = S.run_scenarios(t, three)
    assert sum("l_quantity" in x for x in scans(df)) == 1 and "LessThan(l_quantity,27.0)" in "".join(scans(df))
    assert sum("l_quantity" in x for x in scans(S.run_scenarios(t, [*three, {"scenario_name": "t", "query_type": "top_n_slowest", "top_n": 3, "min_link_samples": 2}]))) == 1


def test_key_counts_take_one_scan_a_table(spark, traffic, scans):
    from tidelane import catalog

    counts = A.key_counts(links=(traffic, "link_id"), names=(traffic, "link_name"), hours=(traffic, C.hour_bucket()), none=(traffic.where("false"), "link_id"))
    assert counts.columns == ["links", "names", "hours", "none"] and tuple(counts.first()) == (4, 4, 6, 0)
    odd = spark.createDataFrame([("", 1), (None, 1), ("a", None)], "k string, n int")
    assert tuple(A.key_counts(k=(odd, "k"), n=(odd, "n")).first()) == (1, 1)
    assert len(scans(catalog.QUERIES["distinct_key_counts"](spark, "/root/testdata/sf0.001"))) == 8


def test_eras(spark, traffic):
    eras = (("early", 1653000000, 1653007200), ("late", 1653007200, 1700000000))
    assert {r.era: r.record_count for r in E.era_summary(traffic, eras).collect()} == {"early": 2, "late": 5}
    assert E.corridor_by_era(traffic, eras).where("link_name = 'Segment 31'").first()["early"] == 12.0
    assert {r.link_id for r in E.slow_links(traffic, "Staten Island", 16.0).collect()} == {31}
    spots = E.hotspots(traffic)
    assert spots.where("borough = 'Bronx'").first().record_count == 2
    assert {r.grouped_by: r.n for r in spots.groupBy("grouped_by").agg(F.count("*").alias("n")).collect()} == {"link_id": 4, "borough": 4, "link_name": 4, "hour_bucket": 6}


def test_eras_may_overlap(spark, traffic):
    table = spark.createDataFrame([("all", 0, 4102444800), ("second day", 1653086400, 1653172800), ("hour", 1653007200, 1653007201), ("none", 5, 5)], "era string, start_epoch long, end_epoch long")
    got = E.in_eras(traffic, table).groupBy("era").count().collect()
    assert {r["era"]: r["count"] for r in got} == {"all": 7, "second day": 2, "hour": 2}
    assert set(E.in_eras(traffic, table).columns) == {*traffic.columns, "era"}


RUNS = [("s", "serial", 1, 1, 10.0, 5), ("s", "serial", 1, 2, 14.0, 5), ("s", "parallel", 4, 1, 6.0, 5), ("s", "parallel", 4, 2, 6.0, 6)]


def test_runs(spark):
    runs = spark.createDataFrame(RUNS, "subset_label string, mode string, thread_count int, run_number int, query_ms double, result_count int")
    stats = R.grouped_stats(runs, ["subset_label", "mode"], ["query_ms"])
    by = {r["mode"]: r for r in stats.collect()}
    assert by["serial"].query_ms_mean == by["serial"].query_ms_median == 12.0 and by["serial"].query_ms_stddev == pytest.approx(8**0.5) and by["parallel"].query_ms_stddev == 0
    up = {r["mode"]: r.speedup for r in R.ratio_to_baseline(stats, ["subset_label"], "query_ms_mean", F.col("mode") == "serial").collect()}
    assert up == {"serial": 1.0, "parallel": 2.0}
    st = {r["mode"]: (r.status, r.reason) for r in R.stability(runs, ["mode"], metric="query_ms").collect()}
    assert st == {"serial": ("FAIL", "averages differ"), "parallel": ("FAIL", "results differ")}
    assert {(r["mode"], r.thread_count, r.actual) for r in R.completeness(runs, ["mode"], [1, 4], 2).collect()} == {("serial", 4, 0), ("parallel", 1, 0)}
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert R.parity(a, a.withColumn("v", F.col("v") + 1e-12), ["k"], ["v"]).count() == 0 and R.parity(a, a.where("k = 1"), ["k"], ["v"]).count() == 1
    batches = spark.createDataFrame([("b1", 1), ("b2", 2)], "batch_utc string, x int")
    assert R.latest_batch(batches).first().x == 2 and R.only_batch(batches, "b1").first().x == 1
    for asked in (None, "b9"):
        with pytest.raises(ValueError):
            R.only_batch(batches, asked)


def test_filter_reaches_the_scan_and_no_python(spark):
    from tidelane import catalog

    plan = catalog.traffic(spark, "/root/testdata/sf0.001").where("speed_mph < 15").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,15.0)" in plan and "Python" not in plan and "l_comment" not in plan


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10 and {"top_n_slowest", "summary"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
