"""Forms that hold at scale: what reaches the scan, what one task gets, and that results stay exact."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidelane import catalog
from tidelane.operators import aggregates as A
from tidelane.operators import eras as E
from tidelane.operators import filters as P
from tidelane.operators import indexes as I
from tidelane.operators import runs as R
from tidelane.operators import running as N
from tidelane.sources import files as IO

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df):
    """Rows that the scan of a plan without shuffles has made."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_time_bounds_reach_the_scan(spark):
    window = P.time_window(catalog.traffic(spark, SF), 820454400, 821059200)
    scan = next(line for line in plan(window).splitlines() if "FileScan" in line and "l_shipdate" in line)
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01" in scan
    # the stored bounds never change the result
    plain = P.time_window(catalog.traffic(spark, SF).drop(P.STORED_TIME), 820454400, 821059200)
    assert window.count() == plain.count() > 0


def test_a_window_reads_its_days_alone(spark, tmp_path):
    second = F.col("id") * 600 + 1704067200 - 86400 * 5
    rows = spark.range(0, 2880, 1, 7).select(F.col("id").alias("link_id"), second.alias("timestamp_epoch_seconds"))
    IO.write_by_day(rows, str(tmp_path / "days"))
    copy = spark.read.parquet(str(tmp_path / "days"))
    assert len(list((tmp_path / "days").glob("event_day=*"))) == 20
    for a, b in ((1704067200, 1704153599), (1704153600, 1704067200 - 1), (0, 4102444800), (-5, 10), (1704067200, 2**60)):
        lo, hi = min(a, b), max(a, b)
        want = rows.where(f"timestamp_epoch_seconds between {lo} and {hi}").count()
        assert P.time_window(copy, a, b).count() == want
    assert rows_scanned(P.time_window(copy, 1704067200, 1704153599)) == 144
    assert "PartitionFilters: [isnotnull(event_day" in plan(P.time_window(copy, 1704067200, 1704153599))


def test_stored_times_with_fractions(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:09.999' as event_time, 1704067209L as timestamp_epoch_seconds")
    assert P.time_window(df, 1704067209, 1704067209).count() == 1 and P.time_window(df, 1704067210, 1704067219).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_medians_are_exact(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot", rng.choice([1.0, 2.0, 3.0]), rng.gauss(0, 5)) for _ in range(9000)]  # ties of thousands, and few
    rows += [("even", float(i), -float(i)) for i in range(8)] + [("odd", 5.0, 1.0), ("odd", 1.0, 2.0), ("odd", 9.0, 3.0)] + [(None, 4.0, None), (None, None, None), ("none", None, 0.5)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(partitions)
    got = {r.k: r for r in N.medians(df, ["k"], ["x", "y"]).collect()}
    for k in {r[0] for r in rows}:
        for m, at in (("x", 1), ("y", 2)):
            values = [r[at] for r in rows if r[0] == k and r[at] is not None]
            assert got[k][m] == (statistics.median(values) if values else None)


def test_a_missed_bracket_is_sought_again(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("a", rng.random()) for _ in range(5001)]
    df = spark.createDataFrame(rows, "k string, x double")
    near = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, at, n: near(c, F.array(F.lit(0.9), F.lit(0.95)), n))
    assert N.medians(df, ["k"], ["x"]).first().x == statistics.median(x for _, x in rows)


def test_no_task_gets_a_groups_values(spark):
    stats = R.grouped_stats(catalog.runs(spark, SF), ["subset_label", "mode"], ["query_ms", "total_ms"])
    assert "percentile(" not in plan(stats) and stats.columns[2:5] == ["n", "query_ms_mean", "query_ms_median"]
    one = R.grouped_stats(spark.createDataFrame([("a", 1.0)], "k string, m double"), ["k"], ["m"]).first()
    assert (one.n, one.m_median, one.m_stddev) == (1, 1.0, 0.0)
    assert R.grouped_stats(spark.createDataFrame([], "k string, m double"), ["k"], ["m"]).count() == 0


def test_running_sums_over_range_edges(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.randrange(5)) for k in ("a", None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, w int").repartition(5)
    got = {(r.k, r.i): r.before for r in N.with_running_sum(df, "w", "before", [F.col("i").desc()], "k").collect()}
    assert got == {(k, i): sum(w for k2, j, w in rows if k2 == k and j > i) for k, i, _ in rows}


def test_ranks_have_no_single_task(spark):
    names = [f"n{i % 40:02d}" for i in range(500)] + [None] * 9
    traffic = spark.createDataFrame([(n, 5.0 if n and int(n[1:]) % 4 else 50.0) for n in names], "link_name string, speed_mph double").repartition(6)
    ids = A.link_names(traffic)
    order = [None, *sorted({n for n in names if n})]
    assert {r.link_name: r.link_name_id for r in ids.collect()} == {n: i for i, n in enumerate(order)} and "SinglePartition" not in plan(ids)
    assert A.dictionary_encoded(traffic).where("link_name is null").first().link_name_id == 0
    shares = E.hotspot_share(traffic, 15.0)
    assert {(r.slow_share, r["rank"]) for r in shares.collect()} == {(1.0, 1), (0.0, 2)} and shares.count() == 41  # many ties, dense
    assert "SinglePartition" not in plan(shares)
    assert A.link_names(traffic.limit(0)).count() == 0


def test_kept_counts_read_one_bucket(spark):
    counts = spark.range(4000).select(F.col("id").alias("link_id"), (F.col("id") % 7 + 1).alias("record_count"))
    kept = I.KeptCounts.of(counts, "link_id", 8)
    assert [kept.lookup(v).first().record_count for v in (0, 13, -1)] == [1, 7, 0]
    assert rows_scanned(kept.counts().where("link_id = 13")) < 4000 / 8 * 1.3
    keys = spark.createDataFrame([(5,), (None,), (99999,)], "link_id long")
    assert sorted(((r.link_id, r.record_count) for r in kept.lookup_all(keys).collect()), key=str) == [(5, 6), (99999, 0), (None, 0)]
    before = kept.table
    kept.refresh(spark.createDataFrame([(13, 3), (13, 2), (7777, 1), (0, -1)], "link_id long, record_count long"))
    assert [kept.lookup(v).first().record_count for v in (13, 7777, 0, 14)] == [12, 1, 0, 1] and kept.counts().count() == 4000
    assert not spark.catalog.tableExists(before)
    kept.drop()
    assert not spark.catalog.tableExists(kept.table)


def test_only_asked_families_are_kept(spark, traffic):
    parcels = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "bbl string")
    assert set(I.keep_families(traffic, parcels, parcels, families=("bbl",), buckets=2)) == {"garage_bbl", "building_bbl"}
    kept = I.keep_families(traffic, families=("link", "borough", "hour", "bbl"), buckets=2)
    assert set(kept) == {"link", "borough", "hour"} and kept["borough"].lookup(5).first().record_count == 3
    assert I.keep_families(garages=parcels, families=("bbl",), buckets=2)["garage_bbl"].lookup("a").first().record_count == 2
    assert math.isclose(kept["hour"].counts().agg(F.sum("record_count")).first()[0], traffic.count())
