import pytest
from pyspark.sql import functions as F

from tidelane.functions import columns as C
from tidelane.sources import files as IO

HEAD = "id,speed,travel_time,status,data_as_of,link_id,borough,link_name\n"


def put(tmp_path, text, name="t.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_traffic_file(spark, tmp_path):
    path = put(
        tmp_path,
        HEAD
        + '7,31.5,120,on,2023-06-05T08:00:00,52,Queens,"Pike, North"\n8,44,61.25,on,2023-06-05 08:15:30,53,bx,Quay Road\n\n'
        + "9,slow,10,on,2023-06-05T08:20:00,54,Brooklyn,Mill Lane\n10,12,10,on,,55,Manhattan,High Street\n",
    )
    judged = IO.read_traffic(spark, path)
    q = IO.quality(judged).first()
    assert (q.rows_read, q.rows_accepted, q.rows_rejected, q.malformed, q.missing_timestamp) == (4, 2, 2, 1, 1)
    got = {r.link_id: r for r in IO.accepted(judged).collect()}
    assert got[52].borough_code == 4 and got[53].borough_code == 2 and got[52].link_name == "Pike, North" and got[52].timestamp_epoch_seconds == 1685952000
    assert IO.rejected(judged).count() == 2 and IO.expect_accepted(judged, 2).count() == 2
    with pytest.raises(ValueError):
        IO.expect_accepted(judged, 3)


def test_odd_rows(spark, tmp_path):
    row = "1,{},{},ok,{},{},Queens,Main\n"
    cases = [("121", "1", "2024-01-01T00:00:00", "1"), ("-1", "1", "2024-01-01T00:00:00", "2"), ("1e400", "1", "2024-01-01T00:00:00", "3"), ("1d", "1", "2024-01-01T00:00:00", "4"), ("NaN", "1", "2024-01-01T00:00:00", "5"),
             ("5", "1", "1970-01-01T00:00:00", "6"), ("5", "1", "2024-01-01T00:00:00+05:00", "7"), ("5", "1", "2024-01-01", "8"), ("5", "1", "2024-01-01T00:00:00.123Z", "9")]
    path = put(tmp_path, HEAD + "".join(row.format(*c) for c in cases) + "1,5,1,ok,2024-01-01T00:00:00,10\n1,5,1\n" + "1,5,1,ok,2024-01-01T00:00:00,11,Queens,Main,extra\n")
    judged = IO.read_traffic(spark, path)
    assert sorted(r.link_id for r in IO.accepted(judged).collect()) == [1, 7, 9, 10, 11]
    q = IO.quality(judged).first()
    assert (q.suspicious_speed, q.missing_timestamp, q.rows_read) == (2, 1, 12)
    assert IO.accepted(judged).where("link_id = 7").first().timestamp_epoch_seconds == 1704067200


def test_headers(spark, tmp_path):
    path = put(tmp_path, "Link ID, Datetime ,SPEED,Travel Time,more\n7,2024-01-01T00:00:00,5,6,x\n")
    assert IO.accepted(IO.read_traffic(spark, path)).first().link_id == 7
    with pytest.raises(ValueError, match="data_as_of"):
        IO.read_traffic(spark, put(tmp_path, "link_id,speed,travel_time\n1,2,3\n", "u.csv"))


def test_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "many").mkdir()
    put(tmp_path / "many", "link_id,speed,travel_time,data_as_of\n1,20,3,2024-01-01T00:00:00\n", "a.csv")
    put(tmp_path / "many", "speed,link_id,timestamp,travel time,borough\n30,2,2024-01-01T00:00:00,4,Queens\n", "b.csv")
    put(tmp_path / "many", "link_id,speed,travel_time,data_as_of\n5,25,3,2024-01-01T00:00:00\n", "c.csv")
    put(tmp_path / "many", "", "empty.csv")
    got = IO.accepted(IO.read_traffic(spark, str(tmp_path / "many"))).collect()
    assert sorted((r.link_id, r.speed_mph, r.borough_code) for r in got) == [(1, 20.0, -1), (2, 30.0, 4), (5, 25.0, -1)]


def test_garages_and_buildings(spark, tmp_path):
    head = "license_nbr,lic_expir_dd,license_creation_date,business_name,address_borough,bbl,latitude,longitude\n"
    path = put(tmp_path, head + "G1,2025-01-01T00:00:00,2020-01-01T00:00:00,A,Manhattan,1,40.5,-73.8\nG2,bad,2020-01-01T00:00:00,B,Bronx,2,40,-73\nG3,,,C,Queens,3,bad,-73\n,,,,Queens,3,1,1\n")
    judged = IO.read_garages(spark, path)
    got = {r.license_number: r for r in IO.accepted(judged).collect()}
    assert set(got) == {"G1", "G3"} and got["G1"].location.latitude == 40.5 and not got["G3"].has_location and got["G3"].borough_code == 4
    q = IO.quality(judged).first()
    assert (q.rows_read, q.rows_accepted, q.rows_rejected) == (4, 2, 2)
    path = put(tmp_path, "bbl,subgrade_level,elevation_feet,latitude,longitude\n1000000001,2,15.5,40.5,-73.8\n1000000002,1,not_number,40.4,-73.7\n,1,1,1,1\n", "b.csv")
    got = IO.accepted(IO.read_buildings(spark, path)).collect()
    assert [(r.bbl, r.subgrade_level, r.elevation_feet) for r in got] == [("1000000001", 2, 15.5), ("", 1, 1.0)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([(" 12 ", 12, 12.0), ("12.0", None, 12.0), ("0x1A", None, None), ("inf", None, None), ("", None, None), (".5", None, 0.5), ("3000000000", None, 3e9)], "t string, i int, d double")
    assert df.where(~C.to_int(F.col("t")).eqNullSafe(F.col("i")) | ~C.to_double(F.col("t")).eqNullSafe(F.col("d"))).count() == 0
    assert spark.range(1).select(C.ratio(F.lit(4.0), F.lit(2.0)), C.ratio(F.lit(4.0), F.lit(0.0)), C.per_second(F.lit(10), F.lit(500)), C.nearly_equal(F.lit(1.0), F.lit(1.0 + 1e-12))).first()[:] == (2.0, None, 20.0, True)


def test_copies_and_sinks(spark, traffic, tmp_path):
    IO.write_columnar(traffic, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 7 and "PartitionFilters: [isnotnull(borough_code" in back.where("borough_code = 1")._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([("a,b", 'say "x"')], "k string, v string")
    IO.write_metrics(rows, str(tmp_path / "m"))
    IO.write_metrics(rows, str(tmp_path / "m"), append=True)
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "m")).collect()] == [("a,b", 'say "x"')] * 2
    subsets = IO.prefix_subsets(traffic, [2, 4, 9], "timestamp_epoch_seconds")
    assert {tuple(r) for r in IO.subset_manifest(subsets, [2, 4, 9]).collect()} == {(2, 2), (4, 4), (9, 7)}


def test_first_alias_of_a_header_counts(spark, tmp_path):
    path = put(tmp_path, "timestamp,link_id,speed,travel_time,data_as_of\n2024-01-01T00:00:00,1,5,6,\n2024-01-01T00:00:00,2,5,6,2024-02-01T00:00:00\n")
    got = {r.link_id: r for r in IO.read_traffic(spark, path).collect()}
    assert got[1].reject_reason == "missing_timestamp" and got[2].timestamp_epoch_seconds == 1706745600


def test_a_file_without_a_required_column_is_an_error(spark, tmp_path):
    (tmp_path / "two").mkdir()
    put(tmp_path / "two", "link_id,speed,travel_time,data_as_of\n1,20,3,2024-01-01T00:00:00\n", "a.csv")
    put(tmp_path / "two", "link_id,travel_time,data_as_of\n1,3,2024-01-01T00:00:00\n", "b.csv")
    with pytest.raises(ValueError, match=r"b\.csv: required column speed"):
        IO.read_traffic(spark, str(tmp_path / "two"))


def test_headers_are_read_without_the_data(spark, tmp_path):
    big = tmp_path / "big"
    big.mkdir()
    with open(big / "a.csv", "wb") as f:  # 40 GB that no disk holds: reading them would not end
        f.write(b"link_id,speed,travel_time,data_as_of\n")
        f.truncate(40 << 30)
    put(big, "\ufeffspeed,Link ID\r\n5,6\r\n", "b.csv")
    put(big, "x" * 200_000 + ",y\n1,2\n", "c.csv")
    put(big, "", "d.csv")
    assert {h.removeprefix("\ufeff")[:13]: [f.rsplit("/", 1)[1] for f in files] for h, files in IO.headers(spark, str(big)).items()} == {"link_id,speed": ["a.csv"], "speed,Link ID": ["b.csv"], "x" * 13: ["c.csv"]}
    assert IO.column_names("\ufeffspeed, Link ID") == ["speed", "link id"]


def test_headers_of_files_that_only_spark_opens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IO, "OPENED_BY_WORKERS", ())
    for i in range(3):
        put(tmp_path, f"link_id,speed,travel_time,data_as_of\n{i},20,3,2024-01-01T00:00:00\n" * 2 if i else "data_as_of,speed,travel_time,link_id\n2024-01-01T00:00:00,1,1,9\n", f"{i}.csv")
    assert sorted(len(f) for f in IO.headers(spark, str(tmp_path)).values()) == [1, 2]


def test_compressed_files(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("link_id,speed,travel_time,data_as_of\n1,20,3,2024-01-01T00:00:00\n")
    assert IO.accepted(IO.read_traffic(spark, str(tmp_path))).first().link_id == 1


def test_ingest_reads_once(spark, tmp_path, scans):
    path = put(tmp_path, HEAD + "".join(f"{i},{'x' if i % 3 == 0 else 130 + i},120,on,2023-06-05T08:00:00,{i},Queens,a\n" for i in range(30)))
    ok, bad, counts = IO.ingest(IO.read_traffic(spark, path), str(tmp_path / "out"))
    assert (ok.count(), bad.count()) == (20, 10) and bad.where("reject_reason is null").count() == 0
    assert counts == {"rows_read": 30, "rows_accepted": 20, "rows_rejected": 10, "malformed": 10, "missing_timestamp": 0, "suspicious_speed": 20, "suspicious_travel_time": 0}
    assert counts == IO.quality(IO.read_traffic(spark, path)).first().asDict()
    rows = IO.expect_accepted(IO.read_traffic(spark, path), 20)
    assert rows.columns == IO.accepted(IO.read_traffic(spark, path)).columns and all("csv" not in x for x in scans(rows))  # the source is not read again


@pytest.mark.parametrize("size", ["40b", "1k", "128m"])
def test_rows_in_file_order(spark, tmp_path, size):
    names = ["b", "a", "c"]
    expected = []
    for name in sorted(names):
        rows = [f"{name}{i}" for i in range(50 if name != "a" else 3)]
        (tmp_path / f"{name}.csv").write_text("v,w\n" + "".join(f"{r},1\n" for r in rows))
        expected += rows
    (tmp_path / "aa.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        for n in (0, 1, 3, 4, 60, 1000):
            got = IO.in_file_order(spark, str(tmp_path), n).orderBy("row_number").collect()
            assert [r.v for r in got] == expected[:n] and [r.row_number for r in got] == list(range(1, len(got) + 1))
        manifest = IO.write_subsets(spark, str(tmp_path), str(tmp_path / "out"), [2, 70, 500])
        assert {tuple(r) for r in manifest.collect()} == {(2, 2), (70, 70), (500, 103)}
        assert [r.v for r in spark.read.option("header", True).csv(str(tmp_path / "out/2")).collect()] == expected[:2]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_refused_garages_and_buildings(spark, tmp_path):
    path = put(tmp_path, "license_nbr,name,latitude,longitude\n,Depot,1,2\n77,,north,2\n , ,1,2\n", "g.csv")
    got = IO.read_garages(spark, path).collect()
    assert [(r.license_number, r.business_name, r.has_location, r.reject_reason) for r in got] == [("", "Depot", True, None), ("77", "", False, None), ("", "", True, "malformed")]
    path = put(tmp_path, "bbl,lat,lng\n5,40.1,-73\n6,north,-73\n7,40.1,1e999\n8,,\n", "b.csv")
    assert [(r.bbl, r.reject_reason) for r in IO.read_buildings(spark, path).collect()] == [("5", None), ("6", "malformed"), ("7", "malformed"), ("8", None)]
