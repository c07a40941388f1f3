"""CSV sources with reject reasons, Parquet copies, CSV sinks and subsets."""

from __future__ import annotations

import csv
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.schemas import BUILDING_ALIASES, GARAGE_ALIASES, TRAFFIC_ALIASES, TRAFFIC_REQUIRED

BAD_ROW = "_corrupt_record"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, the folder that driver and executors share; in local mode one of our own where it is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tidelane-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: what is numbered or counted once stays so."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that are read at a time in search of the end of a header.
FIRST_BYTES = 1 << 16
#: Kinds of storage whose files a Python worker can open; of others one line a file is read by Spark, some files a job.
OPENED_BY_WORKERS = ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")
FILES_A_JOB = 32


def file_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, size) of the files under ``path``, from the listing alone: no byte of them is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))


def _first_line(file: str) -> str | None:
    """The first line of a file, None for an empty one; compressed files are told by their names."""
    scheme, _, rest = file.partition(":")
    if scheme == "file":
        store, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        store, name = fs.FileSystem.from_uri(quote(file, safe="/:@"))
    head = b""
    with store.open_input_stream(name, compression="detect", buffer_size=FIRST_BYTES) as f:
        while b"\n" not in head and (more := f.read(FIRST_BYTES)):
            head += more
    return head.split(b"\n")[0].rstrip(b"\r").decode("utf-8", "replace") if head else None


def first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, head) of the files under ``path`` that are not empty.

    The listing is dealt to tasks, which open their files and read FIRST_BYTES of each, more only where a header
    is longer. A file of a kind that workers can't open is read by Spark up to its first line.
    """
    files = file_list(spark, path).select("file")
    opened = files.where(F.substring_index("file", ":", 1).isin(*OPENED_BY_WORKERS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("file").to_pylist()
            heads = [_first_line(n) for n in names]
            yield pa.record_batch([pa.array([n for n, h in zip(names, heads) if h is not None], pa.string()), pa.array([h for h in heads if h is not None], pa.string())], ["file", "head"])

    out = opened.mapInArrow(read, "file string, head string")
    others = [r["file"] for r in files.where(~F.substring_index("file", ":", 1).isin(*OPENED_BY_WORKERS)).collect()]
    found = []
    for i in range(0, len(others), FILES_A_JOB):
        each = [spark.read.text(f).limit(1).select(F.lit(f).alias("file"), F.col("value").alias("head")) for f in others[i : i + FILES_A_JOB]]
        found += reduce(DataFrame.unionAll, each).collect()
    return out.unionAll(spark.createDataFrame(found, "file string, head string")) if found else out


def headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """The files under ``path`` by their first line. Where all have one, none but the first is named.

    Only first lines are read. If files differ, their names come to the driver, where Spark lists them anyway.
    """
    lines = first_lines(spark, path)
    kinds = lines.groupBy("head").agg(F.min("file").alias("file")).collect()
    if len(kinds) < 2:
        return {r["head"]: [r["file"]] for r in kinds}
    found: dict[str, list[str]] = {}
    for r in lines.collect():
        found.setdefault(r["head"], []).append(r["file"])
    return {h: sorted(f) for h, f in found.items()}


def column_names(head: str) -> list[str]:
    """The trimmed, lower-cased names of a header line."""
    return [n.strip().lower() for n in next(csv.reader([head.removeprefix("\ufeff")]), [])]


def _raw_csv(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """All columns of files with one header as text, plus the text of short or long rows. Of a name that comes twice the last column counts."""
    last = {n: i for i, n in enumerate(names)}
    schema = T.StructType([T.StructField(n if last[n] == i else f"_{i}_{n}", T.StringType()) for i, n in enumerate(names)] + [T.StructField(BAD_ROW, T.StringType())])
    options = {"header": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_ROW, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "enforceSchema": True}
    return spark.read.options(**options).schema(schema).csv(path)


def _by_header(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], str, DataFrame]]:
    """(column names, one of the files, rows) for each header of the files under ``path``."""
    found = headers(spark, path)
    if not found:
        raise ValueError(f"{path} has no header")
    named = [(column_names(head), files) for head, files in sorted(found.items())]
    return [(names, files[0], _raw_csv(spark, path if len(found) == 1 else files, names)) for names, files in named]


def raw_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text under their trimmed, lower-cased header names, plus the text of short or long rows.

    Files may differ in columns and their order: each is read by its own header, and a column that a file lacks
    is null there. Rows are single lines; quotes are doubled inside quotes.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows for _, _, rows in _by_header(spark, path)])


def bound(names: list[str], aliases: dict[str, tuple[str, ...]], required: tuple[str, ...] = (), file: str = "the file") -> dict[str, str | None]:
    """The column of a header that each of ``aliases`` means: its first alias that the header has, blank or not; None for absent ones, an error for absent required ones."""
    out = {name: next((a for a in options if a in names), None) for name, options in aliases.items()}
    for name in required:
        if out[name] is None:
            raise ValueError(f"{file}: required column {name} is missing; looked for {', '.join(aliases[name])}")
    return out


def resolved(raw: DataFrame, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...] = (), file: str = "the file") -> DataFrame:
    """The columns of ``aliases`` by the names that ``raw``, of one header, has."""
    columns = bound(raw.columns, aliases, required, file)
    kept = [BAD_ROW] if BAD_ROW in raw.columns else []
    return raw.select(*[(F.col(f"`{c}`") if c is not None else F.lit(None).cast("string")).alias(name) for name, c in columns.items()], *kept)


def read_columns(spark: SparkSession, path: str | list[str], aliases: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``aliases`` as text from the files under ``path``, bound and checked by each file's own header."""
    return reduce(DataFrame.unionByName, [resolved(rows, aliases, required, file) for _, file, rows in _by_header(spark, path)])


def judged_traffic(raw: DataFrame) -> DataFrame:
    """Typed traffic columns of ``raw`` (resolved text columns), reject_reason (null: accepted) and the suspicious flags.

    The first failure counts: absent field, unreadable number, unreadable time, impossible value. Flags are
    set only on rows whose time can be read. A null time on a short row is an absent field.
    """
    short = F.col(BAD_ROW).isNotNull() if BAD_ROW in raw.columns else F.lit(False)
    d = raw.select(
        C.to_long(F.col("link_id")).alias("link_id"),
        C.to_double(F.col("speed")).alias("speed_mph"),
        C.to_double(F.col("travel_time")).alias("travel_time_seconds"),
        C.to_epoch(F.col("data_as_of")).alias("timestamp_epoch_seconds"),
        F.coalesce(C.trim(F.col("borough")), F.lit("")).alias("borough"),
        C.borough_code(F.col("borough")).alias("borough_code"),
        F.coalesce(C.trim(F.col("link_name")), F.lit("")).alias("link_name"),
        (short & F.col("data_as_of").isNull()).alias("absent"),
    )
    numbers = F.col("link_id").isNull() | F.col("speed_mph").isNull() | F.col("travel_time_seconds").isNull()
    timed = ~F.col("absent") & ~numbers & F.col("timestamp_epoch_seconds").isNotNull()
    valid = C.valid_core(F.col("link_id"), F.col("speed_mph"), F.col("travel_time_seconds"), F.col("timestamp_epoch_seconds"))
    reason = F.when(F.col("absent") | numbers, "malformed").when(~timed, "missing_timestamp").when(~valid, "malformed")
    return d.select(
        *[c for c in d.columns if c != "absent"],
        reason.alias("reject_reason"),
        (timed & C.suspicious_speed(F.col("speed_mph"))).alias("suspicious_speed"),
        (timed & C.suspicious_travel(F.col("travel_time_seconds"))).alias("suspicious_travel_time"),
    )


def _text(c: str) -> Column:
    return F.coalesce(C.trim(F.col(c)), F.lit(""))


def judged_garages(raw: DataFrame) -> DataFrame:
    """Garages with reject_reason: dates that are there must be readable, and a licence or business name must be given; a bad place is only left out."""

    def bad(c: str) -> Column:
        return (_text(c) != "") & C.to_epoch(F.col(c)).isNull()

    place = C.geo_point(F.col("latitude"), F.col("longitude"))
    plain = [c for c in GARAGE_ALIASES if c not in ("license_nbr", "lic_expir_dd", "license_creation_date", "address_borough", "latitude", "longitude")]
    reason = F.when(bad("lic_expir_dd") | bad("license_creation_date"), "malformed").when(~C.identified(_text("license_nbr"), _text("business_name")), "malformed")
    return raw.select(
        _text("license_nbr").alias("license_number"),
        F.coalesce(C.to_epoch(F.col("lic_expir_dd")), F.lit(0)).cast("bigint").alias("license_expiration_epoch_seconds"),
        F.coalesce(C.to_epoch(F.col("license_creation_date")), F.lit(0)).cast("bigint").alias("license_creation_epoch_seconds"),
        *[_text(c).alias(c) for c in plain],
        _text("address_borough").alias("borough"),
        C.borough_code(F.col("address_borough")).alias("borough_code"),
        place.alias("location"),
        place.isNotNull().alias("has_location"),
        reason.alias("reject_reason"),
    )


def judged_buildings(raw: DataFrame) -> DataFrame:
    """Buildings with reject_reason: numbers that are there must be readable; a missing parcel number is kept."""
    level_bad = (_text("subgrade_level") != "") & C.to_int(F.col("subgrade_level")).isNull()
    bad = level_bad | C.bad_number(F.col("elevation_feet")) | C.bad_number(F.col("latitude")) | C.bad_number(F.col("longitude"))
    point = F.struct(F.coalesce(C.to_double(F.col("latitude")), F.lit(0.0)).alias("latitude"), F.coalesce(C.to_double(F.col("longitude")), F.lit(0.0)).alias("longitude"))
    return raw.select(
        _text("bbl").alias("bbl"),
        F.coalesce(C.to_int(F.col("subgrade_level")), F.lit(0)).alias("subgrade_level"),
        F.coalesce(C.to_double(F.col("elevation_feet")), F.lit(0.0)).alias("elevation_feet"),
        point.alias("location"),
        F.when(bad, "malformed").alias("reject_reason"),
    )


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reject_reason is null").drop("reject_reason", "suspicious_speed", "suspicious_travel_time")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("reject_reason is not null")


def quality_columns(judged: DataFrame) -> tuple[list[str], list[Column]]:
    """Names and aggregates: rows read, accepted, rejected, by reason and flag."""
    reason, flags = F.col("reject_reason"), [c for c in ("suspicious_speed", "suspicious_travel_time") if c in judged.columns]
    names = ["rows_read", "rows_accepted", "rows_rejected", "malformed", "missing_timestamp", *flags]
    return names, [F.count(F.lit(1)), F.count_if(reason.isNull()), F.count_if(reason.isNotNull()), F.count_if(reason == "malformed"), F.count_if(reason == "missing_timestamp"), *[F.count_if(F.col(c)) for c in flags]]


def quality(judged: DataFrame) -> DataFrame:
    """One row: rows read, accepted, rejected, by reason and flag."""
    return judged.agg(*[c.alias(name) for name, c in zip(*quality_columns(judged))])


def read_traffic(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Traffic files as ``judged_traffic``; a file without a required column is an error that names it."""
    return judged_traffic(read_columns(spark, path, TRAFFIC_ALIASES, TRAFFIC_REQUIRED))


def read_garages(spark: SparkSession, path: str) -> DataFrame:
    return judged_garages(read_columns(spark, path, GARAGE_ALIASES))


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    return judged_buildings(read_columns(spark, path, BUILDING_ALIASES))


def write_columnar(traffic: DataFrame, path: str) -> None:
    """A Parquet copy, a folder a borough, so that queries on boroughs read those alone."""
    traffic.write.mode("overwrite").partitionBy("borough_code").parquet(path)


def write_by_day(traffic: DataFrame, path: str) -> None:
    """A Parquet copy, a folder a day (UTC, column event_day), by time within: a time window reads its days alone. A day of many rows is dealt over several files."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(timestamp_epoch_seconds div 86400 as int)"))
    n = int(traffic.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = traffic.withColumn("event_day", day).repartitionByRange(n, "event_day", "timestamp_epoch_seconds")
    dealt.sortWithinPartitions("event_day", "timestamp_epoch_seconds").write.mode("overwrite").partitionBy("event_day").parquet(path)


def write_metrics(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order``: nested for growing n."""
    return df.orderBy(*order).limit(n)


def prefix_subsets(df: DataFrame, sizes: list[int], *order: str) -> DataFrame:
    """(subset_rows, ...): for each size the first rows by ``order``.

    Only rows within the largest size are numbered, and those are found by a top-n.
    """
    top = df.orderBy(*order).limit(max(sizes))
    ranked = top.withColumn("row_number", F.row_number().over(Window.orderBy(*order)))
    return _nested(ranked, sizes)


def _nested(numbered: DataFrame, sizes: list[int]) -> DataFrame:
    return numbered.withColumn("subset_rows", F.explode(F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]), lambda n: F.col("row_number") <= n)))


def in_file_order(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """The first ``n`` data rows under ``path`` as text, files by name and rows by their place, with row_number from 1.

    Files are opened in order, twice as many each time, until they hold enough rows; rows are counted a block of
    a file, and only blocks that begin within the first ``n`` rows are numbered, each by itself.
    """
    files = [r["file"] for r in file_list(spark, path).where("size > 0").orderBy("file").collect()]
    place = [F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_")]
    k, blocks, rows = 1, [], None
    while n > 0 and (rows is None or (sum(b["n"] for b in blocks) < n and k // 2 < len(files))):
        parts = [part.select("*", *place, F.monotonically_increasing_id().alias("at_")) for _, _, part in _by_header(spark, files[:k])]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        blocks = rows.groupBy("file_", "block_").agg(F.count("*").alias("n")).orderBy("file_", "block_").collect()
        k *= 2
    if rows is None:
        return raw_csv(spark, path).withColumn("row_number", F.lit(0).cast("bigint")).limit(0)
    starts, before = [], 0
    for b in blocks:
        if before < n:
            starts.append((b["file_"], b["block_"], before))
        before += b["n"]
    needed = spark.createDataFrame(starts, "f_ string, b_ long, before_ long")
    inside = F.row_number().over(Window.partitionBy("file_", "block_").orderBy("at_"))
    numbered = rows.join(needed, (F.col("file_") == F.col("f_")) & (F.col("block_") == F.col("b_"))).withColumn("row_number", inside + F.col("before_"))
    return numbered.where(F.col("row_number") <= n).drop("file_", "block_", "at_", "f_", "b_", "before_")


def file_prefixes(spark: SparkSession, path: str | list[str], sizes: list[int]) -> DataFrame:
    """(subset_rows, row_number, ...): for each size the first data rows under ``path`` by their place in the files."""
    return _nested(in_file_order(spark, path, max(sizes)), sizes)


def write_subsets(spark: SparkSession, path: str | list[str], out: str, sizes: list[int]) -> DataFrame:
    """A folder of CSV files with their header for each size, and its manifest (requested_rows, written_rows)."""
    rows = stored(in_file_order(spark, path, max(sizes)), "subsets")
    for n in sizes:
        own = rows.where(F.col("row_number") <= n).orderBy("row_number")
        write_metrics(own.drop("row_number", BAD_ROW), f"{out}/{n}")
    return subset_manifest(_nested(rows, sizes), sizes)


def subset_manifest(subsets: DataFrame, sizes: list[int]) -> DataFrame:
    """(requested_rows, written_rows) a subset."""
    asked = subsets.sparkSession.createDataFrame([(n,) for n in sizes], "requested_rows int")
    got = subsets.groupBy("subset_rows").agg(F.count("*").alias("written_rows"))
    return asked.join(got, asked.requested_rows == got.subset_rows, "left").select("requested_rows", F.coalesce("written_rows", F.lit(0)).alias("written_rows"))


def ingest(judged: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(accepted, rejected, quality) of ``judged``, from one pass: rows go to two folders of ``path`` and are counted on their way."""
    seen = Observation()
    counts = {name: c for name, c in zip(*quality_columns(judged))}
    watched = judged.observe(seen, *[c.alias(name) for name, c in counts.items()])
    watched.withColumn("is_accepted", F.col("reject_reason").isNull()).write.partitionBy("is_accepted").parquet(path)
    kept = judged.sparkSession.read.schema(judged.schema.add("is_accepted", "boolean")).parquet(path)
    return accepted(kept.where("is_accepted").drop("is_accepted")), rejected(kept.where("not is_accepted").drop("is_accepted")), seen.get


def expect_accepted(judged: DataFrame, expected: int) -> DataFrame:
    """``judged``'s accepted rows; raises if their number is another. The source is read once: rows are counted as they are written."""
    rows, _, counts = ingest(judged, scratch(judged.sparkSession, "ingest"))
    if counts["rows_accepted"] != expected:
        raise ValueError(f"{counts['rows_accepted']} rows accepted, {expected} expected")
    return rows
