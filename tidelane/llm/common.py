"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes at which words end: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark removes the shuffle files of a write at its end, not only when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders of the open ``scratch`` blocks, the innermost last.
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode one of our own where it is unset.

    On a cluster a folder of the driver's machine would lose data, so there an unset one is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidelane-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``stored`` writes inside is removed at the end, but for tables written ``outside``.

    Tables stay as long as the session otherwise, so those of all steps would be on disk at once. Nothing that is
    left to be computed may read what goes.
    """
    folder = f"{shared_dir(spark)}/tidelane-{uuid.uuid4().hex}"
    before = _SCRATCH.set((*_SCRATCH.get(), folder))
    try:
        yield
    finally:
        _SCRATCH.reset(before)
    spark.range(0).write.mode("overwrite").parquet(folder)  # in any store that Spark writes to


def stored(df: DataFrame, compression: str = "snappy", outside: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: its lineage ends there, and its shuffle files go.

    In a ``scratch`` block it is written to the block's folder, or if ``outside`` to that around the block.
    """
    spark = df.sparkSession
    folders = (shared_dir(spark), *_SCRATCH.get())
    path = f"{folders[-2 if outside and len(folders) > 1 else -1]}/tidelane-{uuid.uuid4().hex}"
    cleanup = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).option("parquet.enable.dictionary", "false").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if cleanup is None else spark.conf.set(_CLEANUP, cleanup)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """As ``stored``, bucketed by ``key``: grouping by it later moves none of the table's rows."""
    spark = df.sparkSession
    name = f"tidelane_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """(row_, *columns): each row as one struct, beside the columns to work on, so no name of ``docs`` clashes with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), *columns)


def unwrapped(rows: DataFrame, docs: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` from ``rows`` (row_, ...), those in ``new`` replaced."""
    new = {k: v for k, v in (new or {}).items() if k in docs.columns}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row_")[c].alias(c) for c in docs.columns])


def n_buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words; null and empty text have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(mod: int, doc_id: Column | None = None) -> Column:
    """crc32 of doc_id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("string"), F.lit("")).cast("binary")) % mod
