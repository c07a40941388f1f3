"""The training-data queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, clustering, katz, langid, linededup, media, merkle, mixing, packing, pii, repair, setsketch, toxicity
from .common import documents, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(operator: Callable[..., DataFrame], **parameters) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(documents(spark, sf_dir), **parameters)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": _on_documents(pii.find),
    "op2_katz": _on_documents(katz.score_documents),
    "op3_packing": _on_documents(packing.pack),
    "op4_chat": lambda spark, sf_dir: chat.parse_conversations(_table(spark, sf_dir, "conversations")),
    "op5_mixing": _on_documents(mixing.mix),
    "op6_media": lambda spark, sf_dir: media.features(stored(media.to_media(documents(spark, sf_dir)), compression="zstd")),
    "op7_langid": _on_documents(langid.predictions),
    "op8_merkle": _on_documents(merkle.fingerprints),
    "op9_linededup": _on_documents(linededup.near_groups),
    "op10_setsketch": _on_documents(setsketch.linked, words=3, percent=85),
    "op11_repair": lambda spark, sf_dir: repair.audits(_table(spark, sf_dir, "conversations")),
    "op12_toxicity": lambda spark, sf_dir: toxicity.predictions(documents(spark, sf_dir), _table(spark, sf_dir, "labels")),
    "op13_clusters": lambda spark, sf_dir: clustering.clusters(_table(spark, sf_dir, "embeddings")).drop("n_verified"),
}

ORACLE_SQL: dict[str, str] = {"op5_mixing": mixing.sql(), "op10_setsketch": setsketch.sql(), "op11_repair": repair.sql(), "op13_clusters": clustering.sql()}
