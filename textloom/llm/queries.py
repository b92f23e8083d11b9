"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, codes, contamination, extraction, licenses, lines, mixing, neardup, quality, ranking, repetition, suffixes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.cut(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "n_lines", F.size("cut").cast("long").alias("n_cut"), "text")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=["doc_id"])
    doc_id = F.col("row")["doc_id"]
    return out.select(doc_id.alias("doc_id"), quality.held_out(doc_id).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = contamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return contamination.digest(scanned)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    named = F.array_sort(F.array_distinct(F.filter(F.col("blocks.license"), lambda x: x.isNotNull())))
    return out.select(F.col("row")["doc_id"].alias("doc_id"), F.size("blocks").cast("long").alias("n_found"), named.alias("licenses"), "blocks")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).drop("record_id", "target_uri")


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.measure(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(F.col("row")["doc_id"].alias("doc_id"), *[c for c in out.columns if c != "row"])


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(_table(spark, sf_dir, "documents"), neardup.THRESHOLD)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    digests = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "n_tokens", *digests)


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_quality": op2_quality,
    "op3_contamination": op3_contamination,
    "op4_licenses": op4_licenses,
    "op5_mixing": op5_mixing,
    "op6_extraction": op6_extraction,
    "op7_suffixes": op7_suffixes,
    "op8_warc": op8_warc,
    "op10_neardup": op10_neardup,
    "op9_repetition": op9_repetition,
    "op11_bpe": op11_bpe,
    "op12_ranking": op12_ranking,
    "op13_codes": op13_codes,
}
ORACLE_SQL: dict[str, str] = {"op1_lines": lines.ORACLE, "op3_contamination": contamination.ORACLE, "op9_repetition": repetition.oracle(), "op5_mixing": mixing.ORACLE, "op8_warc": warc.ORACLE, "op12_ranking": ranking.ORACLE, "op13_codes": codes.oracle()}
