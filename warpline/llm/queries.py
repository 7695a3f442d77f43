"""The registered queries of this subpackage, one ``opN_<name>`` for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from warpline.llm import bpe, fingerprints, grulm, langid, linededup, packing, quality, simhash, urlfilter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(_read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits_of_pages(spark, _read(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_read(spark, sf_dir, "documents"))


def op5_grulm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grulm.language_model_scores(_read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(_read(spark, sf_dir, "documents"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_read(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_linededup": op1_linededup,
        "op2_warc": op2_warc,
        "op3_simhash": op3_simhash,
        "op4_langid": op4_langid,
        "op5_grulm": op5_grulm,
        "op6_packing": op6_packing,
        "op7_fingerprints": op7_fingerprints,
        "op8_urlfilter": op8_urlfilter,
        "op9_quality": op9_quality,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.sql(), "op8_urlfilter": urlfilter.sql()}
