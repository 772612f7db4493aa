"""One query per operator over its whole table, with its SQL cross-check where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalmart.llm import addressable, centroids, decontaminate, fingerprints, html_extract, language_id, licenses, ngram_join, packing, quality, sharding, spelling, token_counts
from evalmart.llm.common import table
from evalmart.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op2_ngram_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return quality.quality(table(spark, sf_dir, "documents"), trusted).drop("_key")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op5_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op6_sharding", sharding.ORACLE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op9_license_scan", licenses.ORACLE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


@query("op11_token_ids")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/evalmart-{uuid.uuid4().hex}"
    addressable.write_ids(table(spark, sf_dir, "documents"), path)
    return addressable.read_documents(spark, path)


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_centroid_clustering", centroids.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))
