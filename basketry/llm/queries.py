"""Registered queries of the training-data operators, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.common import table
from basketry.llm.embedding_dedup import near_vectors
from basketry.llm.exact_dedup import exact_dedup
from basketry.llm.html_extract import extract
from basketry.llm.language_id import fit, identify, page_evidence
from basketry.llm.merkle_manifest import manifest
from basketry.llm.mixing import mix
from basketry.llm.ngram_join import ngram_components
from basketry.llm.packing import pack
from basketry.llm.periodic_runs import digests, periodic_runs, planted
from basketry.llm.quality_mil import quality
from basketry.llm.secret_scan import scan
from basketry.llm.toxicity import toxicity
from basketry.llm.warc_revisit import captures_of, resolve


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken",
                       F.coalesce("first_slot", F.lit(-1)).alias("first_slot"))


def op3_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(page_evidence(table(spark, sf_dir, "pages")), fit(table(spark, sf_dir, "documents")), markup=True)
    return found.select("page_id", "url", "host", "declared", "language", "confidence", "text_language", "accepted")


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op10_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures_of(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_difference_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op13_bitmap_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_length_buckets, op2_source_schedule, op3_itq_near_dedup, op4_chunk_recipes, op5_dom_model, op6_secret_cnn, op7_language_id, op8_compression_toxicity, op9_ngram_join,
    op10_revisit_resolution, op11_attention_quality, op12_difference_cover_runs, op13_bitmap_manifest)}
