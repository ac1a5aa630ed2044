"""Queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_main, langid, linededup, mixing, simhash, sketch, substring, suffix


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(_table(spark, sf_dir, "documents")).drop("h")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines and paragraphs."""
    done = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    spans = F.concat_ws(",", F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))
    return done.select("doc_id", "n_units", "n_removed", spans.alias("removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_edited(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_nearest_neighbours,
        op3_source_mixing,
        op4_bpe_round_trip,
        op5_language_id,
        op6_html_main_text,
        op7_suffix_array_dedup,
        op8_line_dedup,
        op9_substring_dedup,
        op10_document_fingerprints,
    )
}

#: SQL of the results that SQL can state on whole tables.
ORACLES: dict[str, str] = {
    "op3_source_mixing": mixing.ORACLE,
    "op7_suffix_array_dedup": suffix.ORACLE,
    "op8_line_dedup": linededup.ORACLE,
    "op9_substring_dedup": substring.ORACLE,
}
