"""The registered queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, minhash, mixing, negatives, neighbours, quality, rules, suffixes, toxicity, urlfilters, warc, webpages
from .oracles import ORACLES
from .work import shared_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffixes.repeated_spans(_table(spark, sf_dir, "documents"), least=100, digest=True)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.col("kept").cast("string").alias("kept_sha256"))


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), RANKS)


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/corpusloom/warc-{uuid.uuid4().hex}"
    warc.write_archive(_table(spark, sf_dir, "pages"), path, least=0)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), weights=[1, 2, 3], most=3).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), host="source", path="lang")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webpages.main_text(_table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), every=100, positives=5, negatives=10)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=10, share=50, top=2000)


#: What op13 judges by before its list: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: host and path of the pages that show a document which labels mark as toxic (its doc_id is the number in the path)."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = urlfilters.url_parts(F.col("url"))
    shown = pages.select(F.concat(host, path).alias("key"), F.regexp_extract(path, "/([0-9]{1,18})(?:[^0-9]|$)", 1).alias("number")).where("number <> ''").distinct()
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("number")).distinct()
    return urlfilters.judged(pages, RULES, shown.join(toxic, "number", "left_semi")).drop("url")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_minhash_near_dedup, op2_suffix_array_dedup, op3_byte_level_bpe, op4_warc_archive, op5_source_mixing, op6_toxicity, op7_nearest_neighbours, op8_quality_classifier, op9_quality_rules, op10_html_extraction, op11_hard_negatives, op12_phrase_collocations, op13_url_filters, pipeline]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict:
    return dict(ORACLES)
