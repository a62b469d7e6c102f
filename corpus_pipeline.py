"""The corpus pipeline: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, minhash, mixing, suffixes, toxicity
from corpusloom.llm.work import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts stay. Repeated rows are judged one by one, other columns pass through."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Null, empty and blank texts are like nothing and stay, as do rows without doc_id. Of rows with one doc_id and equal
    text one stays; other texts under a doc_id that stays do too. Other columns pass through, whatever their names.
    """
    return minhash.deduplicated(docs, words=5, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 100 that start earlier in the corpus go, with the broken characters at the edges of a cut.

    Null and empty texts and rows without doc_id stay as they are; a document of which nothing is left stays with an
    empty text. Rows that share a doc_id lose what any of them loses. Other columns pass through, whatever their names.
    """
    return suffixes.without_repeats(docs, least=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it; of the one at the edge of a source's budget, a part.

    Rows without words come as often as their source's complete epochs. Rows equal in doc_id, source and text are taken
    alike. The null source is one of its own. Other columns pass through, whatever their names.
    """
    return mixing.mixed(docs, weights=[1, 2, 3], most=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every row of the mix: one row each, repeated ones too; null and empty texts have no tokens."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL can't express the stages: their tests hold each one against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
