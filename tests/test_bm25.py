"""The stored index gives what splitting all texts gives, before and after changes."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bm25
from corpusloom.operators import retrieval as rt
from corpusloom.operators import upsert as up
from corpusloom.sources.shared import shared_folder


def path(spark):
    return f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}"


def texts(rng, n):
    words = [f"w{i}" for i in range(60)] + ["É", "糖尿病", "x1"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40), weights=[1 / (j + 1) for j in range(len(words))])), rng.choice("ab")) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "", "a"), (n + 2, "?!", "b"), (n + 3, rows[0][1], "b"), (n + 4, rows[0][1], None)]


def found(df):
    return sorted((r.query_id, r.route_no, r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


QUERIES = [(1, 0, "w0 w1 w1 w50"), (1, 1, "糖尿病 É"), (2, 0, "w3, W4"), (3, 0, "nothing here"), (4, 0, ""), (5, 0, None), (6, 0, "w0")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, route_no int, text string")


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_index(spark, asked, monkeypatch, most):
    monkeypatch.setattr(bm25, "MOST_WEIGHTS", most)
    monkeypatch.setattr(bm25, "DOCS", 40)
    docs = frame(spark, texts(random.Random(1), 400))
    index = bm25.build_index(docs, path(spark), keep=["lang"], near=["lang"])
    assert found(bm25.index_topk(index, asked, 5)) == found(rt.bm25_topk(asked, docs, 5))
    only = F.col("lang") == "a"
    assert found(bm25.index_topk(index, asked, 5, where=only)) == found(rt.bm25_topk(asked, docs, 5, where=only))
    assert bm25.index_topk(index, asked.limit(0), 5).count() == 0
    assert bm25.index_topk(bm25.build_index(docs.limit(0), path(spark), keep=["lang"]), asked, 5).count() == 0
    assert bm25.open_index(spark, path(spark)) is None


def test_index_follows_the_plan(spark, asked, monkeypatch):
    monkeypatch.setattr(bm25, "DOCS", 40)
    rng = random.Random(2)
    state = lambda df: df.select(F.col("doc_id").alias("chunk_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.lit("child").alias("chunk_type"), F.lit("s").alias("source_id"), F.lit(None).cast("long").alias("parent_chunk_id"))
    rows = texts(rng, 300)
    index = bm25.build_index(frame(spark, rows), path(spark), keep=["lang"])
    for _ in range(3):  # documents go, change, come, and come back
        changed = [(i, t if rng.random() < 0.8 else texts(rng, 1)[0][1], lang) for i, t, lang in rows if rng.random() < 0.9]
        changed += [(1000 + rng.randrange(40), texts(rng, 1)[0][1], "b")] if all(i < 1000 for i, *_ in changed) else []
        old, new = frame(spark, rows), frame(spark, changed)
        index = bm25.follow_plan(index, up.plan_incremental(state(old), state(new)), new, keep=["lang"])
        assert found(bm25.index_topk(index, asked, 6)) == found(rt.bm25_topk(asked, new, 6))
        assert found(bm25.index_topk(index, asked, 6, where=F.col("lang") == "b")) == found(rt.bm25_topk(asked, new, 6, where=F.col("lang") == "b"))
        rows = changed
    assert len(index.segments) == 4


def test_stored_index_is_found_again_until_the_files_change(spark, monkeypatch):
    folder = path(spark)
    frame(spark, texts(random.Random(3), 20)).write.parquet(f"{folder}/docs")
    docs = spark.read.parquet(f"{folder}/docs")
    first = bm25.stored_index(docs, folder)
    assert [s.folder for s in bm25.stored_index(docs, folder).segments] == [s.folder for s in first.segments]
    frame(spark, [(99, "more", "a")]).write.mode("append").parquet(f"{folder}/docs")
    assert bm25.stored_index(spark.read.parquet(f"{folder}/docs"), folder).docs == first.docs + 1
