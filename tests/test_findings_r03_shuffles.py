"""One small test for each finding of the third round on what is shuffled, spilled and written, or on time."""

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import bm25
from corpusloom.operators import evaluation as ev
from corpusloom.sources.parsed import _Reader
from corpusloom.sources.shared import shared_folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f7_f8_f16_f17_f18_postings_of_a_block_are_made_where_its_texts_are(spark, monkeypatch):
    monkeypatch.setattr(bm25, "DOCS", 10)
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('a b', id % 7, ' a c', id) AS text", "'x' AS lang").repartition(5)
    index = bm25.build_index(docs, f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}", near=["lang"])
    rows = index.table("postings").select("block", "term", "n", "max_tf", F.input_file_name().alias("file"))
    assert rows.groupBy("block").agg(F.count_distinct("file").alias("files")).where("files > 1").count() == 0  # terms were dealt over buckets
    assert {r.term: (r.n, r.tf) for r in rows.where("term in ('a', 'b3')").groupBy("term").agg(F.sum("n").alias("n"), F.max("max_tf").alias("tf")).collect()} == {"a": (200, 2), "b3": (29, 1)}


def test_f13_a_plan_is_joined_once_and_texts_are_not_shuffled_by_it(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a b', id % 7) AS text")
    index = bm25.build_index(docs, f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}")
    seen = []
    write = bm25._write_segment
    monkeypatch.setattr(bm25, "_write_segment", lambda docs, gone, *args: (seen.extend([plan(docs), plan(gone)]), write(docs, gone, *args)))
    changes = docs.selectExpr("doc_id AS chunk_id", "array('same', 'changed', 'deleted')[int(doc_id % 3)] AS action").join(docs.selectExpr("doc_id AS chunk_id").hint("merge"), "chunk_id")
    index = bm25.follow_plan(index, changes, docs)
    assert len(seen) == 2 and not any("SortMergeJoin" in p for p in seen) and all("BroadcastHashJoin" in p for p in seen)
    assert index.docs == 27 and {r.term: r.n for r in index.table("gone_terms").where("segment = 1").collect()}["a"] == 26


def test_f15_members_of_a_group_are_counted_not_listed_for_each_query(spark):
    members = spark.range(300).selectExpr("id", "nullif(concat('s', id % 3), 's2') AS source").unionByName(spark.createDataFrame([(300, "lone")], "id long, source string"))
    hits = spark.range(5).selectExpr("id AS query_id", "explode(sequence(1, 30)) AS rank").selectExpr("query_id", "(query_id * 40 + rank * (1 + query_id % 2)) % 301 AS id", "rank")
    truth = spark.createDataFrame([(0, "s0"), (1, "s1"), (2, None), (3, "none"), (4, "lone")], "query_id long, source string")
    gold = truth.join(members, "source").select("query_id", "id")
    want = sorted(map(tuple, ev.recall_at_k(hits, gold, 20).collect()))
    assert sorted(map(tuple, ev.recall_of_group(hits, truth, members, "source", 20).collect())) == want and [w[0] for w in want] == [0, 1, 4]


def test_f9_files_are_listed_by_the_tasks(tmp_path):
    for folder in ("a", "b", "deep/c", "deep/er/d"):
        (tmp_path / "flat" / folder).mkdir(parents=True)
        (tmp_path / "flat" / folder / "x.md").write_text(folder)
        (tmp_path / "nested" / "top" / folder).mkdir(parents=True)
        (tmp_path / "nested" / "top" / folder / "x.md").write_text(folder)
    (tmp_path / "flat" / "own.md").write_text("own")
    for kind, more, n in (("flat", ["own"], 4), ("nested", [], 3)):
        reader = _Reader(f"file://{tmp_path}/{kind}", 1)
        parts = reader.partitions()
        assert len(parts) == n and sorted(row[1] for p in parts for row in reader.read(p)) == sorted(["a", "b", "deep/c", "deep/er/d", *more])
        assert not any(path.endswith(".md") for p in parts for path, _ in p.folders)
