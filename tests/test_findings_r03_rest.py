"""One small test for each finding of the third round that was still open."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import blocks as bl
from corpusloom.operators import bm25
from corpusloom.operators import retrieval as rt
from corpusloom.plans import layout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f8_terms_are_counted_by_arrays(monkeypatch):
    monkeypatch.setattr(bm25, "COUNTED", 3)
    lists = [["b", "a", "b"], [], ["é", "é", "é", "a"], ["b"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "t"])
    rows = pa.Table.from_batches(bm25._counted([batch, batch.slice(1, 1), batch.slice(0, 0)])).to_pylist()
    assert [(r["doc_id"], r["doc_len"], [(x["term"], x["tf"]) for x in r["terms"]]) for r in rows] == [(0, 3, [("a", 1), ("b", 2)]), (1, None, []), (2, 4, [("a", 1), ("é", 3)]), (3, 1, [("b", 1)]), (4, None, []), (1, None, [])]


def test_f19_a_batch_is_multiplied_and_texts_are_split_once(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('a b', id % 7, ' ', repeat('c ', int(id % 5)), 'Éx, 糖尿病') AS text", "if(id % 3 = 0, 'x', null) AS lang").unionByName(spark.createDataFrame([(300, None, "x"), (301, "", "x"), (302, "?!", "x"), (-5, "a b1", "x")], "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, 0, "a c c b3"), (1, 1, "糖尿病"), (2, 0, "none here"), (3, 0, None), (4, 0, "b1 éX zz")], "query_id long, route_no int, text string")
    rows = lambda df: sorted((r.query_id, r.route_no, r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())
    for where in (None, F.col("lang") == "x"):
        out = rt.bm25_topk(asked, docs, 7, where=where)
        text = plan(out)
        assert "MapInArrow" in text and "regexp_extract_all" not in text and "SortMergeJoin" not in text  # texts and terms met in joins
        joined = rt.topk(rt.bm25_scores(asked, docs, where=where).withColumn("score", F.round("score", 9)), ["query_id", "route_no"], 7, "doc_id")
        assert rows(out) == rows(joined) and len(rows(out)) == 21
    with monkeypatch.context() as m:
        m.setattr(rt, "CELLS", 3)
        assert rows(rt.bm25_topk(asked, docs, 7, where=F.col("lang") == "x")) == rows(joined)
    assert rows(rt.bm25_topk(asked, docs.limit(0), 7)) == [] == rows(rt.bm25_topk(asked.limit(0), docs, 7))


def test_f20_snippets_go_and_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a" * 12 + "b" * 24 + "a" * 12 + "c"), (2, "kept"), (3, None)], "source_id long, text string")
    snippets = spark.createDataFrame([(1, 1, 0, "a" * 20), (1, 0, 3, "b" * 24), (1, 0, 1, "c"), (1, 0, 0, "a" * 24), (3, 0, 0, "x" * 20)], "source_id long, page_idx int, block_idx int, snippet string")
    out = bl.strip_snippets(docs, snippets)
    text = plan(out)
    assert "Broadcast" not in text and text.count("Exchange ") == 2 and text.count("aggregate(") == 1  # the clean text was made for each snippet
    assert {r.source_id: (r.text, r.clean_text, r.leftovers) for r in out.collect()} == {1: ("a" * 12 + "b" * 24 + "a" * 12 + "c", "aaaac", 0), 2: ("kept", "kept", 0), 3: (None, None, 0)}
    again = bl.strip_snippets(docs, snippets.where("page_idx = 0"))  # what the second one leaves holds the first one
    assert {r.source_id: (r.clean_text, r.leftovers) for r in again.collect()} == {1: ("a" * 24 + "c", 1), 2: ("kept", 0), 3: (None, 0)}


def test_f21_pages_are_made_without_a_shuffle(spark):
    class Given:
        documents = spark.createDataFrame([(1, "\n".join(f"line {i}" if i % 4 or i > 30 else " " for i in range(47)) + "\n" * 15 + "end"), (2, "x"), (3, " \n"), (4, ""), (5, None), (6, "\n" * 10 + "y")], "doc_id long, text string")

    pages = layout._pages(Given)
    assert "Exchange" not in plan(layout.block_texts(Given))
    want = {}
    for doc_id, text in Given.documents.collect():
        for i, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                want.setdefault(doc_id, {}).setdefault(i // 10, []).append((i % 7, line))
    names = ["title", "paragraph", "list", "table", "chart", "equation_interline", "image"]
    want = {d: [[(names[k], line) for k, line in p] for p in own.values()] for d, own in want.items()}
    assert {r.source_id: [[(b.type, b.content.math_content) for b in p] for p in r.pages] for r in pages.collect() if r.pages} == want and sorted(want) == [1, 2, 6]


def test_f22_tables_are_sorted_once_and_rows_are_taken_apart_once(spark):
    table = lambda *rows: "<table><tr><th>H</th></tr>" + "".join(f"<tr><td>{r}</td></tr>" for r in rows) + "</table>"
    rows = [("a", 1, 0, "T", table("x", "y &amp; z")), ("a", 2, 0, " ", table("x", "y&z", "new", "new", "<b>new</b>")), ("a", 4, 0, " ", table("more", " ", "n ew", "&lt;")), ("a", 7, 0, " ", table("far")), ("a", 7, 1, " ", table("far", "end")), ("a", 7, 2, "T", table("alone")), ("b", 7, 3, " ", "no rows"), ("b", 7, 4, " ", None)]
    tables = spark.createDataFrame(rows, "heading_path string, page_idx int, block_idx int, c string, content string").selectExpr("'s' AS source_id", "*", "array(c) AS caption")
    merged = bl.crosspage_siblings(tables)
    text = plan(merged)
    assert text.count("Sort ") == 1  # islands were sorted again
    assert [(r.page_idx, r.block_idx, r.merge_role, r.merge_group_id, r.header) for r in merged.orderBy("heading_path", "page_idx", "block_idx").collect()] == [(1, 0, "anchor", "p1-b0", "H"), (2, 0, "sibling", "p1-b0", "H"), (4, 0, "sibling", "p1-b0", "H"), (7, 0, "anchor", "p7-b0", "H"), (7, 1, "sibling", "p7-b0", "H"), (7, 2, "single", "p7-b2", "H"), (7, 3, "single", "p7-b3", ""), (7, 4, "single", "p7-b4", "")]
    out = bl.table_extension(merged)
    assert "Join" not in plan(out)  # siblings' and anchors' rows were taken apart each for itself
    row = lambda *cells: "".join(f"<tr><td>{c}</td></tr>" for c in cells)
    assert {r.merge_group_id: r.extension for r in out.collect()} == {"p1-b0": row("new", "more", "&lt;"), "p7-b0": row("end")}
