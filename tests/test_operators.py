"""Operators on small literal tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import ids, models
from corpusloom.functions import text as tx
from corpusloom.operators import blocks as bl
from corpusloom.operators import buckets as bk
from corpusloom.operators import evaluation as ev
from corpusloom.operators import profiles as pf
from corpusloom.operators import retrieval as rt
from corpusloom.operators import sections as sc
from corpusloom.operators import terms as tm
from corpusloom.operators import upsert as up
from corpusloom.streaming import rates as sr
from corpusloom.streaming import stateful as st


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("ＡＢＣ", "abc"), ("１２３", "123"), ("Ａ　Ｂ", "a b"), ("  Diagnosis \n x", "diagnosis x"), ("é", "é"), ("", ""), (None, None)])
def test_normalize(spark, raw, want):
    c = tx.normalize_text(F.col("t"))
    assert one(spark, c, t=raw) == want
    if want:
        assert one(spark, c, t=want) == want


def test_ids(spark):
    a, b = (one(spark, ids.source_id(F.col("f")), f=f) for f in ("/x/Book.v2.pdf", "book.V2.PDF"))
    assert a == b and len(a) == 16
    path = lambda *t: one(spark, ids.heading_path_id(F.array(*map(F.lit, t))))
    assert path("a", "b") != path("a:b") and path("A ", "b") == path("a", "b") and len(path("a")) == 64
    assert one(spark, ids.content_hash(F.lit("A"))) != one(spark, ids.content_hash(F.lit("a")))
    made = spark.range(1000).select(ids.chunk_id(F.lit("s"), F.lit("h"), F.col("id").cast("string")).alias("i"))
    assert made.distinct().count() == 1000
    assert one(spark, ids.media_relative(F.lit("table"), F.lit(3), F.lit(4))) == "table:p3_b4"


def test_scalars(spark):
    assert one(spark, tx.question_index(F.lit("some_q_chunk_q3"))) == 3
    assert one(spark, tx.question_index(F.lit("x_qfoo"))) is None
    assert one(spark, tx.split_heading(F.lit("a >  b > "))) == ["a", "b"]
    assert one(spark, tx.strict_key(F.lit("第　1 章（上）"))) == "第1章(上)"
    assert one(spark, tx.normalize_toc(F.lit("第 5 节 感染……12"))) == "第5节 感染"
    assert one(spark, tx.normalize_toc(F.lit("|Intro| .... 3 4"))) == "Intro"
    strong = tx.norm_strong(F.col("t"))
    assert one(spark, strong, t="Ewing&#x27;肉瘤") == one(spark, strong, t="Ewing' <b>肉瘤</b>")
    assert one(spark, strong, t=r"$\times 10^{9}$") == one(spark, strong, t=r"\times 10^{9}")
    assert one(spark, tx.html_rows(F.lit("<table><tr><td>a</td><th>b</th></tr><TR><td>c</td></TR></table>"))) == [["a", "b"], ["c"]]
    assert one(spark, tx.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == pytest.approx(1.0)
    assert one(spark, tx.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0)))) == 0.0
    assert [one(spark, tx.value_type(F.lit(v))) for v in ("1", "-2.5", "true", '{"a":1}', "x")] == ["int", "float", "bool", "json", "str"]
    assert [one(spark, tx.statement_class(F.lit(v))) for v in (" select 1", "Insert into", "with x")] == ["SELECT", "INSERT", "OTHER"]
    assert one(spark, tx.slot_phrase(F.lit("onset"), F.lit("3d"), {"onset": "since {}"})) == "since 3d"
    assert one(spark, tx.slot_phrase(F.lit("other"), F.lit("3d"), {"onset": "since {}"})) == "other=3d"
    assert one(spark, tx.risk_line(F.lit("high"), F.lit("d"), F.lit("stop"))) == "[high] d 建议:stop"
    flags = one(spark, tx.safety_flags(F.array(F.lit("a "), F.lit("a"), F.lit("")), F.lit(None).cast("boolean"), F.lit(False)))
    assert flags.banned == ["a"] and flags.pregnancy == "unknown" and flags.lactation == "not_lactating"
    assert one(spark, sc.chinese_number(F.lit("二十三"))) == 23
    assert [one(spark, sc.chinese_number(F.lit(v))) for v in ("十", "一百零五", "7")] == [10, 105, 7]
    assert one(spark, tm.drop_negated(F.lit("腹痛(-)"))) is False


ITEM = "array<struct<type:string,content:string>>"


def test_blocks(spark):
    items = [("x", [("text", "第一步")]), ("x", [("text", " ")]), ("x", [("text", "第三步"), ("equation", "e")])]
    df = spark.createDataFrame([("ordered_list", items), ("text_list", items)], f"kind string, items array<struct<item_type:string,item_content:{ITEM}>>")
    got = [r.x for r in df.select(bl.render_list(F.col("kind"), F.col("items")).alias("x")).collect()]
    assert got == ["1. 第一步\n3. 第三步", "- 第一步\n- 第三步"]
    raw = spark.createDataFrame([("a", [["x", "y"], []]), ("b", None)], "source_id string, pages array<array<string>>")
    good, bad = bl.explode_blocks(raw)
    assert [(r.page_idx, r.block_idx, r.block) for r in good.collect()] == [(0, 0, "x"), (0, 1, "y")] and bad.count() == 1
    docs = spark.createDataFrame([("a", "one two " + "s" * 25 + " end")], "source_id string, text string")
    snips = spark.createDataFrame([("a", 0, 1, "s" * 25), ("a", 0, 0, "two")], "source_id string, page_idx int, block_idx int, snippet string")
    r = bl.strip_snippets(docs, snips).first()
    assert r.clean_text == "one two  end" and r.leftovers == 0


def test_reroute_and_covers(spark):
    rows = [("table", ["图 3-1 x"]), ("table", ["插图 1"]), ("table", ["图 1 表 2"]), ("figure", ["表 1"])]
    df = spark.createDataFrame([(k, c, None) for k, c in rows], "chunk_kind string, caption array<string>, original_chunk_kind string")
    once = bl.reroute_kind(df)
    assert [r.chunk_kind for r in once.collect()] == ["figure", "table", "table", "figure"]
    assert [r.chunk_kind for r in bl.reroute_kind(once).collect()] == ["figure", "table", "table", "figure"]
    blocks = [("a", 0, "table", "", "", [0.0, 0.0, 900.0, 800.0]), ("a", 1, "table", "", "", [0.0, 0.0, 900.0, 800.0]), ("a", 1, "paragraph", "x", None, None)]
    df = spark.createDataFrame(blocks, "source_id string, page_idx int, type string, text string, html string, bbox array<double>")
    assert sorted((r.page_idx, r.type) for r in bl.drop_cover_tables(df).collect()) == [(1, "paragraph"), (1, "table")]


def test_crosspage_tables(spark):
    table = lambda *rows: "<table>" + "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in rows) + "</table>"
    head = ("name", "v")
    rows = [
        ("s", "h", 909, 6, ["t"], table(head, ("a", 1))),
        ("s", "h", 910, 0, [], table(head, ("a", 1), ("b", 2))),
        ("s", "h", 911, 0, [], table(("Name".lower(), " v"), ("c", 3))),
        ("s", "h", 920, 1, [], table(head, ("z", 9))),
        ("s", "g", 911, 1, [], table(head, ("q", 1))),
    ]
    df = spark.createDataFrame(rows, "source_id string, heading_path string, page_idx int, block_idx int, caption array<string>, content string")
    out = bl.crosspage_siblings(df)
    got = {(r.page_idx, r.block_idx): (r.merge_role, r.merge_group_id) for r in out.collect()}
    assert got == {(909, 6): ("anchor", "p909-b6"), (910, 0): ("sibling", "p909-b6"), (911, 0): ("sibling", "p909-b6"), (920, 1): ("single", "p920-b1"), (911, 1): ("single", "p911-b1")}
    anchors = {r.page_idx: r.anchor for r in bl.resolve_anchor(out).collect() if r.anchor}
    assert {k: (a.page_idx, a.block_idx) for k, a in anchors.items()} == {910: (909, 6), 911: (909, 6)}
    assert [r.extension for r in bl.table_extension(out).collect()] == ["<tr><td>b</td><td>2</td></tr><tr><td>c</td><td>3</td></tr>"]


def test_panels(spark):
    rows = [(0, "h", []), (1, "h", ["A.运动前"]), (2, "h", ["图 1"]), (3, "h", []), (4, "g", ["图 2"]), (5, "g", ["图 3"])]
    df = spark.createDataFrame([("s", 1, b, h, c) for b, h, c in rows], "source_id string, page_idx int, block_idx int, heading_path string, caption array<string>")
    got = {r.block_idx: (r.merge_role, r.merge_group_id) for r in bl.merge_panels(df).collect()}
    assert got[0] == ("sibling", "p1-b2") and got[2] == ("anchor", "p1-b2") and got[1][0] == "standalone" and got[3][0] == "standalone" and got[4][0] == "standalone"


def test_headings(spark):
    media = spark.createDataFrame([("a", 1, "m1"), ("a", 5, "m2"), ("a", 9, "m3")], "source_id string, position int, id string")
    ranges = spark.createDataFrame([("a", 1, 5, "x"), ("a", 7, 8, "y")], "source_id string, start int, end int, heading_path string")
    got = {r.id: (r.heading_path, r.orphan_reason) for r in bl.assign_heading(media, ranges).collect()}
    assert got == {"m1": ("x", None), "m2": ("x", None), "m3": (None, "outside_sections")}
    parents = spark.createDataFrame([("a", 1, "p", "one"), ("a", 2, "p", "two"), ("a", 3, "q", "x")], "source_id string, position int, section_path string, head string")
    assert [r.heading_path for r in bl.heading_paths(parents).orderBy("position").collect()] == ["p", "p > two", "q"]


def test_children(spark):
    make = lambda lens: spark.createDataFrame([("s", 0, i, n) for i, n in enumerate(lens)], "source_id string, parent int, pos int, len int")
    split = lambda lens: [r.child for r in sc.split_children(make(lens)).orderBy("pos").collect()]
    assert split([600, 600]) == [0, 0]
    assert split([600, 601]) == [0, 1]
    assert split([300, 300, 300, 300, 100]) == [0, 0, 1, 1, 1]
    assert split([150, 900, 900]) == [0, 0, 1]
    assert split([600, 600, 100]) == [0, 1, 1]


def test_sections(spark):
    rows = [("a", 0, 1, 5000), ("a", 1, 1, 100), ("a", 2, 2, 3000), ("a", 3, 3, 10), ("a", 4, 1, 20)]
    df = spark.createDataFrame(rows, "source_id string, pos int, level int, len int")
    assert [r.group for r in sc.absorb_short(df).orderBy("pos").collect()] == [0, 2, 2, 3, 4]
    blocks = spark.createDataFrame([("a", i, 0, "paragraph", t, len(t)) for i, t in enumerate(["preface", "one", "text", "References", "ref", "two", "more"])], "source_id string, pos int, page int, type string, text string, len int")
    starts = spark.createDataFrame([("a", 1, "one", 1), ("a", 5, "two", 1)], "source_id string, pos int, section string, level int")
    placed = sc.assign_sections(blocks, starts)
    assert [r.text for r in sc.truncate_body(placed, "^END$", "^References$").orderBy("pos").collect()] == ["one", "text", "two", "more"]
    parents, children = sc.chunk_documents(blocks, starts, [("^x", 10)], "^$")
    assert sc.conservation(parents, children).count() == 0
    cands = spark.createDataFrame([("a", 0, 1, ["k"], "exact"), ("a", 1, 1, ["k"], "exact"), ("a", 6, 1, ["k"], "page_header")], "source_id string, pos int, level int, path array<string>, action string")
    assert sc.choose_starts(cands, blocks, least=5).first().pos == 1
    split = spark.createDataFrame([("a", 0, "第一章"), ("a", 1, "总论"), ("a", 2, "第二章 感染")], "source_id string, pos int, text string")
    assert [r.text for r in sc.merge_split_titles(split).orderBy("pos").collect()] == ["第一章 总论", "第二章 感染"]
    nums = spark.createDataFrame([("a", "p", i, n) for i, n in enumerate([1, 2, 4, 4])], "source_id string, parent string, pos int, number int")
    assert [(r.number, r.expected) for r in sc.numbering_gaps(nums).orderBy("pos").collect()] == [(4, 3), (4, 5)]


def test_upsert_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a", "t0", "t0"), (2, "b", "t0", "t0")], "id int, v string, created_at string, updated_at string")
    new = spark.createDataFrame([(2, "B", 1), (2, "C", 2), (3, "d", 1)], "id int, v string, n int")
    once = up.upsert(target, new, ["id"], F.lit("t1"), [F.col("n")])
    rows = sorted(map(tuple, once.collect()))
    assert rows == [(1, "a", "t0", "t0"), (2, "C", "t0", "t1"), (3, "d", "t1", "t1")]
    assert sorted(map(tuple, up.upsert(once, new, ["id"], F.lit("t2"), [F.col("n")]).collect())) == rows


def test_plans(spark):
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, content_hash string, chunk_type string, source_id string, parent_chunk_id string")
    old = make([("a", "1", "child", "s", "p"), ("b", "2", "child", "s", "p"), ("p", "9", "parent", "s", None), ("z", "5", "child", "other", None)])
    new = make([("a", "1", "child", "s", "p"), ("c", "2", "child", "s", "p"), ("p", "8", "parent", "s", None)])
    got = {r.chunk_id: (r.action, r.embed) for r in up.plan_incremental(old, new).collect()}
    assert got == {"a": ("unchanged", False), "b": ("deleted", False), "c": ("new", True), "p": ("changed", False), "z": ("deleted", False)}
    assert [r.chunk_id for r in up.stale_chunks(old, new).collect()] == ["b"]
    vectors = spark.createDataFrame([("b", "vec")], "source_chunk_id string, v string")
    assert [(r.chunk_id, r.from_chunk_id) for r in up.reuse_vectors(up.plan_incremental(old, new), new, old, vectors).collect()] == [("c", "b")]
    done = spark.createDataFrame([("a", "ok"), ("b", "failed"), ("c", "merged")], "k string, status string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert sorted(r.k for r in up.purge_for_rerun(done, keys, ["k"]).collect()) == ["c"]
    assert sorted(r.k for r in up.todo(keys, done, ["k"]).collect()) == ["d"]
    assert sorted(r.k for r in up.todo(keys, done, ["k"], retry_failed=True).collect()) == ["b", "d"]
    now = dt.datetime(2024, 1, 1, 12)
    chunks = spark.createDataFrame([("a", "pending", now - dt.timedelta(minutes=9)), ("b", "failed", now - dt.timedelta(minutes=9)), ("c", "pending", now)], "chunk_id string, embedding_status string, updated_at timestamp")
    expected = spark.createDataFrame([("a", "a"), ("a", "a_q0"), ("b", "b")], "source_chunk_id string, id string")
    have = spark.createDataFrame([("a",), ("a_q0",)], "id string")
    assert {r.chunk_id: r.action for r in up.compensation_plan(chunks, expected, have, F.lit(now)).collect()} == {"a": "mark_done", "b": "embed"}


def test_vector_records(spark):
    rows = [("c", "s", "child", "raw", None, "T", "sum", ["q0", " ", "q2"]), ("t", "s", "table", "raw", "", "", None, None), ("f", "s", "figure", "raw", "st", None, "", None), ("p", "s", "parent", "raw", None, "", "", None)]
    df = spark.createDataFrame(rows, "chunk_id string, source_id string, chunk_type string, chunk_raw_text string, medical_statement string, title string, summary string, hypothetical_questions array<string>")
    good, bad = bl.build_vector_records(df)
    assert {r.id: r.text for r in good.collect()} == {"c": "T\nraw", "c_summary": "sum", "c_q0": "q0", "c_q2": "q2", "f": "st"}
    assert [r.chunk_id for r in bad.collect()] == ["t"]


def test_fusion(spark):
    hits = [("q", 0, "dense", 1, "a"), ("q", 0, "dense", 2, "b"), ("q", 1, "sparse", 1, "a"), ("q", 2, "sparse", 3, "c")]
    df = spark.createDataFrame(hits, "query_id string, route_no int, kind string, rank int, id string")
    got = {r.id: r for r in rt.rrf_fuse(df).collect()}
    assert got["a"].score == pytest.approx(2 / 61) and got["b"].score == pytest.approx(1 / 62) and got["c"].first_rank == 3
    many = df.where("kind = 'dense'").unionByName(spark.range(10).select(F.lit("q").alias("query_id"), (F.col("id") + 1).cast("int").alias("route_no"), F.lit("sparse").alias("kind"), F.lit(1).alias("rank"), F.lit("x").alias("id")))
    assert {r.id: r.score for r in rt.rrf_fuse(many).collect()}["a"] == pytest.approx(2 / 61)
    assert {r.id: r.score for r in rt.rrf_fuse(many, factor=0).collect()}["a"] == pytest.approx(1 / 61)
    records = spark.createDataFrame([("a", "k1", "original"), ("b", "k1", "summary"), ("c", "k2", "question")], "id string, source_chunk_id string, vector_type string")
    chunks = {r.source_chunk_id: r for r in rt.aggregate_vectors(rt.rrf_fuse(df), records).collect()}
    assert chunks["k1"].score == pytest.approx(2 / 61 + 1 / 62) and [h.id for h in chunks["k1"].vector_hits] == ["a", "b"]
    assert rt.rrf_fuse(df.limit(0)).count() == 0


def test_filters_and_rerank(spark):
    df = spark.createDataFrame([("q", "a", 1, None), ("q", "b", 2, True), ("q", "c", 3, False)], "query_id string, id string, rank int, ok boolean")
    assert [r.id for r in rt.apply_post_filters(df, [F.col("ok"), F.lit(True)]).orderBy("rank").collect()] == ["a", "b"]
    score = F.when(F.col("id") == "c", 9.0).otherwise(1.0)
    assert [r.id for r in rt.rerank(df, score, 2).orderBy("rank").collect()] == ["c", "a"]
    assert [r.id for r in rt.rerank(df, F.when(F.col("id") == "c", 9.0), 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r.id for r in rt.rerank(df, score, 2, enabled=False).orderBy("rank").collect()] == ["a", "b"]


def test_bm25_prefers_rare_terms_and_limits_groups(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "发热 咳嗽"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([("x", 0, "gamma alpha"), ("y", 0, "发热")], "query_id string, route_no int, text string")
    got = rt.bm25_topk(q, docs, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [("x", 2), ("x", 1), ("y", 3)]
    plan = rt.topk(docs.withColumn("score", F.lit(1.0)), ["text"], 2, "doc_id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_context(spark):
    chunks = spark.createDataFrame([("c", "p", "child", "h", "own", "0"), ("p", None, "parent", "h", "up", "parent"), ("o", None, "child", "h", " ", "1")] + [(f"m{i}", "p", "figure", "h", "x", f"figure:p{i}_b1") for i in (10, 2, 1, 3)], "chunk_id string, parent_chunk_id string, chunk_type string, heading_path_id string, chunk_raw_text string, relative_chunk_index string")
    cands = spark.createDataFrame([("q", "c", 1, "mt"), ("q", "o", 2, "match"), ("q", "gone", 3, "left")], "query_id string, source_chunk_id string, rank int, matched_text string")
    assert {r.source_chunk_id: r.context for r in rt.expand_to_parent(cands, chunks).collect()} == {"c": "up", "o": "match", "gone": "left"}
    media = rt.section_media(spark.createDataFrame([("h",)], "heading_path_id string"), chunks, 3)
    assert [r.relative_chunk_index for r in media.orderBy("media_rank").collect()] == ["figure:p10_b1", "figure:p1_b1", "figure:p2_b1"]
    assert [r.parent_id for r in rt.unique_parents(cands, chunks).orderBy("rank").collect()] == ["p", "o"]
    parents = spark.createDataFrame([("q", "has mt inside")], "query_id string, context string")
    assert sorted(r.matched_text for r in rt.hints(cands, parents).collect()) == ["left", "match"]


def test_metrics(spark):
    rows = [("ideal", i + 1, s) for i, s in enumerate([3, 2, 1, 0])] + [("reversed", i + 1, s) for i, s in enumerate([0, 1, 2, 3])] + [("zero", 1, 0)]
    got = {r.c: r for r in ev.graded(spark.createDataFrame(rows, "c string, rank int, score int"), 4, ["c"]).collect()}
    assert got["ideal"].ndcg == pytest.approx(1) and 0 < got["reversed"].ndcg < 1 and got["zero"].ndcg == 0
    assert got["reversed"].mrr == pytest.approx(1 / 3) and got["ideal"].p2 == 0.5 and got["zero"].mrr == 0
    rho = {r.c: r.rho for r in ev.spearman(spark.createDataFrame(rows, "c string, rank int, score int"), ["c"]).collect()}
    assert rho["ideal"] == pytest.approx(1) and rho["reversed"] == pytest.approx(-1) and rho["zero"] is None


def test_linking(spark):
    vocab = spark.createDataFrame([("R50", "fever", "fever", [1.0, 0.0]), ("R10", "fever", "fever", [1.0, 0.0]), ("K1", "pain", "ache", [0.0, 1.0])], "concept_id string, preferred_term string, alias string, vector array<double>")
    mentions = spark.createDataFrame([(1, "fever", [0.0, 0.0]), (2, "aching", [0.05, 1.0]), (3, "other", [1.0, 1.0])], "mention_id int, text string, vector array<double>")
    got = {r.mention_id: (r.concept_id, r.tier) for r in tm.link_entities(mentions, vocab).collect()}
    assert got == {1: ("R10", 1), 2: ("K1", 2), 3: (None, 3)}
    names = spark.createDataFrame([("x", "b"), ("x", "bb"), ("x", "aa"), ("y", "c")], "concept_id string, alias string")
    bags = spark.createDataFrame([("d", "x"), ("e", "y")], "dimension string, concept_id string")
    assert [(r.dimension, r.bag) for r in tm.expand_aliases(bags, names).collect()] == [("d", "aa bb")]


def test_questions(spark):
    rows = [("s", 1, "d1", "dimension", 0.9, True), ("s", 1, "d2", "dimension", 0.8, True), ("s", 1, "d3", "dimension", 0.7, True), ("s", 1, "i1", "item", 0.5, True), ("s", 1, "i2", "item", 0.6, False), ("t", 2, "i1", "item", 0.1, True)]
    df = spark.createDataFrame(rows, "session_id string, round int, item string, kind string, gain double, askable boolean")
    got = {(r.session_id, r.item): r.status for r in tm.select_questions(df, 3).collect()}
    assert got == {("s", "d1"): "ask", ("s", "d2"): "ask", ("s", "d3"): "skip", ("s", "i1"): "ask", ("s", "i2"): "unaskable", ("t", "i1"): "skip"}


def test_profiles_and_as_of(spark):
    people = spark.createDataFrame([(1,), (2,)], "id int")
    kids = spark.createDataFrame([(1, "b"), (1, "a")], "id int, v string")
    got = {r.id: [x.v for x in r.kids] for r in pf.nested(people, "id", {"kids": (kids, ["v"])}).collect()}
    assert got == {1: ["a", "b"], 2: []}
    t = lambda h: dt.datetime(2024, 1, 1, h)
    events = spark.createDataFrame([("k", t(1), 1), ("k", t(3), 2), ("k", t(6), 3)], "config_key string, ts timestamp, event_id int")
    changes = spark.createDataFrame([("k", t(2), "x"), ("k", t(5), None)], "config_key string, created_at timestamp, new_value string")
    assert {r.event_id: r.in_force for r in pf.config_as_of(events, changes).collect()} == {1: None, 2: "x", 3: None}


def test_throttle_batch_and_stream_agree(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 61, 61.5])] + [("b", 9, t0)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    want = {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, 58), 4: (True, None), 5: (True, None), 9: (True, None)}
    assert {r.event_id: (r.accepted, r.retry_after) for r in sr.throttle(df, 3, 60.0).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    st.use_rocksdb(spark)
    stream = st.throttle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 60.0)
    q = stream.writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r.event_id: (r.accepted, r.retry_after) for r in spark.table("admitted").collect()} == want


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=m), float(m), m % 3 == 0) for m in range(30)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, value double, bad boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    job = lambda d: sr.error_ratio(d, F.col("bad"), ["k"], "10 minutes", "5 minutes")
    stream = job(sr.event_time(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("ratios").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("ratios").collect())) == sorted(map(tuple, job(df).collect()))


def test_logs_and_ingest(spark, tmp_path):
    lines = [('{"log": "{\\"timestamp\\": \\"2024-01-01T00:00:00\\", \\"level\\": \\"INFO\\", \\"event\\": \\"e\\"}", "stream": "stdout", "time": "2024-01-02T00:00:00"}',), ('{"log": "broken", "stream": "stderr", "time": "2024-01-03T00:00:00"}',), ("junk",)]
    out = sr.parse_log_stream(spark.createDataFrame(lines, "value string"), F.lit("2030-01-01").cast("timestamp")).collect()
    assert [(r.ts.isoformat()[:10], r.level, r.event) for r in out] == [("2024-01-01", "info", "e"), ("2024-01-03", "unknown", None), ("2030-01-01", "unknown", None)]
    t = dt.datetime(2024, 1, 1)
    src, dst = tmp_path / "src", tmp_path / "dst"
    schema = "id int, ts timestamp, v string"
    stream = lambda: sr.ingest_stream(spark.readStream.schema(schema).parquet(str(src)), str(dst), "id", str(tmp_path / "ck")).start()
    for v in ("one", "two"):
        spark.createDataFrame([(1, t, v), (2 if v == "one" else 3, t, v)], schema).coalesce(1).write.mode("append").parquet(str(src))
        q = stream()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.id, r.v) for r in sr.read_ingested(spark, str(dst)).collect()) == [(1, "two"), (2, "one"), (3, "two")]
    # what isn't published yet isn't seen
    spark.createDataFrame([(9, t, "x", 7, 0)], f"{schema}, place int, bucket int").write.partitionBy("place", "bucket").mode("append").parquet(str(dst / "data"))
    assert sorted(r.id for r in sr.read_ingested(spark, str(dst)).collect()) == [1, 2, 3]
    assert sr.read_ingested(spark, str(tmp_path / "nothing")) is None


def test_a_lost_checkpoint_loses_no_rows_and_folders_stay_few(spark, tmp_path, monkeypatch):
    t = dt.datetime(2024, 1, 1)
    src, dst = tmp_path / "src", tmp_path / "dst"
    schema = "id int, ts timestamp, v string"

    def run(rows, check):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(src))
        q = sr.ingest_stream(spark.readStream.schema(schema).parquet(str(src)), str(dst), "id", str(tmp_path / check)).start()
        q.processAllAvailable()
        q.stop()

    run([(1, t, "a"), (2, t, "a")], "one")
    run([(1, t, "b")], "two")
    run([(1, t + dt.timedelta(days=1), "z")], "three")  # a new checkpoint each: batch numbers begin at 0 again
    assert sorted((r.id, r.v) for r in sr.read_ingested(spark, str(dst)).collect()) == [(1, "z"), (2, "a")]
    monkeypatch.setattr(bk, "PLACES", 3)
    held = sr.read_ingested(spark, str(dst))
    for i in range(10):
        sr.publish(spark.createDataFrame([(1, t, f"v{i}")], schema), str(dst), "id")
        if i == 0:
            assert sorted((r.id, r.v) for r in held.collect()) == [(1, "z"), (2, "a")]  # a reader goes on with its snapshot
    assert sorted((r.id, r.v) for r in sr.read_ingested(spark, str(dst)).collect()) == [(1, "v9"), (2, "a")]
    assert len(list((dst / "data").glob("place=*/bucket=*"))) <= 3 * 2 + 2 and len(list((dst / "log").glob("at=*"))) <= 4
    sr.publish(spark.createDataFrame([], schema), str(dst), "id")
    assert sorted((r.id, r.v) for r in sr.read_ingested(spark, str(dst)).collect()) == [(1, "v9"), (2, "a")]


def test_models(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "abc")], "id int, t string")
    got = {r.id: r.vector for r in models.with_embeddings(df, "t").collect()}
    assert got[2] is None and got[1] == got[3] and len(got[1]) == models.DIM
    out = models.enriched(df, lambda r: {"n": len(r["t"])}, "id int, t string, n int, status string, error string")
    assert {r.id: r.status for r in out.collect()} == {1: "ok", 2: "failed", 3: "ok"}


def test_json_lines(spark, tmp_path):
    from corpusloom.sources.documents import read_jsonl

    (tmp_path / "x.jsonl").write_text('{"k": "a", "status": "ok"}\n{"k": "b", "status": "failed"}\n\n{broken\n')
    ok, failed, bad = read_jsonl(spark, str(tmp_path / "x.jsonl"), "k string, status string")
    assert [r.k for r in ok.collect()] == ["a"] and [r.k for r in failed.collect()] == ["b"] and [r.line for r in bad.collect()] == ["{broken"]


def test_parsed_documents_and_manifest(spark, tmp_path):
    from corpusloom.sources.documents import load_parsed_documents, write_manifest

    for name, parts in (("a", ("x.md", "x_content_list.json", "x_middle.json", "x_model.json")), ("b", ("y.md",))):
        (tmp_path / "in" / name).mkdir(parents=True)
        for part in parts:
            (tmp_path / "in" / name / part).write_text('[[{"type": "title", "content": {"title_content": [{"type": "text", "content": "T"}]}}]]' if "content_list" in part else "body")
    good, bad = load_parsed_documents(spark, str(tmp_path / "in"))
    (row,) = good.collect()
    assert row.folder.endswith("/a") and row.md == "body" and row.pages[0][0].content.title_content[0].content == "T"
    assert [(r.folder[-1], r.missing) for r in bad.collect()] == [("b", ["content_list", "middle", "model"])]
    write_manifest(spark.createDataFrame([("one", 1), ("two", 2)], "book_dir string, n int"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("book_dir", "n").collect()) == [("one", 1), ("two", 2)]


def test_large_vocabularies_meet_in_blocks(spark, monkeypatch):
    import numpy as np

    from corpusloom.operators import terms as tm

    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 32))
    m = v + rng.standard_normal(v.shape) * 0.2
    vocabulary = spark.createDataFrame([(f"c{i:03}", f"t{i}", x.tolist()) for i, x in enumerate(v)], "concept_id string, preferred_term string, vector array<double>")
    mentions = spark.createDataFrame([(i, "m", x.tolist()) for i, x in enumerate(m)], "mention_id int, text string, vector array<double>")
    whole = sorted(tuple(r) for r in tm.link_nearest(mentions, vocabulary, 0.92).collect())
    monkeypatch.setattr(tm, "is_small", lambda df: False)
    assert sorted(tuple(r) for r in tm.link_nearest(mentions, vocabulary, 0.92).collect()) == whole and len(whole) > 50


def test_upsert_needs_an_order_for_several_updates(spark):
    import pytest

    from corpusloom.operators import upsert as up

    target = spark.createDataFrame([(1, "a", "t", "t")], "k int, v string, created_at string, updated_at string")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(Exception, match="several updates"):
        up.upsert(target, twice, ["k"], F.lit("now")).collect()
    assert up.upsert(target, twice, ["k"], F.lit("now"), [F.col("v")]).first().v == "c"


def test_sequential_section_operators(spark):
    from corpusloom.operators import sections as sc

    flat = spark.createDataFrame([(1, 0, 0, "head one"), (1, 1, 0, "text"), (1, 2, 0, "head one"), (1, 3, 1, ""), (1, 4, 1, "last")], "source_id int, pos long, page long, text string")
    parents = spark.createDataFrame([(1, 0, 0, "head one"), (1, 1, 0, "head one"), (1, 2, 1, ""), (1, 3, 9, "nowhere")], "source_id int, parent_idx long, page long, head string")
    assert [(r.start, r.end) for r in sc.locate_parents(parents, flat).orderBy("parent_idx").collect()] == [(0, 2), (2, 4), (4, None), (None, None)]
    sections = spark.createDataFrame([(1, 0, 1, "a", "A"), (1, 1, 2, "gone", "X"), (1, 2, 1, "b", "B"), (1, 3, 1, "a", "A2")], "source_id int, pos long, level int, title string, path string")
    own = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 1, "a"), (1, 2, 1, "b"), (1, 3, 1, "a"), (1, 4, 1, "none")], "source_id int, pos long, level int, title string")
    assert [r.section_path for r in sc.align_sections(own, sections).orderBy("pos").collect()] == ["A", "A", "B", "A2", None]


def test_fuzzy_titles_are_the_best_by_matching_blocks(spark):
    from difflib import SequenceMatcher

    from corpusloom.operators import sections as sc

    keys = ["第一章总论", "第二章肺炎", "第三章肾脏疾病", "第四章肾脏病"]
    toc = spark.createDataFrame([(1, k, k, 1) for k in keys], "source_id int, key string, text string, level int")
    raw = ["第二章肺炎症", "第三章肾疾病", "第九章", "第四章 肾脏病", "附录"]
    titles = spark.createDataFrame([(1, i, t, t.replace(" ", ""), None) for i, t in enumerate(raw)], "source_id int, pos int, text string, key string, match string")
    got = {r.pos: (r.match.toc_title, r.match.ratio) for r in sc.fuzzy_titles(titles, toc, "^第.*章", 0.8).collect()}
    want = {}
    for i, t in enumerate(raw):
        best = max((SequenceMatcher(None, t.replace(" ", ""), k).ratio(), k) for k in keys)
        if t.startswith("第") and best[0] >= 0.8:
            want[i] = (best[1], best[0])
    assert got == want and want


def _contents(spark, titles):
    """Contents of one source: (level, title) in order."""
    rows = [("a", i, level, t) for i, (level, t) in enumerate(titles)]
    return sc.with_ancestors(spark.createDataFrame(rows, "source_id string, pos int, level int, text string"), 4).withColumn("key", F.col("text"))


def test_equal_names_go_to_the_chapter_they_stand_in(spark):
    toc = _contents(spark, [(1, "Ch1"), (2, "Alpha"), (2, "Intro"), (1, "Ch2"), (2, "Beta"), (2, "Intro")])
    body = spark.createDataFrame([("a", i, t) for i, t in enumerate(["Ch1", "Alpha", "Intro", "Ch2", "Beta", "Intro"])], "source_id string, pos int, text string")
    assert [r.match.toc_pos for r in sc.match_titles(body, toc).orderBy("pos").collect()] == [0, 1, 2, 3, 4, 5]
    three = _contents(spark, [(1, "Ch1"), (2, "Intro"), (1, "Ch2"), (2, "Intro"), (1, "Ch3"), (2, "Intro")])
    places = spark.createDataFrame([("a", i, t, "exact") for i, t in enumerate(["Ch1", "Intro", "Ch2", "Intro", "Ch3", "Intro"])], "source_id string, pos int, key string, action string")
    blocks = spark.createDataFrame([("a", i, 100) for i in range(6)], "source_id string, pos int, len int")
    got = sorted((r.pos, r.level, list(r.path)) for r in sc.section_starts(places, three, blocks).collect())
    assert got == [(0, 1, ["Ch1"]), (1, 2, ["Ch1", "Intro"]), (2, 1, ["Ch2"]), (3, 2, ["Ch2", "Intro"]), (4, 1, ["Ch3"]), (5, 2, ["Ch3", "Intro"])]


def test_titles_against_a_stack_kept_line_by_line(spark):
    rng = random.Random(7)
    titles = [(rng.choice([1, 2, 2, 3, 3, 3, 4]), i) for i in range(120)]
    titles = [(level, f"{level}-{i if level == 1 and i % 3 else rng.choice('abc')}") for level, i in titles]
    toc = _contents(spark, titles)
    known = [(r.pos, r.level, r.text, list(r.ancestors)) for r in toc.orderBy("pos").collect()]
    lines = [t for _, t in titles if rng.random() < 0.8] + ["none", "2-a"]
    stack, want = [None] * 4, []
    for t in lines:
        of = [e for e in known if e[2] == t]
        hit = of[0] if of else None
        if len(of) > 1:
            hit = next((e for e in of if [x for x in stack[: e[1] - 1] if x] == e[3]), hit)
        if hit:
            stack = [*stack[: hit[1] - 1], hit[2], *[None] * (4 - hit[1])]
        want.append(hit and hit[0])
    body = spark.createDataFrame([("a", i, t) for i, t in enumerate(lines)], "source_id string, pos int, text string")
    assert [r.match and r.match.toc_pos for r in sc.match_titles(body, toc).orderBy("pos").collect()] == want


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.95])
def test_alike_titles_are_those_of_all_pairs(spark, threshold):
    from difflib import SequenceMatcher

    rng = random.Random(int(threshold * 100))
    names = ["".join(rng.choices("ab糖c", k=rng.randint(0, 14))) for _ in range(120)]
    edited = []
    for x in names:
        x = list(x)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(x))
            x[at : at + rng.randint(0, 1)] = rng.choices("ab糖c", k=rng.randint(0, 2))
        edited.append("".join(x))
    one = spark.createDataFrame([("s", x) for x in edited] + [("s", None), ("t", names[0])], "source_id string, title_key string")
    two = spark.createDataFrame([("s", x) for x in names] + [("s", None)], "source_id string, toc_key string")
    got = {(r.title_key, r.toc_key) for r in sc.alike_titles(one, two, threshold).collect()}
    want = {(a, b) for a in set(edited) for b in set(names) if a and b and SequenceMatcher(None, a, b).ratio() >= threshold}
    assert got == want and len(want) > 20


def test_nested_bodies(spark):
    import json

    nested = {"a": [{"x": 1, "y": ["no", {"z": {"q": "<td>deep"}}]}], "b": "<table>later"}
    rows = [("s", 0, "table", 0, json.dumps(nested)), ("s", 0, "chart", 0, json.dumps(["|a|b|", "|a|b|\n|1|2|", "x"])), ("s", 1, "figure", 0, json.dumps({"t": " Mermaid\ngraph"})), ("s", 2, "figure", 0, "broken {"), ("s", 3, "figure", 0, None), ("s", 4, "table", 0, json.dumps({"t": [None, 1, True, " "]}))]
    df = spark.createDataFrame(rows, "source_id string, page_idx int, chunk_kind string, kind_ordinal int, block string")
    assert {(r.page_idx, r.chunk_kind): r.content for r in bl.nested_bodies(df).collect()} == {(0, "table"): "<td>deep", (0, "chart"): "|a|b|\n|1|2|", (1, "figure"): " Mermaid\ngraph"}
    assert {(r.page_idx, r.chunk_kind) for r in bl.nested_bodies(df, levels=3).collect()} == {(0, "table"), (0, "chart"), (1, "figure")}


def test_upserts_write_only_the_buckets_they_touch(spark, tmp_path):
    table, cols = str(tmp_path / "store"), "id int, v string"
    up.upsert_table(table, spark.createDataFrame([(i, "a") for i in range(500)], cols), ["id"], F.lit("t0"), buckets=100)
    before = bk.snapshot(spark, table)
    changes = spark.createDataFrame([(3, "b"), (700, "n"), (4, "a"), (3, "c")], cols)
    up.upsert_table(table, changes, ["id"], F.lit("t1"), [F.col("v")])
    after = bk.snapshot(spark, table)
    moved = {b for b in after.live if after.live[b] != before.live.get(b)}
    assert len(moved) <= 3 and after.buckets == 100 and after.version == 1
    got = {r.id: tuple(r)[1:] for r in bk.read_table(spark, table).select("id", "v", "created_at", "updated_at").collect()}
    assert len(got) == 501 and got[3] == ("c", "t0", "t1") and got[700] == ("n", "t1", "t1") and got[4] == got[5] == ("a", "t0", "t0")
    up.upsert_table(table, changes, ["id"], F.lit("t2"), [F.col("v")])
    assert {r.id: tuple(r)[1:] for r in bk.read_table(spark, table).select("id", "v", "created_at", "updated_at").collect()} == got
