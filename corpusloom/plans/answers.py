"""Lookup and context of hits, scalar functions, evidence, enrichment and stores over the provided tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import models as md
from ..functions import text as tx
from ..operators import blocks as bl
from ..operators import evaluation as ev
from ..operators import profiles as pf
from ..operators import retrieval as rt
from ..operators import sections as sc
from ..operators import terms as tm
from ..operators import upsert as up
from ..streaming import rates as sr
from .content import _COS, _LINES, lines
from .registry import Tables, query

#: Turns of conversations stand for chunks: an assistant's turn is a child of the user's turn before it.
_CHUNKS = """chunks AS (SELECT conv_id, turn, conv_id * 1000 + turn AS chunk_id, CASE WHEN role = 'assistant' THEN conv_id * 1000 + max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent_chunk_id, role, text FROM conversations),
cand AS (SELECT conv_id AS query_id, chunk_id AS source_chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank, 'matched ' || left(text, 20) AS matched_text, text FROM chunks)"""


def _chunks(t: Tables) -> DataFrame:
    user = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.withColumn("_u", user)
    kind = F.when(F.col("role") == "user", "table").when(F.col("role") == "assistant", "figure").otherwise("child")
    parent = F.when(F.col("role") == "assistant", F.col("conv_id") * 1000 + F.col("_u"))
    return rows.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), parent.alias("parent_chunk_id"), F.col("conv_id").cast("string").alias("heading_path_id"), F.col("turn").cast("string").alias("relative_chunk_index"), kind.alias("chunk_type"), F.col("text").alias("chunk_raw_text"))


def _candidates(t: Tables) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc(F.length("chunk_raw_text")), "turn"))
    return _chunks(t).select(F.col("conv_id").alias("query_id"), F.col("chunk_id").alias("source_chunk_id"), rank.alias("rank"), F.concat(F.lit("matched "), F.substring("chunk_raw_text", 1, 20)).alias("matched_text"))


@query(f"""WITH {_CHUNKS} SELECT query_id, source_chunk_id, parent_chunk_id, length(text) AS n FROM (SELECT * FROM cand WHERE rank <= 3 UNION ALL SELECT query_id, -1, 99, NULL, NULL FROM cand WHERE rank = 1) c LEFT JOIN (SELECT chunk_id, parent_chunk_id FROM chunks) k ON k.chunk_id = c.source_chunk_id""")
def looked_up(t: Tables) -> DataFrame:
    """JN-06, UDF-05: the best chunks of each query with their text; one that is gone has none."""
    best = _candidates(t).where("rank <= 3").select("query_id", "source_chunk_id")
    gone = best.select("query_id").distinct().withColumn("source_chunk_id", F.lit(-1).cast("long"))
    return rt.lookup_text(best.unionByName(gone), _chunks(t)).select("query_id", "source_chunk_id", "parent_chunk_id", F.length("chunk_raw_text").cast("long").alias("n"))


@query(f"""WITH {_CHUNKS} SELECT query_id, source_chunk_id, sha256(coalesce(nullif(CASE WHEN trim(u.text) <> '' THEN u.text END, ''), CASE WHEN trim(k.text) <> '' THEN k.text END, matched_text)) AS context_hash
FROM cand c LEFT JOIN chunks k ON k.chunk_id = c.source_chunk_id LEFT JOIN chunks u ON u.chunk_id = k.parent_chunk_id""")
def parent_contexts(t: Tables) -> DataFrame:
    """JN-07: candidates with the text of their parent, or their own."""
    return rt.expand_to_parent(_candidates(t), _chunks(t)).select("query_id", "source_chunk_id", F.sha2("context", 256).alias("context_hash"))


@query(f"""WITH {_CHUNKS}, p AS (SELECT query_id, coalesce(parent_chunk_id, chunk_id) AS parent_id, min(rank) AS r FROM cand JOIN chunks ON chunk_id = source_chunk_id GROUP BY 1, 2)
SELECT query_id, parent_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r, parent_id) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r, parent_id) <= 2""")
def first_parents(t: Tables) -> DataFrame:
    """RNK-07: the first two parents in candidate order."""
    return rt.unique_parents(_candidates(t), _chunks(t), 2)


@query(f"""WITH {_CHUNKS}, m AS (SELECT conv_id, chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY CAST(turn AS VARCHAR), chunk_id) AS n FROM chunks WHERE role IN ('user', 'assistant')),
u AS (SELECT query_id, source_chunk_id AS chunk_id, 0 AS priority FROM cand WHERE rank <= 2 UNION ALL SELECT conv_id, chunk_id, 1 FROM m WHERE n <= 3)
SELECT query_id, chunk_id, min(priority) AS priority FROM u GROUP BY 1, 2""")
def context_media(t: Tables) -> DataFrame:
    """JN-08, SET-04: media of hits before the first three of their section."""
    direct = _candidates(t).where("rank <= 2").select("query_id", F.col("source_chunk_id").alias("chunk_id"))
    chunks = _chunks(t)
    section = rt.section_media(chunks.select("heading_path_id"), chunks, 3).select(F.col("conv_id").alias("query_id"), "chunk_id")
    return rt.context_media(direct, section)


@query(f"""WITH {_CHUNKS}, h AS (SELECT query_id, left(text, 12) AS matched_text, rank FROM cand WHERE trim(left(text, 12)) <> ''), ctx AS (SELECT query_id, text AS context FROM cand WHERE rank = 1)
SELECT query_id, matched_text, min(rank) AS rank FROM h WHERE NOT EXISTS (SELECT 1 FROM ctx WHERE ctx.query_id = h.query_id AND contains(context, matched_text)) GROUP BY 1, 2""")
def hint_texts(t: Tables) -> DataFrame:
    """SET-05: openings of chunks that the best chunk of their query doesn't hold."""
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc(F.length("chunk_raw_text")), "turn"))
    rows = _chunks(t).select(F.col("conv_id").alias("query_id"), rank.alias("rank"), F.substring("chunk_raw_text", 1, 12).alias("matched_text"), F.col("chunk_raw_text").alias("context"))
    return rt.hints(rows.select("query_id", "matched_text", "rank"), rows.where("rank = 1")).select("query_id", "matched_text", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_CHUNKS}, s AS (SELECT *, CASE WHEN query_id % 3 = 0 AND rank = 2 THEN NULL ELSE length(text) % 7 END AS score, bool_or(query_id % 3 = 0 AND rank = 2) OVER (PARTITION BY query_id) AS broken FROM cand)
SELECT query_id, source_chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT broken THEN -score END, rank) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT broken THEN -score END, rank) <= 4""")
def reranked(t: Tables) -> DataFrame:
    """RNK-06, UDF-02: reranked by a scorer; where it fails for one, the query keeps its order."""

    def score(queries: list[str], texts: list[str]) -> list[float]:
        return [float("nan") if q == "broken" else float(len(x) % 7) for q, x in zip(queries, texts)]

    rows = _candidates(t).join(_chunks(t).select(F.col("chunk_id").alias("source_chunk_id"), "chunk_raw_text"), "source_chunk_id")
    found = md.pair_score(score)(F.when((F.col("query_id") % 3 == 0) & (F.col("rank") == 2), "broken").otherwise("query"), F.col("chunk_raw_text"))
    rows = rows.withColumn("_score", F.nanvl(found, F.lit(None).cast("double")))
    return rt.rerank(rows, F.col("_score"), 4).select("query_id", "source_chunk_id", "rank")


@query(f"""WITH {_CHUNKS}, x AS (SELECT query_id, rank, source_chunk_id, CASE WHEN source_chunk_id % 3 = 0 THEN left(text, 5) END AS summary, CASE WHEN source_chunk_id % 2 = 0 THEN string_split(text, ' ')[2] END AS question, text FROM cand)
SELECT query_id, source_chunk_id, sha256(left(coalesce(CASE WHEN trim(summary) <> '' THEN summary END, CASE WHEN trim(question) <> '' THEN question END, text), 200)) AS preview, sha256(concat_ws(' ', CASE WHEN trim(text) <> '' THEN trim(text) END, CASE WHEN trim(summary) <> '' THEN trim(summary) END, CASE WHEN trim(question) <> '' THEN trim(question) END)) AS candidate FROM x WHERE rank <= 5""")
def previews(t: Tables) -> DataFrame:
    """PRJ-10, PRJ-11, FN-11, FN-12: previews and joined texts of the best chunks; a question is the second word."""
    rows = _candidates(t).join(_chunks(t).select(F.col("chunk_id").alias("source_chunk_id"), "chunk_raw_text"), "source_chunk_id")
    raw, words = F.col("chunk_raw_text"), F.split("chunk_raw_text", " ")
    kinds = {"original": F.lit("c"), "summary": F.lit("c_summary"), "question": F.lit("c_q1")}
    hits = [F.struct(F.lit(kind).alias("vector_type"), rt.matched_text(F.lit(kind), tx.question_index(name), raw, F.when(F.col("source_chunk_id") % 3 == 0, F.substring(raw, 1, 5)), F.when(F.col("source_chunk_id") % 2 == 0, words)).alias("matched_text")) for kind, name in kinds.items()]
    rows = rows.withColumn("vector_hits", F.array(*hits))
    out = rt.preview_candidates(rows).join(rows.select("query_id", "source_chunk_id", rt.candidate_text(F.col("vector_hits")).alias("candidate")), ["query_id", "source_chunk_id"])
    return out.select("query_id", "source_chunk_id", F.sha2("preview", 256).alias("preview"), F.sha2("candidate", 256).alias("candidate"))


@query("""WITH p AS (SELECT page_id, url, regexp_replace(url, '^.*/', '') AS f, string_split(html, '<h1>')[2] AS h FROM pages), d AS (SELECT *, coalesce(string_split(h, '</h1>')[1], '') AS title FROM p)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(url || ' >  > ' || title, ' > '), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), '|') AS heading,
trim(regexp_replace(regexp_replace('第3节' || trim(regexp_replace(title || ' ...... 12', '[|\\s]+', ' ', 'g')), '(\\s*([.·…]{2,}|…)\\s*\\(?\\d*\\)?|\\s+\\(?\\d+\\)?)+\\s*$', ''), '[.·…]+\\s*$', '')) AS toc, length(regexp_replace(title, '\\s+', '', 'g')) AS key_len, CAST(len(string_split_regex('第1章a第2章b' || page_id, '第')) - 1 AS INTEGER) AS n_entries, '图1  ' || page_id AS caption FROM d""")
def heading_functions(t: Tables) -> DataFrame:
    """FN-04..07, FN-10: headings, contents lines, keys, glued entries and captions of pages."""
    title = F.coalesce(F.get(F.split(F.get(F.split("html", "<h1>"), 1), "</h1>"), 0), F.lit(""))
    rows = t.pages.withColumn("title", title)
    entries = F.size(tx.split_anchors(F.concat(F.lit("第1章a第2章b"), F.col("page_id").cast("string")), "第[0-9]章"))
    return rows.select("page_id", F.array_join(tx.split_heading(F.concat_ws(" > ", "url", F.lit(""), "title")), "|").alias("heading"), tx.normalize_toc(F.concat(F.lit("第 3 节"), "title", F.lit(" ...... 12"))).alias("toc"), F.length(tx.strict_key(F.col("title"))).cast("long").alias("key_len"), entries.alias("n_entries"), tx.caption_text(F.array(F.lit("图1"), F.col("page_id").cast("string"))).alias("caption"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'at once: ' || o_orderstatus WHEN '2-HIGH' THEN 'soon ' || o_orderstatus ELSE o_orderpriority || '=' || o_orderstatus END AS phrase,
array_to_string(CASE WHEN o_orderpriority = o_orderstatus THEN [o_orderpriority] ELSE [o_orderpriority, o_orderstatus] END, ',') AS merged, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'new' END, o_orderpriority) AS scalar,
concat_ws('; ', 'past:' || left(o_orderpriority, 120), CASE WHEN o_orderstatus = 'F' THEN 'medication:' || o_orderstatus END) AS history, CASE WHEN o_orderstatus = 'F' THEN 'step ' || o_orderkey WHEN o_custkey % 2 = 0 THEN 'empty_result' END AS error_reason, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS INTEGER) END AS error_step,
CASE WHEN o_custkey % 3 > 0 AND o_orderkey % 10 < 8 THEN 'followup' ELSE 'diagnose' END AS next, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 < 3 THEN 'exam' ELSE 'safety' END AS after, CASE o_orderstatus WHEN 'F' THEN 'pregnant' WHEN 'O' THEN 'not_pregnant' ELSE 'unknown' END AS pregnancy, 2 AS n_banned,
'[' || o_orderstatus || '] ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ' 建议:rest' ELSE '' END AS risk, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'other' END AS note,
CASE WHEN o_orderstatus = 'F' THEN 'SELECT' ELSE 'OTHER' END AS statement, CASE WHEN o_orderstatus = 'F' THEN 'int' WHEN o_orderstatus = 'O' THEN 'float' ELSE 'str' END AS value_type, CAST(o_orderkey + 5 AS BIGINT) AS remapped, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def state_functions(t: Tables) -> DataFrame:
    """FN-15..26: slots, histories, errors, routes, safety, notes, statements, types and dates of orders."""
    status, priority, key = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")
    failed, open_ = status == "F", status == "O"
    error = tx.error_info(F.when(failed, F.concat(F.lit("step "), key.cast("string"))), (F.col("o_custkey") % 2).cast("int"))
    safety = tx.safety_flags(F.array(F.lit(" a "), F.lit("b"), F.lit("a"), F.lit("")), F.when(failed, True).when(open_, False), F.lit(None).cast("boolean"))
    return t.orders.select(
        "o_orderkey", tx.slot_phrase(priority, status, {"1-URGENT": "at once: {}", "2-HIGH": "soon {}"}).alias("phrase"), F.array_join(tx.merged_lists(F.array(priority), F.array(status)), ",").alias("merged"), tx.merged_scalars(priority, F.when(failed, "new")).alias("scalar"),
        tx.history_summary(priority, F.when(failed, status), F.lit("")).alias("history"), error["reason"].alias("error_reason"), error["step"].alias("error_step"), tx.next_step((F.col("o_custkey") % 3).cast("int"), (key % 10).cast("int")).alias("next"), tx.after_diagnosis(open_, (key % 5).cast("int")).alias("after"),
        safety["pregnancy"].alias("pregnancy"), F.size(safety["banned"]).alias("n_banned"), tx.risk_line(status, priority, F.when(failed, "rest")).alias("risk"), tx.failure_note(F.when(failed | open_, status), {"F": "failed"}, "other").alias("note"),
        tx.statement_class(F.when(failed, " select 1").otherwise("with x")).alias("statement"), tx.value_type(F.when(failed, "12").when(open_, "1.5e3").otherwise("x")).alias("value_type"), F.get(tx.remap_index(F.array(key), F.lit(5)), 0).alias("remapped"), tx.iso_date(F.col("o_orderdate")).alias("day"),
    )


@query("""WITH s AS (SELECT p_partkey, trim(p_name) AS c, trim(p_brand) AS a, string_split(p_name, ' ') AS l, p_type FROM part), q AS (SELECT *, list_filter(list_transform(list_concat([c, a], l), lambda x: trim(x)), lambda x: length(x) >= 2) AS every FROM s)
SELECT p_partkey, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), '|') AS queries, concat_ws(',', CASE WHEN p_type = 'ECONOMY' THEN 'kind' END, CASE WHEN len(l) = 0 THEN 'words' END) AS empty, CASE WHEN p_type = 'ECONOMY' THEN 'kind' ELSE '' END AS chosen, NOT regexp_matches(p_type, '\\(-\\)|ECONOMY') AS positive FROM q""")
def slot_queries(t: Tables) -> DataFrame:
    """PRJ-09, PRJ-12, SET-02, SET-08, FLT-09: queries from slots, empty slots, and those of them that were chosen."""
    words = F.split("p_name", " ")
    state = F.struct(F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("kind"), words.alias("words"))
    empty = tm.empty_slots(F.col("state"), ["kind"], ["words"])
    rows = t.part.withColumn("state", state)
    finding = F.when(F.col("p_type") == "ECONOMY", "见(-)").otherwise("x")
    return rows.select("p_partkey", F.array_join(tm.sparse_queries(F.col("p_name"), [F.col("p_brand")], [words]), "|").alias("queries"), F.array_join(empty, ",").alias("empty"), F.array_join(tm.valid_slots(F.array(F.lit("other"), F.lit("kind")), empty, 1), ",").alias("chosen"), tm.drop_negated(finding).alias("positive"))


@query("""WITH i AS (SELECT p_brand AS session_id, p_name AS text, p_type AS preferred_term, p_partkey FROM part), f AS (SELECT p_brand AS session_id, p_name AS finding, max(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS pos FROM part WHERE p_size > 10 GROUP BY 1, 2
UNION ALL SELECT p_brand, p_type, max(CASE WHEN p_size > 49 THEN 1 ELSE 0 END) FROM part WHERE p_size > 48 GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN coalesce(a.pos, 0) = 1 OR coalesce(b.pos, 0) = 1 THEN 'confirmed' WHEN a.pos IS NOT NULL OR b.pos IS NOT NULL THEN 'denied' ELSE 'remaining' END AS status FROM i LEFT JOIN f a ON a.session_id = i.session_id AND a.finding = i.text LEFT JOIN f b ON b.session_id = i.session_id AND b.finding = i.preferred_term""")
def reported_evidence(t: Tables) -> DataFrame:
    """JN-18: names and types of a brand's parts as confirmed, denied or remaining."""
    items = t.part.select(F.col("p_brand").alias("session_id"), F.col("p_name").alias("text"), F.col("p_type").alias("preferred_term"), "p_partkey")
    by_name = t.part.where("p_size > 10").select(F.col("p_brand").alias("session_id"), F.col("p_name").alias("finding"), (F.col("p_size") > 25).alias("positive"))
    by_type = t.part.where("p_size > 48").select(F.col("p_brand").alias("session_id"), F.col("p_type").alias("finding"), (F.col("p_size") > 49).alias("positive"))
    return tm.consume_evidence(items, by_name.unionByName(by_type)).select("p_partkey", "status")


@query(f"""WITH old AS (SELECT vec_id, embedding, label FROM embeddings JOIN benchmark ON item_id = vec_id), c AS (SELECT a.vec_id, max({_COS}) AS best FROM embeddings a JOIN old b ON a.label % 2 = b.label % 2 GROUP BY 1)
SELECT a.vec_id FROM embeddings a LEFT JOIN c USING (vec_id) WHERE CASE WHEN a.label < 3 THEN NOT EXISTS (SELECT 1 FROM old WHERE old.label = a.label) ELSE coalesce(round(1 - best, 9) >= 0.7, true) END""")
def unasked_items(t: Tables) -> DataFrame:
    """JN-19: items that weren't asked: linked ones by their term, others by their vectors."""
    rows = t.embeddings.select("vec_id", (F.col("label") % 2).alias("session_id"), F.col("label").cast("string").alias("preferred_term"), (F.col("label") < 3).alias("linked"), F.col("embedding").alias("vector"))
    asked = rows.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select("session_id", "preferred_term", "vector")
    return tm.drop_asked(rows, asked, 0.7).select("vec_id")


@query(f"""WITH concepts AS (SELECT label, arg_min(embedding, vec_id) AS embedding, min(vec_id) AS head FROM embeddings GROUP BY 1), p AS (SELECT a.vec_id AS m, b.label, {_COS} AS score FROM embeddings a CROSS JOIN concepts b WHERE a.vec_id NOT IN (SELECT head FROM concepts)),
n AS (SELECT m, arg_min(label, (-score, label)) AS c FROM p WHERE score >= 0.3 GROUP BY 1), l AS (SELECT e.vec_id, CASE WHEN k.head IS NOT NULL THEN 1 WHEN n.m IS NOT NULL THEN 2 ELSE 3 END AS tier, CASE WHEN k.head IS NOT NULL THEN k.label ELSE n.c END AS concept FROM embeddings e LEFT JOIN concepts k ON k.head = e.vec_id LEFT JOIN n ON n.m = e.vec_id)
SELECT tier, count(*) AS mentions, count(DISTINCT concept) AS concepts FROM l GROUP BY 1""")
def link_tiers(t: Tables) -> DataFrame:
    """JN-09..11, AGG-28: mentions linked exactly, by vector, or not at all."""
    concept = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"), F.min("vec_id").alias("head"))
    vocabulary = concept.select(F.lpad(F.col("label").cast("string"), 4, "0").alias("concept_id"), F.col("label").cast("string").alias("preferred_term"), F.col("head").cast("string").alias("alias"), "vector")
    mentions = t.embeddings.select(F.col("vec_id").alias("mention_id"), F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("vector"))
    return tm.link_stats(tm.link_entities(mentions, vocabulary, 0.3))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 1 ELSE 0 END = 1 AS linked, row_number() OVER (ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_name, p_partkey) AS place FROM (SELECT p_partkey, p_size, p_name || ' ' || p_partkey AS p_name FROM part)""")
def ordered_terms(t: Tables) -> DataFrame:
    """RNK-09: all terms with their places, linked ones first, then by text."""
    rows = t.part.select("p_partkey", (F.col("p_size") > 25).alias("linked"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("text"))
    return tm.placed_terms(rows).select("p_partkey", "linked", F.col("place").cast("long").alias("place"))


@query(f"""WITH m AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 2 = 0), x AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 2 = 1)
SELECT vec_id FROM m a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.label = a.label AND {_COS} > 0.25)""")
def distinct_media(t: Tables) -> DataFrame:
    """SET-07: vectors (even ids) that are near none of the other ones of their label."""
    rows = lambda c: t.embeddings.where(c).select("vec_id", F.col("label").cast("string").alias("heading_path_id"), F.col("embedding").alias("vector"))
    return bl.drop_redundant_media(rows("vec_id % 2 = 0"), rows("vec_id % 2 = 1"), 0.25).select("vec_id")


_ENRICHED = """m AS (SELECT p_partkey, p_brand, p_name, p_type, p_size, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand || ' > ' || p_type END AS heading_path, list_value('table', 'chart', 'figure')[CAST(p_size % 3 AS INTEGER) + 1] AS kind, CASE WHEN p_size % 5 = 0 THEN 'sibling' ELSE 'single' END AS role FROM part),
e AS (SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'failed' ELSE 'ok' END AS status, repeat(p_name || ' ', CAST(p_size % 4 AS INTEGER)) AS statement, p_name AS title, CASE WHEN p_size % 6 = 0 THEN ' ' ELSE p_type END AS summary, string_split(p_name, ' ') AS questions FROM part WHERE p_size % 13 <> 0)"""


def _manifest(t: Tables) -> DataFrame:
    kinds = F.array(F.lit("table"), F.lit("chart"), F.lit("figure"))
    return t.part.select(
        "p_partkey", F.col("p_brand").alias("source_id"), F.when(F.col("p_size") % 7 != 0, F.concat_ws(" > ", "p_brand", "p_type")).alias("heading_path"), F.element_at(kinds, F.col("p_size") % 3 + 1).alias("chunk_kind"), F.when(F.col("p_size") % 5 == 0, "sibling").otherwise("single").alias("merge_role"),
        F.col("p_size").alias("page_idx"), F.col("p_partkey").alias("block_idx"), F.array(F.col("p_name"), F.lit(" ")).alias("caption"), F.array("p_type").alias("footnote"), F.concat(F.lit("<table>"), "p_name", F.lit("</table>")).alias("content"),
    )


def _enrichment(t: Tables) -> DataFrame:
    """What a model (here a function of the row that fails for some) makes of each part."""

    def enrich(row: dict) -> dict:
        if row["p_size"] % 11 == 0:
            raise ValueError("no answer")
        return {"medical_statement": f"{row['p_name']} " * (row["p_size"] % 4), "title": row["p_name"], "summary": " " if row["p_size"] % 6 == 0 else row["p_type"], "hypothetical_questions": row["p_name"].split(" ")}

    schema = "p_partkey long, p_name string, p_type string, p_size int, medical_statement string, title string, summary string, hypothetical_questions array<string>, status string, error string"
    return md.enriched(t.part.where("p_size % 13 <> 0").select("p_partkey", "p_name", "p_type", "p_size"), enrich, schema)


@query(f"""WITH {_ENRICHED} SELECT p_partkey, status, concat_ws(',', CASE WHEN length(trim(coalesce(statement, ''))) < 30 THEN 'statement_short' END, CASE WHEN NOT length(trim(coalesce(title, ''))) BETWEEN 1 AND 60 THEN 'title_size' END, CASE WHEN length(trim(coalesce(summary, ''))) = 0 THEN 'summary_empty' END, CASE WHEN len(coalesce(questions, [])) < 1 THEN 'no_question' END) AS reasons
FROM (SELECT p_partkey, status, CASE WHEN status = 'ok' THEN statement END AS statement, CASE WHEN status = 'ok' THEN title END AS title, CASE WHEN status = 'ok' THEN summary END AS summary, CASE WHEN status = 'ok' THEN questions END AS questions FROM e)""")
def validated_enrichment(t: Tables) -> DataFrame:
    """UDF-03, FLT-07: rows that a function made or failed on, and why they are no good."""
    rows = _enrichment(t).withColumnsRenamed({"medical_statement": "statement", "hypothetical_questions": "questions"})
    return bl.validate_enrichment(rows).select("p_partkey", "status", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_ENRICHED} SELECT coalesce(CASE WHEN heading_path IS NULL THEN 'orphan' WHEN role = 'sibling' THEN 'merged' WHEN status IS NULL THEN 'no_enrichment' WHEN status <> 'ok' THEN 'failed' END, 'eligible') AS reason, kind, count(*) AS n FROM m LEFT JOIN e USING (p_partkey) GROUP BY 1, 2""")
def media_eligibility(t: Tables) -> DataFrame:
    """FLT-08, JN-05, AGG-05: media by the one reason for which they are skipped."""
    out = bl.eligible_media(_manifest(t), _enrichment(t).select("p_partkey", "status"), ["p_partkey"])
    return pf.stage_counts(out.select(F.coalesce("skip_reason", F.lit("eligible")).alias("reason"), F.col("chunk_kind").alias("kind")), ["reason", "kind"])


@query(f"""WITH {_ENRICHED}, r AS (SELECT *, CASE kind WHEN 'table' THEN 'table' ELSE 'figure' END AS ct, sha256(sha256(lower(trim(p_brand))) || ':' || sha256(lower(trim(p_type)))) AS hp FROM m JOIN e USING (p_partkey) WHERE status = 'ok' AND heading_path IS NOT NULL),
x AS (SELECT *, ct || ':p' || p_size || '_b' || p_partkey AS rel, CASE ct WHEN 'table' THEN p_name || chr(10) || '<table>' || p_name || '</table>' || chr(10) || p_type ELSE p_name || chr(10) || p_type END AS raw FROM r)
SELECT ct AS chunk_type, sha256(p_brand || ':' || hp || ':' || rel) AS chunk_id, sha256(p_brand || ':' || hp || ':parent') AS parent_chunk_id, rel AS relative_chunk_index, sha256(raw || chr(10) || statement) AS content_hash FROM x""")
def media_records(t: Tables) -> DataFrame:
    """PRJ-05, PRJ-08, FN-02: chunk records of media with a good enrichment."""
    out = bl.build_media_records(_manifest(t).where("heading_path is not null"), _enrichment(t).drop("p_name", "p_type", "p_size", "error"), ["p_partkey"])
    return out.select("chunk_type", "chunk_id", "parent_chunk_id", "relative_chunk_index", "content_hash")


@query(f"""WITH {_ENRICHED} SELECT p.p_partkey, CASE WHEN e.status = 'ok' THEN e.title || '!' ELSE p.p_name END AS p_name, p.p_type FROM part p LEFT JOIN e USING (p_partkey)""")
def applied_enrichment(t: Tables) -> DataFrame:
    """SNK-04: names of parts replaced by those of rows that went well."""
    found = _enrichment(t).select("p_partkey", "status", F.concat("title", F.lit("!")).alias("p_name"))
    return up.apply_columns(t.part.select("p_partkey", "p_name", "p_type"), found, "p_partkey", ["p_name"])


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'ok' ELSE 'merged_into_anchor' END AS status FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderpriority <> '1-URGENT'""")
def purged_runs(t: Tables) -> DataFrame:
    """SNK-07: results of urgent orders go before they are made again; traces of merged ones stay."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ok").otherwise("merged_into_anchor")
    done = t.orders.select("o_orderkey", status.alias("status"))
    return up.purge_for_rerun(done, t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), ["o_orderkey"])


@query("""WITH c AS (SELECT o_orderkey AS chunk_id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey * 100 END AS parent, o_totalprice AS v FROM orders), u AS (SELECT chunk_id, parent, v FROM c UNION ALL SELECT -chunk_id, parent, v FROM c WHERE v > 300000)
SELECT chunk_id, v AS value FROM u a WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u b WHERE b.chunk_id = a.parent)""")
def orphaned_chunks(t: Tables) -> DataFrame:
    """SNK-02: chunks that lack their parent after new ones are in."""
    parent = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") * 100)
    old = t.orders.select(F.col("o_orderkey").alias("chunk_id"), parent.alias("parent_chunk_id"), F.col("o_totalprice").alias("value"), F.lit("then").alias("created_at"), F.lit("then").alias("updated_at"))
    new = old.where("value > 300000").select((-F.col("chunk_id")).alias("chunk_id"), "parent_chunk_id", "value")
    return up.upsert_chunks(old, new, F.lit("now"))[1].select("chunk_id", "value")


@query("""SELECT vec_id AS id, label + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END AS label, CASE WHEN vec_id % 3 = 0 THEN 'now' ELSE 'then' END AS updated_at, 'kept' AS state FROM embeddings UNION ALL SELECT -1 - vec_id, label, NULL, 'refused' FROM embeddings WHERE vec_id % 5 = 0""")
def upserted_vectors(t: Tables) -> DataFrame:
    """SNK-03, SNK-06: vector records put in by id; those of another dimension stay out."""
    old = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.lit("then").alias("created_at"), F.lit("then").alias("updated_at"))
    good = old.where("id % 3 = 0").select("id", "vector", (F.col("label") + 100).alias("label"))
    bad = old.where("id % 5 = 0").select((-1 - F.col("id")).alias("id"), F.slice("vector", 1, 3).alias("vector"), "label")
    kept, refused = up.upsert_vectors(old, good.unionByName(bad), F.lit("now"), 64)
    return kept.select("id", "label", "updated_at", F.lit("kept").alias("state")).unionByName(refused.select("id", "label", F.lit(None).cast("string").alias("updated_at"), F.lit("refused").alias("state")))


@query("""WITH n AS (SELECT doc_id AS chunk_id, sha256(text) AS h FROM documents), o AS (SELECT -1 - min(doc_id) AS chunk_id, sha256(text) AS h FROM documents WHERE lang <> 'fr' GROUP BY 2)
SELECT n.chunk_id, o.chunk_id AS from_chunk_id, -o.chunk_id AS vector FROM n JOIN o USING (h)""")
def reused_vectors(t: Tables) -> DataFrame:
    """JN-15, JN-16: chunks under new ids take the vectors that their content had."""
    rows = t.documents.select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"), F.lit("child").alias("chunk_type"), "lang")
    old = rows.where("lang <> 'fr'").groupBy("content_hash").agg((-1 - F.min("chunk_id")).alias("chunk_id")).withColumn("chunk_type", F.lit("child"))
    vectors = old.select(F.col("chunk_id").alias("source_chunk_id"), (-F.col("chunk_id")).alias("vector"))
    return up.reuse_vectors(up.plan_incremental(old, rows), rows, old, vectors)


@query("""WITH c AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'done' END AS s, ts FROM events), w AS (SELECT event_id FROM c WHERE s IN ('failed', 'pending') AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 MINUTE)
SELECT event_id AS chunk_id, CAST(CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS missing, CASE WHEN event_id % 4 < 2 THEN 'embed' ELSE 'mark_done' END AS action FROM w""")
def compensations(t: Tables) -> DataFrame:
    """JN-17: chunks that have waited too long, by whether all their vectors are there."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "pending").otherwise("done")
    chunks = t.events.select(F.col("event_id").alias("chunk_id"), status.alias("embedding_status"), F.col("ts").alias("updated_at"))
    expected = chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.explode(F.array(F.concat(F.col("chunk_id").cast("string"), F.lit("_a")), F.concat(F.col("chunk_id").cast("string"), F.lit("_b")))).alias("id"))
    there = expected.where("source_chunk_id % 4 >= 2 or (source_chunk_id % 4 = 1 and id like '%_a')").select("id")
    return up.compensation_plan(chunks, expected, there, F.lit("2024-01-20").cast("timestamp_ntz"))


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS current, count(*) FILTER (trim(CASE WHEN o_orderpriority LIKE '%URGENT' THEN ' ' ELSE o_orderpriority END) <> '') AS usable FROM orders GROUP BY 1""")
def current_orders(t: Tables) -> DataFrame:
    """FLT-14, FLT-15: orders that haven't ended, and those with a file."""
    rows = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("ended_at"), F.when(F.endswith("o_orderpriority", F.lit("URGENT")), " ").otherwise(F.col("o_orderpriority")).alias("file_path"))
    count = lambda df, name: df.groupBy("o_custkey").agg(F.count("*").alias(name))
    both = count(rows, "_n").join(count(pf.current(rows), "current"), "o_custkey", "left").join(count(pf.usable_reports(rows), "usable"), "o_custkey", "left")
    return both.select("o_custkey", F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("usable", F.lit(0)).alias("usable"))


@query("""WITH h AS (SELECT l_partkey AS target_id, l_returnflag AS route, l_orderkey AS chunk_id, l_linenumber AS section, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey) AS rank FROM lineitem),
g AS (SELECT target_id, min(chunk_id) AS c, min(section) AS s FROM h GROUP BY 1), r AS (SELECT route, target_id, min(CASE WHEN chunk_id = c THEN rank END) AS strict, min(CASE WHEN section = s THEN rank END) AS loose FROM g CROSS JOIN (SELECT DISTINCT route FROM h) LEFT JOIN h USING (target_id, route) GROUP BY 1, 2)
SELECT route, round(avg(CASE WHEN strict <= 2 THEN 1.0 ELSE 0.0 END), 6) AS strict_2, round(avg(CASE WHEN strict <= 5 THEN 1.0 ELSE 0.0 END), 6) AS strict_5, round(avg(CASE WHEN loose <= 2 THEN 1.0 ELSE 0.0 END), 6) AS loose_2, round(avg(CASE WHEN loose <= 5 THEN 1.0 ELSE 0.0 END), 6) AS loose_5 FROM r GROUP BY 1""")
def target_recall(t: Tables) -> DataFrame:
    """AGG-20: targets found strictly and loosely by each route (return flags stand for routes)."""
    rank = F.row_number().over(W.partitionBy("l_partkey", "l_returnflag").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_suppkey"))
    hits = t.lineitem.select(F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("route"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("section"), rank.alias("rank"))
    targets = hits.groupBy("target_id").agg(F.min("chunk_id").alias("chunk_id"), F.min("section").alias("section"))
    out = ev.target_recall(hits, targets, [2, 5])
    return out.select("route", *[F.round(c, 6).alias(c) for c in ("strict_2", "strict_5", "loose_2", "loose_5")])


@query("""SELECT o_orderkey, coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey % 4 AS INTEGER) END, 0) AS score FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def propagated_scores(t: Tables) -> DataFrame:
    """JN-26: orders with the judged score of their customer; unjudged ones count 0."""
    hits = t.orders.select(F.lit(1).alias("case_id"), F.col("o_custkey").alias("parent_id"), "o_orderkey")
    judged = t.customer.where("c_mktsegment <> 'BUILDING'").select(F.lit(1).alias("case_id"), F.col("c_custkey").alias("parent_id"), (F.col("c_nationkey") % 4).alias("score"))
    return ev.propagate_scores(hits, judged).select("o_orderkey", "score")


@query("""SELECT conv_id AS session_id, min(text) AS raw_query, CAST(count(*) AS INTEGER) AS n_retrieved, array_to_string(list(CAST(turn AS VARCHAR) ORDER BY turn) FILTER (turn > 0), ',') AS chunk_ids, CAST(count(*) * 2 + 7 AS DOUBLE) AS total_ms, CASE WHEN conv_id % 5 = 0 THEN 'step 3 failed' WHEN conv_id % 2 = 0 THEN 'empty_result' END AS error FROM conversations GROUP BY 1""")
def audit_rows(t: Tables) -> DataFrame:
    """PRJ-14: audit rows of final states (conversations)."""
    chunk = F.struct(F.col("turn"), F.when(F.col("turn") == 0, "").otherwise(F.col("turn").cast("string")).alias("source_chunk_id"))
    states = t.conversations.groupBy("conv_id").agg(F.min("text").alias("patient_input"), F.array_sort(F.collect_list(chunk)).alias("candidates"))
    nothing = F.lit(None).cast("array<string>")
    states = states.select(
        F.col("conv_id").alias("session_id"), F.lit(1).alias("user_id"), "patient_input", F.lit(None).cast("string").alias("chief_complaint"), nothing.alias("confirmed"), nothing.alias("denied"), "candidates", F.col("candidates").alias("reranked"), F.lit(None).cast("string").alias("final_response"),
        F.when(F.col("conv_id") % 5 == 0, "step 3 failed").alias("failure"), (F.col("conv_id") % 2).cast("int").alias("results"), F.lit(None).cast("map<string,bigint>").alias("token_usage"), F.create_map(F.lit("total"), F.lit(-1.0)).alias("latency_ms"), (F.size("candidates") * 2 + 7).alias("total_ms"),
    )
    out = pf.trace_rows(states)
    return out.select("session_id", "raw_query", F.size("retrieved_chunks").alias("n_retrieved"), F.array_join("chunk_ids", ",").alias("chunk_ids"), F.element_at("latency_ms", F.lit("total")).alias("total_ms"), F.col("error_info.reason").alias("error"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' ELSE date_trunc('second', ts) END AS ts, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE event_type END AS level, CASE WHEN event_id % 2 = 0 THEN 'abcdef012345' END AS container, 'm' || event_id AS message FROM events""")
def parsed_logs(t: Tables) -> DataFrame:
    """SRC-06, STR-13: container log lines read back; broken times take the time of ingest."""
    stamp = F.when(F.col("event_id") % 3 == 0, "broken").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    level = F.when(F.col("event_id") % 4 != 0, F.upper("event_type"))
    inner = F.to_json(F.struct(stamp.alias("timestamp"), level.alias("level"), F.col("event_id").cast("string").alias("event"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message")))
    path = F.when(F.col("event_id") % 2 == 0, "containers/abcdef012345")
    lines_ = t.events.select(F.to_json(F.struct(inner.alias("log"), F.lit("stdout").alias("stream"), path.alias("file"))).alias("value"))
    out = sr.parse_log_stream(lines_, F.lit("2000-01-01").cast("timestamp"))
    return out.select(F.col("event").cast("long").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "container", "message")


@query("""SELECT event_type AS name, date_trunc('day', ts) AS window_start, round(avg(value), 6) AS value, CASE event_type WHEN 'view' THEN 12.0 ELSE 11.0 END AS "limit" FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2 HAVING avg(value) > CASE event_type WHEN 'view' THEN 12.0 ELSE 11.0 END""")
def alerts(t: Tables) -> DataFrame:
    """STR-08: days on which a measure is over its limit."""
    daily = sr.sliding(t.events, "1 day", "1 day", ["event_type"], [F.avg("value").alias("value")])
    out = sr.alerts(daily.select(F.col("event_type").alias("name"), "window_start", "value"), {"view": 12.0, "click": 11.0})
    return out.select("name", "window_start", F.round("value", 6).alias("value"), "limit")


@query(f"""WITH {_LINES}, c AS (SELECT source_id, sum(len) AS n FROM lines GROUP BY 1), k AS (SELECT source_id, sum(len) AS n FROM lines WHERE pos <> 3 GROUP BY 1) SELECT source_id, c.n AS parents, k.n AS children FROM c FULL JOIN k USING (source_id) WHERE c.n IS DISTINCT FROM k.n""")
def lost_lengths(t: Tables) -> DataFrame:
    """AGG-10: documents whose children (here without the fourth line) don't add up to their parents."""
    return sc.conservation(lines(t), lines(t).where("pos <> 3")).select("source_id", "parents", "children")


@query("""SELECT vec_id, CAST(round(sum(x * x), 3) AS DOUBLE) AS norm FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1""")
def encoded_texts(t: Tables) -> DataFrame:
    """UDF-01: vectors from an encoder of the caller's (which here parses them from their text)."""

    def encode(texts: list[str]):
        return pd.Series([[float(x) for x in s.split(",")] for s in texts])

    rows = t.embeddings.select("vec_id", F.array_join(F.col("embedding").cast("array<string>"), ",").alias("text"))
    out = md.with_embeddings(rows, "text", encode)
    return out.select("vec_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("norm"))


@query("SELECT sha256(CAST(p_partkey AS VARCHAR)) AS hash, p_partkey || '_' || substr(sha256(p_name), 1, 16) AS id, CASE WHEN upper(substr(p_name, 1, 1)) = 'R' THEN 'symptom' ELSE 'disease' END AS category, p_partkey AS concept_id FROM part")
def alias_records(t: Tables) -> DataFrame:
    """SNK-06, FN-02: index records of a vocabulary."""
    out = tm.build_alias_records(t.part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name")))
    category = tx.code_category(F.col("alias"))
    return out.select(ids.content_hash(F.col("concept_id")).alias("hash"), "id", category.alias("category"), F.col("concept_id").cast("long").alias("concept_id"))
