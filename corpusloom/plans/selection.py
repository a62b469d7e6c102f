"""Selection of questions and terms, comparisons of runs, and small audit questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as bl
from ..operators import evaluation as ev
from ..operators import profiles as pf
from ..operators import retrieval as rt
from ..operators import terms as tm
from ..operators import upsert as up
from .content import _LINES, lines
from .registry import Tables, query
from .retrieval import _COSINE, _RANKED, _ranked


@query("""WITH r AS (SELECT p_brand AS session_id, p_partkey AS item, CASE WHEN p_size > 25 THEN 'dimension' ELSE 'item' END AS kind, p_retailprice AS gain, p_type <> 'ECONOMY' AS askable FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind, askable ORDER BY gain DESC, item) AS k FROM r),
g AS (SELECT *, askable AND (kind <> 'dimension' OR k <= 2) AS good FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id, good ORDER BY CAST(kind <> 'dimension' AS INTEGER), gain DESC, item) AS place FROM g)
SELECT session_id, item, CASE WHEN NOT askable THEN 'unaskable' WHEN good AND place <= 5 THEN 'ask' ELSE 'skip' END AS status FROM p""")
def selected_questions(t: Tables) -> DataFrame:
    """RNK-08: five questions for each brand, at most two on dimensions, by price."""
    kind = F.when(F.col("p_size") > 25, "dimension").otherwise("item")
    rows = t.part.select(F.col("p_brand").alias("session_id"), F.lit(1).alias("round"), F.col("p_partkey").alias("item"), kind.alias("kind"), F.col("p_retailprice").alias("gain"), (F.col("p_type") != "ECONOMY").alias("askable"))
    return tm.select_questions(rows, 5).select("session_id", "item", "status")


@query("""WITH u AS (SELECT p_brand AS session_id, p_name AS preferred_term, p_partkey AS position, CAST(p_type <> 'ECONOMY' AS INTEGER) AS new FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, preferred_term ORDER BY new, position) AS n FROM u) SELECT session_id, preferred_term, position FROM n WHERE new = 0 OR n = 1""")
def appended_terms(t: Tables) -> DataFrame:
    """SET-01: a brand's other names, unless they are known."""
    rows = lambda c: t.part.where(c).select(F.col("p_brand").alias("session_id"), F.col("p_name").alias("preferred_term"), F.col("p_partkey").alias("position"))
    return tm.append_terms(rows("p_type = 'ECONOMY'"), rows("p_type <> 'ECONOMY'"))


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS concept_id, 't' || b.label AS preferred_term, 'a' || b.vec_id AS alias, round({_COSINE}, 6) AS score FROM embeddings a JOIN benchmark i ON i.item_id = a.vec_id CROSS JOIN embeddings b),
q AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(alias), concept_id, alias) AS n FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, preferred_term ORDER BY n) AS f FROM q WHERE n <= 25)
SELECT query_id, concept_id, preferred_term, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) AS INTEGER) AS rank FROM o WHERE f = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n) <= 5""")
def alias_topk(t: Tables) -> DataFrame:
    """RNK-04: the five best terms of each item; a label is the preferred term of its vectors."""
    vocab = t.embeddings.select(F.col("vec_id").alias("concept_id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("preferred_term"), F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("alias"), F.col("embedding").alias("vector"))
    q = t.embeddings.join(F.broadcast(t.benchmark.select(F.col("item_id").alias("vec_id"))), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return tm.alias_topk(q, vocab, 5).select("query_id", "concept_id", "preferred_term", "score", "rank")


@query(f"""{_RANKED}, m AS (SELECT case_id, avg(score) FILTER (rank <= 5) AS a1, avg(score) FILTER (rank <= 20) AS b1, count(*) FILTER (rank <= 5 AND score >= 2) / 5.0 AS a2, count(*) FILTER (rank <= 20 AND score >= 2) / 20.0 AS b2 FROM ranked GROUP BY 1),
g AS (SELECT 'avg_score' AS metric, round(b1 - a1, 9) AS gain FROM m UNION ALL SELECT 'p2', round(b2 - a2, 9) FROM m)
SELECT metric, round(avg(gain), 6) AS mean_gain, count(*) FILTER (gain > 0) AS wins, count(*) AS cases FROM g GROUP BY 1""")
def paired_comparison(t: Tables) -> DataFrame:
    """AGG-18: the same ranking at 20 against 5."""
    ranked = _ranked(t)
    cut = lambda k: ev.graded(ranked, k, ["case_id"]).select("case_id", F.round("avg_score", 9).alias("avg_score"), F.round("p2", 9).alias("p2"))
    return ev.compare_runs(cut(5), cut(20), "case_id", ["avg_score", "p2"]).withColumn("mean_gain", F.round("mean_gain", 6))


@query(f"""{_RANKED}, f AS (SELECT case_id, label, min(rank) AS r FROM ranked JOIN embeddings ON vec_id = item_id GROUP BY ALL), p AS (SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY r) AS rank FROM f),
g AS (SELECT vec_id AS case_id, label FROM embeddings JOIN benchmark ON item_id = vec_id)
SELECT case_id, CASE WHEN rank <= 1 THEN 1 ELSE 0 END AS top1, CASE WHEN rank <= 3 THEN 1 ELSE 0 END AS top3, CASE WHEN rank <= 5 THEN 1 ELSE 0 END AS top5, CAST(count(rank) AS DOUBLE) AS label_recall, count(rank) = 1 AS all_found FROM g LEFT JOIN p USING (case_id, label) GROUP BY case_id, rank""")
def label_hits(t: Tables) -> DataFrame:
    """AGG-21: whether an item's label is among the first labels of its neighbours."""
    from pyspark.sql import Window as W

    of = t.embeddings.select(F.col("vec_id").alias("item_id"), "label")
    first = _ranked(t).join(of, "item_id").groupBy("case_id", "label").agg(F.min("rank").alias("_r"))
    predictions = first.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy("_r")))
    gold = of.join(F.broadcast(t.benchmark.select("item_id")), "item_id").select(F.col("item_id").alias("case_id"), "label")
    return ev.label_hits(predictions.select("case_id", "label", "rank"), gold)


@query("SELECT event_type, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS prompt, CAST(sum(user_id) AS BIGINT) AS completion, count(*) AS calls FROM events GROUP BY 1")
def token_totals(t: Tables) -> DataFrame:
    """AGG-26: totals of a map column; values stand for prompts, users for completions."""
    usage = F.create_map(F.lit("prompt"), F.floor("value").cast("long"), F.lit("completion"), F.col("user_id"))
    return pf.token_usage(t.events.select("event_type", usage.alias("token_usage")), ["event_type"])


@query("""SELECT o_custkey AS trace_id, count(*) AS retrieved_n, max(o_totalprice) AS retrieved_max, round(avg(o_totalprice), 4) AS retrieved_mean, count(*) FILTER (o_orderstatus = 'F') AS reranked_n, max(o_totalprice) FILTER (o_orderstatus = 'F') AS reranked_max, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS reranked_mean FROM orders GROUP BY 1""")
def score_shift(t: Tables) -> DataFrame:
    """AGG-25: scores before and after a choice (orders stand for chunks)."""
    one = F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    rows = t.orders.groupBy(F.col("o_custkey").alias("trace_id")).agg(F.array_sort(F.collect_list(one)).alias("retrieved_chunks"))
    rows = rows.withColumn("reranked_chunks", F.filter("retrieved_chunks", lambda x: x["o_orderstatus"] == "F"))
    out = pf.score_shift(rows)
    return out.select("trace_id", *[F.col(f"{m}_n").cast("long").alias(f"{m}_n") if s == "n" else F.round(f"{m}_{s}", 4).alias(f"{m}_{s}") if s == "mean" else F.col(f"{m}_{s}") for m in ("retrieved", "reranked") for s in ("n", "max", "mean")])


@query("SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY GROUP BY 1")
def retained_events(t: Tables) -> DataFrame:
    """FLT-16: what a retention of ten days keeps at the end of the month."""
    kept, _ = up.apply_retention(t.events.withColumnRenamed("ts", "created_at"), F.lit("2024-01-31").cast("timestamp_ntz"), 10)
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"))


@query("SELECT o_orderkey AS chunk_id, o_orderpriority AS source_id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderkey LIMIT 50")
def pending_batch(t: Tables) -> DataFrame:
    """FLT-13: the next fifty pending rows."""
    rows = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("source_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("embedding_status"))
    return up.pending_chunks(rows, None, 50).select("chunk_id", "source_id")


@query(f"WITH {_LINES} SELECT source_id, pos, CASE WHEN len < 80 THEN 'second' ELSE 'first' END AS content_source, len FROM lines")
def recovered_lines(t: Tables) -> DataFrame:
    """JN-01: short lines as missing bodies, recovered from a second source by page and ordinal."""
    rows = lines(t).select("source_id", F.col("page").alias("page_idx"), F.col("pos").alias("block_idx"), F.lit("line").alias("chunk_kind"), "text")
    second = bl.with_ordinal(rows).select("source_id", "page_idx", "chunk_kind", "kind_ordinal", F.col("text").alias("content"))
    first = bl.with_ordinal(rows).withColumn("content", F.when(F.length("text") >= 80, F.col("text")))
    return bl.recover_content(first, second).select("source_id", F.col("block_idx").cast("long").alias("pos"), "content_source", F.length("content").cast("long").alias("len"))


@query("""SELECT o_orderkey AS trace_id, c_name AS raw_query FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'""")
def feedback_traces(t: Tables) -> DataFrame:
    """JN-23: urgent orders as feedback on the trace of their customer."""
    feedback = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("feedback_id"), F.col("o_custkey").alias("trace_id"))
    traces = t.customer.select(F.col("c_custkey").alias("trace_id"), F.lit("").alias("session_id"), F.col("c_name").alias("raw_query"), F.lit(None).cast("timestamp").alias("created_at"))
    return pf.feedback_with_trace(feedback, traces).select(F.col("feedback_id").alias("trace_id"), "raw_query")


@query("""SELECT doc_id, source FROM documents WHERE (source IN ('src0', 'src5') OR source IS NULL) AND (n_chars > 500 OR n_chars IS NULL)""")
def filtered_candidates(t: Tables) -> DataFrame:
    """FLT-10, FLT-11: predicates that only remove what is known to be false."""
    return rt.apply_post_filters(t.documents, [rt.source_in(["src0", "src5"], "source"), F.col("n_chars") > 500]).select("doc_id", "source")
