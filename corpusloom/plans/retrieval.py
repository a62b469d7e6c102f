"""Retrieval, fusion and evaluation over documents, benchmark items and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25
from ..operators import evaluation as ev
from ..operators import retrieval as rt
from ..operators import upsert as up
from ..sources.shared import shared_folder
from .registry import Tables, query

_TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_POSTINGS = f"""
words AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents WHERE length(text) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS doc_len FROM tf GROUP BY 1),
stat AS (SELECT count(*) AS n, avg(doc_len) AS mean FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""
_SCORES = """
asked AS (SELECT query_id, route_no, term, count(*) AS qtf FROM (SELECT query_id, route_no, unnest({terms}) AS term FROM queries) GROUP BY ALL),
scores AS (
  SELECT query_id, route_no, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean))) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN stat GROUP BY ALL),
sparse AS (
  SELECT query_id, route_no, doc_id, score, row_number() OVER (PARTITION BY query_id, route_no ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores)""".format(terms=_TERMS.format("text"))


_KEEP = {"keep": ["lang"], "near": ["lang"]}


def _index(t: Tables) -> bm25.Index:
    """The stored index of documents, built when it is first asked for."""
    return bm25.stored_index(t.documents, f"{shared_folder(t.documents.sparkSession)}/corpusloom", **_KEEP)


def _items(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.lit(0).alias("route_no"), "text")


_BM25 = f"""WITH {_POSTINGS}, queries AS (SELECT item_id AS query_id, 0 AS route_no, text FROM benchmark), {_SCORES}
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM sparse WHERE rank <= 10"""


@query(_BM25)
def bm25_topk(t: Tables) -> DataFrame:
    """RNK-02: the ten best documents of each benchmark item, from the stored index."""
    return bm25.index_topk(_index(t), _items(t), 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(_BM25)
def bm25_without_index(t: Tables) -> DataFrame:
    """RNK-02: the same by splitting all texts for this batch."""
    return rt.bm25_topk(_items(t), t.documents, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(_BM25)
def bm25_after_update(t: Tables) -> DataFrame:
    """RNK-02, JN-15: an index of an older state of the documents that follows the plan to the present one."""
    docs = t.documents.select("doc_id", "text", "lang")
    other = docs.where("doc_id % 3 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "text", "lang")  # gone by now
    old = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" older words"))).otherwise(F.col("text"))).unionByName(other)
    index = bm25.build_index(old, f"{shared_folder(docs.sparkSession)}/corpusloom/bm25-{uuid.uuid4().hex}", **_KEEP)
    state = lambda rows: rows.select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"), F.lit("child").alias("chunk_type"), F.lit("s").alias("source_id"), F.lit(None).cast("long").alias("parent_chunk_id"))
    index = bm25.follow_plan(index, up.plan_incremental(state(old), state(docs)), docs, **_KEEP)
    return bm25.index_topk(index, _items(t), 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_ROUTES = """queries AS (
  SELECT item_id AS query_id, CAST(i AS INTEGER) AS route_no, trim(parts[i]) AS text
  FROM (SELECT item_id, string_split(text, '.') AS parts, unnest(range(1, len(string_split(text, '.')) + 1)) AS i FROM benchmark) WHERE trim(parts[i]) <> '')"""


def _sparse(t: Tables) -> DataFrame:
    """The twenty best documents of each sentence of an item."""
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.split("text", "\\.").alias("texts"))
    return bm25.index_topk(_index(t), rt.text_routes(queries), 20)


def _asked(t: Tables) -> DataFrame:
    """Each item's own vector (ids pair items and documents with vectors)."""
    return t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _dense(t: Tables) -> DataFrame:
    """Nearest vectors of each item's own vector."""
    return rt.dense_topk(_asked(t), t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 20)


def _fused(t: Tables) -> DataFrame:
    dense = _dense(t).select("query_id", F.lit(0).alias("route_no"), F.lit("dense").alias("kind"), "rank", "id")
    sparse = _sparse(t).select("query_id", "route_no", F.lit("sparse").alias("kind"), "rank", F.col("doc_id").alias("id"))
    return rt.rrf_fuse(rt.union_routes(dense, sparse))


_COSINE = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / greatest(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 1e-9)"
_DENSE = f"""dense AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COSINE}, 9) AS score FROM embeddings a JOIN benchmark i ON i.item_id = a.vec_id CROSS JOIN embeddings b))"""
_FUSED = f"""WITH {_POSTINGS}, {_ROUTES}, {_SCORES}, {_DENSE},
hits AS (SELECT query_id, 0 AS route_no, 'dense' AS kind, rank, id FROM dense WHERE rank <= 20 UNION ALL SELECT query_id, route_no, 'sparse', rank, doc_id FROM sparse WHERE rank <= 20),
weight AS (SELECT query_id, greatest(1.0, count(DISTINCT CASE WHEN kind = 'sparse' THEN route_no END) / 5.0) AS w FROM hits GROUP BY 1),
fused AS (SELECT query_id, id, sum(CASE WHEN kind = 'dense' THEN w ELSE 1.0 END / (60 + rank)) AS score, arg_min(rank, route_no) AS first_rank FROM hits JOIN weight USING (query_id) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM fused)"""


@query(f"{_FUSED} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, CAST(first_rank AS INTEGER) AS first_rank FROM best WHERE rank <= 10")
def fused_topk(t: Tables) -> DataFrame:
    """AGG-01, WIN-17, RNK-03/05, SET-03: dense and sparse routes of each item fused by weighted reciprocal ranks."""
    best = rt.topk(_fused(t).withColumn("score", F.round("score", 12)), ["query_id"], 10, "id")
    return best.select("query_id", "id", "rank", F.round("score", 6).alias("score"), "first_rank")


@query(f"""WITH {_DENSE} SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 20""")
def dense_hits(t: Tables) -> DataFrame:
    """RNK-01, FN-14: the twenty nearest vectors of each item."""
    return _dense(t).select("query_id", "id", "rank")


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COSINE}, 9) AS score FROM embeddings a JOIN benchmark i ON i.item_id = a.vec_id CROSS JOIN embeddings b WHERE b.label < 4 AND a.vec_id <> b.vec_id)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""")
def filtered_dense(t: Tables) -> DataFrame:
    """FLT-12, RNK-01: the five nearest among the vectors that a filter lets through."""
    of = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rt.dense_topk(_asked(t), of, 5, F.col("label") < 4, apart=True).select("query_id", "id", "rank")


@query(f"""WITH {_POSTINGS}, queries AS (SELECT item_id AS query_id, 0 AS route_no, text FROM benchmark), {_SCORES},
kept AS (SELECT s.query_id, s.doc_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, s.doc_id) AS r FROM scores s JOIN documents d USING (doc_id) WHERE d.lang = 'en')
SELECT query_id, doc_id, CAST(r AS INTEGER) AS rank FROM kept WHERE r <= 10""")
def filtered_bm25(t: Tables) -> DataFrame:
    """FLT-12, RNK-02: the ten best English documents, by the statistics of all."""
    return bm25.index_topk(_index(t), _items(t), 10, where=F.col("lang") == "en").select("query_id", "doc_id", "rank")


@query(f"""{_FUSED}
SELECT query_id, source AS source_chunk_id, round(sum(score), 6) AS score, count(*) AS n_hits FROM fused JOIN documents ON doc_id = id GROUP BY ALL""")
def vector_aggregation(t: Tables) -> DataFrame:
    """AGG-02: fused records summed for the chunk that they stand for (here: a document's source)."""
    records = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("source_chunk_id"), F.lit("original").alias("vector_type"))
    out = rt.aggregate_vectors(_fused(t).withColumn("id", F.col("id")), records)
    return out.select("query_id", "source_chunk_id", F.round("score", 6).alias("score"), F.size("vector_hits").cast("long").alias("n_hits"))


_RANKED = f"""WITH pairs AS (
  SELECT a.vec_id AS case_id, b.vec_id AS item_id, a.label AS own, b.label AS other, round({_COSINE}, 9) AS sim
  FROM embeddings a JOIN benchmark i ON i.item_id = a.vec_id CROSS JOIN embeddings b WHERE a.vec_id <> b.vec_id),
ranked AS (SELECT * FROM (SELECT case_id, item_id, CAST(greatest(0, 3 - abs(own - other)) AS INTEGER) AS score, row_number() OVER (PARTITION BY case_id ORDER BY sim DESC, item_id) AS rank FROM pairs) WHERE rank <= 50)"""


def _ranked(t: Tables) -> DataFrame:
    """Judged rankings: an item's nearest vectors, graded by how near their labels are."""
    of = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    best = rt.dense_topk(_asked(t), of, 50, apart=True)
    label = lambda c, name: of.select(F.col("id").alias(c), F.col("label").alias(name))
    both = best.join(label("id", "other"), "id").join(label("query_id", "own"), "query_id")
    return both.select(F.col("query_id").alias("case_id"), F.col("id").alias("item_id"), "rank", F.greatest(F.lit(0), 3 - F.abs(F.col("own") - F.col("other"))).alias("score"))


@query(f"""{_RANKED},
ideal AS (SELECT *, row_number() OVER (PARTITION BY case_id, rank <= 20 ORDER BY score DESC, rank) AS best FROM ranked)
SELECT case_id, round(CASE WHEN b > 0 THEN d / b ELSE 0 END, 6) AS ndcg, round(p2, 6) AS p2, round(p3, 6) AS p3, hit3, round(avg_score, 6) AS avg_score, round(mrr, 6) AS mrr FROM (
  SELECT case_id, sum((pow(2, score) - 1) / log2(rank + 1)) FILTER (rank <= 20) AS d, sum((pow(2, score) - 1) / log2(best + 1)) FILTER (rank <= 20) AS b,
    count(*) FILTER (rank <= 20 AND score >= 2) / 20.0 AS p2, count(*) FILTER (rank <= 20 AND score >= 3) / 20.0 AS p3,
    max(CASE WHEN rank <= 20 AND score >= 3 THEN 1 ELSE 0 END) AS hit3, avg(score) FILTER (rank <= 20) AS avg_score, coalesce(1 / min(rank) FILTER (score >= 2), 0) AS mrr
  FROM ideal GROUP BY 1)""")
def graded_metrics(t: Tables) -> DataFrame:
    """AGG-12..14: NDCG, precision, hit, mean score and MRR of each case at 20."""
    out = ev.graded(_ranked(t), 20, ["case_id"])
    return out.select("case_id", F.round("ndcg", 6).alias("ndcg"), F.round("p2", 6).alias("p2"), F.round("p3", 6).alias("p3"), "hit3", F.round("avg_score", 6).alias("avg_score"), F.round("mrr", 6).alias("mrr"))


@query(f"""{_RANKED}, judged AS (SELECT *, rank() OVER (PARTITION BY case_id ORDER BY score DESC) + (count(*) OVER (PARTITION BY case_id, score) - 1) / 2.0 AS j FROM ranked)
SELECT case_id, round(corr(rank, j), 6) AS rho FROM judged GROUP BY 1""")
def spearman_rho(t: Tables) -> DataFrame:
    """AGG-15; NaN where all scores are equal, as in SQL."""
    return ev.spearman(_ranked(t), ["case_id"]).select("case_id", F.coalesce(F.round("rho", 6), F.lit(float("nan"))).alias("rho"))


@query(f"""{_RANKED}, d AS (SELECT case_id, k, avg(score) FILTER (rank <= k) AS avg_score, count(*) FILTER (rank <= k AND score >= 2) / k AS p2, coalesce(1 / min(rank) FILTER (score >= 2), 0) AS mrr FROM ranked CROSS JOIN (SELECT unnest([5.0, 20.0, 50.0]::DOUBLE[]) AS k) GROUP BY 1, 2)
SELECT CAST(k AS INTEGER) AS k, round(avg(avg_score), 6) AS avg_score, round(avg(p2), 6) AS p2, round(avg(mrr), 6) AS mrr, count(*) AS cases FROM d GROUP BY 1""")
def macro_metrics(t: Tables) -> DataFrame:
    """AGG-17: macro averages for each cutoff."""
    ranked = _ranked(t)
    each = [ev.graded(ranked, k, ["case_id"]).withColumn("k", F.lit(k)) for k in (5, 20, 50)]
    out = ev.macro(rt.union_routes(*each), ["k"], ["avg_score", "p2", "mrr"])
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("avg_score", "p2", "mrr")], "cases")


@query(f"""{_FUSED}, truth AS (SELECT query_id, source FROM best JOIN documents ON doc_id = id WHERE rank = 1),
gold AS (SELECT query_id, d.doc_id AS id FROM truth JOIN documents d USING (source))
SELECT query_id, round(count(rank) / count(*), 6) AS recall FROM gold LEFT JOIN (SELECT query_id, id, rank FROM best WHERE rank <= 20) USING (query_id, id) GROUP BY 1""")
def recall_at_20(t: Tables) -> DataFrame:
    """AGG-16: recall of the documents that share the source of the best hit."""
    best = rt.topk(_fused(t).withColumn("score", F.round("score", 12)), ["query_id"], 20, "id")
    of = t.documents.select(F.col("doc_id").alias("id"), "source")
    truth = best.where("rank = 1").join(of, "id").select("query_id", "source")
    return ev.recall_of_group(best, truth, of, "source", 20).select("query_id", F.round("recall", 6).alias("recall"))


@query(f"""{_FUSED}, lone AS (SELECT query_id, id FROM hits GROUP BY ALL HAVING bool_and(kind = 'dense')), plain AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, id) AS rank FROM hits GROUP BY query_id, id),
heavy AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(CASE WHEN kind = 'dense' THEN 3.0 ELSE 1.0 END / (60 + rank)), 12) DESC, id) AS rank FROM hits GROUP BY query_id, id),
j AS (SELECT query_id, id, a.rank AS ra, b.rank AS rb FROM (SELECT * FROM plain WHERE rank <= 10) a FULL JOIN (SELECT * FROM heavy WHERE rank <= 10) b USING (query_id, id))
SELECT query_id, round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(*), 6) AS jaccard, count(*) FILTER (ra IS NOT NULL AND o.id IS NOT NULL) AS dense_kept_a, count(*) FILTER (rb IS NOT NULL AND o.id IS NOT NULL) AS dense_kept_b
FROM j LEFT JOIN lone o USING (query_id, id) GROUP BY 1""")
def fusion_comparison(t: Tables) -> DataFrame:
    """AGG-19: equal weights against a dense route that counts as three."""
    dense = _dense(t).select("query_id", F.lit(0).alias("route_no"), F.lit("dense").alias("kind"), "rank", "id")
    sparse = _sparse(t).select("query_id", "route_no", F.lit("sparse").alias("kind"), "rank", F.col("doc_id").alias("id"))
    hits = rt.union_routes(dense, sparse)
    only = hits.groupBy("query_id", "id").agg(F.bool_and(F.col("kind") == "dense").alias("d")).where("d")
    best = lambda w: rt.topk(hits.groupBy("query_id", "id").agg(F.round(F.sum(F.when(F.col("kind") == "dense", w).otherwise(1.0) / (60 + F.col("rank"))), 12).alias("score")), ["query_id"], 10, "id")
    out = ev.compare_fusions(best(1.0), best(3.0), only, 10)
    return out.select("query_id", F.round("jaccard", 6).alias("jaccard"), "dense_kept_a", "dense_kept_b")


@query("""WITH r AS (SELECT quality, toxic, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (p = 1 AND quality = 1) AS tp, count(*) FILTER (p = 1 AND quality = 0) AS fp, count(*) FILTER (p = 0 AND quality = 1) AS fn, count(*) FILTER (p = 0 AND quality = 0) AS tn FROM r)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr FROM c""")
def binary_quality(t: Tables) -> DataFrame:
    """AGG-22: how well length alone tells good documents."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("p", (F.col("n_chars") >= 1000).cast("int"))
    out = ev.binary_metrics(rows, "p", "quality")
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")])


@query("""SELECT CAST(count(text) AS DOUBLE) / count(*) AS text, CAST(count(quality) AS DOUBLE) / count(*) AS quality, CAST(count(toxic) AS DOUBLE) / count(*) AS toxic FROM (SELECT text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))""")
def field_fill_rate(t: Tables) -> DataFrame:
    """AGG-27."""
    return ev.fill_rate(t.documents.join(t.labels, "doc_id", "left"), ["text", "quality", "toxic"])
