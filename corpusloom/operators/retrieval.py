"""Dense and BM25 retrieval for batches of queries, fusion, lookup and context.

A batch of queries is one job per route kind. Filters come before the ranking window; lookups come after it, so that
text is joined to survivors only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import question_index
from ..sources.shared import shared_folder
from .tables import is_small
from .tiles import BROADCAST_BYTES, nearest_rows

K1, B, RRF_K = 1.2, 0.75, 60

#: Documents that a batch of queries is multiplied with at once; elements of a matrix, at most.
DOCS, CELLS = 1 << 10, BROADCAST_BYTES // 8


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, then runs of Chinese characters as overlapping pairs (single ones alone)."""
    low = F.lower(text)
    plain = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"\p{IsHan}+"), F.lit(0))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
    return F.when(F.rlike(text, F.lit(r"\p{IsHan}")), F.concat(plain, F.flatten(F.transform(runs, pairs)))).otherwise(plain)


def _words(docs: DataFrame, doc_id: str, text: str, where: Column | None) -> DataFrame:
    """doc_id, the terms t of each text, and whether the document may be in the result."""
    return docs.where(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("t"), (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("_in"))


def _asked(queries: DataFrame) -> DataFrame:
    """How often each route of each query (query_id, route_no, text) has each of its terms."""
    return queries.select("query_id", "route_no", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "route_no", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(queries: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """Score of the documents for every (query_id, route_no, text) that shares a term with them.

    Only the queries' terms are counted. Lengths and frequencies cover all documents with terms; `where` (a column of
    docs) keeps documents out of the result, not out of the statistics.
    """
    words = _words(docs, doc_id, text, where)
    # no filter on the terms: it would move below them and split every text twice
    whole = words.select(F.nullif(F.size("t"), F.lit(0)).alias("size")).agg(F.count("size").alias("n"), F.avg("size").alias("mean"))
    asked = _asked(queries)
    # the queries' terms bound the terms that are counted: one count of them says what may be broadcast
    hint = F.broadcast if is_small(asked) else lambda df: df
    vocabulary = asked.select("term").distinct()
    tf = words.select("doc_id", "_in", F.size("t").alias("doc_len"), F.explode("t").alias("term")).join(hint(vocabulary), "term", "left_semi")
    tf = tf.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"), F.first("_in").alias("_in"))
    # reads all columns of tf, so that both come from one exchange
    frequency = tf.groupBy("term").agg(F.count_if((F.col("tf") > 0) & (F.col("doc_len") > 0) & F.col("_in").isNotNull()).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean")))
    hits = tf.join(hint(frequency), "term").where("_in").join(hint(asked), "term").crossJoin(F.broadcast(whole))
    return hits.groupBy("query_id", "route_no", "doc_id").agg(F.sum(part).alias("score"))


def topk(hits: DataFrame, keys: list[str], k: int, item: str) -> DataFrame:
    """The k best of each key with rank; ties to the smaller item."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), item))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _within(shared):
    """doc_id, _in, the number of terms of a text, and those of the queries among them by number with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            code = pc.index_in(lists.flatten(), value_set=words)
            of = np.repeat(np.arange(len(sizes)), sizes)[code.is_valid().to_numpy(zero_copy_only=False)]
            at, tf = np.unique(of * max(1, len(words)) + code.drop_null().to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(at, np.arange(len(sizes) + 1) * max(1, len(words))), pa.int32())
            codes, counts = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at % max(1, len(words)), tf))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), codes, counts], ["doc_id", "_in", "doc_len", "codes", "tf"])

    return run


def _frequencies(size: int):
    """A task's documents with each code; those with terms at all come last, then their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 2, dtype=np.int64)
        for batch in batches:
            length = batch.column(0).to_numpy()
            n[:size] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
            n[size:] += np.count_nonzero(length), length.sum(dtype=np.int64)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["code", "n"])

    return run


def _scored(shared, k: int, digits: int, mean: float):
    """The k best documents of each route in some documents after others, those left out that lie below what earlier ones gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value  # a row for each term, a column for each route
        routes = weights.shape[1]
        step, width = (max(1, min(DOCS, CELLS // n)) for n in (routes, max(routes, DOCS)))
        reached = np.full(routes, -np.inf)
        for rows in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            rows = rows.take(pc.sort_indices(rows.column(0), null_placement="at_start"))  # ties go to the smaller id
            ids, length, codes, tf = rows.columns
            of = np.repeat(np.arange(len(ids)), codes.value_lengths().to_numpy())
            tf, long = tf.flatten().to_numpy().astype(np.float64), length.to_numpy().astype(np.float64)[of]
            impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * long / mean))
            used, row = np.unique(codes.flatten().to_numpy(), return_inverse=True)
            score = np.zeros((routes, len(ids)))
            for begin in range(0, len(used), width):
                some = (row >= begin) & (row < begin + width)
                matrix = np.zeros((min(width, len(used) - begin), len(ids)))
                matrix[row[some] - begin, of[some]] = impact[some]
                score += weights[used[begin : begin + width]].T @ matrix
            score = np.where(score > 0, np.round(score, digits), -np.inf)  # every weight is above 0
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(score, order, axis=1)
            route, place = np.nonzero((best > -np.inf) & (best >= reached[:, None]))
            if best.shape[1] == k:
                reached = np.maximum(reached, best[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), ids.take(pa.array(order[route, place])), pa.array(best[route, place])], ["route", "doc_id", "score"])

    return run


def _multiplied(asked: DataFrame, words: DataFrame, k: int, digits: int) -> DataFrame:
    """The k best documents of each route: the queries' weights are one matrix that every task multiplies with its documents.

    asked: query_id, route_no, term, qtf; words: doc_id, _in and the terms. Texts are split once: what they have of the
    queries' terms is written to the shared folder, and read for the frequencies and for the scores.
    """
    spark = words.sparkSession
    rows = asked.toArrow()
    keys = sorted({*zip(rows["query_id"].to_pylist(), rows["route_no"].to_pylist())})
    number = {key: i for i, key in enumerate(keys)}
    coded = rows["term"].combine_chunks().dictionary_encode()
    size = len(coded.dictionary)
    kind = words.schema["doc_id"].dataType.simpleString()
    folder = f"{shared_folder(spark)}/corpusloom/batch-{uuid.uuid4().hex}"
    vocabulary = spark.sparkContext.broadcast(coded.dictionary.to_pylist())
    words.select("doc_id", "_in", "t").mapInArrow(_within(vocabulary), f"doc_id {kind}, _in boolean, doc_len int, codes array<int>, tf array<int>").write.option("compression", "zstd").parquet(folder)
    counted = spark.read.parquet(folder)
    found = counted.select("doc_len", "codes").mapInArrow(_frequencies(size), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # a row for each term
    n = np.zeros(size + 2)
    n[[r.code for r in found]] = [r.n for r in found]
    idf = np.log(1 + (n[size] - n[:size] + 0.5) / (n[:size] + 0.5))
    weights = np.zeros((size, len(keys)))
    code = coded.indices.to_numpy()
    weights[code, [number[key] for key in zip(rows["query_id"].to_pylist(), rows["route_no"].to_pylist())]] = rows["qtf"].to_numpy() * idf[code]
    shared = spark.sparkContext.broadcast(weights)
    hits = counted.where("_in").select("doc_id", "doc_len", "codes", "tf").mapInArrow(_scored(shared, k, digits, n[size + 1] / max(1.0, n[size])), f"route long, doc_id {kind}, score double")
    names = spark.createDataFrame([(*key, i) for i, key in enumerate(keys)], asked.select("query_id", "route_no").schema.add("route", "long"))
    return topk(hits.join(F.broadcast(names), "route").select("query_id", "route_no", "doc_id", "score"), ["query_id", "route_no"], k, "doc_id")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", where: Column | None = None, digits: int = 9) -> DataFrame:
    """The k best documents of every route of every query; scores are rounded, so that ties don't depend on the order of sums.

    Routes and terms whose matrix takes BROADCAST_BYTES at most are multiplied with the documents; more are joined to
    their terms. doc_id is unique.
    """
    asked = _asked(queries)
    n = asked.agg(F.count_distinct("term").alias("terms"), F.count_distinct(F.struct("query_id", "route_no")).alias("routes")).first()
    if 0 < n.terms * n.routes <= CELLS:
        return _multiplied(asked, _words(docs, doc_id, text, where), k, digits)
    scores = bm25_scores(queries, docs, doc_id, text, where).withColumn("score", F.round("score", digits))
    return topk(scores, ["query_id", "route_no"], k, "doc_id")


def text_routes(queries: DataFrame) -> DataFrame:
    """Every text of every query (query_id, texts) as a route numbered from 1; blank texts are none."""
    routes = queries.select("query_id", F.posexplode("texts").alias("route_no", "text")).where(F.trim("text") != "")
    return routes.select("query_id", (F.col("route_no") + 1).alias("route_no"), F.trim("text").alias("text"))


def sparse_routes(queries: DataFrame, docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """The k best documents of every text of every query (query_id, texts), each an independent route numbered from 1; blank texts are none."""
    return bm25_topk(text_routes(queries), docs, k, doc_id, text, where)


def _products(shared, k: int, digits: int, apart: bool):
    """The k best of each query among a task's vectors: one matrix product for each batch, the best so far kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, matrix = shared.value
        best_id = np.empty((len(asked), 0), dtype=np.int64)
        best = np.empty((len(asked), 0))
        size = np.sqrt((matrix**2).sum(axis=1))
        for batch in batches:
            flat = batch.column(1)
            good = [i for i, v in enumerate(flat) if v.as_py() is not None and len(v) == matrix.shape[1]] if flat.null_count or len(flat.flatten()) != len(flat) * matrix.shape[1] else None
            if good is not None:
                batch = batch.take(pa.array(good, pa.int64()))
            if batch.num_rows == 0:
                continue
            ids, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            score = np.round((matrix @ v.T) / np.maximum(size[:, None] * np.sqrt((v**2).sum(axis=1))[None], 1e-9), digits)
            if apart:
                score[asked[:, None] == ids[None]] = -np.inf
            best = np.concatenate((best, score), axis=1)
            best_id = np.concatenate((best_id, np.broadcast_to(ids, score.shape)), axis=1)
            order = np.lexsort((best_id, -best), axis=1)[:, :k]
            best, best_id = np.take_along_axis(best, order, axis=1), np.take_along_axis(best_id, order, axis=1)
        found = best > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, found.sum(axis=1)), pa.int64()), pa.array(best_id[found], pa.int64()), pa.array(best[found], pa.float64())], ["query_id", "id", "score"])

    return run


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None, digits: int = 9, apart: bool = False) -> DataFrame:
    """The k nearest vectors by cosine, exactly. queries: query_id, vector; vectors: id, vector and whatever `where` reads.

    Ids are integers. Scores are rounded; ties go to the smaller id. With `apart` a query's own id is no answer. Queries
    of one length whose vectors take BROADCAST_BYTES at most are one matrix that every task multiplies with its batches
    of vectors; else tiles of queries meet tiles of vectors.
    """
    rows = (vectors if where is None else vectors.where(where)).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(F.exists("vector", lambda x: x.isNotNull()))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    size = asked.agg(F.coalesce(8 * F.sum(F.size("vector").cast("long")), F.lit(0)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if size[0] > BROADCAST_BYTES or size[1] != size[2]:
        best = nearest_rows(asked, rows, k, ["id"], digits, ("query_id", "id") if apart else None)
        return best.select("query_id", "id", "score", F.col("place").alias("rank"))
    few = asked.collect()
    if not few:
        return rows.select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in few], dtype=np.int64), np.array([r[1] for r in few], dtype=np.float64)))
    hits = rows.mapInArrow(_products(shared, k, digits, apart), "query_id long, id long, score double")
    return topk(hits, ["query_id"], k, "id")


def union_routes(*routes: DataFrame) -> DataFrame:
    out = routes[0]
    for r in routes[1:]:
        out = out.unionByName(r)
    return out


def rrf_fuse(hits: DataFrame, k: int = RRF_K, factor: float = 5.0) -> DataFrame:
    """Weighted reciprocal ranks summed for each (query_id, id), with the rank on the route that saw the record first.

    hits: query_id, route_no, kind ('dense' or 'sparse'), rank, id. Dense routes weigh as a fifth (by factor) of the
    number of sparse routes that found anything, and 1 at least; a factor of 0 or less weighs all alike. The dense
    route has the smallest route_no.
    """
    sparse = F.size(F.collect_set(F.when(F.col("kind") == "sparse", F.col("route_no"))).over(W.partitionBy("query_id")))
    weight = F.greatest(F.lit(1.0), sparse / F.lit(float(factor))) if factor > 0 else F.lit(1.0)
    part = F.when(F.col("kind") == "dense", weight).otherwise(1.0) / (k + F.col("rank"))
    return hits.withColumn("_part", part).groupBy("query_id", "id").agg(F.sum("_part").alias("score"), F.min_by("rank", "route_no").alias("first_rank"), F.min("route_no").alias("first_route"))


def aggregate_vectors(fused: DataFrame, records: DataFrame) -> DataFrame:
    """Scores summed for each chunk, with its hits in the order they were first seen. records: id, source_chunk_id, vector_type."""
    hits = fused.join(records.select("id", "source_chunk_id", "vector_type"), "id")
    one = F.struct("first_route", "first_rank", "id", "vector_type", question_index(F.col("id")).alias("question"))
    return hits.groupBy("query_id", "source_chunk_id").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(one)).alias("vector_hits"))


def top_candidates(chunks: DataFrame, n: int) -> DataFrame:
    return topk(chunks, ["query_id"], n, "source_chunk_id")


def apply_post_filters(df: DataFrame, predicates: list[Column]) -> DataFrame:
    """Rows for which no predicate is false; unknown passes."""
    keep = F.lit(True)
    for p in predicates:
        keep = keep & F.coalesce(p, F.lit(True))
    return df.where(keep)


def source_in(ids: list[str], column: str = "source_id") -> Column:
    return F.col(column).isNull() | F.col(column).isin(ids)


def matched_text(vector_type: Column, question: Column, raw: Column, summary: Column, questions: Column) -> Column:
    """The text that a vector stands for; blank if it isn't there."""
    return F.coalesce(F.when(vector_type == "original", raw).when(vector_type == "summary", summary).when(vector_type == "question", F.get(questions, question)), F.lit(""))


def lookup_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Survivors with their chunk's text; chunks that are gone leave nulls."""
    return hits.join(chunks.select(F.col("chunk_id").alias("source_chunk_id"), "heading_path_id", "parent_chunk_id", "chunk_raw_text"), "source_chunk_id", "left")


def rerank(candidates: DataFrame, score: Column | None, k: int, enabled: bool = True) -> DataFrame:
    """Best k by score; a query with any missing score, or reranking off, keeps its order."""
    if not enabled or score is None:
        return candidates.where(F.col("rank") <= k)
    scored = candidates.withColumn("rerank_score", score)
    whole = F.min(F.col("rerank_score").isNotNull()).over(W.partitionBy("query_id"))
    order = W.partitionBy("query_id").orderBy(F.when(F.col("_whole"), -F.col("rerank_score")), "rank")
    return scored.withColumn("_whole", whole).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("rank", "_whole").withColumnRenamed("_n", "rank")


def unique_parents(candidates: DataFrame, chunks: DataFrame, n: int = 20) -> DataFrame:
    """The first n distinct parents in candidate order."""
    of = chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.coalesce("parent_chunk_id", "chunk_id").alias("parent_id"))
    best = candidates.join(of, "source_chunk_id").groupBy("query_id", "parent_id").agg(F.min("rank").alias("_r"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_r", "parent_id"))).where(F.col("rank") <= n).drop("_r")


def expand_to_parent(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with context: the parent's text, else their own, else what matched."""
    own = chunks.select(F.col("chunk_id").alias("source_chunk_id"), "parent_chunk_id", F.col("chunk_raw_text").alias("_own"))
    up = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("chunk_raw_text").alias("_up"))
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    return candidates.join(own, "source_chunk_id", "left").join(up, "parent_chunk_id", "left").withColumn("context", F.coalesce(some("_up"), some("_own"), F.col("matched_text"))).drop("_up", "_own")


def section_media(sections: DataFrame, chunks: DataFrame, most: int = 5) -> DataFrame:
    """Tables and figures of the given heading_path_id, at most so many each, in text order of relative_chunk_index."""
    media = chunks.where(F.col("chunk_type").isin("table", "figure")).join(sections.select("heading_path_id").distinct(), "heading_path_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("heading_path_id").orderBy("relative_chunk_index", "chunk_id"))
    return media.withColumn("media_rank", rank).where(F.col("media_rank") <= most)


def context_media(direct: DataFrame, section: DataFrame) -> DataFrame:
    """Media of direct hits before those of their sections, each chunk once for a query."""
    both = direct.select("query_id", "chunk_id", F.lit(0).alias("priority")).unionByName(section.select("query_id", "chunk_id", F.lit(1).alias("priority")))
    return both.groupBy("query_id", "chunk_id").agg(F.min("priority").alias("priority"))


def hints(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """Matched texts that no expanded parent of their query holds, each once, in order."""
    own = candidates.where(F.trim("matched_text") != "")
    held = own.alias("c").join(parents.select("query_id", "context").alias("p"), (F.col("c.query_id") == F.col("p.query_id")) & F.contains(F.col("p.context"), F.col("c.matched_text")), "left_anti")
    return held.groupBy("query_id", "matched_text").agg(F.min("rank").alias("rank"))


def preview_candidates(candidates: DataFrame, most: int = 5, chars: int = 200) -> DataFrame:
    """Previews of the best chunks: summary, else question, else original, cut."""
    pick = lambda kind: F.get(F.filter("vector_hits", lambda h: (h["vector_type"] == kind) & (F.trim(h["matched_text"]) != "")), F.lit(0))["matched_text"]
    return candidates.where(F.col("rank") <= most).select("query_id", "source_chunk_id", "rank", F.substring(F.coalesce(pick("summary"), pick("question"), pick("original")), 1, chars).alias("preview"))


def candidate_text(hits: Column) -> Column:
    """All matched texts of a candidate, joined."""
    return F.array_join(F.filter(F.transform(hits, lambda h: F.trim(h["matched_text"])), lambda t: t != ""), " ")
