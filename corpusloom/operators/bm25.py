"""A stored BM25 index: postings in blocks of documents with their maxima, in segments that follow the corpus.

Texts are split once, when they are indexed. A segment holds, for each term and block of documents, the postings and what
bounds their scores: the largest frequency and the smallest length. The texts are shuffled once, by block, so that a task has
whole blocks and makes their postings by itself. A batch of queries is one sparse matrix; a task goes
through blocks one after another, and a route skips those whose bound lies below what its k best have reached so far.
Changes add segments; what they replace is noted as gone, so that counts stay those of the present corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import B, K1, terms, topk
from .tables import small

#: Documents of a block, about; blocks of a task, at most about; terms that are multiplied at once; terms of all routes of a
#: batch up to which they are broadcast; ids of a plan up to which they are; terms of texts that are counted at once, about.
DOCS, BLOCKS, TERMS, MOST_WEIGHTS, MOST_IDS, COUNTED = 1 << 10, 8, 1 << 11, 1_000_000, 1_000_000, 1 << 20


@dataclass
class Segment:
    number: int
    folder: str
    docs: int
    length: int


@dataclass
class Index:
    """The live segments under a path, with the number of documents and of their terms."""

    spark: SparkSession
    path: str
    segments: list[Segment]

    @property
    def docs(self) -> int:
        return sum(s.docs for s in self.segments)

    @property
    def mean(self) -> float:
        return sum(s.length for s in self.segments) / max(1, self.docs)

    def table(self, name: str) -> DataFrame | None:
        """A table of all segments, with the segment's number."""
        out = None
        for s in self.segments:
            rows = self.spark.read.parquet(f"{self.path}/{s.folder}/{name}").withColumn("segment", F.lit(s.number))
            out = rows if out is None else out.unionByName(rows)
        return out


def open_index(spark: SparkSession, path: str) -> Index | None:
    """The index under a path, None if there is none (or none that was finished)."""
    try:
        rows = spark.read.parquet(f"{path}/segments").collect()  # a row for each change since it was last merged
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return Index(spark, path, sorted((Segment(r.number, r.folder, r.docs, r.length) for r in rows), key=lambda s: s.number))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column, the terms of a text, becomes their number (null for none) and (term, tf) of each different one."""
    for batch in batches:
        whole = batch.columns[-1].value_lengths().to_numpy()
        # as many rows at once as hold some number of terms
        cuts = np.flatnonzero(np.diff(np.cumsum(whole) // COUNTED)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(whole)]):
            *columns, lists = batch.slice(a, b - a).columns
            coded, sizes = lists.flatten().dictionary_encode(), whole[a:b]
            order = pc.sort_indices(coded.dictionary)
            words, rank = coded.dictionary.take(order), np.argsort(order.to_numpy())
            n = max(1, len(words))
            at, tf = np.unique(np.repeat(np.arange(b - a), sizes) * n + rank[coded.indices.to_numpy()], return_counts=True)
            each = pa.StructArray.from_arrays([words.take(pa.array(at % n)), pa.array(tf, pa.int32())], ["term", "tf"])
            ends = np.searchsorted(at, np.arange(b - a + 1) * n)
            columns += [pa.array(sizes, pa.int32(), mask=sizes == 0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "doc_len", "terms"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each term in each block; what comes of a block in one run is one row for each of its terms."""

    def grouped(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        doc, block, doc_len, lists = (rows[c].combine_chunks() for c in ("doc_id", "block", "doc_len", "terms"))
        term, count = (lists.flatten().field(i) for i in (0, 1))
        coded = term.dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        of = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())[order]
        n = np.bincount(codes, minlength=len(coded.dictionary))
        starts = np.cumsum(n) - n
        tf, length = count.to_numpy()[order], doc_len.take(pa.array(of)).to_numpy()
        each = pa.StructArray.from_arrays([doc.take(pa.array(of)), pa.array(tf), pa.array(length)], ["doc_id", "tf", "doc_len"])
        lists = pa.ListArray.from_arrays(pa.array([*starts, len(of)], pa.int32()), each)
        columns = [coded.dictionary, pa.repeat(block[0], len(n)), pa.array(n, pa.int64()), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts)), lists]
        return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "max_tf", "min_len", "postings"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
            if a < b and held and held[0].column("block")[0].as_py() != blocks[a]:
                yield grouped(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield grouped(held)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "zstd").parquet(path)


def _write_segment(docs: DataFrame, gone: DataFrame | None, path: str, number: int, doc_id: str, text: str, keep: list[str], near: list[str], mode: str) -> None:
    spark = docs.sparkSession
    folder = f"{path}/segment-{uuid.uuid4().hex}"
    n_blocks = max(1, -(-docs.count() // DOCS))
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // BLOCKS)
    block = F.xxhash64(*near, F.pmod(F.xxhash64(doc_id), F.lit(n_blocks))).alias("block")
    rows = docs.where(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), block, *keep, F.col(text).alias("_text")).repartition(width, "block").sortWithinPartitions("block")
    # what each document holds: texts are split here and nowhere else; no filter on the terms, it would split them twice
    rows = rows.select("doc_id", "block", *keep, terms(F.col("_text")).alias("t"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "doc_len int", "terms array<struct<term: string, tf: int>>"])
    _write(rows.mapInArrow(_counted, schema), f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    kind = forward.schema["doc_id"].dataType.simpleString()
    whole = forward.where("doc_len is not null").select("doc_id", "block", "doc_len", "terms")
    _write(whole.mapInArrow(_postings, f"term string, block long, n long, max_tf int, min_len int, postings array<struct<doc_id: {kind}, tf: int, doc_len: int>>"), f"{folder}/postings")
    gone = forward.limit(0) if gone is None else gone
    _write(gone.select("doc_id", "doc_len"), f"{folder}/gone")
    _write(gone.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n")), f"{folder}/gone_terms")
    size = lambda name: spark.read.parquet(f"{folder}/{name}").agg(F.count("doc_len"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    new, less = size("forward"), size("gone")
    # the segment is live once this row is there
    spark.createDataFrame([(number, folder[len(path) + 1 :], new[0] - less[0], new[1] - less[1])], "number long, folder string, docs long, length long").coalesce(1).write.mode(mode).parquet(f"{path}/segments")


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] = (), near: list[str] = ()) -> Index:
    """Indexes all docs anew. keep: columns for filters; near: columns whose equal rows come into common blocks.

    Rows without text or without terms aren't indexed; doc_id is unique.
    """
    _write_segment(docs, None, path, 0, doc_id, text, list(keep), list(near), "overwrite")
    return open_index(docs.sparkSession, path)


def follow_plan(index: Index, plan: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] = (), near: list[str] = ()) -> Index:
    """Adds a segment with what an incremental plan (chunk_id, action) has changed; nothing else is split or written.

    docs holds the texts after it, under doc_id. What is changed or deleted is known from the index itself.
    """
    # written once: it is asked several times, and comes of a join of all hashes
    folder = f"{index.path}/plan-{uuid.uuid4().hex}"
    _write(plan.where(F.col("action").isin("new", "changed", "deleted")).select("chunk_id", "action"), folder)
    plan = index.spark.read.parquet(folder)
    # ids that may be broadcast spare a shuffle of all texts and terms
    of = lambda rows, name, *actions: rows.join(small(plan.where(F.col("action").isin(*actions)).select(F.col("chunk_id").alias(name)).distinct(), MOST_IDS), name, "left_semi")
    number = max((s.number for s in index.segments), default=-1) + 1
    gone = of(_live(index, index.table("forward")), "doc_id", "changed", "deleted")
    _write_segment(of(docs, doc_id, "new", "changed"), gone, index.path, number, doc_id, text, list(keep), list(near), "append")
    return open_index(index.spark, index.path)


def _live(index: Index, hits: DataFrame) -> DataFrame:
    """Hits (doc_id, segment) without those of documents that a later segment has replaced."""
    if len(index.segments) == 1:
        return hits
    gone = index.table("gone").groupBy(F.col("doc_id").alias("_gone")).agg(F.max("segment").alias("_last"))
    return hits.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("segment") < F.col("_last")), "left_anti")


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, route_no, term and the weight of each of its terms, by the counts of the present corpus."""
    asked = queries.select("query_id", "route_no", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "route_no", "term").agg(F.count("*").alias("qtf"))
    vocabulary = small(asked.select("term").distinct())
    df = index.table("postings").select("term", F.col("n").cast("long").alias("n")).join(vocabulary, "term", "left_semi")
    if len(index.segments) > 1:
        gone = index.table("gone_terms").select("term", (-F.col("n")).alias("n"))
        df = df.unionByName(gone.join(vocabulary, "term", "left_semi"))
    frequency = df.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(index.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(frequency, "term").select("query_id", "route_no", "term", (F.col("qtf") * idf).alias("weight"))


def index_scores(index: Index, queries: DataFrame, where: Column | None = None) -> DataFrame:
    """Score of the documents for every (query_id, route_no, text) that shares a term with them. where reads the columns kept."""
    read = index.table("postings").select("segment", "term", F.explode("postings").alias("p")).join(_asked(index, queries), "term")
    part = F.col("weight") * F.col("p.tf") * (K1 + 1) / (F.col("p.tf") + K1 * (1 - B + B * F.col("p.doc_len") / F.lit(index.mean)))
    out = read.groupBy("query_id", "route_no", "segment", F.col("p.doc_id").alias("doc_id")).agg(F.sum(part).alias("score"))
    out = _live(index, out)
    if where is not None:
        out = out.join(index.table("forward").where(where).select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
    return out.select("query_id", "route_no", "doc_id", "score")


def _best(shared, k: int, digits: int, mean: float, listed: bool):
    """The best of each route in blocks that come one after another, those left out that can't reach what earlier ones gave.

    A block's rows are its terms with their postings, and, if listed, one without term that names the documents to rank.
    """

    def impact(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))

    def ranked(rows: pa.Table, reached: np.ndarray) -> pa.RecordBatch | None:
        routes, terms_, place, first, route, weight = shared.value
        rows = rows.combine_chunks()
        term = rows["term"].combine_chunks()
        real = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        if not len(real) or listed and len(real) == len(rows):
            return None
        at = np.array([place[t] for t in term.take(pa.array(real)).to_pylist()])
        top = impact(*(rows[c].to_numpy()[real].astype(np.float64) for c in ("max_tf", "min_len")))
        counts = first[at + 1] - first[at]
        # weights of the block's terms: a row for each route
        w = np.zeros((len(routes), len(real)))
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[at], counts)
        w[route[inside], np.repeat(np.arange(len(real)), counts)] = weight[inside]
        may = np.flatnonzero((w.any(axis=1)) & (w @ top >= reached - 1e-6))
        if not len(may):
            return None
        lists = rows["postings"].combine_chunks()
        values, bounds = lists.flatten(), lists.value_lengths().to_numpy()
        ids = values.field("doc_id").dictionary_encode()
        doc, tf, length = ids.indices.to_numpy(), *(values.field(c).to_numpy().astype(np.float64) for c in ("tf", "doc_len"))
        of = np.repeat(np.arange(len(rows)), bounds)
        allowed = np.ones(len(ids.dictionary), dtype=bool)
        if listed:
            allowed[:] = False
            allowed[doc[~np.isin(of, real)]] = True
        column = np.full(len(rows), -1)
        column[real] = np.arange(len(real))
        score = np.zeros((len(may), len(ids.dictionary)))
        share = np.zeros_like(score, dtype=bool)
        for begin in range(0, len(real), TERMS):
            some = (column[of] >= begin) & (column[of] < begin + TERMS)
            matrix = np.zeros((min(TERMS, len(real) - begin), len(ids.dictionary)))
            matrix[column[of[some]] - begin, doc[some]] = impact(tf[some], length[some])
            own = w[may, begin : begin + TERMS]
            score += own @ matrix
            share |= (own != 0).astype(np.float32) @ (matrix > 0).astype(np.float32) > 0
        score = np.where(share & allowed, np.round(score, digits), -np.inf)
        n = min(k, score.shape[1])
        least = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
        if n == k:
            reached[may] = np.maximum(reached[may], least)
        row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf) & (score >= reached[may][:, None]))
        return pa.RecordBatch.from_arrays([pa.array(may[row], pa.int64()), ids.dictionary.take(pa.array(col)), pa.array(score[row, col])], ["route", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.full(len(shared.value[0]), -np.inf)
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            blocks, segments = batch.column("block").to_numpy(), batch.column("segment").to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (segments[1:] != segments[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
                if a == b:
                    continue
                if held and now != (segments[a], blocks[a]):
                    out = ranked(pa.Table.from_batches(held), reached)
                    if out is not None:
                        yield out
                    held = []
                now = (segments[a], blocks[a])
                held.append(batch.slice(a, b - a))
        if held and (out := ranked(pa.Table.from_batches(held), reached)) is not None:
            yield out

    return run


def index_topk(index: Index, queries: DataFrame, k: int, where: Column | None = None, digits: int = 9) -> DataFrame:
    """The k best documents of every route of every query (query_id, route_no, text), as retrieval.bm25_topk gives them.

    Up to MOST_WEIGHTS terms of all routes are one sparse matrix that every task multiplies with its blocks of postings,
    block after block; more are joined to the postings.
    """
    weighed = _asked(index, queries)
    rows = weighed.limit(MOST_WEIGHTS + 1).toArrow()
    if rows.num_rows > MOST_WEIGHTS:
        return topk(index_scores(index, queries, where).withColumn("score", F.round("score", digits)), ["query_id", "route_no"], k, "doc_id")
    keys = sorted({*zip(rows["query_id"].to_pylist(), rows["route_no"].to_pylist())})
    number = {key: i for i, key in enumerate(keys)}
    rows = rows.sort_by("term").combine_chunks()
    coded = rows["term"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
    first = np.searchsorted(coded.indices.to_numpy(), np.arange(len(coded.dictionary) + 1))
    route = np.array([number[key] for key in zip(rows["query_id"].to_pylist(), rows["route_no"].to_pylist())], dtype=np.int64)
    words = coded.dictionary.to_pylist()
    spark = index.spark
    shared = spark.sparkContext.broadcast((keys, words, {t: i for i, t in enumerate(words)}, first, route, rows["weight"].to_numpy()))
    postings = index.table("postings").select("segment", "block", "term", "max_tf", "min_len", "postings")
    read = postings.join(F.broadcast(spark.createDataFrame([(w,) for w in words], "term string")), "term", "left_semi").select(*postings.columns)
    listed = where is not None or len(index.segments) > 1
    if listed:
        docs = _live(index, index.table("forward") if where is None else index.table("forward").where(where))
        zero = F.lit(0)
        one = F.struct("doc_id", zero.cast(postings.schema["postings"].dataType.elementType["tf"].dataType).alias("tf"), zero.cast(postings.schema["postings"].dataType.elementType["doc_len"].dataType).alias("doc_len"))
        names = docs.groupBy("segment", "block").agg(F.collect_list(one).alias("postings"))
        read = read.unionByName(names, allowMissingColumns=True)
    doc_type = postings.schema["postings"].dataType.elementType["doc_id"].dataType.simpleString()
    found = read.repartition("segment", "block").sortWithinPartitions("segment", "block").mapInArrow(_best(shared, k, digits, index.mean, listed), f"route long, doc_id {doc_type}, score double")
    schema = queries.select("query_id", "route_no").schema.add("route", "long")
    names = spark.createDataFrame([(*key, i) for i, key in enumerate(keys)], schema)
    return topk(found.join(F.broadcast(names), "route").select("query_id", "route_no", "doc_id", "score"), ["query_id", "route_no"], k, "doc_id")


def stored_index(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] = (), near: list[str] = ()) -> Index:
    """The index of a table of files: the one in folder, if the files are still those that it was built from, else a new one."""
    m = F.col("_metadata")
    files = docs.select(F.struct(m["file_path"], m["file_size"], m["file_modification_time"]).alias("f")).distinct()
    own = F.lit(f"2 {doc_id} {text} {[*keep]} {[*near]}")  # the layout, and what the index holds
    name = files.agg(F.sha2(F.concat(own, F.to_json(F.sort_array(F.collect_list("f")))), 256)).first()[0]  # a row for each file
    path = f"{folder}/bm25-{name[:32]}"
    return open_index(docs.sparkSession, path) or build_index(docs, path, doc_id, text, keep, near)
