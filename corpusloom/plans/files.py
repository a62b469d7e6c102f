"""Files and stores: what is written from the provided tables into the shared folder, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import buckets
from ..operators import retrieval as rt
from ..operators import upsert as up
from ..sources.documents import read_jsonl, write_manifest
from ..sources.parsed import read_all_parsed, write_parsed
from ..sources.shared import shared_folder
from .registry import Tables, query
from .retrieval import _FUSED, _fused


def _folder(t: Tables) -> str:
    """A new folder, which only this run reads."""
    return f"{shared_folder(t.documents.sparkSession)}/corpusloom/files-{uuid.uuid4().hex}"


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT 'document-' || doc_id AS folder, sha256(text) AS md_hash, CASE WHEN doc_id % 7 = 3 THEN 'model' WHEN doc_id % 7 = 5 THEN 'middle,model' ELSE '' END AS missing, CASE WHEN doc_id % 7 NOT IN (3, 5) THEN 1 END AS n_pages, CASE WHEN doc_id % 7 NOT IN (3, 5) THEN left(text, 40) END AS title FROM d""")
def parse_results(t: Tables) -> DataFrame:
    """SRC-01: parse results, four files for each document, of which some lack a part, in archives of 500 documents."""
    path = _folder(t)
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    title = F.struct(F.lit("title").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.substring("text", 1, 40).alias("content"))).alias("title_content")).alias("content"))
    kind = F.col("doc_id") % 7
    rows = docs.select(F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("folder"), F.col("text").alias("md"), F.to_json(F.array(F.array(title))).alias("content_list"), F.when(kind != 5, "{}").alias("middle"), F.when(~kind.isin(3, 5), "{}").alias("model"))
    write_parsed(rows, path, archived=500)
    read = read_all_parsed(t.documents.sparkSession, path, folders=500)
    first = F.get(F.get(F.get("pages", F.lit(0)), F.lit(0))["content"]["title_content"], F.lit(0))["content"]
    whole = F.size("missing") == 0
    return read.select("folder", F.sha2("md", 256).alias("md_hash"), F.array_join("missing", ",").alias("missing"), F.when(whole, F.size("pages")).alias("n_pages"), F.when(whole, first).alias("title"))


@query("""SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 'broken' WHEN 4 THEN 'failed' ELSE 'ok' END AS state, CASE WHEN doc_id % 10 <> 3 THEN lang END AS lang FROM documents""")
def json_lines(t: Tables) -> DataFrame:
    """SRC-03: JSON lines read as rows that went well, rows that failed, and broken lines."""
    path = _folder(t)
    line = F.to_json(F.struct("doc_id", "lang", F.when(F.col("doc_id") % 10 == 4, "error").otherwise("ok").alias("status")))
    t.documents.select(F.when(F.col("doc_id") % 10 == 3, F.regexp_replace(line, ",.*", ", \"status")).otherwise(line).alias("value")).write.text(path)
    ok, failed, bad = read_jsonl(t.documents.sparkSession, path, "doc_id long, lang string, status string")
    number = F.regexp_extract("line", "([0-9]+)", 1).cast("long")
    out = ok.select("doc_id", F.lit("ok").alias("state"), "lang").unionByName(failed.select("doc_id", F.lit("failed").alias("state"), "lang"))
    return out.unionByName(bad.select(number.alias("doc_id"), F.lit("broken").alias("state"), F.lit(None).cast("string").alias("lang")))


@query("SELECT 'book' || doc_id % 5 AS book_dir, doc_id, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def manifests(t: Tables) -> DataFrame:
    """SNK-05: a manifest for each book, read back from all of them."""
    path = _folder(t)
    write_manifest(t.documents.select(F.concat(F.lit("book"), (F.col("doc_id") % 5).cast("string")).alias("book_dir"), "doc_id", "n_chars"), path)
    return t.documents.sparkSession.read.schema("doc_id long, n_chars long, book_dir string").json(path).select("book_dir", "doc_id", "n_chars")


@query("""WITH u AS (SELECT o_custkey AS k, max(o_totalprice) AS bal FROM orders WHERE o_custkey % 50 = 1 GROUP BY 1)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(bal, c_acctbal) AS c_acctbal, CASE WHEN c_custkey IS NULL THEN 'now' ELSE 'then' END AS created_at, CASE WHEN k IS NOT NULL AND bal IS DISTINCT FROM c_acctbal THEN 'now' ELSE 'then' END AS updated_at FROM customer FULL JOIN u ON c_custkey = k""")
def upserted_store(t: Tables) -> DataFrame:
    """SNK-01: a stored table of customers that takes the updates of a few: the buckets of these are read and written, no others."""
    path = _folder(t)
    up.upsert_table(path, t.customer.select("c_custkey", "c_acctbal"), ["c_custkey"], F.lit("then"), buckets=16)
    updates = t.orders.where("o_custkey % 50 = 1").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    up.upsert_table(path, updates, ["c_custkey"], F.lit("now"), [F.col("c_acctbal")])
    return buckets.read_table(t.documents.sparkSession, path).select("c_custkey", "c_acctbal", "created_at", "updated_at")


@query(f"""{_FUSED}, chunks AS (SELECT query_id, source AS source_chunk_id, round(sum(score), 9) AS score FROM fused JOIN documents ON doc_id = id GROUP BY ALL)
SELECT query_id, source_chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_chunk_id) AS INTEGER) AS rank FROM chunks QUALIFY rank <= 3""")
def top_chunks(t: Tables) -> DataFrame:
    """RNK-05, AGG-02: the three best chunks of each item by the summed scores of their vectors."""
    records = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("source_chunk_id"), F.lit("original").alias("vector_type"))
    chunks = rt.aggregate_vectors(_fused(t), records).withColumn("score", F.round("score", 9))
    return rt.top_candidates(chunks, 3).select("query_id", "source_chunk_id", F.round("score", 6).alias("score"), "rank")
