"""Keyed upserts and incremental plans: pure DataFrame to DataFrame, so that running twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .buckets import BUCKETS, change


def latest(updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order]))
    return updates.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _only(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates with one row for each key; a job that meets a second one fails."""
    n = F.count("*").over(W.partitionBy(*keys))
    return updates.withColumn("_n", n).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("several updates for one key need an order")).cast("boolean"))).drop("_n")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], now: Column, order: list[Column] | None = None) -> DataFrame:
    """target with the updates' rows in place of its own: created_at stays, updated_at becomes `now`.

    Of several updates for a key the last by `order` counts; without an order, several are an error. Rows whose content is the same as before are left alone.
    """
    fresh = latest(updates, keys, order) if order else _only(updates, keys)
    content = [c for c in target.columns if c not in keys and c not in ("created_at", "updated_at")]
    old = target.select(*keys, F.struct(*target.columns).alias("_old"))
    new = fresh.select(*keys, F.struct(*[c for c in content if c in fresh.columns]).alias("_new"))
    both = old.join(new, keys, "full_outer")
    value = lambda c: F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")) if c in fresh.columns else F.col(f"_old.{c}")
    changed = F.lit(False)
    for c in content:
        if c in fresh.columns:
            changed = changed | ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    touched = F.col("_new").isNotNull() & (F.col("_old").isNull() | changed)
    made = F.coalesce(F.col("_old.created_at"), now)
    out = {c: value(c) for c in content} | {"created_at": made, "updated_at": F.when(touched, now).otherwise(F.col("_old.updated_at"))}
    return both.select(*[F.col(c) if c in keys else out[c].alias(c) for c in target.columns])


def upsert_table(table: str, updates: DataFrame, keys: list[str], now: Column, order: list[Column] | None = None, buckets: int = BUCKETS) -> None:
    """upsert into a table that is kept in buckets of its keys (buckets.read_table): only those with updates are read and written.

    The first updates make the table, with their columns besides created_at and updated_at.
    """

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            old = new.limit(0).drop("created_at", "updated_at").select("*", now.alias("created_at"), now.alias("updated_at"))
        return upsert(old, new, keys, now, order)

    change(table, updates, keys, merge, buckets)


def orphans(chunks: DataFrame) -> DataFrame:
    """Chunks whose parent isn't there."""
    parents = chunks.select(F.col("chunk_id").alias("parent_chunk_id"))
    return chunks.where("parent_chunk_id is not null").join(parents, "parent_chunk_id", "left_anti")


def upsert_chunks(target: DataFrame, chunks: DataFrame, now: Column, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """target with the chunks in, by chunk_id, and those that now lack their parent."""
    out = upsert(target, chunks, ["chunk_id"], now, order)
    return out, orphans(out)


def upsert_vectors(target: DataFrame, records: DataFrame, now: Column, dim: int, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """target with the vector records in, by id, and the records whose vector isn't of `dim` numbers, which stay out."""
    good = F.coalesce(F.size("vector") == dim, F.lit(False))
    return upsert(target, records.where(good), ["id"], now, order), records.where(~good)


def apply_columns(chunks: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of successful rows only."""
    good = found.where("status = 'ok'").select(key, F.struct(*columns).alias("_new"))
    both = chunks.join(good, key, "left")
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in chunks.columns])


def purge_for_rerun(done: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """done without the ok and failed rows of the keys that are run again; traces of merged and orphaned rows stay."""
    redo = done.where(F.col("status").isin("ok", "failed")).join(keys.select(*on).distinct(), on, "left_semi")
    rest = done.where(~F.col("status").isin("ok", "failed") | F.col("status").isNull())
    keep = done.where(F.col("status").isin("ok", "failed")).join(redo.select(*on).distinct(), on, "left_anti")
    return rest.unionByName(keep)


def todo(inputs: DataFrame, done: DataFrame, on: list[str], retry_failed: bool = False) -> DataFrame:
    """Inputs that aren't processed yet; failures again if asked for."""
    processed = done.where("status <> 'failed'") if retry_failed else done
    return inputs.join(processed.select(*on).distinct(), on, "left_anti")


def plan_incremental(old: DataFrame, new: DataFrame) -> DataFrame:
    """chunk_id, action (new, changed, unchanged, deleted) and embed (never for parents)."""
    o = old.select("chunk_id", F.col("content_hash").alias("_old"), F.col("chunk_type").alias("_old_type"))
    n = new.select("chunk_id", F.col("content_hash").alias("_new"), F.col("chunk_type").alias("_new_type"))
    both = o.join(n, "chunk_id", "full_outer")
    action = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    kind = F.coalesce("_new_type", "_old_type")
    return both.select("chunk_id", kind.alias("chunk_type"), action.alias("action"), (action.isin("new", "changed") & (kind != "parent")).alias("embed"))


def stale_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of the sources in `new` that are no longer there; children come before their parents."""
    gone = old.join(new.select("source_id").distinct(), "source_id", "left_semi").join(new.select("chunk_id"), "chunk_id", "left_anti")
    return gone.withColumn("delete_order", F.when(F.col("parent_chunk_id").isNull(), 1).otherwise(0))


def reuse_vectors(plan: DataFrame, new: DataFrame, old: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of chunks whose content another id had before."""
    fresh = plan.where("action = 'new' and embed").join(new.select("chunk_id", "content_hash"), "chunk_id")
    before = old.groupBy("content_hash").agg(F.min("chunk_id").alias("from_chunk_id"))
    return fresh.join(before, "content_hash").join(vectors.withColumnRenamed("source_chunk_id", "from_chunk_id"), "from_chunk_id").select("chunk_id", "from_chunk_id", *[c for c in vectors.columns if c != "source_chunk_id"])


def compensation_plan(chunks: DataFrame, expected: DataFrame, vectors: DataFrame, now: Column, grace: str = "INTERVAL 5 MINUTES") -> DataFrame:
    """What to do with chunks left pending or failed for longer than the grace time.

    expected has (source_chunk_id, id) for all vectors that a chunk should have. mark_done if all are present, else embed.
    """
    waiting = chunks.where(F.col("embedding_status").isin("pending", "failed") & (F.col("updated_at") < now - F.expr(grace))).select("chunk_id")
    due = expected.withColumnRenamed("source_chunk_id", "chunk_id").join(waiting, "chunk_id", "left_semi")
    missing = due.join(vectors.select("id"), "id", "left_anti").groupBy("chunk_id").agg(F.count("*").alias("missing"))
    return waiting.join(missing, "chunk_id", "left").select("chunk_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.when(F.coalesce("missing", F.lit(0)) == 0, "mark_done").otherwise("embed").alias("action"))


def pending_chunks(chunks: DataFrame, source: str | None, n: int) -> DataFrame:
    """The next n chunks to embed, in a fixed order."""
    rows = chunks.where("embedding_status = 'pending'")
    return (rows if source is None else rows.where(F.col("source_id") == source)).orderBy("source_id", "chunk_id").limit(n)


def apply_retention(rows: DataFrame, now: Column, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows to archive."""
    edge = now - F.make_dt_interval(F.lit(days))
    return rows.where(F.col("created_at") >= edge), rows.where(F.col("created_at") < edge)
