"""Rates, quantiles, alerts and admission over event streams; every job has a batch twin with the same result."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.buckets import change, read_table
from ..operators.upsert import latest
from .stateful import admit, admitted, seconds


def throttle_key(user: Column, address: Column) -> Column:
    """The user if there is one, else the address."""
    return F.coalesce(F.concat(F.lit("user:"), F.when(F.trim(user) != "", user)), F.concat(F.lit("ip:"), address))


def parse_log_stream(lines: DataFrame, ingest: Column | None = None) -> DataFrame:
    """Container log lines (value) as ts, level, event, container and message; broken times take the time of ingest."""
    outer = F.from_json("value", "log string, stream string, time string")
    inner = F.from_json(F.col("outer.log"), "timestamp string, level string, event string, message string")
    rows = lines.withColumn("outer", outer).withColumn("inner", inner)
    now = ingest if ingest is not None else F.current_timestamp()
    ts = F.coalesce(F.try_to_timestamp("inner.timestamp"), F.try_to_timestamp("outer.time"), now)
    container = F.nullif(F.regexp_extract("value", r"containers/([0-9a-f]{12,64})", 1), F.lit(""))
    return rows.select(ts.alias("ts"), F.lower(F.coalesce("inner.level", F.lit("unknown"))).alias("level"), F.col("inner.event").alias("event"), F.col("outer.stream").alias("stream"), container.alias("container"), F.coalesce("inner.message", "outer.log").alias("message"))


def event_time(logs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream with its watermark: events later than this are dropped from windows."""
    return logs.withWatermark("ts", late)


def sliding(events: DataFrame, width: str, step: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates over sliding windows of event time, for streams and tables alike."""
    out = events.groupBy(F.window("ts", width, step).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *[c for c in out.columns if c not in ("_w", *keys)])


def request_rate(events: DataFrame, keys: list[str], width: str = "1 minute", step: str = "1 minute", seconds: int = 60) -> DataFrame:
    return sliding(events, width, step, keys, [F.count("*").alias("n"), (F.count("*") / F.lit(float(seconds))).alias("per_second")])


def error_ratio(events: DataFrame, failed: Column, keys: list[str], width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    return sliding(events, width, step, keys, [F.count("*").alias("n"), (F.count_if(failed) / F.count("*")).alias("error_ratio")])


def latency_quantiles(events: DataFrame, value: str, keys: list[str], width: str = "5 minutes", step: str = "5 minutes") -> DataFrame:
    """Exact p50 and p95 (values that occur; nulls don't count), and n of all events. Tables count equal values and sort the counts, streams hold them."""
    kind, asked = events.schema[value].dataType, {"p50": 0.5, "p95": 0.95}
    if events.isStreaming:
        return sliding(events, width, step, keys, [F.count("*").alias("n"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)").cast(kind).alias(p) for p, q in asked.items()]])
    each = events.groupBy(F.window("ts", width, step).alias("_w"), *keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    group = W.partitionBy("_w", *keys)
    known = F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))).over(group)
    rows = each.withColumn("_known", known).withColumn("_upto", F.sum("_c").over(group.orderBy(F.asc_nulls_last("_v")).rowsBetween(W.unboundedPreceding, W.currentRow)))
    first = lambda q: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_known") * F.lit(q)), F.col("_v")))
    out = rows.groupBy("_w", *keys).agg(F.sum("_c").alias("n"), *[first(q).alias(p) for p, q in asked.items()])
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "n", *asked)


def bucket_quantile(buckets: DataFrame, q: float, keys: list[str]) -> DataFrame:
    """Quantile of cumulative counts by upper bound `le` (infinity last), linear within a bucket; of the last, its lower bound."""
    rows = buckets.groupBy(*keys, "le").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*keys).orderBy("le")
    total = F.max("n").over(W.partitionBy(*keys))
    rows = rows.withColumn("_goal", total * q).withColumn("_low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("_before", F.coalesce(F.lag("n").over(order), F.lit(0)))
    hit = rows.where("n >= _goal").groupBy(*keys).agg(F.min(F.struct("le", "n", "_low", "_before", "_goal")).alias("b"))
    inside = F.col("b._low") + (F.col("b.le") - F.col("b._low")) * F.coalesce(F.try_divide(F.col("b._goal") - F.col("b._before"), F.col("b.n") - F.col("b._before")), F.lit(0.0))
    return hit.select(*keys, F.when(F.col("b.le") == F.lit(float("inf")), F.col("b._low")).otherwise(inside).alias("value"))


def counter_rate(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Increase of counters between samples (keys, ts, value); after a reset the new value is the increase.

    Its twin on streams is stateful.counter_stream.
    """
    before = F.lag("value").over(W.partitionBy(*keys).orderBy("ts"))
    at = F.col("ts").cast("timestamp").cast("double")
    seconds = at - F.lag(at).over(W.partitionBy(*keys).orderBy("ts"))
    rows = samples.withColumn("_b", before).withColumn("_s", seconds).where("_b is not null")
    rows = rows.withColumn("increase", F.when(F.col("value") < F.col("_b"), F.col("value")).otherwise(F.col("value") - F.col("_b")))
    return rows.withColumn("per_second", F.try_divide(F.col("increase"), F.col("_s"))).drop("_b", "_s")


def alerts(measures: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Measures (name, window_start, value) over their limits."""
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return measures.withColumn("limit", F.try_element_at(table, F.col("name"))).where(F.col("value") > F.col("limit"))


def failed_in_a_row(probes: DataFrame, keys: list[str], times: int = 3) -> DataFrame:
    """Runs of at least so many failed probes (keys, ts, ok): islands between successes."""
    order = W.partitionBy(*keys).orderBy("ts")
    rows = probes.withColumn("_island", F.sum(F.col("ok").cast("int")).over(order)).where(~F.col("ok"))
    return rows.groupBy(*keys, "_island").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count("*").alias("failures")).where(F.col("failures") >= times).drop("_island")


def output_health(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, retries, failures and fallbacks of structured outputs, and the share that passed at once."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    out = calls.groupBy(*keys).agg(n("attempt"), n("retry"), n("failure"), n("fallback"))
    return out.withColumn("first_pass", 1 - F.try_divide(F.col("retry"), F.col("attempt")))


def loop_counts(rounds: DataFrame, most: dict[str, int]) -> DataFrame:
    """Loops of each kind in a session, and whether they reached their cap."""
    table = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    out = rounds.groupBy("session_id", "kind").agg(F.count("*").alias("loops"))
    return out.withColumn("capped", F.col("loops") >= F.try_element_at(table, F.col("kind")))


_ADMITTED = "key string, event_id long, ts timestamp, accepted boolean, retry_after int"


def throttle(events: DataFrame, limit: int, window_s: float) -> DataFrame:
    """Admission of a table of events (key, event_id, ts): at most `limit` accepted in any trailing window.

    Where a key was idle for longer than the window nothing counts any more, so that what comes after is an island of its
    own. Islands are dealt over tasks and read in the order of their events; of each only the accepted ones of a window
    are in memory. Its twin on streams is stateful.throttle_stream.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque = deque()
        now = None
        for frame in frames:
            times, done = seconds(frame["ts"]), []
            keys, islands = frame["key"].to_numpy(), frame["island"].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (islands[1:] != islands[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(frame)] if len(frame) else []):
                held, now = (held if (keys[a], islands[a]) == now else deque()), (keys[a], islands[a])
                done += admit(times[a:b], limit, window_s, held)
            yield admitted(frame, done)

    order = W.partitionBy("key").orderBy("ts", "event_id")
    at = F.unix_micros("ts")
    rows = events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("idle", at - F.lag(at).over(order) > window_s * 1_000_000)
    rows = rows.withColumn("island", F.count_if("idle").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.select("key", "island", "event_id", "ts").repartition("key", "island").sortWithinPartitions("key", "island", "ts", "event_id").mapInPandas(run, _ADMITTED)


def fold_dialogue(turns: DataFrame) -> DataFrame:
    """First status of each term in a session, and the round in which it came up.

    turns: session_id, round, position, term, status. A term that has a status keeps it; later mentions add nothing.
    """
    first = F.min(F.struct("round", "position", "status"))
    return turns.groupBy("session_id", "term").agg(first.alias("_f")).select("session_id", "term", F.col("_f.status").alias("status"), F.col("_f.round").alias("since_round"))


def ingest_stream(stream: DataFrame, table: str, key: str, checkpoint: str, encode=None):
    """Starts a stream that keeps a table of the latest row for each key: keyed, hence safe to replay.

    Each micro-batch is published as in `publish`. A failed row (encode may set status) stays pending and doesn't stop
    the others. One stream writes a table; a stream with a new checkpoint goes on where the table is.
    """

    def batch(df: DataFrame, number: int) -> None:
        publish(encode(df) if encode is not None else df, table, key)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def publish(rows: DataFrame, table: str, key: str) -> None:
    """Puts rows (key, ts, ...) into an ingested table: the latest of each key, new ones before old ones."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        every = new.withColumn("_new", F.lit(1))
        if old is not None:
            every = old.withColumn("_new", F.lit(0)).unionByName(every, allowMissingColumns=True)
        return latest(every, [key], [F.col("_new"), F.col("ts")]).drop("_new")

    change(table, rows, [key], merge)


def read_ingested(spark, table: str) -> DataFrame | None:
    """The published rows of an ingested table; None before its first batch."""
    return read_table(spark, table)
