"""Nested profiles and the analysis of audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nested(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """parent with one sorted array of structs for each child table; a parent without rows gets an empty array.

    children: name of the array to (table with the key, columns). Each child is grouped before it is joined.
    """
    out = parent
    for name, (table, columns) in children.items():
        rows = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(rows, key, "left")
        kind = rows.schema[name].dataType
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def current(rows: DataFrame, ended: str = "ended_at") -> DataFrame:
    return rows.where(F.col(ended).isNull())


def usable_reports(reports: DataFrame) -> DataFrame:
    return reports.where(F.trim("file_path") != "")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in order; at most 200."""
    return rows.orderBy(*order).offset(offset).limit(min(limit, 200))


def feedback_with_trace(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    return feedback.join(traces.select("trace_id", "session_id", "raw_query", F.col("created_at").alias("traced_at")), "trace_id", "left")


def config_as_of(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Events (config_key, ts, event_id) with the value in force at their time: null before the first change and after a delete."""
    e = events.select("config_key", "ts", "event_id", F.lit(None).cast("string").alias("value"), F.lit(False).alias("_set"), F.lit(1).alias("_kind"))
    c = changes.select("config_key", F.col("created_at").alias("ts"), F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.col("new_value").alias("value"), F.lit(True).alias("_set"), F.lit(0).alias("_kind"))
    order = W.partitionBy("config_key").orderBy("ts", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = F.last(F.when(F.col("_set"), F.struct("value")), ignorenulls=True).over(order)
    return e.unionByName(c).withColumn("in_force", held["value"]).where("_kind = 1").select("config_key", "event_id", "ts", "in_force")


def changes_near(feedback: DataFrame, changes: DataFrame, days: int) -> DataFrame:
    """Feedback with the changes of the `days` days before it: joined by day, then compared to the second."""
    f = feedback.withColumn("_day", F.explode(F.sequence(F.date_sub(F.to_date("created_at"), days), F.to_date("created_at"))))
    c = changes.select(F.to_date("created_at").alias("_day"), F.col("change_id"), F.col("created_at").alias("changed_at"))
    near = (F.col("changed_at") <= F.col("created_at")) & (F.col("changed_at") >= F.col("created_at") - F.make_dt_interval(F.lit(days)))
    return f.join(c, "_day").where(near).drop("_day")


def _hours(rows: DataFrame) -> DataFrame:
    """rows with the hour of created_at since 1970 and its microseconds in the hour; those without time go."""
    at = F.col("created_at")
    if rows.schema["created_at"].dataType.typeName() == "timestamp":
        hour, micros = F.floor(F.unix_micros(at) / 3_600_000_000), F.pmod(F.unix_micros(at), F.lit(3_600_000_000))
    else:
        hour, micros = F.date_diff(F.to_date(at), F.lit("1970-01-01").cast("date")) * 24 + F.hour(at), (F.minute(at) * 60 + F.date_part(F.lit("SECOND"), at)) * 1_000_000
    return rows.where(at.isNotNull()).withColumn("_hour", hour.cast("long")).withColumn("_at", micros.cast("long"))


def count_changes(feedback: DataFrame, changes: DataFrame, days: int) -> DataFrame:
    """feedback_id, n_changes and first_change (the smallest id) of the feedback that changes_near gives pairs of, without the pairs.

    Of the `days` (1 at least) days, the hours between are taken whole, from totals of the hours; the first and the last
    hour by running counts.
    """
    f = _hours(feedback.select("feedback_id", "created_at"))
    c = _hours(changes.select("change_id", F.col("created_at").cast(feedback.schema["created_at"].dataType).alias("created_at")))
    none = F.lit(None).cast(changes.schema["change_id"].dataType)
    # an hour is run through from its begin for the feedback in it, and from its end for that of `days` days later
    ends = F.explode(F.array(F.lit(1), F.lit(-1))).alias("_turn")
    marks = c.select("_hour", "_at", ends, F.lit(1).alias("_n"), "change_id", F.lit(None).cast(feedback.schema["feedback_id"].dataType).alias("feedback_id"), F.lit(False).alias("_asks"))
    asks = f.select("_hour", "_at", ends, F.lit(0).alias("_n"), none.alias("change_id"), "feedback_id", F.lit(True).alias("_asks")).withColumn("_hour", F.when(F.col("_turn") == 1, F.col("_hour")).otherwise(F.col("_hour") - 24 * days))
    run = W.partitionBy("_hour", "_turn").orderBy(F.col("_at") * F.col("_turn")).rangeBetween(W.unboundedPreceding, W.currentRow)
    edges = marks.unionByName(asks).select("feedback_id", "_asks", F.sum("_n").over(run).alias("n"), F.min("change_id").over(run).alias("first")).where("_asks").drop("_asks")
    hours = c.groupBy("_hour").agg(F.count("*").alias("n"), F.min("change_id").alias("first"))
    later = F.explode(F.sequence(F.col("_hour") + 1, F.col("_hour") + 24 * days - 1)).alias("_hour")
    whole = hours.select(later, "n", "first").groupBy("_hour").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    both = edges.unionByName(f.join(whole, "_hour").select("feedback_id", "n", "first"))
    return both.groupBy("feedback_id").agg(F.sum("n").alias("n_changes"), F.min("first").alias("first_change")).where("n_changes > 0")


def config_changes(log: DataFrame) -> DataFrame:
    """Old and new value of every step of a key's log (config_key, ts, value); a null value is a delete."""
    return log.withColumn("old_value", F.lag("value").over(W.partitionBy("config_key").orderBy("ts"))).withColumnRenamed("value", "new_value")


def stage_latency(traces: DataFrame) -> DataFrame:
    """p50, p95 of each stage of a JSON map of milliseconds, and how often it was the slowest of its trace."""
    each = traces.select("trace_id", F.explode(F.from_json("latency_ms", "map<string,double>")).alias("stage", "ms"))
    slow = F.max(F.struct("ms", "stage")).over(W.partitionBy("trace_id"))["stage"]
    rows = each.withColumn("_slow", slow)
    return rows.groupBy("stage").agg(F.percentile("ms", F.lit(0.5)).alias("p50"), F.percentile("ms", F.lit(0.95)).alias("p95"), F.count_if(F.col("_slow") == F.col("stage")).alias("slowest"), F.count("*").alias("n"))


def rating_summary(feedback: DataFrame) -> DataFrame:
    n = F.count("*")
    return feedback.groupBy("rating").agg(n.alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def score_shift(traces: DataFrame) -> DataFrame:
    """Scores of what was retrieved and of what was left after reranking, for each trace."""
    stats = lambda c, m: [F.size(c).alias(f"{m}_n"), F.array_max(F.transform(c, lambda x: x["score"])).alias(f"{m}_max"), (F.aggregate(c, F.lit(0.0), lambda s, x: s + x["score"]) / F.nullif(F.size(c), F.lit(0))).alias(f"{m}_mean")]
    return traces.select("trace_id", *stats("retrieved_chunks", "retrieved"), *stats("reranked_chunks", "reranked"))


def token_usage(traces: DataFrame, keys: list[str]) -> DataFrame:
    total = lambda k: F.sum(F.coalesce(F.try_element_at("token_usage", F.lit(k)), F.lit(0)))
    return traces.groupBy(*keys).agg(total("prompt").alias("prompt"), total("completion").alias("completion"), F.count("*").alias("calls"))


def stage_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def group_sizes(rows: DataFrame, key: str) -> DataFrame:
    """How many groups have how many members."""
    return rows.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def load_report(results: DataFrame) -> DataFrame:
    """Totals of a load by status: one source that fails is a row, not an error."""
    return results.groupBy("status").agg(F.count("*").alias("sources"), F.sum(F.coalesce("rows", F.lit(0))).alias("rows"))


def trace_rows(states: DataFrame) -> DataFrame:
    """Audit rows of final states: what was asked, found, kept and answered, tokens, latencies with their total, and the error.

    states: session_id, user_id, patient_input, chief_complaint, confirmed, denied, candidates and reranked (arrays of
    structs with source_chunk_id), final_response, failure, results, token_usage and latency_ms (maps), total_ms.
    """
    from ..functions.text import error_info

    none = F.array().cast("array<string>")
    intent = F.struct("chief_complaint", F.coalesce("confirmed", none).alias("confirmed_symptoms"), F.coalesce("denied", none).alias("denied_symptoms"))
    usage = F.coalesce("token_usage", F.create_map(*[F.lit(x) for k in ("prompt_tokens", "completion_tokens", "total_tokens") for x in (k, 0)]).cast("map<string,bigint>"))
    latency = F.map_concat(F.map_filter(F.coalesce("latency_ms", F.create_map().cast("map<string,double>")), lambda k, v: k != "total"), F.create_map(F.lit("total"), F.col("total_ms").cast("double")))
    ids = F.array_compact(F.transform("reranked", lambda c: F.nullif(c["source_chunk_id"], F.lit(""))))
    return states.select("session_id", "user_id", F.coalesce("patient_input", F.lit("")).alias("raw_query"), intent.alias("intent_result"), F.col("candidates").alias("retrieved_chunks"), F.col("reranked").alias("reranked_chunks"), F.coalesce("final_response", F.lit("")).alias("final_response"), usage.alias("token_usage"), latency.alias("latency_ms"), error_info(F.col("failure"), F.col("results")).alias("error_info"), F.coalesce(ids, none).alias("chunk_ids"))
