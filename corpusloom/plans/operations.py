"""Profiles, audit analysis, rates and admission over customers, orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profiles as pf
from ..streaming import rates as sr
from .registry import Tables, query


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS order_keys
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def customer_profiles(t: Tables) -> DataFrame:
    """JN-22, PRJ-13: customers with their orders as a nested array; none gives an empty one."""
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    out = pf.nested(t.customer.select("c_custkey", "c_name"), "c_custkey", {"orders": (orders, ["o_orderkey", "o_totalprice"])})
    total = F.aggregate("orders", F.lit(0.0), lambda s, x: s + x["o_totalprice"])
    return out.select("c_custkey", "c_name", F.size("orders").cast("long").alias("n_orders"), F.round(total, 2).alias("total"), F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("order_keys"))


@query("""WITH c AS (SELECT user_id, ts, event_id, value, event_type FROM events WHERE event_type IN ('view', 'purchase')),
w AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN CAST(value AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS v FROM c)
SELECT user_id AS config_key, event_id, CAST(v AS DOUBLE) AS in_force FROM w WHERE event_type = 'purchase'""")
def value_as_of(t: Tables) -> DataFrame:
    """JN-24: the last viewed value of a user at each purchase."""
    events = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("config_key"), "ts", "event_id")
    changes = t.events.where("event_type = 'view'").select(F.col("user_id").alias("config_key"), F.col("ts").alias("created_at"), F.col("value").cast("string").alias("new_value"))
    return pf.config_as_of(events, changes).select("config_key", "event_id", F.col("in_force").cast("double").alias("in_force"))


@query("""SELECT f.event_id AS feedback_id, count(*) AS n_changes, min(c.event_id) AS first_change FROM events f JOIN events c ON f.event_type = 'error' AND c.event_type = 'signup' AND c.ts <= f.ts AND c.ts >= f.ts - INTERVAL 2 DAY GROUP BY 1""")
def changes_before(t: Tables) -> DataFrame:
    """JN-25: signups in the two days before each error."""
    f = t.events.where("event_type = 'error'").select(F.col("event_id").alias("feedback_id"), F.col("ts").alias("created_at"))
    c = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("change_id"), F.col("ts").alias("created_at"))
    return pf.count_changes(f, c, 2)


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS ms FROM events) SELECT 'k' AS stage, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, count(*) AS slowest, count(*) AS n FROM e WHERE ms IS NOT NULL""")
def stage_latency(t: Tables) -> DataFrame:
    """AGG-23: quantiles of a JSON map of stages."""
    out = pf.stage_latency(t.events.select(F.col("event_id").alias("trace_id"), F.col("props").alias("latency_ms")))
    return out.select("stage", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "slowest", "n")


@query("SELECT event_type AS rating, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def rating_shares(t: Tables) -> DataFrame:
    """AGG-24."""
    out = pf.rating_summary(t.events.select(F.col("event_type").alias("rating")))
    return out.select("rating", "n", F.round("share", 6).alias("share"))


@query("SELECT size, count(*) AS groups FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) GROUP BY 1")
def group_sizes(t: Tables) -> DataFrame:
    """AGG-06."""
    return pf.group_sizes(t.lineitem, "l_orderkey")


@query("SELECT o_orderstatus AS status, count(*) AS sources, sum(CAST(o_custkey AS BIGINT))::BIGINT AS rows FROM orders GROUP BY 1")
def load_totals(t: Tables) -> DataFrame:
    """SRC-05, AGG-05: totals of a load by status."""
    return pf.load_report(t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("rows")))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 100")
def newest_orders(t: Tables) -> DataFrame:
    """RNK-10: a page of orders, newest first."""
    return pf.page(t.orders, [F.desc("o_orderdate"), F.asc("o_orderkey")], 500, 100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(count(*) / 3600.0, 9) AS per_second FROM events GROUP BY 1, 2")
def request_rate(t: Tables) -> DataFrame:
    """STR-03: events of each type by hour."""
    out = sr.request_rate(t.events, ["event_type"], "1 hour", "1 hour", 3600)
    return out.select("event_type", "window_start", "n", F.round("per_second", 9).alias("per_second"))


@query("""WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * i AS window_start, event_type FROM events CROSS JOIN (SELECT unnest(range(3)) AS i))
SELECT window_start, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_ratio FROM w GROUP BY 1""")
def error_ratio(t: Tables) -> DataFrame:
    """STR-04: share of errors in windows of three hours that slide by one."""
    out = sr.error_ratio(t.events, F.col("event_type") == "error", [], "3 hours", "1 hour")
    return out.select("window_start", "n", F.round("error_ratio", 6).alias("error_ratio"))


@query("SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1, 2")
def latency_quantiles(t: Tables) -> DataFrame:
    """STR-05: quantiles of values by type and day."""
    return sr.latency_quantiles(t.events, "value", ["event_type"], "1 day", "1 day").select("event_type", "window_start", "n", "p50", "p95")


@query("""WITH s AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) SELECT user_id, round(sum(CASE WHEN value < b THEN value ELSE value - b END), 6) AS increase, count(*) AS steps FROM s WHERE b IS NOT NULL GROUP BY 1""")
def counter_increase(t: Tables) -> DataFrame:
    """STR-07: increase of a counter with resets, by user."""
    out = sr.counter_rate(t.events.select("user_id", "ts", "value"), ["user_id"])
    return out.groupBy("user_id").agg(F.round(F.sum("increase"), 6).alias("increase"), F.count("*").alias("steps"))


@query("""WITH i AS (SELECT user_id, ts, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events)
SELECT user_id, min(ts) AS since, max(ts) AS until, count(*) AS failures FROM i WHERE NOT ok GROUP BY user_id, g HAVING count(*) >= 2""")
def failure_runs(t: Tables) -> DataFrame:
    """STR-08: runs of two or more errors of a user."""
    probes = t.events.select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return sr.failed_in_a_row(probes, ["user_id"], 2)


@query("""WITH b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events CROSS JOIN (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, 'infinity'::DOUBLE]) AS le) GROUP BY ALL),
p AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS low, coalesce(lag(n) OVER w, 0) AS bef, 0.9 * max(n) OVER (PARTITION BY event_type) AS goal FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)),
h AS (SELECT event_type, arg_min(struct_pack(le, n, low, bef, goal), le) AS x FROM p WHERE n >= goal GROUP BY 1)
SELECT event_type, round(CASE WHEN isinf(x.le) THEN x.low ELSE x.low + (x.le - x.low) * coalesce((x.goal - x.bef) / nullif(x.n - x.bef, 0), 0) END, 6) AS value FROM h""")
def bucket_quantile(t: Tables) -> DataFrame:
    """STR-06: the 0.9 quantile from cumulative buckets."""
    les = F.explode(F.array(*[F.lit(x) for x in (5.0, 10.0, 25.0, 50.0, 100.0, float("inf"))])).alias("le")
    buckets = t.events.select("event_type", "value", les).groupBy("event_type", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("n"))
    return sr.bucket_quantile(buckets, 0.9, ["event_type"]).select("event_type", F.round("value", 6).alias("value"))


@query("""SELECT CAST(user_id AS VARCHAR) AS k, count(*) FILTER (event_type = 'view') AS attempt, count(*) FILTER (event_type = 'click') AS retry, count(*) FILTER (event_type = 'error') AS failure, count(*) FILTER (event_type = 'signup') AS fallback, round(1 - count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0), 6) AS first_pass FROM events GROUP BY 1""")
def output_health(t: Tables) -> DataFrame:
    """STR-09: attempts, retries, failures and fallbacks (event types stand for them)."""
    kinds = {"view": "attempt", "click": "retry", "error": "failure", "signup": "fallback"}
    outcome = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    out = sr.output_health(t.events.select(F.col("user_id").cast("string").alias("k"), outcome.alias("outcome")), ["k"])
    return out.withColumn("first_pass", F.round("first_pass", 6))


@query("""WITH RECURSIVE e AS (SELECT 'user:' || user_id AS key, event_id, ts, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, event_id, ts, n, true AS accepted, NULL::INTEGER AS retry_after, [t] AS held FROM e WHERE n = 1 UNION ALL
  SELECT key, event_id, ts, n, len(h) < 3, CASE WHEN len(h) >= 3 THEN greatest(1, CAST(floor(h[1] + 86400 - t) AS INTEGER) + 1) END, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END
  FROM (SELECT e.*, list_filter(r.held, lambda x: x >= e.t - 86400) AS h FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
SELECT key, event_id, ts, accepted, retry_after FROM r""")
def throttled(t: Tables) -> DataFrame:
    """STR-01, STR-02: at most three events of a user accepted in any day."""
    out = sr.throttle(t.events.select(sr.throttle_key(F.col("user_id").cast("string"), F.lit("")).alias("key"), "event_id", "ts"), 3, 86_400.0)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT conv_id AS session_id, term, arg_min(role, turn) AS status, min(turn) AS since_round FROM (SELECT conv_id, turn, role, string_split(text, ' ')[1] AS term FROM conversations) GROUP BY 1, 2""")
def dialogue_fold(t: Tables) -> DataFrame:
    """STR-10: who said a conversation's opening words first."""
    turns = t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("round"), F.lit(0).alias("position"), F.get(F.split("text", " "), 0).alias("term"), F.col("role").alias("status"))
    return sr.fold_dialogue(turns)


@query("SELECT conv_id AS session_id, role AS kind, count(*) AS loops, count(*) >= CASE role WHEN 'user' THEN 3 ELSE 2 END AS capped FROM conversations WHERE role <> 'system' GROUP BY 1, 2")
def loop_counts(t: Tables) -> DataFrame:
    """STR-11."""
    return sr.loop_counts(t.conversations.where("role <> 'system'").select(F.col("conv_id").alias("session_id"), F.col("role").alias("kind")), {"user": 3, "assistant": 2})


@query("""SELECT user_id AS config_key, event_id, CAST(lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS DOUBLE) AS old_value, value AS new_value FROM events""")
def change_log(t: Tables) -> DataFrame:
    """STR-14: each value of a user with the one before."""
    return pf.config_changes(t.events.select(F.col("user_id").alias("config_key"), "event_id", "ts", "value")).select("config_key", "event_id", "old_value", "new_value")
