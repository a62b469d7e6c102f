"""One small test for each finding of the third round that was right."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import blocks as bl
from corpusloom.operators import evaluation as ev
from corpusloom.operators import profiles as pf
from corpusloom.operators import sections as sc
from corpusloom.streaming import rates as sr


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f1_titles_and_entries_are_never_broadcast(spark):
    titles = spark.sql("SELECT int(id) AS source_id, int(id) AS pos, concat('a title', repeat('.', int(id))) AS text, concat('atitle', repeat('.', int(id))) AS key, if(id > 0, 'x', null) AS match FROM range(1)")
    toc = spark.sql("SELECT int(id) AS source_id, concat('btitle', repeat('.', int(id))) AS key, concat('b title', repeat('.', int(id))) AS text, int(id) AS level FROM range(1)")
    out = sc.fuzzy_titles(titles, toc, ".", 0.8)
    assert "Broadcast" not in plan(out) and [r.match.toc_title for r in out.collect()] == ["b title"]


def test_f2_second_bodies_are_never_broadcast(spark):
    rows = lambda n, content: spark.range(n).selectExpr("'s' AS source_id", "int(id) AS page_idx", "'table' AS chunk_kind", "0 AS kind_ordinal", f"{content} AS content")
    media, second = rows(3, "array(' ', 'own', null)[int(id)]"), rows(2, "array('body', 'other')[int(id)]")
    out = bl.recover_content(media, second)
    assert "Broadcast" not in plan(out)
    assert {r.page_idx: (r.content, r.content_source) for r in out.collect()} == {0: ("body", "second"), 1: ("own", "first"), 2: (None, "none")}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("days", [1, 2])
def test_f3_changes_are_counted_without_pairs(spark, kind, days):
    rng = random.Random(days)
    begin = dt.datetime(1969, 12, 30)
    times = [begin + dt.timedelta(seconds=rng.randrange(6 * 86400)) for _ in range(150)]
    times += [t + dt.timedelta(days=2) for t in times[:20]] + [t + dt.timedelta(days=1) for t in times[:20]] + times[:20] + [t + dt.timedelta(days=2, microseconds=1) for t in times[:20]] + [None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, at timestamp_ntz").withColumn("at", F.col("at").cast(kind))
    f = rows.where("id % 2 = 0 or at is null").select(F.col("id").alias("feedback_id"), F.col("at").alias("created_at"))
    c = rows.where("id % 3 > 0 or at is null").select(F.col("id").alias("change_id"), F.col("at").alias("created_at"))
    out = pf.count_changes(f, c, days)
    want = pf.changes_near(f, c, days).groupBy("feedback_id").agg(F.count("*").alias("n"), F.min("change_id").alias("first"))
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 50


def test_f4_constant_scores_give_no_error_and_null(spark):
    rows = [("same", i, 2) for i in (1, 2, 3)] + [("down", i, 4 - i) for i in (1, 2, 3)] + [("one", 1, 1)]
    rho = {r.c: r.rho for r in ev.spearman(spark.createDataFrame(rows, "c string, rank int, score int"), ["c"]).collect()}
    assert rho["same"] is None and rho["one"] is None and rho["down"] == pytest.approx(1)


def test_f5_quantiles_are_exact(spark):
    n = 60_000
    events = spark.range(n).select(F.lit(dt.datetime(2024, 1, 1)).alias("ts"), (F.lit("a")).alias("k"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("value"))
    events = events.unionByName(spark.createDataFrame([(dt.datetime(2024, 1, 1), "a", None), (dt.datetime(2024, 1, 1), "b", None)], "ts timestamp, k string, value double"))
    got = {r.k: (r.n, r.p50, r.p95) for r in sr.latency_quantiles(events, "value", ["k"], "1 day", "1 day").collect()}
    assert got == {"a": (n + 1, math.ceil(0.5 * n) - 1, math.ceil(0.95 * n) - 1), "b": (1, None, None)}


def _brute_merged(rows, least):
    """Groups as the rule says it: list of (pos, level, len) to {pos: group}."""
    groups, waiting = [], []

    def close(joins):
        if joins and groups and groups[-1][0][1] <= min(x[1] for x in waiting):
            groups[-1].extend(waiting)
        else:
            groups.append(list(waiting))
        waiting.clear()

    for x in sorted(rows):
        if waiting and x[1] > min(y[1] for y in waiting):
            close(True)
        waiting.append(x)
        if sum(y[2] for y in waiting) >= least:
            close(False)
    if waiting:
        close(True)
    return {x[0]: g[0][0] for g in groups for x in g}


def test_f6_f11_tiny_parents_without_a_call_for_each_source(spark):
    rng = random.Random(1)
    rows = [(s, p, rng.randint(1, 3), rng.choice([1, 5, 30, 120])) for s in [None, *range(60)] for p in rng.sample(range(100), rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "source_id int, pos long, level int, len long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = sc.merge_tiny(df, 100)
        got = {(r.source_id, r.pos): r.group for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(s, p): g for s in {r[0] for r in rows} for p, g in _brute_merged([r[1:] for r in rows if r[0] == s], 100).items()}
    assert got == want and "InPandas" not in plan(out)


def test_f10_f12_sources_are_gone_through_in_turn(spark):
    flat = spark.createDataFrame([(s, i, i // 5, f"{'xyz'[i % 3]} line") for s in range(30) for i in range(40)], "source_id int, pos long, page long, text string")
    heads = spark.createDataFrame([(s, i, (s * i) % 8, "xyz"[(s + i) % 3] if i % 4 else "") for s in range(31) for i in range(9)], "source_id int, parent_idx long, page long, head string")
    out = sc.locate_parents(heads, flat)
    got = {(r.source_id, r.parent_idx): (r.start, r.end) for r in out.collect()}
    want = {}
    for s in range(31):
        at, found = 0, []
        for i in range(9):
            page, head = (s * i) % 8, "xyz"[(s + i) % 3] if i % 4 else ""
            hit = next((j for j in range(at, 40) if s < 30 and (j // 5 == page and "xyz"[j % 3] == head if head else j // 5 >= page)), None)
            found.append(hit)
            at = at if hit is None else hit + 1
        want |= {(s, i): (found[i], next((x for x in found[i + 1 :] if x is not None), None)) for i in range(9)}
    assert got == want and "InPandas" not in plan(out)
    sections = flat.select("source_id", "pos", F.lit(1).alias("level"), F.col("text").alias("title"), F.concat("text", F.col("pos").cast("string")).alias("path"))
    own = sections.where("pos % 4 = 0").select("source_id", "pos", "level", "title")
    out = sc.align_sections(own, sections)
    assert out.count() == 300 and "InPandas" not in plan(out) and {r.section_path for r in out.where("pos = 4").collect()} == {"y line1"}


def test_f14_a_batch_of_many_islands_is_one_frame(spark):
    begin = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [(f"user:{u}", i, begin + dt.timedelta(seconds=rng.randrange(3000))) for u in range(20) for i in range(u * 100, u * 100 + 25)]
    out = sr.throttle(spark.createDataFrame(rows, "key string, event_id long, ts timestamp"), 2, 60.0)
    got = {r.event_id: r.accepted for r in out.collect()}
    want, held = {}, {}
    for key, i, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        near = [t for t in held.get(key, []) if t >= ts - dt.timedelta(seconds=60)]
        want[i] = len(near) < 2
        held[key] = [*near, ts] if want[i] else near
    assert got == want
    assert all("groupby" not in c.co_names for c in sr.throttle.__code__.co_consts if hasattr(c, "co_names"))  # a frame for each island took milliseconds
