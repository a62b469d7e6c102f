"""Stateful streams give what their batch twins give, however the events are cut into micro-batches."""

import datetime as dt
import random
import uuid

import pytest

from corpusloom.streaming import rates as sr
from corpusloom.streaming import stateful as st

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs an operator over rows, one micro-batch for each list of rows, and returns all it gave."""
    st.use_rocksdb(spark)

    def run(batches, schema, job):
        folder = tmp_path / uuid.uuid4().hex
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        name = f"out_{uuid.uuid4().hex}"
        q = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "check")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        rows_left = q.lastProgress.stateOperators[0].numRowsTotal
        return spark.table(name).collect(), rows_left

    return run


def batches(rng, rows, n, ahead):
    """rows (the time last) in n batches, each shuffled, and a few rows later than their neighbours."""
    late = sorted(rows, key=lambda r: r[-1] + dt.timedelta(seconds=rng.uniform(0, ahead)))
    size = -(-len(late) // n)
    out = [late[i : i + size] for i in range(0, len(late), size)]
    for b in out:
        rng.shuffle(b)
    return out


def test_counters(spark, streamed):
    rng = random.Random(1)
    rows = []
    for key in "ab":
        value, at = 0.0, 0
        for _ in range(60):
            at += rng.randint(1, 50)
            value = rng.uniform(0, 3) if rng.random() < 0.15 else value + rng.randint(0, 9)
            rows.append((key, value, T0 + dt.timedelta(seconds=at)))
    end = [("z", 0.0, T0 + dt.timedelta(days=d)) for d in (1, 2, 3)]
    schema = "k string, value double, ts timestamp"
    got, left = streamed([*batches(rng, rows, 6, 300), *[[e] for e in end]], schema, lambda d: st.counter_stream(d, ["k"], idle_s=3600))
    want = sr.counter_rate(spark.createDataFrame(rows, schema), ["k"]).collect()
    plain = lambda r: (r.k, r.ts, r.value, round(r.increase, 6), round(r.per_second, 6))
    assert sorted(map(plain, got)) == sorted(map(plain, want))
    assert left <= 4  # the states of a and b are gone; z's last sample, what waits and its timer remain


def test_dialogues(spark, streamed):
    rng = random.Random(2)
    rows = []
    for s in ("s1", "s2", "s3"):
        for r in range(12):
            at = T0 + dt.timedelta(seconds=60 * r + rng.randint(0, 30))
            rows += [(s, r, p, rng.choice(["fever", "cough", "rash", "pain", "itch"]), rng.choice(["confirmed", "denied"]), at) for p in range(2)]
    end = [("end", 0, 0, "x", "denied", T0 + dt.timedelta(days=d)) for d in (1, 2)]
    schema = "session_id string, round int, position int, term string, status string, ts timestamp"
    got, _ = streamed([*batches(rng, rows, 5, 240), *[[e] for e in end]], schema, lambda d: st.dialogue_stream(d, gap_s=900))
    want = sr.fold_dialogue(spark.createDataFrame(rows, schema)).collect()
    plain = lambda r: (r.session_id, r.term, r.status, r.since_round)
    assert sorted(plain(r) for r in got if r.session_id != "end") == sorted(map(plain, want))


def test_throttle_of_one_hot_key(spark, streamed):
    rng = random.Random(3)
    at, rows = 0.0, []
    for i in range(30_000):
        at += rng.choice([0.001, 0.2, 0.5, 7.0 if i % 100 == 0 else 0.1])
        rows.append(("hot", i, T0 + dt.timedelta(seconds=round(at, 3))))
    schema = "key string, event_id long, ts timestamp"
    df = spark.createDataFrame(rows, schema)
    plain = lambda r: (r.event_id, r.accepted, r.retry_after)
    held, want = [], []
    for _, i, ts in rows:
        t = (ts - T0).total_seconds()
        held = [x for x in held if x >= t - 5 - 1e-9]
        ok = len(held) < 4
        want.append((i, ok, None if ok else max(1, int(held[0] + 5 - t + 1e-9) + 1)))
        held += [t] if ok else []
    batch = sorted(map(plain, sr.throttle(df.repartition(3), 4, 5.0).collect()))
    assert sum(a != b for a, b in zip(batch, want)) <= 3 and len(batch) == len(want)  # seconds as doubles, rounded at the window's edge
    got, left = streamed([rows[:20_000], rows[20_000:]], schema, lambda d: st.throttle_stream(d, 4, 5.0))
    assert sorted(map(plain, got)) == batch
    assert left <= 6
