"""Stateful operators on streams, by state that is read and trimmed event by event and ends by the watermark.

The session needs the RocksDB state store (`use_rocksdb`). Each operator has a batch twin in `rates`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that list, map and value state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def admit(times: Iterable[float], limit: int, window: float, held: deque) -> Iterator[tuple[bool, int | None]]:
    """Decisions for events in order: only accepted ones count (held, in order), those older than the window are forgotten."""
    for t in times:
        while held and held[0] < t - window:
            held.popleft()
        if len(held) < limit:
            held.append(t)
            yield True, None
        else:
            yield False, max(1, int(held[0] + window - t) + 1)


def seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def decided(rows: pd.DataFrame, limit: int, window: float, held: deque) -> pd.DataFrame:
    return admitted(rows, list(admit(seconds(rows["ts"]), limit, window, held)))


def admitted(rows: pd.DataFrame, done: list[tuple]) -> pd.DataFrame:
    """rows with what admit has said of each."""
    return rows[["key", "event_id", "ts"]].assign(accepted=[a for a, _ in done], retry_after=pd.array([r for _, r in done], dtype="Int32"))


class _Timed(StatefulProcessor):
    """One timer for each key, moved on as long as there is something to wait for."""

    handle: StatefulProcessorHandle

    def _wake(self, at_ms: int, watermark_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(at_ms, watermark_ms + 1))

    def close(self) -> None:
        pass


class Throttle(_Timed):
    """List state: the times of a key's accepted events within the window, `limit` at most."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "t double")

    def handleInputRows(self, key, rows, timerValues):
        held = deque(sorted(t for (t,) in self.held.get()))
        for frame in rows:
            yield decided(frame.sort_values(["ts", "event_id"]), self.limit, self.window, held)
        self.held.put([(t,) for t in held])
        self._wake(int((max(held) + self.window) * 1000) + 1, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "event_id": pd.Series([], dtype="int64"), "ts": pd.Series([], dtype="datetime64[ns]"), "accepted": pd.Series([], dtype=bool), "retry_after": pd.Series([], dtype="Int32")})


def throttle_stream(events: DataFrame, limit: int, window_s: float, late: str = "10 minutes") -> DataFrame:
    """Admission of a stream of events (key, event_id, ts): at most `limit` accepted in any trailing window.

    A key's state is the times of its accepted events, and it goes once the watermark has passed the window of the last
    one. Events are decided as they come: those that arrive in one piece of a micro-batch (as many as Arrow hands over
    at once) by their times, a later piece sees the state as it is. However many events a key has, only a piece of them
    is in memory.
    """
    rows = events.select("key", "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Throttle(limit, window_s), "key string, event_id long, ts timestamp, accepted boolean, retry_after int", "Append", "EventTime")


class Counter(_Timed):
    """Map state: samples that may still be overtaken by earlier ones; value state: the last one that can't be any more."""

    def __init__(self, keys: list[str], idle_ms: int):
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long", "value double")
        self.last = handle.getValueState("last", "ts long, value double")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for ts, value in zip((frame["ts"].astype("datetime64[us]").astype("int64")).tolist(), frame["value"].tolist()):
                self.waiting.updateValue((ts,), (value,))
        self._next(timerValues)
        return iter(())

    def _next(self, timerValues) -> None:
        first = min((ts for (ts,) in self.waiting.keys()), default=None)
        if first is not None:
            self._wake(first // 1000 + 1, timerValues.getCurrentWatermarkInMs())
        elif self.last.exists():
            self._wake(self.last.get()[0] // 1000 + self.idle_ms + 1, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = expiredTimerInfo.getExpiryTimeInMs()
        watermark = max(upto, timerValues.getCurrentWatermarkInMs())
        last = self.last.get() if self.last.exists() else None
        ready = sorted((ts, value) for (ts,), (value,) in self.waiting.iterator() if ts <= watermark * 1000)
        out = []
        for ts, value in ready:
            self.waiting.removeKey((ts,))
            if last is not None and ts - last[0] <= self.idle_ms * 1000:
                increase = value if value < last[1] else value - last[1]
                out.append((*key, pd.Timestamp(ts, unit="us"), value, increase, increase / ((ts - last[0]) / 1e6)))
            last = (ts, value)
        if ready:
            self.last.update(last)
        elif last is not None and last[0] // 1000 + self.idle_ms < watermark:
            self.last.clear()
        self._next(timerValues)
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "ts", "value", "increase", "per_second"])


def counter_stream(samples: DataFrame, keys: list[str], late: str = "10 minutes", idle_s: int = 86_400) -> DataFrame:
    """Increase of counters between samples (keys, ts, value) of a stream, each once the watermark has passed it.

    So the result doesn't depend on the order in which samples arrive, as long as they aren't late; later ones are
    dropped. After a reset the new value is the increase. A counter without samples for idle_s starts anew, and its
    state goes. Of samples of a counter at one time the last that came counts.
    """
    rows = samples.select(*keys, "ts", F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(Counter(keys, idle_s * 1000), f"{kinds}, ts timestamp, value double, increase double, per_second double", "Append", "EventTime")


class Dialogue(_Timed):
    """Map state of a session: the first mention of each term so far."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "term string", "round long, position long, status string")
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        until = self.until.get()[0] if self.until.exists() else 0
        for frame in rows:
            frame = frame.sort_values(["round", "position", "status"])
            until = max(until, int(frame["ts"].astype("datetime64[ms]").astype("int64").max()) + self.gap_ms)
            for term, round_, position, status in frame.drop_duplicates("term")[["term", "round", "position", "status"]].itertuples(index=False):
                mention = (int(round_), int(position), status)
                if not self.first.containsKey((term,)) or mention < tuple(self.first.getValue((term,))):
                    self.first.updateValue((term,), mention)
        self.until.update((until,))
        self._wake(until + 1, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = [(key[0], term, status, round_) for (term,), (round_, _, status) in self.first.iterator()]
        self.first.clear()
        self.until.clear()
        yield pd.DataFrame(out, columns=["session_id", "term", "status", "since_round"])


def dialogue_stream(turns: DataFrame, late: str = "10 minutes", gap_s: int = 1800) -> DataFrame:
    """First status of each term in a session, and its round, once the session has ended: gap_s after its last turn, by the watermark.

    turns: session_id, round, position, term, status, ts. Turns may come in any order; the earliest mention of a term
    counts, as in fold_dialogue. A turn that comes after its session's end begins the session anew.
    """
    rows = turns.select("session_id", F.col("round").cast("long").alias("round"), F.col("position").cast("long").alias("position"), "term", "status", "ts").where("term IS NOT NULL").withWatermark("ts", late)
    kind = turns.schema["session_id"].dataType.simpleString()
    return rows.groupBy("session_id").transformWithStateInPandas(Dialogue(gap_s * 1000), f"session_id {kind}, term string, status string, since_round long", "Append", "EventTime")
