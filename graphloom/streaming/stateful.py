"""Keyed state machines on streams: gate, running receipt, throttle, last value.

Each is a processor with state by key in the session's state store (``state_session``
gives one with RocksDB, which these processors need).  A key's rows of one
micro-batch are taken in the order of their time, so a source's rate limit bounds
what is sorted at once; what came before is state.  After a restart from its
checkpoint a query goes on where it was.

A key loses its state by a timer once the watermark is past its last row by more than
it may be idle; one timer a key is pending at a time.  Until then results equal
those of the batch forms in ``live`` over all rows so far, for rows that come in
time order.  The watermark only lets timers fire: no row is dropped as late.

Times are microseconds inside, as time zones are none of a processor's business.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.streaming.live import FRAME_GAP_MS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds after which an idle key's state goes: of sessions, of requests, and of an event for late joiners.
SESSION_IDLE_S, REQUEST_IDLE_S, EVENT_IDLE_S = 24 * 3600, 600, 24 * 3600
#: How far the watermark is behind the latest row.
LATENESS = "10 minutes"
#: The kind of an event with which a subscriber asks for the last one.
JOIN = "join"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own, with a state store that these processors can use; ``spark`` stays as it is."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return session


class Idle(StatefulProcessor):
    """State that a timer clears once its key has been idle for ``idle_s`` of event time.

    A subclass names its states in ``states`` and works in ``rows``, which gets a
    key's rows in order.
    """

    order: list[str] = ["at", "event_id"]

    def __init__(self, idle_s: float):
        self.idle_ms = int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")
        self.held = self.states(handle)

    def states(self, handle: StatefulProcessorHandle) -> list:
        raise NotImplementedError

    def rows(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        latest, before = int(given["at"].max()) // 1000, self.seen.get()
        if before is None:
            self.handle.registerTimer(latest + self.idle_ms)
        self.seen.update((max(latest, before[0] if before else latest),))
        yield self.rows(key, given)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = (self.seen.get() or (0,))[0] + self.idle_ms
        if until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)
        else:
            for state in (self.seen, *self.held):
                state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Gate(Idle):
    """A query primes a session, a write ends that; searching unprimed is denied."""

    def states(self, handle):
        self.primed = handle.getValueState("primed", "primed boolean")
        return [self.primed]

    def rows(self, key, rows):
        primed = bool((self.primed.get() or (False,))[0])
        decided = []
        for kind in rows["kind"]:
            decided.append("deny" if kind == "search" and not primed else "allow")
            primed = True if kind == "query" else False if kind == "write" else primed
        self.primed.update((primed,))
        return pd.DataFrame({"event_id": rows["event_id"], "session": key[0], "kind": rows["kind"], "decision": decided})


class Receipt(Idle):
    """Calls and tokens so far, and what reading each touched file whole, once, would have been."""

    def states(self, handle):
        self.sums = handle.getValueState("sums", "calls long, tokens long, n_files long, baseline long")
        self.files = handle.getMapState("files", "file_id long", "touched boolean")
        return [self.sums, self.files]

    def rows(self, key, rows):
        calls, tokens, n_files, baseline = self.sums.get() or (0, 0, 0, 0)
        told = []
        for row in rows.itertuples():
            calls, tokens = calls + 1, tokens + int(row.tokens)
            for file_id, loc in zip(row.file_ids if row.file_ids is not None else [], row.locs if row.locs is not None else [], strict=True):
                if not self.files.containsKey((int(file_id),)):
                    self.files.updateValue((int(file_id),), (True,))
                    n_files, baseline = n_files + 1, baseline + 8 * max(int(loc), 1)
            told.append((row.at, row.event_id, calls, tokens, n_files, baseline))
        self.sums.update((calls, tokens, n_files, baseline))
        out = pd.DataFrame(told, columns=["at", "event_id", "calls", "tokens", "n_files", "baseline"])
        out.insert(0, "session", key[0])
        return out


class Throttle(Idle):
    """Partial frames a gap or more after the last partial one that was sent, and every final one."""

    order = ["at", "done", "text"]

    def __init__(self, gap_ms: int, idle_s: float):
        super().__init__(idle_s)
        self.gap_ms = gap_ms

    def states(self, handle):
        self.last = handle.getValueState("last", "ms long")
        return [self.last]

    def rows(self, key, rows):
        last, sent = (self.last.get() or (None,))[0], []
        for at, done in zip(rows["at"], rows["done"], strict=True):
            ms = at // 1000
            due = done or last is None or ms - last >= self.gap_ms
            sent.append(bool(due))
            if due and not done:
                last = ms
        if last is not None:
            self.last.update((int(last),))
        out = rows[sent]
        return pd.DataFrame({"request_id": key[0], "at": out["at"], "text": out["text"], "done": out["done"]})


class Replay(Idle):
    """A subscriber that joins gets the last event before."""

    def states(self, handle):
        self.last = handle.getValueState("last", "at long, event_id long, kind string")
        return [self.last]

    def rows(self, key, rows):
        last, told = self.last.get() if self.last.exists() else None, []
        for row in rows.itertuples():
            if row.kind != JOIN:
                last = (int(row.at), int(row.event_id), row.kind)
            elif last is not None:
                told.append((row.event_id, *last))
        if last is not None:
            self.last.update(last)
        out = pd.DataFrame(told, columns=["joined_id", "at", "event_id", "kind"])
        out.insert(0, "key", key[0])
        return out


def _keyed(rows: DataFrame, key: str, processor: Idle, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"{key} {dict(rows.dtypes)[key]}, {schema}", outputMode="append", timeMode="EventTime")


def _timed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withWatermark("ts", LATENESS).select(*columns, F.unix_micros("ts").alias("at"))


def gate_stream(events: DataFrame, idle_s: float = SESSION_IDLE_S) -> DataFrame:
    """``event_id, session, kind, decision`` of ``session, ts, event_id, kind``: ``live.gate`` on a stream."""
    out = _keyed(_timed(events, "session", "event_id", "kind"), "session", Gate(idle_s), "event_id long, kind string, decision string")
    return out.select("event_id", "session", "kind", "decision")


def receipt_stream(calls: DataFrame, idle_s: float = SESSION_IDLE_S) -> DataFrame:
    """``session, ts, event_id, calls, tokens, n_files, baseline`` after each call of ``session, ts, event_id, tokens, file_ids, locs``: ``live.running_files`` on a stream."""
    given = _timed(calls, "session", "event_id", "tokens", "file_ids", "locs")
    out = _keyed(given, "session", Receipt(idle_s), "at long, event_id long, calls long, tokens long, n_files long, baseline long")
    return out.select("session", F.timestamp_micros("at").alias("ts"), "event_id", "calls", "tokens", "n_files", "baseline")


def throttle_stream(frames: DataFrame, gap_ms: int = FRAME_GAP_MS, idle_s: float = REQUEST_IDLE_S) -> DataFrame:
    """``request_id, ts, text, done`` of frames that are sent: ``live.throttled`` on a stream."""
    out = _keyed(_timed(frames, "request_id", "text", "done"), "request_id", Throttle(gap_ms, idle_s), "at long, text string, done boolean")
    return out.select("request_id", F.timestamp_micros("at").alias("ts"), "text", "done")


def replay_stream(events: DataFrame, idle_s: float = EVENT_IDLE_S) -> DataFrame:
    """``key, joined_id, ts, event_id, kind`` of ``key, ts, event_id, kind``: ``live.replayed`` on a stream."""
    out = _keyed(_timed(events, "key", "event_id", "kind"), "key", Replay(idle_s), "joined_id long, at long, event_id long, kind string")
    return out.select("key", "joined_id", F.timestamp_micros("at").alias("ts"), "event_id", "kind")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what its source has now, and returns all that it has written under ``folder`` so far."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
