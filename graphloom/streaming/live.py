"""Events, requests, telemetry and reindexing over time.

Event time with watermarks bounds the state of streams; the batch forms of the
same operators are what the oracle checks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEBOUNCE = "200 milliseconds"
REQUEST_TTL_S, REQUEST_CAP = 600, 20
#: Fixed value: paths whose events never start a reindex.
WATCH_IGNORED = r"(^|/)(\.git|node_modules|\.next|dist|build|coverage|__pycache__)(/|$)"


def telemetry_hourly(records: DataFrame, watermark: str | None = None) -> DataFrame:
    """``hour, tool, calls, total_ms, max_ms`` from ``ts, tool, latency_ms``."""
    rows = records.withWatermark("ts", watermark) if watermark else records
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "tool").agg(F.count("*").alias("calls"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms"))
    return out.select(F.col("w.start").alias("hour"), "tool", "calls", "total_ms", "max_ms")


def debounced(events: DataFrame, gap: str = DEBOUNCE, watermark: str | None = None) -> DataFrame:
    """``key, started, ended, n_events``: events closer than the gap start one reindex."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    out = rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.max("ts").alias("ended"))
    return out.select("key", F.col("w.start").alias("started"), "ended", "n_events")


def last_event(events: DataFrame) -> DataFrame:
    """``key, ts, event_id, kind``: the latest event of each key, for late joiners."""
    return events.groupBy("key").agg(F.max(F.struct("ts", "event_id", "kind")).alias("e")).select("key", "e.ts", "e.event_id", "e.kind")


def receipt(calls: DataFrame, touched: DataFrame, files: DataFrame) -> DataFrame:
    """``session, calls, tokens, n_files, baseline``: what was returned against reading each touched file whole, once."""
    spent = calls.groupBy("session").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    read = touched.select("session", "file_id").distinct().join(files.select(F.col("id").alias("file_id"), "loc"), "file_id")
    base = read.groupBy("session").agg(F.count("*").alias("n_files"), F.sum(F.greatest("loc", F.lit(1)) * 8).alias("baseline"))
    return spent.join(base, "session", "left").select("session", "calls", "tokens", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("baseline", F.lit(0)).alias("baseline"))


def gate(events: DataFrame) -> DataFrame:
    """``event_id, session, kind, decision``: a query primes a session, a write ends that; searching unprimed is denied.

    ``kind`` is ``query``, ``write``, ``search`` or anything else, which passes.
    """
    before = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("kind") == "query", F.lit(True)).when(F.col("kind") == "write", F.lit(False))
    primed = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False))
    return events.select("event_id", "session", "kind", F.when((F.col("kind") == "search") & ~primed, "deny").otherwise("allow").alias("decision"))


class Queue:
    """First in, first out; requests older than the TTL are dropped whenever the queue is touched; at most ``REQUEST_CAP``."""

    def __init__(self, items: list[tuple[float, int, str]] | None = None):
        self.items = items or []

    def prune(self, now: float) -> None:
        self.items = [i for i in self.items if now - i[0] <= REQUEST_TTL_S]

    def put(self, now: float, request: int, kind: str) -> int | None:
        """The request that had to go, if any."""
        self.prune(now)
        self.items.append((now, request, kind))
        return self.items.pop(0)[1] if len(self.items) > REQUEST_CAP else None

    def take(self, now: float, kind: str | None = None) -> int | None:
        """The oldest request, or the oldest of a kind; it is given once."""
        self.prune(now)
        for i, item in enumerate(self.items):
            if kind is None or item[2] == kind:
                return self.items.pop(i)[1]
        return None


QUEUE_EVENTS = "key long, ts timestamp, event_id long, action string, kind string"
QUEUE_OUT = "key long, event_id long, taken long"


def queue_results(events: DataFrame) -> DataFrame:
    """``key, event_id, taken`` of each ``take`` in ``key, ts, event_id, action, kind``, by key (one queue a key)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queue, out = Queue(), []
        for e in pdf.sort_values(["ts", "event_id"]).itertuples():
            now = e.ts.timestamp()
            if e.action == "put":
                queue.put(now, e.event_id, e.kind)
            else:
                out.append((e.key, e.event_id, queue.take(now, None if e.action == "take" else "question")))
        return pd.DataFrame(out, columns=["key", "event_id", "taken"]).astype({"key": "int64", "event_id": "int64", "taken": "Int64"})

    return events.groupBy("key").applyInPandas(run, QUEUE_OUT)


def queue_stream(events: DataFrame) -> DataFrame:
    """The same on a stream: a key's queue is state, kept as arrays; it times out with its youngest request."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.getOption
        queue, out = Queue(list(zip(*held, strict=True)) if held and held[0] else []), []
        for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            now = e.ts.timestamp()
            if e.action == "put":
                queue.put(now, e.event_id, e.kind)
            else:
                out.append((key[0], e.event_id, queue.take(now, None if e.action == "take" else "question")))
        state.update(tuple(list(c) for c in zip(*queue.items, strict=True)) if queue.items else ([], [], []))
        state.setTimeoutDuration(REQUEST_TTL_S * 1000)
        yield pd.DataFrame(out, columns=["key", "event_id", "taken"]).astype({"key": "int64", "event_id": "int64", "taken": "Int64"})

    return events.groupBy("key").applyInPandasWithState(run, QUEUE_OUT, "ts array<double>, id array<long>, kind array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def answers(requests: DataFrame, replies: DataFrame, within: str = "10 minutes") -> DataFrame:
    """``request_id, kind, answer, waited_ms``: requests and their answers; on streams both sides carry watermarks."""
    same = (F.col("q.request_id") == F.col("a.request_id")) & (F.col("a.ts") >= F.col("q.ts")) & (F.col("a.ts") <= F.col("q.ts") + F.expr(f"interval {within}"))
    joined = requests.alias("q").join(replies.alias("a"), same)
    return joined.select("q.request_id", "q.kind", "a.answer", (F.unix_millis("a.ts") - F.unix_millis("q.ts")).alias("waited_ms"))


#: Milliseconds between an answer's partial frames.
FRAME_GAP_MS = 120


def throttled(frames: DataFrame, gap_ms: int = FRAME_GAP_MS) -> DataFrame:
    """``request_id, ts, text, done`` of frames that are sent: partial ones ``gap_ms`` or more after the last partial one sent, and every final one.

    Which partial frames are sent depends on the ones before, so a request's frames
    pass in order through a task that holds a batch of them and the time of the last.
    """
    request = dict(frames.dtypes)["request_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        request_id = last = None
        for batch in batches:
            due = []
            for key, at, done in zip(batch["request_id"], batch["at"], batch["done"], strict=True):
                if key != request_id:
                    request_id, last = key, None
                ms = at // 1000
                due.append(bool(done or last is None or ms - last >= gap_ms))
                if due[-1] and not done:
                    last = ms
            yield batch[due]

    order = ["request_id", F.unix_millis("ts"), "done", "text"]
    dealt = frames.where("request_id is not null").repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_id").sortWithinPartitions(*order)
    sent = dealt.select("request_id", F.unix_micros("ts").alias("at"), "text", "done").mapInPandas(run, f"request_id {request}, at long, text string, done boolean")
    return sent.select("request_id", F.timestamp_micros("at").alias("ts"), "text", "done")


def replayed(events: DataFrame, join: str = "join") -> DataFrame:
    """``key, joined_id, ts, event_id, kind``: for each event of the kind ``join`` the key's last other event before."""
    before = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("kind") != join, F.struct("ts", "event_id", "kind"))
    found = events.withColumn("last", F.last(other, ignorenulls=True).over(before)).where((F.col("kind") == join) & F.col("last").isNotNull())
    return found.select("key", F.col("event_id").alias("joined_id"), "last.ts", "last.event_id", "last.kind")


def running_files(calls: DataFrame) -> DataFrame:
    """``session, ts, event_id, calls, tokens, n_files, baseline`` so far, after each call of ``session, ts, event_id, tokens, file_ids, locs``.

    A file counts at its session's first call that touches it.
    """
    touched = calls.select("session", "ts", "event_id", F.explode(F.arrays_zip("file_ids", "locs")).alias("f"))
    first = touched.groupBy("session", "f.file_ids").agg(F.min(F.struct("ts", "event_id", "f.locs")).alias("at"))
    fresh = first.groupBy("session", "at.event_id").agg(F.count("*").alias("more"), F.sum(F.greatest("at.locs", F.lit(1)) * 8).alias("lines"))
    so_far = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"calls": F.count("*"), "tokens": F.sum("tokens"), "n_files": F.sum(F.coalesce("more", F.lit(0))), "baseline": F.sum(F.coalesce("lines", F.lit(0)))}
    joined = calls.select("session", "ts", "event_id", "tokens").join(fresh, ["session", "event_id"], "left")
    return joined.select("session", "ts", "event_id", *[v.over(so_far).cast("long").alias(k) for k, v in sums.items()])


def running_receipt(calls: DataFrame) -> DataFrame:
    """``session, ts, event_id, calls, tokens`` so far, after each call of a session."""
    so_far = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return calls.select("session", "ts", "event_id", F.count("*").over(so_far).alias("calls"), F.sum("tokens").over(so_far).alias("tokens"))


def questions(requests: DataFrame) -> DataFrame:
    """Requests that an agent answers by itself: those of no kind or of the kind ``question``."""
    return requests.where(F.col("kind").isNull() | (F.col("kind") == "question"))


def answer_events(replies: DataFrame) -> DataFrame:
    """``kind, request_id, answer, done, ts`` events from ``request_id, answer, ts``; a reply that lacks either is none."""
    given = replies.where((F.coalesce("request_id", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != ""))
    return given.select(F.lit("answer").alias("kind"), "request_id", "answer", F.lit(True).alias("done"), "ts")


def watch(changes: DataFrame, reindex: Callable[[DataFrame, int], None], every: str = "200 milliseconds", checkpoint: str | None = None):
    """Reindex on changed paths: what comes while a batch runs makes exactly one next batch."""

    def batch(df: DataFrame, number: int) -> None:
        kept = df.where(~F.col("path").rlike(WATCH_IGNORED)).select("path").distinct()
        if not kept.isEmpty():
            reindex(kept, number)

    writer = changes.writeStream.foreachBatch(batch).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
