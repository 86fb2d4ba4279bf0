"""Keyed state machines as streams that stop and go on, against their batch forms."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import live, stateful

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def restarted(spark, folder, parts, schema, made):
    """Writes one part after the other and runs the stream to its end each time, from its checkpoint."""
    session = stateful.state_session(spark)
    out = None
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = stateful.run_available(made(session.readStream.schema(schema).parquet(f"{folder}/in")), folder)
    return sorted(map(repr, map(tuple, out.collect()))), spark.read.schema(schema).parquet(f"{folder}/in")


def rows_in_order(rng, n, make):
    """Rows by time in three parts; some share their time."""
    times = sorted(rng.randrange(2 * n) for _ in range(n))
    rows = [make(t, i) for i, t in enumerate(times)]
    cuts = [n // 3, n // 3, n // 2]  # the second part is empty
    while times[cuts[2] - 1] == times[cuts[2]]:
        cuts[2] += 1
    while times[cuts[0] - 1] == times[cuts[0]]:
        cuts[0] += 1
    return [rows[: cuts[0]], rows[cuts[0] : cuts[2]], rows[cuts[2] :]]


def case(name):
    rng = random.Random(name)
    if name == "gate":
        parts = rows_in_order(rng, 150, lambda t, i: (f"s{rng.randrange(5)}", at(t), i, rng.choice(["query", "write", "search", "other"])))
        return parts, "session string, ts timestamp, event_id long, kind string", stateful.gate_stream, live.gate
    if name == "receipt":
        parts = rows_in_order(rng, 150, lambda t, i: (rng.randrange(4), at(t), i, rng.randrange(100), [rng.randrange(12), rng.randrange(12)] if i % 4 else None, [rng.randrange(9), rng.randrange(9)] if i % 4 else None))
        return parts, "session long, ts timestamp, event_id long, tokens long, file_ids array<long>, locs array<long>", stateful.receipt_stream, live.running_files
    if name == "throttle":
        parts = rows_in_order(rng, 200, lambda t, i: (rng.randrange(3), at(t), f"t{i:03d}", rng.random() < 0.1))
        return parts, "request_id long, ts timestamp, text string, done boolean", lambda d: stateful.throttle_stream(d, 7000), lambda d: live.throttled(d, 7000)
    parts = rows_in_order(rng, 150, lambda t, i: (rng.randrange(4), at(t), i, rng.choice(["join", "open", "close"])))
    return parts, "key long, ts timestamp, event_id long, kind string", stateful.replay_stream, live.replayed


@pytest.mark.parametrize("name", ["gate", "receipt", "throttle", "replay"])
def test_streams_go_on_where_they_stopped(spark, tmp_path, name):
    parts, schema, streamed, batch = case(name)
    got, given = restarted(spark, f"file://{tmp_path}", parts, schema, streamed)
    want = batch(given)
    assert got == sorted(map(repr, map(tuple, want.collect()))) and len(got) > 5


def test_idle_sessions_lose_their_state(spark, tmp_path):
    """A primed session is forgotten once the watermark is past its idle time; one that stays busy isn't."""
    schema = "session string, ts timestamp, event_id long, kind string"
    day = 24 * 3600
    parts = [
        [("idle", at(0), 1, "query"), ("busy", at(0), 2, "query"), ("idle", at(5), 3, "search")],
        [("busy", at(day / 2), 4, "search"), ("idle", at(day / 2), 5, "search")],
        [("busy", at(day * 1.2), 6, "search")],
        [("busy", at(day * 2), 7, "search"), ("other", at(day * 2.2), 8, "search")],
        [("idle", at(day * 2.3), 9, "search"), ("busy", at(day * 2.4), 10, "search")],
    ]
    got, _ = restarted(spark, f"file://{tmp_path}", parts, schema, stateful.gate_stream)
    decided = {eval(r)[0]: eval(r)[3] for r in got}  # noqa: S307
    assert decided == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "deny", 9: "deny", 10: "allow"}


def test_state_stays_bounded(spark, tmp_path):
    """Ever new sessions, each of one call: what the store holds doesn't grow with their number."""
    schema = "session long, ts timestamp, event_id long, tokens long, file_ids array<long>, locs array<long>"
    session, folder, held = stateful.state_session(spark), f"file://{tmp_path}", []
    for part in range(4):
        rows = [(part * 100 + i, at(part * 10_000 + i), part * 100 + i, 1, [i], [1]) for i in range(100)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = stateful.receipt_stream(session.readStream.schema(schema).parquet(f"{folder}/in"), idle_s=60)
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert spark.read.parquet(f"{folder}/out").count() == 400
    assert max(held) < 2 * held[0] + 200


def test_frames_pass_a_task_in_batches(spark):
    """One request with very many frames, and others between batches."""
    n = 30_000
    frames = spark.range(n).select(F.when(F.col("id") % 5000 == 1, F.col("id")).otherwise(0).alias("request_id"), F.timestamp_millis(F.col("id") * 40).alias("ts"), F.col("id").cast("string").alias("text"), (F.col("id") == n - 1).alias("done"))
    found = live.throttled(frames, 120).where("request_id = 0").orderBy("ts").collect()
    times = [i * 40 for i in range(n) if i % 5000 != 1]
    want, last = [], None
    for t in times:
        if last is None or t - last >= 120 or t == (n - 1) * 40:
            want.append(str(t // 40))
            last = t
    assert [r.text for r in found] == want
