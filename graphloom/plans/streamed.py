"""Queries of the keyed state machines: each is run as a stream over the events, to its end, and what it wrote is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.plans import views as V
from graphloom.plans.registry import ORACLES, query, with_
from graphloom.plans.shared_folder import scratch
from graphloom.streaming import stateful


def _streamed(spark: SparkSession, d: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    session = stateful.state_session(spark)
    # A pattern, as a stream's plain path must be a folder and a table may be a file.
    table = session.readStream.schema(V.read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    stream, folder = made(V.events_of(table)), scratch(spark, "stream")
    stateful.run_available(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(ORACLES["prime_gate"])
def streamed_gate(spark, d):
    kind = F.when(F.col("kind") == "signup", "query").when(F.col("kind") == "purchase", "write").when(F.col("kind") == "view", "search").otherwise("other")
    return _streamed(spark, d, lambda e: stateful.gate_stream(e.select("event_id", F.col("key").alias("session"), "ts", kind.alias("kind"))))


@query(ORACLES["throttled_frames"])
def streamed_frames(spark, d):
    frame = lambda e: e.select(F.col("key").alias("request_id"), "ts", F.col("event_id").cast("string").alias("text"), (F.col("kind") == "purchase").alias("done"))
    return _streamed(spark, d, lambda e: stateful.throttle_stream(frame(e), 40_000_000)).select("request_id", "text")


RECEIPTS = with_(
    "e AS (SELECT user_id, ts, event_id, ceil(length(props) / 4.0)::BIGINT AS tok, (props::JSON->>'k')::BIGINT AS f FROM events)",
    "n AS (SELECT *, row_number() OVER (PARTITION BY user_id, f ORDER BY ts, event_id) = 1 AS fresh FROM e)",
) + """SELECT user_id AS session, event_id, count(*) OVER w AS calls, sum(tok) OVER w::BIGINT AS tokens, sum(fresh::INT) OVER w::BIGINT AS n_files,
  sum(CASE WHEN fresh THEN 8 * greatest(f % 97, 1) ELSE 0 END) OVER w::BIGINT AS baseline FROM n
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _calls(e: DataFrame) -> DataFrame:
    """Each event as a call that touches the one file that its properties name."""
    file_id = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("key").alias("session"), "ts", "event_id", T.estimate_tokens(F.col("props")).alias("tokens"), F.array(file_id).alias("file_ids"), F.array(file_id % 97).alias("locs"))


@query(RECEIPTS)
def streamed_receipt(spark, d):
    return _streamed(spark, d, lambda e: stateful.receipt_stream(_calls(e))).drop("ts")


@query(RECEIPTS)
def receipts_so_far(spark, d):
    from graphloom.streaming import live

    return live.running_files(_calls(V.events(spark, d))).drop("ts")


REPLAYS = """SELECT * FROM (SELECT user_id AS key, event_id AS joined_id, event_type = 'click' AS asks,
  last_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) OVER w AS event_id, last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER w AS kind FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
REPLAYS = f"SELECT key, joined_id, event_id, kind FROM ({REPLAYS}) WHERE asks AND event_id IS NOT NULL"


def _joining(e: DataFrame) -> DataFrame:
    return e.select("key", "ts", "event_id", F.when(F.col("kind") == "click", stateful.JOIN).otherwise(F.col("kind")).alias("kind"))


@query(REPLAYS)
def streamed_replays(spark, d):
    return _streamed(spark, d, lambda e: stateful.replay_stream(_joining(e))).drop("ts")


@query(REPLAYS)
def replayed_events(spark, d):
    from graphloom.streaming import live

    return live.replayed(_joining(V.events(spark, d)), stateful.JOIN).drop("ts")
