"""Sinks and stores that outlive their writers and readers."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import index_state
from graphloom.operators.model import Graph
from graphloom.sources import exchange, telemetry


def records(spark, numbers):
    df = spark.createDataFrame([(1, f"tool{n % 3}", n, float(n % 250), n, "r") for n in numbers], "v int, tool string, ts long, latencyMs double, resultSize long, repoHash string")
    return df.withColumn("hash", exchange.record_hash(F.col("tool"), F.col("latencyMs"), F.col("resultSize")))


def test_a_writer_that_dies_loses_and_repeats_nothing(spark, tmp_path):
    class Dying(telemetry.SegmentWriter):
        """Dies between two segments while a flag is there."""

        def _put(self, store, root, lines):
            if os.path.exists(f"{root}/die") and len(os.listdir(f"{root}/segments")) >= 2:
                raise RuntimeError("killed")
            return super()._put(store, root, lines)

    class DyingSegments(telemetry.Segments):
        @classmethod
        def name(cls):
            return "dying"

        def streamWriter(self, schema, overwrite):  # noqa: N802
            return Dying(self.options["path"], schema.fieldNames(), int(self.options["size"]))

    spark.dataSource.register(DyingSegments)
    folder = f"file://{tmp_path}/log"

    def run():
        stream = spark.readStream.schema(telemetry.TELEMETRY).json(f"{tmp_path}/in")
        stream.writeStream.format("dying").option("path", folder).option("size", 50).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    records(spark, range(120)).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    run()
    records(spark, range(120, 500)).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    open(f"{tmp_path}/log/die", "w").close()
    with pytest.raises(Exception, match="killed"):
        run()
    assert sorted(r.ts for r in telemetry.read(spark, folder).collect()) == list(range(120))
    os.remove(f"{tmp_path}/log/die")
    run()
    run()  # nothing is left to do
    found = telemetry.read(spark, folder)
    assert sorted(r.ts for r in found.collect()) == list(range(500))
    assert found.where(F.col("hash") != exchange.record_hash(F.col("tool"), F.col("latencyMs"), F.col("resultSize"))).count() == 0
    assert max(sum(1 for _ in open(f"{tmp_path}/log/segments/{n}")) for n in telemetry.named(folder)) == 50


def test_left_segments_are_cleared_after_a_while(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    writer = telemetry.SegmentWriter(folder, ["ts"], 2)
    rows = records(spark, range(5)).select("ts").collect()
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([first, None], 7)
    writer.commit([second], 7)  # the batch ran again though it counted already
    assert telemetry.named(folder) == first.names and len(first.names) == 3
    assert telemetry.cleared(folder) == []
    assert telemetry.cleared(folder, now=time.time() + 61) == sorted(second.names)
    third = writer.write(iter(rows))
    writer.abort([third, None], 8)
    assert sorted(os.listdir(f"{tmp_path}/log/segments")) == sorted(first.names)
    assert telemetry.read(spark, f"file://{tmp_path}/none").count() == 0


def graph(spark, n, tag):
    files = spark.createDataFrame([(i, f"{tag}{i}.ts") for i in range(n)], "id long, path string")
    symbols = spark.createDataFrame([(1, 0, "same")], "id long, file_id long, name string")
    edges = spark.createDataFrame([(0, 0, 1, 1)], "id long, source_id long, target_id long, weight long")
    return Graph("g", files, symbols, edges, edges)


def test_versions_share_parts_expire_and_are_pinned(spark, tmp_path):
    store = index_state.Store(spark, f"file://{tmp_path}/store")
    assert store.version() is None and store.load() is None and store.known_ids() is None
    for k in range(4):
        assert store.save(graph(spark, 3 + k, "f" if k < 3 else "g")) == k + 1
    parts = [store.manifest(v) for v in store.versions()]
    assert len({p["symbols"]["path"] for p in parts}) == 1 and len({p["files"]["path"] for p in parts}) == 4
    held = store.load(version=1)
    store.pin(1, 100)
    assert store.expire(keep=1) == [2, 3] and store.versions() == [1, 4]
    assert store.clear() == 0  # parts that young may belong to a save
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{tmp_path}/store/parts") for f in names)
    before = size()
    freed = store.clear(left_s=0, now=time.time() + 1)
    assert freed > 0 and size() == before - freed and held.files.count() == 3 and store.load().files.count() == 6
    assert store.expire(keep=1, now=time.time() + 101) == [1]
    assert store.clear(left_s=0, now=time.time() + 1) > 0 and len(os.listdir(f"{tmp_path}/store/parts")) == 4
    store.delete(4)
    assert store.load() is None


def test_readers_and_savers_at_the_same_time(spark, tmp_path):
    """Whatever a reader has loaded stays whole while versions are saved and expire."""
    from concurrent.futures import ThreadPoolExecutor

    store = index_state.Store(spark, f"file://{tmp_path}/store")
    store.save(graph(spark, 5, "a"))

    def read(_):
        version = store.version()
        store.pin(version, 60)
        found = store.load(version=version)
        rows = found.files.collect()
        return {r.path[0] for r in rows}, len(rows)

    def save(k):
        store.save(graph(spark, 5 + k, "bcd"[k]))
        store.expire(keep=1)
        store.clear()

    with ThreadPoolExecutor(4) as pool:
        saved = [pool.submit(save, k) for k in range(2)]
        seen = list(pool.map(read, range(4)))
        for s in saved:
            s.result()
    assert all(len(tags) == 1 and n == {"a": 5, "b": 5, "c": 6}[next(iter(tags))] for tags, n in seen)
