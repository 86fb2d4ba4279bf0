"""A sink of telemetry that survives its writers: a streaming data source with a commit protocol.

Tasks write segments of at most ``SEGMENT`` records under names of their own.  A
batch counts from the moment that one manifest names its segments; a batch that is
run again after its manifest was written changes nothing, and segments that no
manifest names belong to nobody: the stream runs their batch again, so they are
only cleared away, once they are ``LEFT_S`` old and no task can still be at them.

    spark.dataSource.register(Segments)
    records.writeStream.format("segments").option("path", folder).option("checkpointLocation", ...).start()
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from graphloom.sources.exchange import TELEMETRY

SEGMENT, LEFT_S = 500, 60


def _store(folder: str):
    """The folder's file system and its path there."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    for part in ("segments", "batches"):
        store.create_dir(f"{root}/{part}")
    return store, root


def _names(store, folder: str) -> dict[str, float]:
    """File names in a folder, with the time they were written."""
    from pyarrow import fs

    return {i.base_name: i.mtime_ns / 1e9 for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file}


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class SegmentWriter(DataSourceStreamWriter):
    def __init__(self, folder: str, columns: list[str], size: int):
        self.folder, self.columns, self.size = folder, columns, size

    def _put(self, store, root: str, lines: list[str]) -> str:
        name = f"{uuid.uuid4().hex}.jsonl"
        with store.open_output_stream(f"{root}/segments/{name}", compression=None) as out:
            out.write(("\n".join(lines) + "\n").encode())
        return name

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.folder)
        names, lines = [], []
        for row in iterator:
            lines.append(json.dumps({c: row[c] for c in self.columns if row[c] is not None}, default=str))
            if len(lines) == self.size:
                names.append(self._put(store, root, lines))
                lines = []
        if lines:
            names.append(self._put(store, root, lines))
        return Written(names)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = _store(self.folder)
        name = f"{batchId:012d}.json"
        if name in _names(store, f"{root}/batches"):
            return
        told = json.dumps([n for m in messages if m is not None for n in m.names]).encode()
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft, compression=None) as out:
            out.write(told)
        store.move(draft, f"{root}/batches/{name}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = _store(self.folder)
        there = _names(store, f"{root}/segments")
        for name in (n for m in messages if m is not None for n in m.names):
            if name in there:
                store.delete_file(f"{root}/segments/{name}")


class Segments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return TELEMETRY

    def streamWriter(self, schema: StructType, overwrite: bool) -> SegmentWriter:  # noqa: N802
        return SegmentWriter(self.options["path"], schema.fieldNames(), int(self.options.get("size", SEGMENT)))


def named(folder: str) -> list[str]:
    """The segments of all batches that count."""
    store, root = _store(folder)
    found = []
    for name in sorted(_names(store, f"{root}/batches")):
        with store.open_input_stream(f"{root}/batches/{name}", compression=None) as file:
            found += json.loads(file.read())
    return found


def read(spark: SparkSession, folder: str, schema: str = TELEMETRY) -> DataFrame:
    """The records of all batches that count."""
    paths = [f"{folder}/segments/{n}" for n in named(folder)]
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def cleared(folder: str, now: float | None = None, left_s: float = LEFT_S) -> list[str]:
    """Removes segments that dead writers left, and says which."""
    store, root = _store(folder)
    # What is there is listed before what counts, so a batch that ends in between loses nothing.
    there, until = _names(store, f"{root}/segments"), (time.time() if now is None else now) - left_s
    left = sorted(set(n for n, at in there.items() if at <= until) - set(named(folder)))
    for name in left:
        store.delete_file(f"{root}/segments/{name}")
    return left
