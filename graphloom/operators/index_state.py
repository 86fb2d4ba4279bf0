"""The index as state: what changed, a parse cache by content, versions on disk.

A version is a manifest that names a part for each table; parts are folders of
Parquet files that are never changed, and a table whose rows are those of an earlier
version shares its part.  The manifest is put in place last, so readers see the old
version or the new one, never a mix.  Versions can be deleted or expire; one that a
reader has pinned stays until the pin runs out.  Parts that no manifest names are
cleared away once they are old enough that no save can still be about to name them.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.assemble import file_ids
from graphloom.operators.model import Graph

ENGINE_VERSION = 2
TABLES = ("files", "symbols", "import_edges", "call_edges")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change`` (added, removed or changed) between two ``path, sha`` tables."""
    b, a = before.select("path", F.col("sha").alias("old")), after.select("path", F.col("sha").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return b.join(a, "path", "full_outer").where("not (old <=> new)").select("path", kind.alias("change"))


def unparsed(files: DataFrame, cache: DataFrame | None) -> DataFrame:
    """One file of each ``(sha, language)`` that the cache lacks: equal bytes are parsed once."""
    todo = files.dropDuplicates(["sha", "language"])
    if cache is None:
        return todo
    return todo.join(cache.where(F.col("engine_version") == ENGINE_VERSION).select("sha", "language"), ["sha", "language"], "left_anti")


#: Seconds after which a part that no manifest names is nobody's.
UNNAMED_S = 3600


class Store:
    """Versions under a folder (a URI) that driver and executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        from pyarrow import fs

        self.spark, self.folder = spark, folder.rstrip("/")
        self.store, self.root = fs.FileSystem.from_uri(self.folder)
        for part in ("manifests", "parts", "pins"):
            self.store.create_dir(f"{self.root}/{part}", recursive=True)

    def _listed(self, part: str) -> list:
        from pyarrow import fs

        return sorted(self.store.get_file_info(fs.FileSelector(f"{self.root}/{part}")), key=lambda i: i.base_name)

    def _manifests(self) -> dict[int, str]:
        """File names by version; of two saves that took one number, the later name counts."""
        return {int(i.base_name.split("-")[0]): i.base_name for i in self._listed("manifests")}

    def manifest(self, version: int) -> dict:
        with self.store.open_input_stream(f"{self.root}/manifests/{self._manifests()[version]}", compression=None) as file:
            return json.loads(file.read())

    def versions(self) -> list[int]:
        return sorted(self._manifests())

    def version(self) -> int | None:
        return max(self._manifests(), default=None)

    def save(self, graph: Graph) -> int:
        last = self.version()
        known = {} if last is None else self.manifest(last)
        tables = {}
        for t in TABLES:
            path = f"parts/{t}-{uuid.uuid4().hex}"
            df = getattr(graph, t)
            df.write.parquet(f"{self.folder}/{path}")
            rows = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{path}")
            n, a, b = rows.agg(F.count("*"), F.bit_xor(F.xxhash64(*rows.columns)), F.bit_xor(F.xxhash64(F.lit(7), *rows.columns))).first()
            content = f"{df.schema.simpleString()}:{n}:{a}:{b}"
            if known.get(t, {}).get("content") == content:
                self.store.delete_dir(f"{self.root}/{path}")
                path = known[t]["path"]
            tables[t] = {"path": path, "content": content}
        version = (last or 0) + 1
        draft = f"{self.root}/draft-{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft, compression=None) as out:
            out.write(json.dumps(tables).encode())
        self.store.move(draft, f"{self.root}/manifests/{version:08d}-{uuid.uuid4().hex}")
        return version

    def load(self, name: str = "graph", version: int | None = None) -> Graph | None:
        version = self.version() if version is None else version
        if version is None:
            return None
        tables = self.manifest(version)
        return Graph(name, *[self.spark.read.parquet(f"{self.folder}/{tables[t]['path']}") for t in TABLES])

    def known_ids(self) -> DataFrame | None:
        found = self.load()
        return None if found is None else found.files.select("path", "id")

    def pin(self, version: int, seconds: float, now: float | None = None) -> None:
        """Keeps a version for a reader, at least so long."""
        until = int((time.time() if now is None else now) + seconds)
        with self.store.open_output_stream(f"{self.root}/pins/{version}-{until}-{uuid.uuid4().hex}", compression=None) as out:
            out.write(b"")

    def delete(self, version: int) -> None:
        """The version's manifest; its parts go with ``clear``."""
        self.store.delete_file(f"{self.root}/manifests/{self._manifests()[version]}")

    def expire(self, keep: int = 2, now: float | None = None) -> list[int]:
        """Deletes all versions but the last ones and those that are pinned."""
        now, pinned = time.time() if now is None else now, set()
        for pin in self._listed("pins"):
            version, until, _ = pin.base_name.split("-")
            if int(until) > now:
                pinned.add(int(version))
            else:
                self.store.delete_file(pin.path)
        gone = [v for v in self.versions()[: -keep or None] if v not in pinned]
        for version in gone:
            self.delete(version)
        return gone

    def clear(self, now: float | None = None, left_s: float = UNNAMED_S) -> int:
        """Removes parts that no version names, and drops nothing that a save may still name; the bytes that are free now."""
        from pyarrow import fs

        now, freed = time.time() if now is None else now, 0
        parts = self._listed("parts")
        named = {t["path"].rpartition("/")[2] for v in self.versions() for t in self.manifest(v).values()}
        for part in parts:
            files = [f for f in self.store.get_file_info(fs.FileSelector(part.path, recursive=True)) if f.is_file]
            if part.base_name not in named and max((f.mtime_ns / 1e9 for f in files), default=0) <= now - left_s:
                freed += sum(f.size for f in files)
                self.store.delete_dir(part.path)
        return freed


def reindexed_files(store: Store, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with sticky ids, and what changed since the stored version."""
    known = store.load()
    before = known.files if known is not None else scanned.limit(0)
    ids = known.files.select("path", "id") if known is not None else None
    return file_ids(scanned.drop("id"), ids), changes(before, scanned)
