"""An index that is kept by batches: after a change only what it touches is parsed and resolved again.

Each batch is a folder of its own with the rows that it made: parsed symbols,
imports and calls of files whose content is new, the paths that their imports
watch, resolved imports, and call links.  The batch's list of files says for each
file which batch has its rows, so a file's old rows are passed over without being
touched.  A batch counts once its number is in the log, which is written last: one
that broke off is written again under its number, and one that is done is not.

*What is touched.*  The watched paths are an inverted index from a path to the files
whose imports try it.  Paths that came or went name the importers to resolve
again, a compiler config that changed the scripts below it.  A file whose content
changed keeps its path, so its importers' imports stay; but their calls are linked
again, as its symbols may have changed.

Results equal those of a full build with the same ids: symbols have numbers that
don't depend on other files, and get dense ones when a graph is read.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import ancestors, base_name
from graphloom.operators import assemble, index_state
from graphloom.operators.model import Graph
from graphloom.operators.numbering import numbered
from graphloom.sources import build, parse

#: A symbol's number is its file's id, shifted by so many bits, and its place in the file.
PLACE_BITS = 20
TABLES = {"imports": "parsed_in", "watch": "resolved_in", "resolved": "resolved_in"}
LINKED = {"symbols": "parsed_in", "calls": "parsed_in", "links": "linked_in"}


#: Both say which side of a join is small enough to be built on the driver.
BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@contextmanager
def _shuffled_joins(spark: SparkSession):
    """Joins that start in here move both sides: a table of ids or paths is small as a file, but not as a hash table on the driver."""
    before = {key: spark.conf.get(key, None) for key in BROADCASTS}
    for key in BROADCASTS:
        spark.conf.set(key, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Index:
    """Batches under a folder that all executors reach; without ``links`` it is an index of imports, so nothing else is parsed."""

    def __init__(self, spark: SparkSession, folder: str, links: bool = True):
        self.spark, self.folder, self.links, self.schemas = spark, folder.rstrip("/"), links, {}
        self.tables = TABLES | LINKED if links else TABLES

    def batches(self) -> list[int]:
        """Those that are done, in order."""
        try:
            return sorted({int(r.value) for r in self.spark.read.text(f"{self.folder}/done").collect()})
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def files(self, batch: int | None = None) -> DataFrame | None:
        """The files as of a batch, the last one unless given."""
        if batch is None:
            done = self.batches()
            batch = done[-1] if done else None
        return None if batch is None else self.spark.read.parquet(f"{self.folder}/files/batch={batch}")

    def rows(self, table: str, files: DataFrame | None = None, done: list[int] | None = None, picked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """A table's rows of the present files (or some of them), each from the batch that has them; ``done`` are the batches, if they are known, and ``picked`` takes a few of the rows first."""
        of = (self.files() if files is None else files).select(F.col("id").alias("file_id"), F.col(self.tables[table]).alias("batch"))
        reader = self.spark.read.option("basePath", f"{self.folder}/{table}")
        if table in self.schemas:
            reader = reader.schema(self.schemas[table])
        stored = reader.parquet(*[f"{self.folder}/{table}/batch={b}" for b in (self.batches() if done is None else done)])
        self.schemas[table] = stored.schema
        stored = stored if picked is None else picked(stored)
        return stored.join(of.hint("merge"), ["file_id", "batch"], "left_semi").drop("batch")

    def _put(self, table: str, batch: int, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{table}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def apply(self, scanned: DataFrame, batch: int) -> bool:
        """Takes in the files (``path, language, sha, content``) as they are now; False if the batch is done already."""
        done = self.batches()
        if batch in done:
            return False
        with _shuffled_joins(self.spark):
            self._apply(scanned, batch, done)
        return True

    def _apply(self, scanned: DataFrame, batch: int, done: list[int]) -> None:
        before = self.files(done[-1]) if done else None
        ids = assemble.file_ids(scanned.select("path"), None if before is None else before.select("path", "id"))
        # Contents are read for their digests and to be parsed, and move only to be parsed.
        files = self._put("listing", batch, scanned.drop("id", "content").join(self._put("ids", batch, ids), "path"))
        known = files.limit(0).select("path", "sha") if before is None else before
        changed = self._put("changes", batch, index_state.changes(known, files))
        aliases = build.aliases_of(scanned)
        listing = files.select("id", "path", "language")

        # What is parsed: contents that are new.
        new = changed.where("change <> 'removed'")
        fresh = files.join(new, "path", "left_semi")
        contents = scanned if before is None else scanned.join(new, "path", "left_semi")
        parsed = self._put("parsed", batch, parse.parse_files(contents, parts=parse.PARTS if self.links else ("imports",)))
        symbols, imports, calls = parse.tables(fresh, parsed)
        imports = self._put("imports", batch, imports)
        if self.links:
            place = F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "pos")) - 1
            symbols = self._put("symbols", batch, symbols.withColumn("id", F.shiftleft("file_id", PLACE_BITS) + place))
            calls = self._put("calls", batch, calls)

        # What is resolved: imports of these, and of files that a path which came or went, or a config, concerns.
        fresh_ids = fresh.select(F.col("id").alias("file_id"))
        stale = fresh_ids.limit(0)
        if before is not None:
            kept = before.join(changed, "path", "left_anti")
            moved = changed.where("change <> 'changed'").select("path")
            touched = self.rows("watch", kept, done, lambda watch: build.touched_importers(watch, moved))
            stale = touched.unionByName(_below_configs(kept, changed))
            imports = imports.unionByName(self.rows("imports", kept, done).join(stale, "file_id", "left_semi"))
        again = self._put("again", batch, fresh_ids.unionByName(stale).distinct())
        named = self._put("tried", batch, build.tried(listing, imports, aliases))
        resolved = self._put("resolved", batch, build.resolved(listing, named))
        self._put("watch", batch, build.watched(named))

        told = [("parsed_in", fresh_ids), ("resolved_in", again)]
        if self.links:
            told.append(("linked_in", self._linked(batch, done, before, changed, fresh_ids, again, symbols, calls, resolved)))
        out = files
        for column, ids in told:
            now = ids.select(F.col("file_id").alias("id"), F.lit(batch).alias("now"))
            out = out.join(now, "id", "left")
            if before is None:
                out = out.withColumn(column, F.col("now")).drop("now")
            else:
                out = out.join(before.select("id", F.col(column).alias("was")), "id", "left").withColumn(column, F.coalesce("now", "was")).drop("now", "was")
        self._put("files", batch, out)
        self.spark.createDataFrame([(str(batch),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/done")

    def _linked(self, batch, done, before, changed, fresh_ids, again, symbols, calls, resolved) -> DataFrame:
        """Links calls of the files whose imports are resolved again, and of the importers of files with new symbols; tells which."""
        relinked = again
        if before is not None:
            kept = before.join(changed, "path", "left_anti").join(again.withColumnRenamed("file_id", "id"), "id", "left_anti")
            old = self.rows("resolved", kept, done)
            relinked = again.unionByName(old.join(fresh_ids.withColumnRenamed("file_id", "target_id"), "target_id", "left_semi").select("file_id")).distinct()
            resolved = resolved.unionByName(old.join(relinked, "file_id", "left_semi"))
            still = before.join(changed, "path", "left_anti")
            calls = calls.unionByName(self.rows("calls", still, done).join(relinked, "file_id", "left_semi"))
            symbols = symbols.unionByName(self.rows("symbols", still, done))
        relinked = self._put("relinked", batch, relinked)
        edges = assemble.import_edges(resolved)
        needed = relinked.unionByName(edges.select(F.col("dst").alias("file_id"))).distinct()
        links = assemble.call_edges(calls, symbols.join(needed, "file_id", "left_semi"), edges)
        self._put("links", batch, links.withColumn("file_id", F.shiftright("src", PLACE_BITS)))
        return relinked

    def import_edges(self) -> DataFrame:
        """``src, dst, weight`` by file id."""
        return assemble.import_edges(self.rows("resolved"))

    def graph(self, name: str) -> Graph:
        """The index as a graph, with dense numbers for symbols and edges."""
        if not self.links:
            raise ValueError("an index without links is no graph")
        files, edges = self.files().drop("parsed_in", "resolved_in", "linked_in"), assemble.numbered_edges(self.import_edges(), self.files())
        symbols = numbered(self.rows("symbols").withColumnRenamed("id", "number"), ["file_id", "start_line", "pos"])
        ends = symbols.select("number", "id")
        links = self.rows("links").join(ends.select(F.col("number").alias("src"), F.col("id").alias("source_id")), "src").join(ends.select(F.col("number").alias("dst"), F.col("id").alias("target_id")), "dst")
        calls = numbered(links.select("source_id", "target_id", "weight"), ["source_id", "target_id"], start=edges.count()).select("id", "source_id", "target_id", "weight")
        return Graph(name, files, symbols.drop("number", "pos"), edges, calls)

    def compact(self, batch: int) -> bool:
        """All present rows in one new batch, so that reading doesn't open a folder for each batch."""
        if batch in self.batches():
            return False
        for table in self.tables:
            self._put(table, batch, self.rows(table))
        self._put("files", batch, self.files().withColumns({c: F.lit(batch) for c in set(self.tables.values())}))
        self.spark.createDataFrame([(str(batch),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/done")
        return True


def _below_configs(files: DataFrame, changed: DataFrame) -> DataFrame:
    """``file_id`` of scripts that lie below a compiler config which came, went or changed."""
    folders = changed.where(base_name(F.col("path")).isin(*build.CONFIGS)).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder")).distinct()
    scripts = files.where(F.col("language").isin("typescript", "javascript")).select(F.col("id").alias("file_id"), F.explode(ancestors(F.col("path"))).alias("folder"))
    return scripts.join(folders, "folder", "left_semi").select("file_id").distinct()
