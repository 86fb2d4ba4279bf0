"""Graphs as JSON bundles, telemetry as JSON lines, and what an import endpoint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import slug
from graphloom.sources.languages import checked_language

MOST_IMPORT_BYTES = 6 * 1024 * 1024
GRAPH_JSON = (
    "repo struct<id: string, name: string, file_count: long, total_loc: long, indexed_at: string>, "
    "files array<struct<id: long, path: string, language: string, loc: long, sha: string, last_modified: double>>, "
    "symbols array<struct<id: long, file_id: long, name: string, kind: string, start_line: int, end_line: int, is_exported: boolean>>, "
    "edges array<struct<id: long, source_id: long, target_id: long, source_kind: string, target_kind: string, edge_kind: string, weight: double>>, "
    "history array<struct<file_id: long, commits_30d: long, commits_90d: long, authors_90d: long>>, "
    "coupling array<struct<file_a_id: long, file_b_id: long, co_changes: long>>, "
    "layout struct<nodes: array<struct<id: long, x: double, y: double>>>"
)
TELEMETRY = "v int, tool string, ts long, latencyMs double, resultSize long, repoHash string, hash string"


def read_table(bundle: DataFrame, name: str) -> DataFrame:
    """One of a bundle's tables as rows, with its defaults."""
    rows = bundle.select(F.explode(F.col(f"graph.{name}")).alias("r")).select("r.*")
    if name == "files":
        return rows.withColumn("language", checked_language(F.col("language")))
    if name == "edges":
        return rows.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return rows


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A bundle, one row a document; a malformed graph is an error."""
    schema = f"kind string, version int, exportedAt string, graph struct<{_inner(GRAPH_JSON)}>"
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def _inner(ddl: str) -> str:
    """Column list to struct fields: ``a type`` becomes ``a: type`` at the top level."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


#: Rows of a table that one document of a bundle holds, about.
DOCUMENT_ROWS = 100_000


def write_bundle(tables: dict[str, DataFrame], repo: tuple[str, str], path: str, exported_at: str, most_rows: int | None = None, document_rows: int = DOCUMENT_ROWS) -> None:
    """All tables of a graph as JSON documents, a file each; every document is a bundle with a share of the rows.

    A table of up to ``document_rows`` rows is whole in the first document, so small
    graphs are one document.  With ``most_rows`` (for readers that take but one), a
    table of more rows, counted before any is gathered, is refused.
    """
    spark = next(iter(tables.values())).sparkSession
    sizes = {}
    for name, df in tables.items():
        if most_rows is not None and df.limit(most_rows + 1).count() > most_rows:
            raise ValueError(f"too large for an exchange file: {name} has more than {most_rows} rows")
        sizes[name] = -(-df.count() // document_rows)
    documents = spark.range(max(1, *sizes.values())).withColumnRenamed("id", "document")
    parts = []
    for name, df in tables.items():
        share = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, sizes[name]))).alias("document")
        gathered = df.select(share, F.struct(*df.columns).alias("row")).groupBy("document").agg(F.sort_array(F.collect_list("row")).alias(name))
        documents = documents.join(gathered, "document", "left")
        parts.append(F.coalesce(name, F.array().cast(gathered.schema[name].dataType)).alias(name))
    head = F.struct(F.lit(repo[0]).alias("id"), F.lit(repo[1]).alias("name"))
    told = (F.lit("graph-bundle").alias("kind"), F.lit(1).alias("version"), F.lit(exported_at).alias("exportedAt"))
    documents.select(*told, F.struct(head.alias("repo"), *parts).alias("graph")).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def bundle_name(name: Column) -> Column:
    return F.concat(slug(name), F.lit(".graph.json"))


def import_verdict(body: Column) -> Column:
    """What an import endpoint answers: too large (in bytes), not JSON, no graph, or ok."""
    parsed = F.from_json(body, "name string, files array<string>, symbols array<string>, edges array<string>", {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(body).isNotNull()
    return (
        F.when(F.octet_length(body) > MOST_IMPORT_BYTES, "too_large").when(~F.coalesce(valid, F.lit(False)), "invalid_json").when(parsed["files"].isNull() | parsed["edges"].isNull(), "invalid_graph").otherwise("ok")
    )


def import_id(body: Column) -> Column:
    return F.substring(F.sha2(body.cast("binary"), 256), 1, 10)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines log; malformed lines are skipped."""
    return spark.read.schema(TELEMETRY).option("mode", "DROPMALFORMED").json(path)


def record_hash(tool: Column, latency_ms: Column, size: Column) -> Column:
    return F.sha2(F.concat(tool, (latency_ms.cast("long") % 100).cast("string"), size.cast("string")).cast("binary"), 512)
