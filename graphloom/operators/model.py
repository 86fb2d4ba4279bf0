"""The data model: a graph is a few DataFrames of fixed schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

FILES = "id long, path string, language string, loc long, sha string, last_modified_ms long"
SYMBOLS = "id long, file_id long, name string, kind string, signature string, start_line int, end_line int, exported boolean"
EDGES = "id long, source_id long, target_id long, kind string, weight long"
RAW_IMPORTS = "file_id long, specifier string"
RAW_CALLS = "file_id long, callee string, line int"
COMMITS = "path string, commit_id string, ts timestamp, author string"
HISTORY = "file_id long, commits_30d long, commits_90d long, authors_90d long"
COUPLING = "file_a_id long, file_b_id long, co_changes long"
LAYOUT = "id long, x long, y long"
PARSED = (
    "symbols array<struct<name: string, kind: string, signature: string, start_line: int, end_line: int, exported: boolean>>, "
    "imports array<string>, calls array<struct<callee: string, line: int>>"
)


@dataclass
class Graph:
    """``import_edges`` join file ids, ``call_edges`` symbol ids; they are kept apart so ids never mix.

    A graph for views that show neither call edges nor many ids of symbols may
    do without the former, and its symbols may have ``pos`` in place of ids.
    """

    name: str
    files: DataFrame
    symbols: DataFrame
    import_edges: DataFrame
    call_edges: DataFrame | None = None

    def edges(self) -> DataFrame:
        """Both kinds with their kind."""
        from pyspark.sql import functions as F

        columns = ["id", "source_id", "target_id", "kind", "weight"]
        imports = self.import_edges.withColumn("kind", F.lit("import")).select(columns)
        return imports.unionByName(self.call_edges.withColumn("kind", F.lit("calls")).select(columns))
