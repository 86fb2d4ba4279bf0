"""Change history: churn, per-file history, files that change together, folder roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import churn_saturation, top_level_folder

#: Files of a commit that come together at once; larger commits are split into blocks, compared two by two.
FILES_A_BLOCK = 256


def churn(commits: DataFrame, until, days: int = 90) -> DataFrame:
    """``path, commits`` within the window; a commit that lists a path twice counts twice, as the log does."""
    recent = commits.where(F.col("ts") >= F.lit(until) - F.expr(f"interval {days} days"))
    return recent.groupBy("path").agg(F.count("*").alias("commits"))


def history(commits: DataFrame, files: DataFrame, until) -> DataFrame:
    """``file_id, commits_30d, commits_90d, authors_90d`` of files with commits in 90 days."""
    since = lambda days: F.col("ts") >= F.lit(until) - F.expr(f"interval {days} days")
    recent = commits.where(since(90)).join(files.select("path", F.col("id").alias("file_id")), "path")
    return recent.groupBy("file_id").agg(
        F.countDistinct(F.when(since(30), F.col("commit_id"))).alias("commits_30d"),
        F.countDistinct("commit_id").alias("commits_90d"),
        F.countDistinct("author").alias("authors_90d"),
    )


def coupling(commits: DataFrame, files: DataFrame, least: int = 2) -> DataFrame:
    """``file_a_id, file_b_id, co_changes`` of files changed in the same commits, ``least`` times or more.

    Pairs arise within a commit, however large.  Files of fewer commits than
    ``least`` are in no such pair, so they are left out first.
    """
    touched = commits.join(files.select("path", F.col("id").alias("file_id")), "path").select("commit_id", "file_id").distinct()
    often = touched.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("file_id")
    touched = touched.join(often, "file_id", "left_semi")
    large = touched.groupBy("commit_id").agg(F.ceil(F.count("*") / FILES_A_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = touched.join(large, "commit_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # A file comes once for each pair of blocks that its own is in.
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("file_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    met = dealt.groupBy("commit_id", "i", "j").agg(
        F.sort_array(F.collect_set(F.when(F.col("own") == F.col("i"), F.col("file_id")))).alias("ids"), F.collect_set(F.when(F.col("own") == F.col("j"), F.col("file_id"))).alias("others")
    )
    one = met.select(F.posexplode("ids").alias("k", "a"), "ids", "others", "i", "j")
    partners = F.when(F.col("i") == F.col("j"), F.slice("ids", F.col("k") + 2, F.size("ids"))).otherwise(F.col("others"))
    pairs = one.select("a", F.explode(partners).alias("b")).select(F.least("a", "b").alias("file_a_id"), F.greatest("a", "b").alias("file_b_id"))
    return pairs.groupBy("file_a_id", "file_b_id").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= least)


def group_graph(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``source_folder, target_folder, import_count, file_pairs`` between folders."""
    folder = files.select("id", top_level_folder(F.col("path")).alias("folder"))
    s, t = folder.withColumnsRenamed({"id": "src", "folder": "source_folder"}), folder.withColumnsRenamed({"id": "dst", "folder": "target_folder"})
    across = edges.join(s, "src").join(t, "dst").where("source_folder <> target_folder")
    return across.groupBy("source_folder", "target_folder").agg(F.sum("weight").alias("import_count"), F.count("*").alias("file_pairs"))


def hotspot_scores(files: DataFrame, scores: DataFrame, churned: DataFrame | None) -> DataFrame:
    """``id, path, centrality, commits, score``; with any churn the score adds its saturation."""
    base = files.select("id", "path").join(scores.select("id", "score"), "id", "left").select("id", "path", F.coalesce("score", F.lit(0.0)).alias("centrality"))
    if churned is None or churned.isEmpty():
        return base.select("*", F.lit(0).cast("long").alias("commits"), F.col("centrality").alias("score"))
    joined = base.join(churned, "path", "left").withColumn("commits", F.coalesce("commits", F.lit(0)).cast("long"))
    return joined.select("id", "path", "centrality", "commits", (F.col("centrality") + churn_saturation(F.col("commits"))).alias("score"))


def hotspots(files: DataFrame, scores: DataFrame, churned: DataFrame | None, limit: int = 20) -> DataFrame:
    """The ``limit`` highest scores that are not nothing."""
    found = hotspot_scores(files, scores, churned).where("centrality > 0 or commits > 0")
    return found.orderBy(F.round("score", 12).desc(), "path").limit(limit)
