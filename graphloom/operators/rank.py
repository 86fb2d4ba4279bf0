"""Centrality: weighted PageRank with optional personalisation.

Two strategies give the same ranks.  ``single_task`` holds the graph as arrays in
one task and serves graphs whose measured size is under ``SMALL_NODES`` and
``SMALL_EDGES``; ``distributed`` deals nodes and their edges to blocks and moves
sums between them once an iteration, for graphs of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import terms
from graphloom.operators.numbering import numbered
from graphloom.plans.shared_folder import written

DAMPING, ITERATIONS, MATCH_WEIGHT = 0.85, 40, 2.0
SMALL_NODES, SMALL_EDGES = 200_000, 2_000_000
#: The most links and nodes of a block, about; rows that a task packs at once; iterations between two writes.
BLOCK_LINKS, BLOCK_NODES, PACKED_ROWS, STEPS_A_JOB = 4_000_000, 1_000_000, 200_000, 10
FOCUS, PATH_HIT, SYMBOL_HIT = 3.0, 1.0, 2.0


def centrality(files: DataFrame, edges: DataFrame, teleport: DataFrame | None = None, iterations: int = ITERATIONS, strategy: str = "auto") -> DataFrame:
    """``id, rank, score`` of each file; ``score`` is ``rank`` over the largest rank.

    ``edges``: ``src, dst, weight``.  ``teleport``: ``id, weight``, else uniform;
    without any positive weight it is uniform too.  A file without outgoing
    edges gives its rank to the teleport targets.  The start is uniform.
    Edges are read twice (to count, to rank): what is dear to make is written first.
    """
    nodes = files.select(F.col("id").cast("long").alias("id")).distinct()
    links = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    n_links = links.count() if strategy != "single_task" else 0
    if strategy == "auto":
        small = n_links <= SMALL_EDGES and nodes.limit(SMALL_NODES + 1).count() <= SMALL_NODES
        strategy = "single_task" if small else "distributed"
    if strategy == "single_task":
        return _single_task(nodes, links, teleport, iterations)
    return _distributed(nodes, links, n_links, teleport, iterations)


def power_iteration(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, lean: np.ndarray, iterations: int) -> np.ndarray:
    """Ranks of ``ids``; sums run in a fixed order, so results repeat bit by bit."""
    n = len(ids)
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    out = np.bincount(s, weights=weight, minlength=n)
    jump = lean / lean.sum() if lean.sum() > 0 else np.full(n, 1 / n)
    share = np.divide(weight, out[s], out=np.zeros(len(s)), where=out[s] != 0)
    rank = np.full(n, 1 / n)
    for _ in range(iterations):
        lost = rank[out == 0].sum()
        rank = (1 - DAMPING + DAMPING * lost) * jump + DAMPING * np.bincount(d, weights=rank[s] * share, minlength=n)
    return rank


def _single_task(nodes: DataFrame, links: DataFrame, teleport: DataFrame | None, iterations: int) -> DataFrame:
    rows = nodes.select(F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("w"))
    rows = rows.unionByName(links.select(F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w")))
    if teleport is not None:
        rows = rows.unionByName(teleport.select(F.lit(2).alias("kind"), F.col("id").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("weight").cast("double").alias("w")))

    def run(pdf):
        import pandas as pd  # here, as the blocks' many workers do without it

        pdf = pdf.sort_values(["kind", "a", "b", "w"])
        ids = pdf.loc[pdf.kind == 0, "a"].to_numpy()
        e = pdf[pdf.kind == 1]
        lean = np.zeros(len(ids))
        t = pdf[(pdf.kind == 2) & pdf.a.isin(ids)]
        np.add.at(lean, np.searchsorted(ids, t.a.to_numpy()), t.w.to_numpy())
        rank = power_iteration(ids, e.a.to_numpy(), e.b.to_numpy(), e.w.to_numpy(), lean, iterations)
        top = rank.max() if len(rank) else 0.0
        return pd.DataFrame({"id": ids, "rank": rank, "score": rank / top if top > 0 else rank * 0})

    return rows.groupBy().applyInPandas(run, "id long, rank double, score double")


def own(block: int) -> int:
    return block


def packed(rows: DataFrame) -> DataFrame:
    """``block, kind, a, b, other, w`` rows as columns of bytes, some rows of each block together."""

    def run(batches):
        held, n = [], 0

        def handed():
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            order = np.lexsort((whole[1], whole[0]))
            whole = [c[order] for c in whole]
            starts = np.flatnonzero(np.r_[True, (np.diff(whole[0]) != 0) | (np.diff(whole[1]) != 0)])
            ends = np.r_[starts[1:], len(order)]
            columns = [[c[i:j].tobytes() for i, j in zip(starts, ends, strict=True)] for c in whole[2:]]
            return pa.RecordBatch.from_arrays([pa.array(whole[0][starts]), pa.array(whole[1][starts]), *[pa.array(c, pa.binary()) for c in columns]], ["block", "kind", "a", "b", "other", "w"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
            if n > PACKED_ROWS:
                yield handed()
                held, n = [], 0
        if n:
            yield handed()

    return rows.mapInArrow(run, "block long, kind long, a binary, b binary, other binary, w binary")


def _graph_blocks(items, jump_of):
    """A block's own part of the graph, and to each block the targets there, which later come as sums in that order."""
    nodes, links, block = [], [], None
    for block, (kind, a, b, other, w) in items:
        (links if kind else nodes).append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(other, np.int64), np.frombuffer(w)))
    if block is None:
        return
    ids, _, _, lean = map(np.concatenate, zip(*nodes, strict=True)) if nodes else (np.empty(0, np.int64),) * 3 + (np.empty(0),)
    order = np.argsort(ids, kind="stable")
    ids, jump = ids[order], jump_of(lean[order])
    out, outgoing = np.zeros(len(ids)), []
    if links:
        src, dst, other, weight = map(np.concatenate, zip(*links, strict=True))
        at = np.searchsorted(ids, src)
        known = at < len(ids)
        known[known] = ids[at[known]] == src[known]
        at, dst, other, weight = at[known], dst[known], other[known], weight[known]
        order = np.lexsort((at, dst, other))  # sums run in a fixed order, so results repeat bit by bit
        at, dst, other, weight = at[order], dst[order], other[order], weight[order]
        out = np.bincount(at, weights=weight, minlength=len(ids))
        share = np.divide(weight, out[at], out=np.zeros(len(at)), where=out[at] != 0)
        for target in np.unique(other).tolist():
            i, j = np.searchsorted(other, [target, target + 1])
            targets, place = np.unique(dst[i:j], return_inverse=True)
            outgoing.append((target, at[i:j].astype(np.int32), place.astype(np.int32), share[i:j]))
            yield target, ("targets", block, targets)
    yield block, ("graph", block, (ids, jump, out == 0, outgoing))


def _placed(items):
    """A block's part of the graph with the places of the targets that each block will send sums for."""
    graph, targets = None, []
    for block, (kind, source, value) in items:
        if kind == "graph":
            graph = (block, *value)
        else:
            targets.append((source, value))
    if graph is None:
        return
    block, ids, jump, leaf, outgoing = graph
    places = {}
    for source, found in targets:
        at = np.searchsorted(ids, found)
        known = at < len(ids)
        known[known] = ids[at[known]] == found[known]
        places[source] = (at[known].astype(np.int32), None if known.all() else known)
    yield block, ("graph", block, (ids, jump, leaf, outgoing, places))


def _next_ranks(items, first: float | None):
    """``block, graph, ranks`` from a block's part of the graph and what came from others; ``first`` is the rank at the start."""
    graph, came = None, []
    for block, (kind, source, value) in items:
        if kind == "graph":
            graph = (block, *value)
        else:
            came.append((source, *value))
    if graph is None:
        return None
    block, ids, jump, *_, places = graph
    if first is not None:
        return block, graph, np.full(len(ids), first)
    flow, lost = np.zeros(len(ids)), 0.0
    for source, sums, gone in sorted(came, key=lambda x: x[0]):
        lost += gone
        if sums is not None:
            at, known = places[source]
            flow[at] += sums if known is None else sums[known]
    return block, graph, (1 - DAMPING + DAMPING * lost) * jump + DAMPING * flow


def _sent(items, first: float | None, blocks: int):
    """What a block's ranks give to the targets in each block, and what its leaves lose, to all."""
    found = _next_ranks(items, first)
    if found is None:
        return
    block, (_, _, _, leaf, outgoing, _), rank = found
    gone, to = float(rank[leaf].sum()), {}
    for target, at, place, share in outgoing:
        to[target] = np.bincount(place, weights=rank[at] * share)
    for target in range(blocks):
        yield target, ("sums", block, (to.get(target), gone))


def _told(items, first: float | None):
    found = _next_ranks(items, first)
    if found is not None:
        _, (_, ids, *_), rank = found
        for i in range(0, len(ids), PACKED_ROWS):
            yield bytearray(ids[i : i + PACKED_ROWS].tobytes()), bytearray(rank[i : i + PACKED_ROWS].tobytes())


def _distributed(nodes: DataFrame, links: DataFrame, n_links: int, teleport: DataFrame | None, iterations: int) -> DataFrame:
    """Nodes fall into blocks by hash, with the links that leave them; an iteration is one shuffle of sums.

    A block knows beforehand which targets each other block sums up, so sums
    alone move, one for each pair of a block and a target.  What leaves lose
    goes along.  Every ``STEPS_A_JOB`` iterations sums are written, so the
    files of shuffles that are done with can go.
    """
    spark = nodes.sparkSession
    if teleport is None:
        based = nodes.withColumn("lean", F.lit(1.0))
    else:
        given = teleport.groupBy("id").agg(F.sum("weight").cast("double").alias("lean"))
        based = nodes.join(given, "id", "left").select("id", F.coalesce("lean", F.lit(0.0)).alias("lean"))
    based = written(based, "rank-nodes")
    n, total = based.agg(F.count("*"), F.sum("lean")).first()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"), F.lit(0.0).alias("score"))
    blocks = max(spark.sparkContext.defaultParallelism, -(-n_links // BLOCK_LINKS), -(-n // BLOCK_NODES))
    jump_of = (lambda lean: lean / total) if total > 0 else (lambda lean: np.full(len(lean), 1 / n))
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias
    none, kind = F.lit(0).cast("long"), lambda k: F.lit(k).cast("long").alias("kind")
    rows = based.select(block_of("id")("block"), kind(0), F.col("id").alias("a"), none.alias("b"), none.alias("other"), F.col("lean").alias("w"))
    rows = rows.unionByName(links.select(block_of("src")("block"), kind(1), F.col("src").alias("a"), F.col("dst").alias("b"), block_of("dst")("other"), F.col("weight").alias("w")))
    dealt = packed(rows).rdd.map(lambda r: (r[0], tuple(r[1:]))).partitionBy(blocks, own)
    graph = dealt.mapPartitions(lambda items: _graph_blocks(items, jump_of)).partitionBy(blocks, own).mapPartitions(_placed, preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)

    came, first = graph, 1 / n  # nothing came yet
    for step in range(1, iterations + 1):
        came = came.mapPartitions(lambda items, first=first: _sent(items, first, blocks)).partitionBy(blocks, own)
        if step % STEPS_A_JOB == 0 and step < iterations:
            rows = came.map(lambda r: (r[0], r[1][1], None if r[1][2][0] is None else bytearray(r[1][2][0].tobytes()), r[1][2][1]))
            kept = written(spark.createDataFrame(rows, "block long, source long, sums binary, gone double"), "rank-sums")
            came = kept.rdd.map(lambda r: (r[0], ("sums", r[1], (None if r[2] is None else np.frombuffer(r[2]), r[3])))).partitionBy(blocks, own)
        # Both are dealt alike, so a block's part of the graph meets what came for it without moving.
        came, first = graph.union(came), None
    told = spark.createDataFrame(came.mapPartitions(lambda items: _told(items, first)), "ids binary, ranks binary")

    def rows_of(batches):
        for batch in batches:
            for ids, ranks in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_py(), np.int64)), pa.array(np.frombuffer(ranks.as_py()))], ["id", "rank"])

    last = written(told.mapInArrow(rows_of, "id long, rank double"), "ranks")
    graph.unpersist()
    top = last.agg(F.max("rank")).first()[0]
    return last.select("id", "rank", (F.col("rank") / top if top else F.lit(0.0)).alias("score"))


def ranked(files: DataFrame, scores: DataFrame) -> DataFrame:
    """``id, path, score, rnk``: by score, then path; scores that differ by rounding only are equal."""
    joined = files.join(scores.select("id", "score"), "id", "left").select("id", "path", F.coalesce("score", F.lit(0.0)).alias("score"))
    lowest_first = joined.withColumn("__order", -F.round("score", 12))
    return numbered(lowest_first, ["__order", "path"], "rnk", start=1).drop("__order")


def task_matches(files: DataFrame, symbols: DataFrame, task: str, focus: list[int] | None = None) -> DataFrame:
    """``id, weight`` of files whose path or symbols have terms of the task, or that are in focus; repeats count."""
    spark = files.sparkSession
    wanted = spark.range(1).select(F.array_distinct(terms(F.lit(task))).alias("t")).first()["t"]
    listed = F.array(*[F.lit(t) for t in wanted]).cast("array<string>")
    hits = lambda c: F.size(F.filter(terms(F.col(c)), lambda t: F.array_contains(listed, t)))
    by_path = files.select("id", (hits("path") * PATH_HIT).alias("weight"))
    by_symbol = symbols.select(F.col("file_id").alias("id"), (hits("name") * SYMBOL_HIT).alias("weight"))
    parts = by_path.unionByName(by_symbol)
    if focus:
        parts = parts.unionByName(files.where(F.col("id").isin(focus)).select("id", F.lit(FOCUS).alias("weight")))
    return parts.where("weight > 0").groupBy("id").agg(F.sum("weight").alias("weight"))


def rank_for_task(files: DataFrame, symbols: DataFrame, edges: DataFrame, task: str = "", focus: list[int] | None = None) -> DataFrame:
    """``id, path, score, rnk``: direct matches first, then personalised centrality; without a match plain centrality."""
    # Used three times, and every symbol's name is cut into terms for it.
    matches = written(task_matches(files, symbols, task, focus), "matches")
    top = matches.agg(F.max("weight")).first()[0]
    if not top:
        return ranked(files, centrality(files, edges))
    scores = centrality(files, edges, matches).select("id", "score").join(matches, "id", "left")
    blended = F.lit(MATCH_WEIGHT) * F.coalesce(F.col("weight") / top, F.lit(0.0)) + F.col("score")
    return ranked(files, scores.select("id", blended.alias("score")))
