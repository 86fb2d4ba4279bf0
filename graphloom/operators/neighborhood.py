"""Breadth-first rings around files, over edges in both directions."""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared_folder import scratch, written

#: Rings up to this one are joins; beyond it far more is met than found, so a task walks from each of its centres.
JOINED_RINGS = 2
#: Links in a chunk, about; chunks that a task keeps; centres that walk together, and centres in a task, about.
CHUNK_LINKS, KEPT_CHUNKS, GROUP, TASK_CENTRES = 1_000_000, 8, 64, 512
#: Met ids that a centre, and those that walk together, hold before they are made distinct; rows told at once.
MOST_MET, MOST_HELD, TOLD_ROWS = 1_000_000, 8_000_000, 200_000


def rings(edges: DataFrame, centres: DataFrame, depth: int = 1) -> DataFrame:
    """``centre, id, ring, relation`` of everything within ``depth`` hops of each centre; repeated edges count once.

    A file reached along imports only is a ``dependency``, against them a
    ``dependent``, both ways on its ring ``mixed``; the nearest ring counts.
    Up to ``JOINED_RINGS`` all centres are walked together: a ring is one join and one
    anti-join.  For more, each file's neighbours are written once, in chunks by id, and
    tasks read those that their centres come by; what centres meet never moves.
    """
    seen = centres.select(F.col("id").alias("centre"), "id", F.lit(0).alias("ring"), F.lit("center").alias("relation"))
    ways = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(1).alias("way")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("to"), F.lit(2).alias("way")))
    if depth > JOINED_RINGS:
        return seen.unionByName(_walked(ways, centres, depth).select("centre", "id", "ring", _relation()))
    frontier = seen
    for ring in range(1, depth + 1):
        reached = frontier.select("centre", "id").join(ways, "id").groupBy("centre", F.col("to").alias("id")).agg(F.bit_or("way").alias("ways"))
        fresh = reached.join(seen.select("centre", "id"), ["centre", "id"], "left_anti")
        frontier = fresh.select("centre", "id", F.lit(ring).alias("ring"), _relation())
        if ring < depth:
            frontier = written(frontier, "ring")
        seen = seen.unionByName(frontier)
    return seen


def _relation():
    return F.when(F.col("ways") == 1, "dependency").when(F.col("ways") == 2, "dependent").otherwise("mixed").alias("relation")


def _walked(ways: DataFrame, centres: DataFrame, depth: int) -> DataFrame:
    """``centre, id, ring, ways`` of rings from the first on."""
    spark, folder = ways.sparkSession, scratch(ways.sparkSession, "neighbours")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    links = ways.select(F.col("id").cast("long").alias("id"), F.col("to").cast("long").alias("to"), F.col("way").cast("tinyint").alias("way")).where("id is not null and to is not null")
    parallel = spark.sparkContext.defaultParallelism * 4
    tasks = max(parallel, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = links.repartitionByRange(tasks, "id").sortWithinPartitions("id")
    # One row a chunk.  A task that ran twice has put its chunks twice, of which one is told.
    told = ranged.mapInArrow(lambda batches: _put(batches, folder), "low long, path string").collect()
    index = sorted((r["low"], r["path"]) for r in told)
    starts = centres.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    n = max(parallel, -(-starts.count() // TASK_CENTRES))

    def run(batches):
        found = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if not found:
            return
        ids, chunks = np.concatenate(found), _Chunks(folder, index)
        for i in range(0, len(ids), GROUP):
            for rows in _walks(ids[i : i + GROUP], depth, chunks):
                for j in range(0, len(rows[0]), TOLD_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[j : j + TOLD_ROWS]) for c in rows], ["centre", "id", "ring", "ways"])

    # Centres that are near by number come by the same chunks, if ids tell at all what is near.
    return starts.repartitionByRange(n, "id").sortWithinPartitions("id").mapInArrow(run, "centre long, id long, ring int, ways tinyint")


def _distinct(pieces: list[np.ndarray]) -> np.ndarray:
    whole = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
    whole.sort()
    return whole[np.r_[True, whole[1:] != whole[:-1]]] if len(whole) else whole


def _lists(ids: np.ndarray, of: np.ndarray, to: np.ndarray) -> pa.Array:
    """For each of ``ids`` the distinct ``to`` of the links that are ``of`` it."""
    order = np.lexsort((to, of))
    of, to = of[order], to[order]
    first = np.r_[True, (of[1:] != of[:-1]) | (to[1:] != to[:-1])] if len(of) else np.empty(0, bool)
    of, to = of[first], to[first]
    return pa.LargeListArray.from_arrays(np.r_[np.searchsorted(of, ids), len(of)].astype(np.int64), pa.array(to, pa.int64()))


def _put(batches, folder: str):
    """Writes rows ``id, to, way``, which come in order of ids, as chunks that each have all links of their ids."""
    store, root = fs.FileSystem.from_uri(folder)

    def put(id_, to, way):
        ids, path = id_[np.r_[True, id_[1:] != id_[:-1]]], uuid.uuid4().hex
        lists = [_lists(ids, id_[way == w], to[way == w]) for w in (1, 2)]
        batch = pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["id", "along", "against"])
        with store.open_output_stream(f"{root}/{path}", compression=None) as out, pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array(ids[:1]), pa.array([path])], ["low", "path"])

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= CHUNK_LINKS and held[-1][0][-1] != held[0][0][0]:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last id may have more to come
            yield put(*[c[:cut] for c in whole])
            held, n = [[c[cut:] for c in whole]], len(whole[0]) - cut
    if held:
        yield put(*[np.concatenate(c) for c in zip(*held, strict=True)])


class _Chunks:
    """Chunks by id, of which the last few are kept."""

    def __init__(self, folder: str, index: list[tuple[int, str]]):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.lows, self.paths, self.kept = np.array([low for low, _ in index], np.int64), [path for _, path in index], OrderedDict()

    def read(self, k: int):
        """``ids`` and, for both ways, where each id's links begin and what they are."""
        if k in self.kept:
            self.kept.move_to_end(k)
            return self.kept[k]
        with self.store.open_input_file(f"{self.root}/{self.paths[k]}") as file:
            batch = pa.ipc.open_file(file).get_batch(0)
        lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns[1:]]
        self.kept[k] = batch.column(0).to_numpy(), lists
        if len(self.kept) > KEPT_CHUNKS:
            self.kept.popitem(last=False)
        return self.kept[k]


def _walks(centres: np.ndarray, depth: int, chunks: _Chunks):
    """``centre, id, ring, ways`` arrays of some centres, which pass by the chunks together; where they hold too much, by halves."""
    found = _walk(centres, depth, chunks)
    if found is not None:
        yield from found
        return
    for half in np.array_split(centres, 2):
        yield from _walks(half, depth, chunks)


def _walk(centres: np.ndarray, depth: int, chunks: _Chunks):
    seen = [centres[i : i + 1] for i in range(len(centres))]
    frontiers, told = list(seen), []
    for ring in range(1, depth + 1):
        met = _met(frontiers, chunks)
        if met is None:
            return None
        for i, (along, against) in enumerate(met):
            ids = _distinct([along, against])
            ways = np.full(len(ids), 2, np.int8)
            ways[np.searchsorted(ids, along)] = 1
            ways[np.searchsorted(ids, against)] |= 2
            at = np.searchsorted(ids, seen[i])
            known = at < len(ids)
            known[known] = ids[at[known]] == seen[i][known]
            fresh = np.ones(len(ids), bool)
            fresh[at[known]] = False
            ids, ways = ids[fresh], ways[fresh]
            frontiers[i] = ids
            if ring < depth:
                seen[i] = _distinct([seen[i], ids])
            told.append((np.full(len(ids), centres[i]), ids, np.full(len(ids), ring, np.int32), ways))
        if len(centres) > 1 and sum(len(rows[0]) for rows in told) > MOST_HELD:
            return None
    return told


def _met(frontiers: list[np.ndarray], chunks: _Chunks):
    """For each frontier the distinct ids that its links lead to, along and against them; None if these are too many to hold for more than one."""
    met = [([], []) for _ in frontiers]
    sizes, limits = [0] * len(frontiers), [MOST_MET] * len(frontiers)
    cuts = [np.r_[np.searchsorted(f, chunks.lows), len(f)] for f in frontiers]
    for k in range(len(chunks.lows)):
        for i, (frontier, cut) in enumerate(zip(frontiers, cuts, strict=True)):
            part = frontier[cut[k] : cut[k + 1]]
            if not len(part):
                continue
            ids, lists = chunks.read(k)
            at = np.searchsorted(ids, part)
            at = at[at < len(ids)] if at[-1] == len(ids) else at
            at = at[ids[at] == part[: len(at)]]
            for pieces, (starts, values) in zip(met[i], lists, strict=True):
                counts = starts[at + 1] - starts[at]
                ends = np.cumsum(counts)
                if len(ends) and ends[-1]:
                    pieces.append(values[np.arange(ends[-1]) + np.repeat(starts[at] - ends + counts, counts)])
                    sizes[i] += int(ends[-1])
            if sizes[i] > limits[i]:
                for pieces in met[i]:
                    pieces[:] = [_distinct(pieces)]
                sizes[i] = sum(len(p[0]) for p in met[i])
                limits[i] = max(MOST_MET, 2 * sizes[i])
        if len(frontiers) > 1 and sum(sizes) > MOST_HELD:
            for i, both in enumerate(met):
                for pieces in both:
                    pieces[:] = [_distinct(pieces)]
                sizes[i] = sum(len(p[0]) for p in both)
            if sum(sizes) > MOST_HELD // 2:
                return None
    return [(_distinct(along), _distinct(against)) for along, against in met]
