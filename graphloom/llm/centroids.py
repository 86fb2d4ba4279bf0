"""Exact centroid clustering of integer vectors with Drake's adaptive bounds.

A round assigns every vector to its nearest centroid (squared Euclidean distance,
ties to the smaller number) and then moves every centroid to the floor of its
vectors' mean.  All of that is integer arithmetic, so results don't depend on
partitions, batches or the order of sums.

*Bounds.*  Between rounds a vector keeps the numbers of its own and of its ``b``
next centroids, an upper bound of its distance to its own, a lower bound for each
of the others, and one lower bound for all the rest.  When centroids move, the
upper bound grows by its own one's way, each lower bound shrinks by its
centroid's way, the remainder by the longest way.  A vector whose upper bound is
below all lower bounds keeps its centroid without a distance computed.  Else the
upper bound is made exact; if that is not enough but still below the remainder,
only the ``b + 1`` known centroids are measured and ordered again, and only if the
remainder can't certify that either, all of them.  Bounds are floating-point
numbers widened by more than rounding can lose, and certify only strict order; so
ties are always decided by exact distances.

*Adaptive.*  Every task reports how many bounds its vectors needed; the next
round stores no more than that, and an eighth of all centroids at least.  A
dropped bound joins the remainder.

*Rounds as jobs.*  A round is one pass over the vectors with their bounds, written
to the shared folder in turn to one of two paths, so that a lost executor costs
its own tasks alone and disk holds two states at most.  The same pass yields, for
each task and centroid, by how much its vectors' sum and number changed; vectors
that stay where they were change nothing.  The driver holds centroids and their
sums, ``k`` times the dimension.  Rounds end early when no centroid moved, as all
further ones would be the same.  Hot clusters are sums within tasks like others.

Defined cases.  Vectors that are null, of another length, or with a null, NaN or
infinite component are left out.  Scaled components beyond ``MOST`` in size (that
is 131,072 before scaling) count as ``MOST``, so that squared distances fit 64 bits.
Repeated rows are vectors of their own, with equal results; null ids are ids
of their own, hashed as an empty text.  First centroids are the rows of least
hash, equal hashes in the order of their components; with fewer vectors than
centroids each is one.  Equal centroids leave the one of larger number empty; it
stays.  A sum of distances beyond 64 bits is null.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import release, scratch, table

CLUSTERS, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024
#: The largest size of a scaled component.
MOST = 1 << 27
#: By which share bounds are widened at each step; rounding loses far less.
SLACK = 1e-12
#: Up to this size of components, products of whole vectors are exact in doubles.
EXACT = 1 << 22

_STATE = {"vec_id": pa.int64(), "x": pa.list_(pa.int32()), "near": pa.list_(pa.int32()), "lower": pa.list_(pa.float64()), "upper": pa.float64(), "distance": pa.int64()}
_SUMS = {"cluster": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.int64()), "depth": pa.int32()}
_SCHEMA = "vec_id long, x array<int>, near array<int>, lower array<double>, upper double, distance long, cluster int, n long, sums array<long>, depth int"


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """``vec_id, x``: the vectors that are whole, as integers ``floor(SCALE * component)``."""
    whole = f"size(`{vector_col}`) = {dims} and forall(`{vector_col}`, e -> e is not null and not isnan(e) and abs(cast(e as double)) < double('infinity'))"
    number = f"transform(`{vector_col}`, e -> cast(greatest(least(floor(least(greatest({SCALE}D * cast(e as double), -1e15D), 1e15D)), {MOST}L), -{MOST}L) as int))"
    return vectors.where(F.col(vector_col).isNotNull() & F.expr(whole)).select(F.col(id_col).cast("long").alias("vec_id"), F.expr(number).alias("x"))


def first_centroids(vectors: DataFrame, clusters: int) -> np.ndarray:
    """Those of least hash; only ``clusters`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``."""
    if not x.size or not c.size:
        return np.zeros((len(x), len(c)), np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) * np.sqrt(x.shape[1] / DIMS) < EXACT:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf**2).sum(axis=1)[:, None] - 2 * (xf @ cf.T) + (cf**2).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def own_distances(x: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its own centroid."""
    return ((x - c[own]) ** 2).sum(axis=1)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


class Bounded:
    """Vectors with their nearest centroids and bounds; ``lower`` has the remainder's last."""

    def __init__(self, x: np.ndarray, near: np.ndarray, lower: np.ndarray, upper: np.ndarray):
        self.x, self.near, self.lower, self.upper = x, near, lower, upper

    @classmethod
    def scanned(cls, x: np.ndarray, c: np.ndarray, b: int) -> Bounded:
        """From all distances."""
        d = distances(x, c)
        order = np.argsort(d, axis=1, kind="stable")
        ranked = np.take_along_axis(d, order, axis=1)
        rest = _below(ranked[:, b + 1]) if b + 1 < len(c) else np.full(len(x), np.inf)
        return cls(x, order[:, : b + 1].astype(np.int32), np.c_[_below(ranked[:, 1 : b + 1]), rest], _above(ranked[:, 0]))

    def kept(self, b: int) -> None:
        """Stores ``b`` bounds; those beyond join the remainder."""
        if b < self.near.shape[1] - 1:
            self.near, self.lower = self.near[:, : b + 1], np.c_[self.lower[:, :b], self.lower[:, b:].min(axis=1)]

    def moved(self, way: np.ndarray) -> None:
        """Centroids have moved by at most ``way``."""
        far = np.c_[way[self.near[:, 1:]], np.full(len(self.x), way.max())]
        self.lower = np.maximum(0.0, self.lower * (1 - SLACK) - far * (1 + SLACK))
        self.upper = (self.upper + way[self.near[:, 0]]) * (1 + SLACK)

    def settled(self, c: np.ndarray) -> int:
        """Makes the first of ``near`` the nearest again; the number of bounds that were needed."""
        b, depth = self.near.shape[1] - 1, 0
        open_ = np.flatnonzero(self.upper >= self.lower.min(axis=1))
        if not len(open_):
            return depth
        self.upper[open_] = _above(own_distances(self.x[open_], c, self.near[open_, 0]))
        open_ = open_[self.upper[open_] >= self.lower[open_].min(axis=1)]
        inside = self.upper[open_] < self.lower[open_, -1]
        some, all_ = open_[inside], open_[~inside]
        if len(some):
            depth = int(((self.lower[some, :-1] <= self.upper[some, None]) * np.arange(1, b + 1)).max())
            near = np.sort(self.near[some], axis=1)  # so that ties go to the smaller number
            d = np.stack([own_distances(self.x[some], c, near[:, k]) for k in range(b + 1)], axis=1)
            order = np.argsort(d, axis=1, kind="stable")
            ranked = np.take_along_axis(d, order, axis=1)
            self.near[some] = np.take_along_axis(near, order, axis=1)
            self.upper[some], self.lower[some, :-1] = _above(ranked[:, 0]), _below(ranked[:, 1:])
        if len(all_):
            depth = b
            new = Bounded.scanned(self.x[all_], c, b)
            self.near[all_], self.lower[all_], self.upper[all_] = new.near, new.lower, new.upper
        return depth


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind.value_type))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    every = _STATE | _SUMS
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in every.items()], list(every))


def passed(state: DataFrame, centroids: np.ndarray, way: np.ndarray | None, b: int, last: bool) -> DataFrame:
    """One assignment of all vectors: their new state, and for each task the changes of its centroids' sums.

    Without ``way`` the vectors have no bounds yet.  The last pass has exact
    distances in place of vectors and bounds.
    """
    shared = state.sparkSession.sparkContext.broadcast((centroids, way))

    def run(batches):
        c, far = shared.value
        n, sums, depth = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), np.int64)
            if far is None:
                held, before = Bounded.scanned(x, c, b), np.full(len(x), -1)
            else:
                held = Bounded(x, _matrix(batch.column(2), np.int32), _matrix(batch.column(3), np.float64), batch.column(4).to_numpy().copy())
                before = held.near[:, 0].copy()
                held.moved(far)
                depth = max(depth, held.settled(c))
                held.kept(b)
            own = held.near[:, 0]
            changed = np.flatnonzero(own != before)
            for side, sign in ((before[changed], -1), (own[changed], 1)):
                for k in np.unique(side[side >= 0]).tolist():
                    n[k] += sign * int((side == k).sum())
                    sums[k] += sign * x[changed[side == k]].sum(axis=0)
            told = {"vec_id": batch.column(0), "near": _lists(held.near, _STATE["near"])}
            if last:
                told["distance"] = pa.array(own_distances(x, c, own))
            else:
                told |= {"x": _lists(x, _STATE["x"]), "lower": _lists(held.lower, _STATE["lower"]), "upper": pa.array(held.upper)}
            yield _batch(told, len(x))
        some = np.flatnonzero(n.astype(bool) | sums.any(axis=1))
        at = np.r_[some, -1].astype(np.int32)  # one row of its own tells the depth
        yield _batch({"cluster": pa.array(at), "n": pa.array(np.r_[n[some], 0]), "sums": _lists(np.r_[sums[some], np.zeros((1, c.shape[1]), np.int64)], _SUMS["sums"]), "depth": pa.array(np.full(len(at), depth, np.int32))}, len(at))
        release()

    columns = ["vec_id", "x"] if way is None else ["vec_id", "x", "near", "lower", "upper"]
    return state.select(*columns).mapInArrow(run, _SCHEMA)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(_SCHEMA).parquet(path)


def changes(found: DataFrame, clusters: int, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The tasks' changes of numbers and sums, added up, and the depth; ``clusters * (dims + 1)`` rows reach the driver."""
    told = found.where("cluster is not null")
    n, sums = np.zeros(clusters, np.int64), np.zeros((clusters, dims), np.int64)
    parts = told.select("cluster", F.posexplode(F.concat("sums", F.array("n"))).alias("place", "value"))
    for r in parts.where("cluster >= 0").groupBy("cluster", "place").agg(F.sum("value").alias("value")).collect():
        if r["place"] == dims:
            n[r["cluster"]] = r["value"]
        else:
            sums[r["cluster"], r["place"]] = r["value"]
    return n, sums, told.agg(F.max("depth")).first()[0] or 0


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, bounds: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of ``vec_id, x`` rows, and the final centroids.

    ``bounds`` is how many lower bounds a vector has at first: a quarter of the centroids, unless given.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, clusters)
    k = len(centroids)
    if not k:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), centroids
    b = min(k - 1, max(1, k // 4) if bounds is None else bounds)
    n, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
    paths, state, way = [scratch(spark, "centroids-even"), scratch(spark, "centroids-odd")], vectors, None
    for step in range(rounds + 1):
        last = step == rounds
        found = _stored(passed(state, centroids, way, b, last), paths[step % 2])
        state = found.where("cluster is null")
        if last:
            break
        more_n, more_sums, depth = changes(found, k, centroids.shape[1])
        n, sums = n + more_n, sums + more_sums
        moved = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
        if way is not None:
            b = min(b, max(depth, k // 8, min(1, k - 1)))
        way, centroids, before = _above(((moved - centroids) ** 2).sum(axis=1)), moved, centroids
        if np.array_equal(before, centroids):
            # All further rounds are like this one.
            found = _stored(passed(state, centroids, way, b, True), paths[(step + 1) % 2])
            state = found.where("cluster is null")
            break
    return state.select("vec_id", F.col("near")[0].alias("cluster"), "distance"), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(scaled(table(spark, sf_dir, "embeddings")))
    # A row for each centroid.
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("total")).collect()}
    whole = sum(sums.values()) if None not in sums.values() else None
    told = [(j, sums[j], whole if whole is None or whole < 1 << 63 else None, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist()) if j in sums]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same rounds as SQL: an assignment and a table of centroids each."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (k.x[i] - c.x[i]) * (k.x[i] - c.x[i])))::BIGINT"
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1)::INT AS j, x FROM kept QUALIFY j < 8)",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"d{t} AS (SELECT k.r, k.vec_id, k.x, c.j, {distance} AS d FROM kept k CROSS JOIN c{t} c)")
        steps.append(f"a{t} AS MATERIALIZED (SELECT * FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if t < ROUNDS:
            steps.append(f"s{t} AS (SELECT j, i, sum(x[i]) AS s, count(*) AS n FROM a{t}, range(1, 65) AS places(i) GROUP BY j, i)")
            steps.append(f"m{t} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{t} GROUP BY j)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m USING (j))")
    t = ROUNDS
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT a.vec_id, a.j AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, "
        f"(sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{t} a JOIN c{t} c USING (j)"
    )


ORACLE = _oracle()
