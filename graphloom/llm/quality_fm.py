"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector: its distinct words hashed into ``DIMS`` places
(weighted so that a document's words have norm one), and in places of their own
some figures on its structure (shares of letters, capitals, digits, marks and
gaps, repetition of words and lines, lengths of words and lines) and metadata
(its length), each in bins.  A factorisation machine scores it by

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

where the pairwise part equals ``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``
(the sum-of-squares identity), so scoring takes time linear in the words.

The model is fitted on the driver on at most ``MOST_ROWS`` labelled documents of
the training folds, those of least hash; scoring covers every whole text.
Labels, language, source and ids are never inputs of a score.

Defined cases.  Null or empty text has no words and is scored from its structure
and the bias, so every row has a score between 0 and 1.  Labelled rows without
a document, or with a null label, are left out of the fit; of documents that share
a labelled id, the fit takes one.  Without any labelled row, every score is the
prior 0.5.  Repeated rows repeat their score.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from graphloom.llm.shared import new_name, release, small_batches, table, text_of
from graphloom.llm.words import hashes, words_of

DIMS, RANK, BINS = 1 << 15, 8, 12
#: Bound of the labelled sample that the model is fitted on.
MOST_ROWS = 6_000
EPOCHS, RATE, DECAY, SEED = 5, 0.08, 2e-5, 7
THRESHOLD, FOLDS = 0.3, 5


def structure(data: bytes, words: list[bytes]) -> np.ndarray:
    """Figures between 0 and 1 about a text as a whole."""
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    lower, upper, digits = counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum()
    gaps, high = counts[32] + counts[9:14].sum(), counts[128:].sum()
    marks = n - lower - upper - digits - gaps - high
    full_stops = counts[46] + counts[44]
    lines = data.split(b"\n")
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:])) if len(words) > 1 else 0  # noqa: B905
    m = max(1, len(words))
    return np.array(
        [
            lower / n, upper / n, digits / n, gaps / n, high / n, max(0, marks) / n, (max(0, marks) - full_stops) / n,
            distinct / m, again / m, len(set(lines)) / len(lines), min(1.0, np.log1p(len(words)) / 10), min(1.0, np.log1p(n) / 14),
            min(1.0, n / m / 16), min(1.0, np.log1p(n / len(lines)) / 10), min(1.0, max(map(len, words), default=0) / 64), min(1.0, full_stops / m),
        ]
    )


N_FIGURES = 16
PLACES = DIMS + N_FIGURES * BINS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of one document's vector."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    places = np.unique((hashes(list(set(words))) >> np.uint64(40)).astype(np.int64) % DIMS) if words else np.empty(0, np.int64)
    bins = np.minimum(BINS - 1, (structure(data, words) * BINS).astype(np.int64)) + np.arange(N_FIGURES) * BINS + DIMS
    values = np.r_[np.full(len(places), 1 / np.sqrt(max(1, len(places)))), np.full(N_FIGURES, 0.5)]
    return np.r_[places, bins], values


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, places: np.ndarray, values: np.ndarray) -> float:
        vx = self.v[places] * values[:, None]
        pairs = 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum())
        return float(self.bias + self.w[places] @ values + pairs)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
    """AdaGrad on the logistic loss; the order of rows and all random numbers are fixed."""
    rng = np.random.default_rng(SEED)
    m = Machine(0.0, np.zeros(PLACES), rng.normal(0, 0.02, (PLACES, RANK)))
    if not rows:
        return m
    positive = min(1 - 1e-3, max(1e-3, sum(y for _, _, y in rows) / len(rows)))
    m.bias = float(np.log(positive / (1 - positive)))
    gw, gv, gb = np.full(PLACES, 1e-6), np.full((PLACES, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            p, x, y = rows[i]
            v = m.v[p]
            vx = v * x[:, None]
            total = vx.sum(axis=0)
            raw = m.bias + m.w[p] @ x + 0.5 * ((total**2).sum() - (vx**2).sum())
            slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
            gb += slope * slope
            m.bias -= RATE * slope / np.sqrt(gb)
            d = slope * x + DECAY * m.w[p]
            gw[p] += d * d
            m.w[p] -= RATE * d / np.sqrt(gw[p])
            d = slope * (x[:, None] * (total - vx)) + DECAY * v
            gv[p] += d * d
            m.v[p] = v - RATE * d / np.sqrt(gv[p])
    return m


def fold(id_column: str) -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(FOLDS))


def trained(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Machine:
    """Fit on the labelled documents outside fold 0, at most ``most_rows`` of least hash."""
    small_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").where(fold("doc_id") != 0)
    chosen = known.select("doc_id", F.col("quality").cast("int").alias("y")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)

    def run(batches):
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype(np.int32).tobytes() for p, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary()), batch.column(2)], ["doc_id", "p", "x", "y"])

    # At most `most_rows` ids are broadcast, so texts don't move.
    texts = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    # One row for each id and label, whatever number of documents share the id, so no more than `most_rows` reach the driver.
    found = texts.mapInArrow(run, "doc_id long, p binary, x binary, y int").groupBy("doc_id", "y").agg(F.min(F.struct("p", "x")).alias("f"))
    rows = found.select("doc_id", "y", "f.*").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["p"]), r["y"]))
    return fit([(np.frombuffer(bytes(r["p"]), np.int32).astype(np.int64), np.frombuffer(bytes(r["x"])), r["y"]) for r in rows])


def _model(bias: float, packed: bytes) -> Machine:
    data = np.frombuffer(zlib.decompress(packed), np.float32)
    return Machine(bias, data[:PLACES], data[PLACES:].reshape(PLACES, RANK))


def scored(docs: DataFrame, machine: Machine, columns: list[str] | None = None, name: str = "__score") -> DataFrame:
    """``columns`` of ``docs`` (all, unless given) and the score, under a name that none of these has."""
    small_batches(docs.sparkSession)
    packed = zlib.compress(machine.w.astype(np.float32).tobytes() + machine.v.astype(np.float32).tobytes(), 1)
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, packed))
    kept = docs.select(*columns) if columns else docs
    # The text is passed once, and not on unless it is one of the columns.
    at = kept.columns.index("text") if "text" in kept.columns else None
    given = kept if at is not None else docs.select(*columns, "text")

    def run(batches):
        m = _model(*shared.value)
        for batch in batches:
            others = batch.columns if at is not None else batch.columns[:-1]
            scores = pa.array([m.score(t.as_py()) for t in (batch.column(at) if at is not None else batch.columns[-1])], pa.float64())
            yield pa.RecordBatch.from_arrays([*others, scores], [*batch.schema.names[: len(others)], name])
        release()

    return given.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, DoubleType())]))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = scored(docs, trained(docs, labels), ["doc_id"])
    predicted = F.when(F.col("__score") >= THRESHOLD, 1).otherwise(0).cast("int")
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("__score").alias("score"), predicted.alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    name = new_name(docs, "__score")
    return scored(docs, trained(docs, labels), name=name).where(F.col(name) >= threshold).drop(name)
