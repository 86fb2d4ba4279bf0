"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over cells of (source, language, topic).  The cells' weights
are raked: in turn, each marginal's cells are scaled so that the marginal meets
its target shares, until no marginal is off by more than ``TOLERANCE`` of all
tokens or ``ROUNDS`` rounds are done; what is left is told with the cells.  A
cell's lift is the ratio of its raked to its observed tokens.  A document is then
kept with probability ``min(1, c * lift)`` of its cell, ``c`` calibrated so that
the expected tokens are ``BUDGET`` of all; the draw is a hash of the document, so
it is the same on every run.

Targets.  Unless given, a marginal's target share goes with its observed share to
the power ``TEMPER``, which lifts small sources and holds down large ones.
Given targets are normalised over the values that occur.

Topics.  Documents are clustered by what they are about.  One pass counts, over
all documents, in how many each hashed word occurs; a second gives each document
a vector of ``DIMS`` numbers, the hashed sum of its words' counts (as logarithms)
weighted by their rarity, where words of more than the share ``COMMON`` of all
documents (as a language's particles are) or of less than ``RARE`` count nothing.  ``TOPICS``
centres are found by spherical k-means over all vectors; only its first centres
come from a bounded sample, ``SEEDS`` documents of least hash, each as far as
possible from those before.

Everything about cells is computed over aggregates; a source with a third of
all rows costs a few rows a task.  Cells reach documents by a broadcast of at most
``MOST_CELLS`` (counted first), else by a join that adaptive execution can split.

Defined cases.  Null text counts as empty and has no tokens: such a document is
kept with its cell's probability.  Null source or language is a value of its
own.  A text without any word that counts is of topic ``none``.  Repeated rows get
the same draw; rows without an id draw by their text.  Very long texts are
counted whole.  A cell without tokens has lift 1; without any tokens all
probabilities are ``BUDGET``.  An empty table gives an empty result.  Other
columns pass through or are ignored; helper columns get names that no column has.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.llm.shared import listed, new_name, parallelism, release, small_batches, table, text_of, written
from graphloom.llm.words import U64, hashes, words_of

TEMPER, BUDGET, ROUNDS, TOLERANCE = 0.7, 0.5, 50, 1e-9
TOPICS, DIMS, PASSES, SEEDS = 8, 64, 6, 256
#: The logarithm of the number of places for words' document counts; the shares of documents between which words count.
PLACE_BITS, COMMON, RARE = 18, 0.15, 0.001
#: Places that one task adds up; units in which vectors' components (1 at most) are added, enough for 2**35 vectors.
RANGE, FIXED = 1 << 10, float(1 << 28)
#: Cells (rows of three short strings and numbers) that the driver may hold.
MOST_CELLS = 100_000
CELL = ["source", "lang", "topic"]


class Topics:
    """Words' weights and topics' centres."""

    def __init__(self, weights: np.ndarray, centres: np.ndarray):
        self.weights, self.centres = weights, centres

    def vector(self, words: list[bytes]) -> np.ndarray:
        """The direction of a text, or zeros."""
        out = np.zeros(DIMS, np.float32)
        if words:
            h, n = np.unique(hashes(words), return_counts=True)
            weight = self.weights[(h >> U64(64 - PLACE_BITS)).astype(np.int64)] * np.log1p(n)
            sign = 1.0 - 2.0 * ((h >> U64(30)) & U64(1)).astype(np.float64)
            out = np.bincount((h & U64(DIMS - 1)).astype(np.int64), weights=weight * sign, minlength=DIMS)
            size = np.sqrt(out @ out)
            out = (out / size if size > 1e-9 else np.zeros(DIMS)).astype(np.float32)
        return out

    def topic(self, vector: np.ndarray) -> str:
        return f"t{int(np.argmax(self.centres @ vector))}" if len(self.centres) and vector.any() else "none"


def _lower_words(text: str | None) -> list[bytes]:
    return words_of(text, lower=True)


def word_weights(docs: DataFrame) -> np.ndarray:
    """Rarity by place, from the number of documents that each place's words occur in.

    Tasks' counts meet by ranges of places, so they are added up by as many tasks as
    there are ranges; the driver gets one row a range, 2 MB in all.
    """
    ranges, schema, names = (1 << PLACE_BITS) // RANGE, "g int, n long, counts binary", ["g", "n", "counts"]

    def told(g, n, counts):
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(n, pa.int64()), pa.array(counts, pa.binary())], names)

    def count(batches):
        total, n = np.zeros(1 << PLACE_BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                words = _lower_words(text.as_py())
                if words:
                    n += 1
                    total[np.unique(hashes(list(set(words))) >> U64(64 - PLACE_BITS)).astype(np.int64)] += 1
        parts = [(g, part) for g, part in enumerate(total.reshape(ranges, RANGE)) if part.any()]
        yield told([-1, *[g for g, _ in parts]], [n, *[0] * len(parts)], [None, *[_packed(part) for _, part in parts]])
        release()

    def add(batches):
        at, n, total = None, 0, np.zeros(RANGE, np.int64)
        for batch in batches:
            for g, more, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if g != at and at is not None:
                    yield told([at], [n], [_packed(total)])
                    n, total = 0, np.zeros(RANGE, np.int64)
                at, n = g, n + more
                if counts.is_valid:
                    total += _unpacked(counts.as_py())
        if at is not None:
            yield told([at], [n], [_packed(total)])

    counted = docs.select(text_of("text").alias("text")).mapInArrow(count, schema)
    dealt = counted.repartition(parallelism(docs.sparkSession), "g").sortWithinPartitions("g")
    total, n = np.zeros(1 << PLACE_BITS, np.int64), 0
    for row in written(dealt.mapInArrow(add, schema), "mix-words").collect():
        if row["g"] < 0:
            n = row["n"]
        else:
            total[row["g"] * RANGE : (row["g"] + 1) * RANGE] = _unpacked(bytes(row["counts"]))
    kept = (total >= max(2, RARE * n)) & (total <= max(2, COMMON * n))
    return np.where(kept, np.log(max(1, n) / np.maximum(1, total)), 0.0).astype(np.float32)


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def described(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, source, lang, drawn, tokens, vector``; tokens are words here."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["doc_id", "source", "lang", "drawn", "tokens", "vector"]

    def run(batches):
        model = Topics(shared.value, np.zeros((0, DIMS)))
        for batch in batches:
            *others, texts = batch.columns
            words = [_lower_words(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*others, pa.array([len(w) for w in words], pa.int64()), pa.array([model.vector(w).tobytes() for w in words], pa.binary())], names)
        release()

    kept = [F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"))]
    return docs.select(*kept, draw("doc_id", "text").alias("drawn"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, source string, lang string, drawn double, tokens long, vector binary")


def _first_centres(vectors: DataFrame, topics: int) -> np.ndarray:
    rows = vectors.where(F.col("vector") != F.lit(bytes(4 * DIMS))).select("vector").distinct().orderBy(F.xxhash64("vector")).limit(SEEDS).collect()
    found = np.array([np.frombuffer(bytes(r["vector"]), np.float32) for r in rows]).reshape(-1, DIMS)
    chosen = list(range(min(1, len(found))))
    while len(chosen) < min(topics, len(found)):
        near = (found @ found[chosen].T).max(axis=1)
        near[chosen] = np.inf
        chosen.append(int(np.argmin(near)))
    return found[chosen]


def centre_sums(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The vectors' sums by their nearest centre, in one job; ``len(centres) * DIMS`` rows reach the driver.

    Components are added as integers, so the order of tasks changes nothing.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        total = np.zeros(shared.value.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, DIMS)
                np.add.at(total, np.argmax(v @ shared.value.T, axis=1), np.rint(v.astype(np.float64) * FIXED).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.int64()))], ["centre", "sums"])

    parts = vectors.select("vector").mapInArrow(run, "centre int, sums array<long>").select("centre", F.posexplode("sums").alias("place", "value"))
    sums = np.zeros(centres.shape, np.int64)
    for r in parts.groupBy("centre", "place").agg(F.sum("value").alias("value")).collect():
        sums[r["centre"], r["place"]] = r["value"]
    return sums / FIXED


def fitted(vectors: DataFrame, weights: np.ndarray, topics: int = TOPICS, passes: int = PASSES) -> Topics:
    """Spherical k-means: each pass over all vectors sums them by centre within tasks, and tasks' sums by key."""
    centres = _first_centres(vectors, topics)
    for _ in range(passes if len(centres) else 0):
        sums = centre_sums(vectors, centres)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        # A centre that lost all documents stays where it was.
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres).round(6).astype(np.float32)
    return Topics(weights, centres)


def with_topics(rows: DataFrame, model: Topics) -> DataFrame:
    """``doc_id, source, lang, drawn, tokens, topic`` of described rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model.centres)

    def run(batches):
        found = Topics(np.zeros(0), shared.value)
        for batch in batches:
            *others, vectors = batch.columns
            topics = pa.array([found.topic(np.frombuffer(v.as_py(), np.float32)) for v in vectors], pa.string())
            yield pa.RecordBatch.from_arrays([*others, topics], [*batch.schema.names[:-1], "topic"])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, drawn double, tokens long, topic string")


def _targets(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float) -> DataFrame:
    """``cells`` with each marginal's wanted tokens, which add up to all tokens over the marginal's values."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    w = cells
    for c in CELL:
        if targets and c in targets:
            given = F.create_map(*[F.lit(x) for pair in targets[c].items() for x in pair])
            share = F.coalesce(given[F.col(c)], F.lit(0.0))
        else:
            share = F.pow(F.sum("tokens").over(Window.partitionBy(c)) / F.lit(max(1, total)), F.lit(temper))
        w = w.withColumn(f"want_{c}", share)
    sums = {c: w.groupBy(c).agg(F.first(f"want_{c}").alias("s")).agg(F.sum("s")).first()[0] or 1.0 for c in CELL}
    return w.withColumns({f"want_{c}": F.col(f"want_{c}") * F.lit(total / sums[c]) for c in CELL})


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, most_cells: int = MOST_CELLS) -> DataFrame:
    """``source, lang, topic, tokens, lift, off`` from ``source, lang, topic, tokens``.

    ``off`` is the largest share of all tokens by which a marginal misses its
    target in the end.  Up to ``most_cells`` cells (counted first) are raked as
    arrays on the driver, more as sums by marginal, written once a round.
    """
    w = written(_targets(cells, targets, temper), "mix-targets")
    lift = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(1.0)).alias("lift")
    if w.limit(most_cells + 1).count() > most_cells:
        w, off = w.withColumn("weight", F.col("tokens").cast("double")), None
        for _ in range(rounds):
            for c in CELL:
                # Few values have very many cells, so sums are taken within tasks first and joined back.
                sums = w.groupBy(F.col(c).alias("value")).agg(F.sum("weight").alias("now"))
                w = w.join(sums, F.col(c).eqNullSafe(F.col("value"))).withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.col(f"want_{c}") / F.col("now")).otherwise(F.col("weight"))).drop("value", "now")
            w = written(w, "mix-round")
            missed = [w.groupBy(c).agg(F.abs(F.sum("weight") - F.max(f"want_{c}")).alias("d")).agg(F.max("d")).first()[0] or 0.0 for c in CELL]
            off = max(missed) / max(1.0, w.agg(F.sum("weight")).first()[0] or 1.0)
            if off <= TOLERANCE:
                break
        return w.select(*CELL, "tokens", lift, F.lit(off).cast("double").alias("off"))
    rows = w.orderBy(*CELL).collect()
    weight = np.array([float(r.tokens) for r in rows])
    places = {}
    for c in CELL:
        known: dict = {}
        places[c] = (np.array([known.setdefault(r[c], len(known)) for r in rows], int), np.array([r[f"want_{c}"] for r in rows]))
    off = None
    for _ in range(rounds if rows else 0):
        for at, wanted in places.values():
            now = np.bincount(at, weights=weight)[at]
            weight = np.where(now > 0, weight * wanted / np.where(now > 0, now, 1), weight)
        off = float(max(np.abs(np.bincount(at, weights=weight)[at] - wanted).max() for at, wanted in places.values()) / max(1.0, weight.sum()))
        if off <= TOLERANCE:
            break
    schema = "source string, lang string, topic string, tokens long, weight double"
    done = cells.sparkSession.createDataFrame([(r.source, r.lang, r.topic, r.tokens, float(x)) for r, x in zip(rows, weight, strict=True)], schema)
    return done.select(*CELL, "tokens", lift, F.lit(off).cast("double").alias("off"))


def calibrated(cells: DataFrame, budget: float = BUDGET) -> float:
    """``c`` for which the expected tokens are ``budget`` of all: three rounds of sums for 64 candidates each."""
    low, high = 0.0, None
    top = cells.agg(F.sum("tokens"), F.min(F.when(F.col("lift") > 0, F.col("lift")))).first()
    if not top[0] or not top[1]:
        return budget
    high = 1 / top[1]
    for step in range(3):
        grid = np.geomspace(high * 1e-6, high, 64) if step == 0 else np.linspace(low, high, 64)
        sums = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(float(c)) * F.col("lift"))).alias(f"c{i}") for i, c in enumerate(grid)]).first()
        i = next((i for i, s in enumerate(sums) if s >= budget * top[0]), 63)
        low, high = float(grid[max(0, i - 1)]), float(grid[i])
    return high


def draw(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """Uniform in [0, 1), from the id, or the text where there is none: 52 bits of a SHA-256."""
    of = F.coalesce(F.concat(F.lit("mix:"), F.col(id_column).cast("long").cast("string")), F.concat(F.lit("text:"), text_of(text_column)))
    return F.conv(F.substring(F.sha2(of.cast("binary"), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def planned(docs: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float) -> tuple[DataFrame, DataFrame, Topics]:
    """Described rows with topics; cells with ``probability``, and the topics' model."""
    small_batches(docs.sparkSession)
    weights = word_weights(docs)
    vectors = written(described(docs, weights), "mix-vectors")
    model = fitted(vectors.select("vector"), weights)
    rows = written(with_topics(vectors, model), "mix-rows")
    observed = written(rows.groupBy(*CELL).agg(F.sum("tokens").alias("tokens")), "mix-observed")
    cells = written(raked(observed, targets), "mix-cells")
    c = calibrated(cells, budget)
    return rows, written(cells.withColumn("probability", F.least(F.lit(1.0), F.lit(c) * F.col("lift"))), "mix-chances"), model


def _told(rows: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    """Rows joined to their cells, broadcast where they are few."""
    few = cells.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    same = [F.col(f"`{n}`").eqNullSafe(F.col(f"cell_{c}")) for n, c in zip(names, CELL, strict=True)]
    told = cells.select(*[F.col(c).alias(f"cell_{c}") for c in CELL], F.col("lift").alias("cell_lift"), F.col("probability").alias("cell_probability"))
    return rows.join(F.broadcast(told) if few else told, same[0] & same[1] & same[2])


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, lift, probability, sampled`` for each row."""
    rows, cells, _ = planned(docs, targets, budget)
    sampled = (F.col("drawn") < F.col("cell_probability")).alias("sampled")
    return _told(rows, cells, CELL).select("doc_id", *CELL, "tokens", F.col("cell_lift").alias("lift"), F.col("cell_probability").alias("probability"), sampled)


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled rows with all their columns, which stay where they are: each row finds its topic once more."""
    _, cells, model = planned(docs, targets, budget)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.centres))
    names = [new_name(docs, f"mix_{c}") for c in (*CELL, "drawn")]
    at = docs.columns.index("text")

    def run(batches):
        found = Topics(*shared.value)
        for batch in batches:
            topics = pa.array([found.topic(found.vector(_lower_words(t.as_py()))) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, topics], [*batch.schema.names, names[2]])
        release()

    given = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[2], StringType())]))
    given = given.withColumns({names[0]: F.col("source").cast("string"), names[1]: F.col("lang").cast("string"), names[3]: draw()})
    return _told(given, cells, names[:3]).where(F.col(names[3]) < F.col("cell_probability")).select(*listed(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
