"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits: a bit is set if it is set in over half the
hashes of the document's word shingles, repeats included.  Two fingerprints link
if they differ in at most ``RADIUS`` bits.

*Covering masks.*  Each bit position has a vector of ``RADIUS + 1`` binary
coordinates, not all zero.  Each such vector ``v`` is a table: its mask has the
positions whose vectors have an odd product with ``v``.  Whatever ``RADIUS``
positions two fingerprints differ in, their vectors leave a ``v`` that has even
products with all of them, as so few linear equations can't determine that many
coordinates; that table's mask has none of these positions.  So every pair
within the radius is equal under some mask of the 15: no pair is missed, and none
is left to chance.  A mask has some half of all positions.

*Buckets.*  Equal fingerprints are one, so copies, however many, cost nothing here.
Its masked values are counted by table.  A bucket of at most ``MOST`` fingerprints
is compared whole in one task, as integers.  The fingerprints of a larger one (a
bitmap of fixed size tells them, and one that it tells by accident is treated in
the same way) differ in the free positions of the mask alone, so these are covered
by a second family of masks in the same manner.  What is still free then is at
most 16 positions: no bucket can have more fingerprints than that has values.

*Links.*  A bucket yields a spanning forest of its links, never all pairs, and
components join the forests.  Buckets come sorted, so a task holds one at a time.

Defined cases.  Null or empty text, or one without words: fingerprint zero, linked
like any other.  Fewer words than a shingle: the whole sequence is the one shingle.
Each row is a node of its own; rows that share an id are linked only by their
texts.  ``component_id`` is the least id that isn't null among the rows reached,
or null if there is none.  Ties of a bit's votes leave it clear.  Very long texts
are hashed whole, a piece at a time.  An empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.shared import bitmap, marked, parallelism, release, salt_mask, salt_of, salts_of, small_batches, table, text_of, written
from graphloom.llm.words import U64, words_of

WORDS, SEED, BITS, RADIUS = 3, 42, 64, 3
#: A bucket of so many fingerprints is compared whole: cheaper than 15 rows more for each of them.
MOST = 1 << 14
#: Buckets up to this size are compared many at a time.
SMALL = 64
#: The most comparisons made at once, and links that are held before they are joined.
AT_ONCE = 1 << 20
#: The logarithm of the length of the bitmap of large buckets; 2 MB are broadcast.
HOT_BITS = 24
#: Shingles whose bits are counted at once.
PIECE = 1 << 15


def fingerprint(words: list[bytes], size: int = WORDS) -> int:
    """64 bits as a signed number."""
    if not words:
        return 0
    text, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    begin, end = starts[:n], ends[min(size, len(words)) - 1 :]
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        shingles = [text[i:j] for i, j in zip(begin[at : at + PIECE].tolist(), end[at : at + PIECE].tolist(), strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.dtype("<u8"), len(shingles))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print`` of each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [fingerprint(words_of(t.as_py(), lower=True), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "print"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, print long")


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions`` such that any ``radius`` of them are outside of some mask, as signed numbers."""
    vectors = 2 ** (radius + 1) - 1
    vector_of = {p: 1 + i % vectors for i, p in enumerate(positions)}
    masks = [sum(1 << p for p, m in vector_of.items() if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def free_positions(mask: int) -> list[int]:
    return [p for p in range(BITS) if not mask >> p & 1]


def _key(masks: list[int], of: str = "print") -> Column:
    """A number for each table and masked value; where two meet by accident, buckets share a task, which changes nothing."""
    return F.array(*[F.xxhash64(F.lit(t), F.col(of).bitwiseAND(F.lit(m).cast("long"))) for t, m in enumerate(masks)])


def first_keys(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``table, key, print`` for each mask."""
    return prints.select(F.posexplode(_key(covering_masks(list(range(BITS)), radius))).alias("table", "key"), "print")


def second_keys(hot: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``key, print`` for each mask over what the first mask leaves free, together with the first one."""
    families = [[m | first for m in covering_masks(free_positions(first), radius)] for first in covering_masks(list(range(BITS)), radius)]
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in family]) for family in families])
    chosen = F.transform(masks[F.col("table")], lambda m, w: F.xxhash64(F.col("table"), w, F.col("print").bitwiseAND(m)))
    return hot.select(F.explode(chosen).alias("key"), "print")


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least of its part) once the ends of links have joined."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, deeper := label[label]):
            label = deeper


def whole_bucket(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a large bucket the first of its part; pairs that are joined already are not listed."""
    n = len(prints)
    label, rows = np.arange(n), max(1, AT_ONCE // n)
    for i in range(0, n, rows):
        # Rows against themselves and what comes after.
        near = np.bitwise_count(prints[i : i + rows, None] ^ prints[None, i:]) <= radius
        near &= label[i : i + rows, None] != label[None, i:]
        a, b = np.nonzero(near)
        label = joined(label, a + i, b + i)
    return label


def small_buckets(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """The same for many buckets, one distance between rows at a time."""
    label, held_a, held_b, held = np.arange(len(prints)), [], [], 0
    end, at = np.repeat(starts + sizes, sizes), np.arange(len(prints))
    for d in range(1, int(sizes.max(initial=0))):
        at = at[at + d < end[at]]
        a = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= radius]
        held_a.append(a)
        held_b.append(a + d)
        held += len(a)
        if held > AT_ONCE:
            label, held_a, held_b, held = joined(label, np.concatenate(held_a), np.concatenate(held_b)), [], [], 0
    return joined(label, np.concatenate(held_a), np.concatenate(held_b)) if held else label


def forests(batches, radius: int = RADIUS):
    """``(a, b)`` arrays of a spanning forest of each bucket's links, from sorted ``(key, print)`` arrays."""

    def done(key, prints):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        for k in np.flatnonzero(sizes > SMALL).tolist():
            some = prints[starts[k] : starts[k] + sizes[k]]
            yield some, whole_bucket(some, radius)
        few = (sizes > 1) & (sizes <= SMALL)
        some = prints[np.repeat(few, sizes)]
        yield some, small_buckets(some, np.cumsum(sizes[few]) - sizes[few], sizes[few], radius)

    parts: list = []
    for more_key, more_prints in batches:
        if not len(more_key):
            continue
        parts.append((more_key, more_prints))
        if more_key[-1] == parts[0][0][0]:
            continue  # one bucket so far
        key, prints = (np.concatenate(c) for c in zip(*parts, strict=True))
        # The last bucket may go on in the next batch.
        cut = int(np.searchsorted(key, key[-1]))
        yield from done(key[:cut], prints[:cut])
        parts = [(key[cut:], prints[cut:])]
    if parts:
        yield from done(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def bucket_links(keys: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b`` of ``key, print`` rows."""

    def run(batches):
        arrays = ((b.column(0).to_numpy(), b.column(1).to_numpy().view(U64)) for b in batches)
        for prints, label in forests(arrays, radius):
            hangs = np.flatnonzero(label != np.arange(len(label)))
            if len(hangs):
                yield pa.RecordBatch.from_arrays([pa.array(prints[hangs].view(np.int64)), pa.array(prints[label[hangs]].view(np.int64))], ["a", "b"])
        release()

    dealt = keys.select("key", "print").repartition(parallelism(keys.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that join all distinct fingerprints within the radius, in one or more steps."""
    keys = first_keys(prints, radius)
    large = written(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("key"), "large-buckets")
    if large.isEmpty():
        return bucket_links(keys, radius)
    told = marked(keys, F.col("key"), written(bitmap(large, F.col("key"), HOT_BITS), "large-bitmap"), HOT_BITS, "large")
    return bucket_links(told.where("not large"), radius).unionByName(bucket_links(second_keys(told.where("large"), radius), radius))


def near(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row."""
    rows = written(fingerprints(docs, words, id_col, text_col).withColumn("salt", salt_of("doc_id")), "fingerprints")
    # One row for each fingerprint, reduced within tasks first: one may be that of most rows.
    prints = written(rows.groupBy("print").agg(F.min("doc_id").alias("least_id"), salt_mask("salt").alias("salts")), "distinct-prints")
    named = written(components(written(links(prints.select("print"), radius), "near-prints")), "print-components")
    least = prints.join(named.withColumnRenamed("node", "print"), "print").groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("node").alias("print"), "component_id", F.lit(True).alias("linked"))
    told = prints.join(named, "print", "left").select("print", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"), salts_of("salts").alias("salt"))
    shown = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return rows.join(told, ["print", "salt"]).select("doc_id", shown, "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "documents"))
