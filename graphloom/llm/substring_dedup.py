"""Removal of passages that an earlier document has, behind a count-min prefilter.

A window is ``WINDOW`` consecutive words.  First, every task counts, for its
documents, the windows' anchors in a count-min sketch: a window's anchor is the
least hash among its inner runs of ``ANCHOR`` words, so equal windows have equal
anchors and neighbouring windows mostly share one, which keeps the sketch small.
Merged, the sketches never underestimate in how many documents an anchor (hence
a window) occurs.  The second pass groups exactly, by 96-bit hash, only windows
whose estimate is two or more; none is lost.  The sketch has ``CELLS`` cells for
each anchor that texts of the corpus's length have, up to ``2**MOST_BITS``; where
a corpus fills that, more windows go to the exact pass and the result is the same.

A window whose estimate reaches ``HOT`` documents is dealt over ``SALTS`` tasks:
each finds the least id among its share, and the shares' least ids meet in a
second, small round.

A window that a document of smaller id has too is removed: all words it covers.
Windows are judged on the input.

Defined cases.  Null or empty text has no words.  A document shorter than a
window is left alone.  Documents with a null id neither lose words nor make
others lose any; rows of equal id don't affect each other.  A window that only
repeats within its document stays.  An empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import parallelism, release, small_batches, table, text_of, written
from graphloom.llm.words import U64, hashes, mix, words_of

WINDOW, ANCHOR = 50, 25
#: The sketch: rows, cells for each anchor, the logarithm of a row's length at least and at most, and that of the ranges in which it is merged.
ROWS, CELLS, LEAST_BITS, MOST_BITS, RANGE_BITS = 2, 4, 20, 28, 18
#: Bytes of a word with its gap, and windows for each anchor, as texts have them on average.
WORD_BYTES, WINDOWS = 6, 13
#: From so many documents a window is dealt over so many tasks; counters stop at 255.
HOT, SALTS = 200, 64

#: Odd multipliers of the two window hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Rolling:
    """Hashes of all runs of consecutive words, modulo 2**64, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def runs(self, h: np.ndarray, size: int) -> np.ndarray:
        if len(h) >= len(self.up):
            n = 2 * len(h) + 1
            self.up = np.cumprod(np.r_[U64(1), np.full(n, self.base)])
            self.down = np.cumprod(np.r_[U64(1), np.full(n, self.inverse)])
        sums = np.r_[U64(0), np.cumsum(h * self.up[: len(h)])]
        return (sums[size:] - sums[:-size]) * self.down[: len(h) - size + 1]


_rolling = [Rolling(b) for b in _BASES]


def windows(h: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """One 64-bit hash for each window, by its place."""
    return mix(_rolling[0].runs(h, size))


def seconds(h: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """32 more bits for each window."""
    return (mix(_rolling[1].runs(h, size)) >> U64(32)).astype(np.uint32).view(np.int32)


def anchors(h: np.ndarray, size: int = WINDOW, inner: int = ANCHOR) -> np.ndarray:
    """Each window's anchor: a sliding minimum of the inner runs' hashes, by doubling."""
    low, span = mix(_rolling[1].runs(h, inner)), 1
    width = size - inner + 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return low


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (anchor >> U64(row * 32)) & U64((1 << bits) - 1)


def bits_for(docs: DataFrame) -> int:
    """The logarithm of a row's length for the texts of a corpus."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (CELLS * n // (WORD_BYTES * WINDOWS)).bit_length()))


def _ranges(bits: int) -> int:
    """Ranges of a row."""
    return max(1, 1 << (bits - RANGE_BITS)) if bits > RANGE_BITS else 1


def _sketches(docs: DataFrame, size: int, inner: int, bits: int) -> DataFrame:
    """``g, cells, counts``: for each range of the sketch, the cells that a task has hit and how often."""
    per, names = _ranges(bits), ["g", "cells", "counts"]

    def run(batches):
        seen = [[] for _ in range(ROWS)]
        for batch in batches:
            for text in batch.column(1):
                h = hashes(words_of(text.as_py()))
                if len(h) >= size:
                    a = np.unique(anchors(h, size, inner))
                    for row in range(ROWS):
                        seen[row].append(_cells(a, row, bits).astype(np.uint32))
        for row in range(ROWS):
            if not seen[row]:
                continue
            cells, n = np.unique(np.concatenate(seen[row]), return_counts=True)
            n, cut = np.minimum(n, 255).astype(np.uint8), np.searchsorted(cells, np.arange(per + 1, dtype=np.uint64) << np.uint64(bits - per.bit_length() + 1))
            out = [(row * per + p, cells[i:j].tobytes(), n[i:j].tobytes()) for p, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if i < j]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    return docs.mapInArrow(run, "g int, cells binary, counts binary")


def estimated_repeated(docs: DataFrame, size: int = WINDOW, inner: int = ANCHOR, bits: int | None = None) -> tuple[int, dict[int, tuple[bytes, bytes]]]:
    """The sketch's ``bits``; for each of its ranges, a bit for each cell that counts two or more, and one for ``HOT`` or more."""
    bits = bits or bits_for(docs)
    per = _ranges(bits)
    length = (1 << bits) // per

    def merge(batches):
        at, total = None, None

        def done():
            packed = [zlib.compress(np.packbits(total >= least).tobytes(), 1) for least in (2, HOT)]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array(packed[:1], pa.binary()), pa.array(packed[1:], pa.binary())], ["g", "repeated", "hot"])

        for batch in batches:
            for g, cells, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if g != at:
                    if at is not None:
                        yield done()
                    at, total = g, np.zeros(length, np.uint8)
                cells = np.frombuffer(cells.as_buffer(), np.uint32) & np.uint32(length - 1)
                total[cells] = np.minimum(255, total[cells].astype(np.int64) + np.frombuffer(n.as_buffer(), np.uint8))
        if at is not None:
            yield done()

    # A task for each range, or as many as there are tasks; the bits of all are at most 2 * 2 * 2**28 / 8 bytes (128 MB).
    tasks = max(parallelism(docs.sparkSession), min(ROWS * per, 1024))
    dealt = _sketches(docs, size, inner, bits).repartition(tasks, "g").sortWithinPartitions("g")
    # All ranges are merged at once and written; the driver then only reads what is there.
    merged = written(dealt.mapInArrow(merge, "g int, repeated binary, hot binary"), "sketch")
    return bits, {row["g"]: (bytes(row["repeated"]), bytes(row["hot"])) for row in merged.toLocalIterator(prefetchPartitions=True)}


def _unpacked(found: dict[int, tuple[bytes, bytes]], bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By row, the bitmaps of repeated and of hot cells."""
    per = _ranges(bits)
    none = bytes(max(1, (1 << bits) // per // 8))
    whole = lambda k, row: np.frombuffer(b"".join(zlib.decompress(found[g][k]) if g in found else none for g in range(row * per, (row + 1) * per)), np.uint8)
    return [whole(0, row) for row in range(ROWS)], [whole(1, row) for row in range(ROWS)]


def _set(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    cells = cells.astype(np.int64)
    return (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def candidates(docs: DataFrame, found: dict[int, tuple[bytes, bytes]], size: int, inner: int, bits: int) -> DataFrame:
    """``h, g, doc_id, salt`` once for each document and window that the sketch takes for repeated; ``salt`` is -1 unless the window is hot."""
    shared, names = docs.sparkSession.sparkContext.broadcast(found), ["h", "g", "doc_id", "salt"]

    def run(batches):
        repeated, hot = _unpacked(shared.value, bits)
        marked = lambda rows, a: np.logical_and.reduce([_set(rows[r], _cells(a, r, bits)) for r in range(ROWS)])
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = hashes(words_of(text.as_py()))
                if len(h) < size:
                    continue
                a = anchors(h, size, inner)
                maybe = marked(repeated, a)
                if maybe.any():
                    w, at = np.unique(windows(h, size)[maybe], return_index=True)
                    salt = np.where(marked(hot, a[maybe][at]), int(mix(np.array([doc_id & (2**64 - 1)], U64))[0] % U64(SALTS)), -1)
                    out.append((w.view(np.int64), seconds(h, size)[maybe][at], np.full(len(w), doc_id, np.int64), salt.astype(np.int8)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
        release()

    return docs.mapInArrow(run, "h long, g int, doc_id long, salt byte")


def _least_first(rows: DataFrame) -> DataFrame:
    """``doc_id, h, g, head``: rows that aren't the first of their ``h, g, salt``, and (``head``) the first of salted ones.

    Rows come sorted, so a group's first row is its least id; a task holds one
    batch, however large a group is.
    """

    def run(batches):
        last = None
        for batch in batches:
            h, g, salt, doc = (batch.column(i).to_numpy() for i in range(4))
            now = (h[0], g[0], salt[0])
            same = np.r_[last is not None and now == last[:3], (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (salt[1:] == salt[:-1])]
            at = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            least = doc[at]
            if same[0]:
                least = np.where(np.cumsum(~same) == 0, last[3], least)
            last = (h[-1], g[-1], salt[-1], least[-1])
            head = ~same & (salt >= 0)
            keep = (doc > least) | head
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(h[keep]), pa.array(g[keep]), pa.array(head[keep])], ["doc_id", "h", "g", "head"])

    key = ["h", "g", "salt"]
    dealt = rows.select(*key, "doc_id").repartition(parallelism(rows.sparkSession), *key).sortWithinPartitions(*key, "doc_id")
    return dealt.mapInArrow(run, "doc_id long, h long, g int, head boolean")


def later_copies(rows: DataFrame) -> DataFrame:
    """``doc_id, h`` of windows that a document of smaller id has too."""
    found = written(_least_first(rows), "later-copies")
    heads = _least_first(found.where("head").select("h", "g", F.lit(-1).cast("byte").alias("salt"), "doc_id"))
    return found.where("not head").select("doc_id", "h").unionByName(heads.select("doc_id", "h"))


def covered(h: np.ndarray, gone: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which words a window in ``gone`` covers."""
    hit = np.isin(windows(h, size), gone.view(U64))
    edge = np.zeros(len(h) + 1, np.int64)
    edge[: len(hit)] += hit
    edge[size : size + len(hit)] -= hit
    return np.cumsum(edge[:-1]) > 0


def repeated_windows(docs: DataFrame, size: int = WINDOW, inner: int = ANCHOR, bits: int | None = None) -> DataFrame:
    """``doc_id, gone array<long>``: the hashes of each document's windows that go."""
    bits, found = estimated_repeated(docs, size, inner, bits)
    named = docs.where("doc_id is not null")
    return later_copies(candidates(named, found, size, inner, bits)).groupBy("doc_id").agg(F.collect_list("h").alias("gone"))


def _joined(docs: DataFrame, size: int, inner: int, bits: int | None) -> DataFrame:
    small_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return given.join(repeated_windows(given, size, inner, bits), "doc_id", "left")


def _kept(batch, size: int):
    """``(words, kept words, spans that went)`` of each row of a batch."""
    for text, gone in zip(batch.column(1), batch.column(2), strict=True):
        words = words_of(text.as_py())
        if gone.is_valid and len(words) >= size:
            out = covered(hashes(words), gone.values.to_numpy(), size)
            edges = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8))).tolist()
            keep = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
            yield words, keep, list(zip(edges[::2], edges[1::2], strict=True))
        else:
            yield words, words, []


def remove_repeats(docs: DataFrame, size: int = WINDOW, inner: int = ANCHOR, bits: int | None = None) -> DataFrame:
    """``doc_id, text`` (kept words, joined by one space) and ``spans`` of words that went, as ``[from, to)``."""

    def run(batches):
        for batch in batches:
            rows = list(_kept(batch, size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([b" ".join(k).decode("utf-8", "surrogatepass") for _, k, _ in rows]),
                    pa.array([[{"from": a, "to": b} for a, b in s] for _, _, s in rows], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                ],
                ["doc_id", "text", "spans"],
            )

    return _joined(docs, size, inner, bits).mapInArrow(run, "doc_id long, text string, spans array<struct<from: int, to: int>>")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what ``remove_repeats`` keeps, taken where the text is."""

    def run(batches):
        for batch in batches:
            rows = list(_kept(batch, WINDOW))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w, _, _ in rows], pa.int64()), pa.array([len(w) - len(k) for w, k, _ in rows], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for _, k, _ in rows])],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = _joined(table(spark, sf_dir, "documents"), WINDOW, ANCHOR, None)
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50),
win AS (SELECT doc_id, p, sha256(array_to_string(w[p:p+49], ' ')) AS h FROM starts),
least AS (SELECT h, min(doc_id) AS first_id FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN least USING (h) WHERE first_id < doc_id),
gone_lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: g IS NULL OR NOT list_contains(g, i)), ' ')) AS kept_sha256
FROM words LEFT JOIN gone_lists USING (doc_id)
"""
