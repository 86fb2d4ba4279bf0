"""Periodic runs in texts, found by block matching.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical), at least ``LEAST`` words and three periods long, which no
neighbouring word extends keeping period ``q``.

*Blocks.*  Scale ``B`` (a power of two from ``FIRST``) looks for periods from ``B`` to
``2B - 1``, the first one for all smaller ones too.  A run of such a period holds an
aligned block of ``B`` words together with its copy one period on, as without its
last period it still has ``2B - 1`` words.  Each word of that block comes again within
``2B - 1`` words, so only blocks with that property are looked for.

*Search.*  A scale's distinct blocks are the integer-sequence keys of an
Aho-Corasick automaton, which is run over the document where these blocks lie.
A key has eight integers at every scale: runs of an eighth of a block are numbered
exactly, by doubling, and an automaton of longer keys would follow a failure link
for each word of a block at each match of a text like ``a a a a``.  An occurrence pairs with the one aligned block (of the first scale, at most two)
that lies at a distance of the scale before it, if that block is the same.
Blocks are taken ``PIECE`` at a time, so an automaton is bounded however long a
document is.

*Extension.*  A seed is extended word by word in both directions, in strides that
double.  Seeds inside a known run whose period divides their distance are left
out: by the theorem of Fine and Wilf the stretch would be that run again.  So what
remains has its distance as smallest period, and each run is extended once.

Defined cases.  A null or empty text has no words and no runs; so has a text of
fewer than ``LEAST`` words.  Rows are judged one by one: repeated rows, shared and
null ids change nothing, and a row with a null id is one of its own.  Texts of any
length are searched whole.  An empty table gives an empty result.  Other columns,
whatever their names, are ignored by ``collapsed`` and the query.
"""

from __future__ import annotations

import hashlib
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import release, small_batches, table, text_of
from graphloom.llm.words import words_of

#: A run has so many words, and so many periods, at least.
LEAST, PERIODS = 24, 3
#: Words of the smallest block (and integers of each key), and the most blocks of one automaton.
FIRST, PIECE = 8, 1 << 15


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def next_same(ids: np.ndarray) -> np.ndarray:
    """How far on each word comes again; beyond the end where it doesn't."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    out = np.full(n, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def doubled(names: np.ndarray, step: int) -> np.ndarray:
    """Numbers of all runs of ``2 * step`` words from those of all runs of ``step`` words."""
    pairs = names[:-step] * (names.max() + 1) + names[step:]
    return np.unique(pairs, return_inverse=True)[1]


def _occurrences(names: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(places, keys, keys of the blocks)``: where copies of the blocks (by their numbers, in order) begin, up to two sizes on.

    ``names`` number the runs of an eighth of ``size`` words.  A block is a key of
    eight of them, and every eighth's offset is a sequence of its own to search.
    """
    step = size // FIRST
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys: dict[tuple, int] = {}
    own = np.array([keys.setdefault(tuple(key), len(keys)) for key in names[blocks[:, None] * size + np.arange(0, size, step)].tolist()], np.int64)
    for key, number in keys.items():
        automaton.add_word(key, number)
    automaton.make_automaton()
    places, found = [], []
    # Stretches that blocks and their copies can reach, merged where they overlap.
    cuts = np.flatnonzero(np.diff(blocks) > 3) + 1
    for first, last in zip(blocks[np.r_[0, cuts]], blocks[np.r_[cuts - 1, len(blocks) - 1]], strict=True):
        begin, end = int(first) * size, min(len(names), (int(last) + 3) * size)
        for offset in range(begin, min(begin + step, end)):
            for at, key in automaton.iter(tuple(names[offset:end:step].tolist())):
                places.append(offset + (at - FIRST + 1) * step)
                found.append(key)
    return np.array(places, np.int64), np.array(found, np.int64), own


def _seeds(names: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, distance)`` of blocks that come again at a distance of their scale."""
    places, keys, own = _occurrences(names, blocks, size)
    key_of = np.full(int(blocks[-1]) + 1, -1)
    key_of[blocks] = own
    starts, distances = [], []
    for back in [size, 1] if size == FIRST else [size]:
        block = (places - back) // size
        known = (block >= 0) & (block < len(key_of))
        known[known] = key_of[block[known]] == keys[known]
        start, far = block[known] * size, places[known] - block[known] * size
        starts.append(start)
        distances.append(far)
    return np.concatenate(starts), np.concatenate(distances)


def _agree(left: np.ndarray, right: np.ndarray) -> int:
    """The length of the common beginning of two sequences."""
    n, at, step = min(len(left), len(right)), 0, 64
    while at < n:
        unlike = left[at : min(n, at + step)] != right[at : min(n, at + step)]
        if unlike.any():
            return at + int(unlike.argmax())
        at, step = min(n, at + step), 2 * step
    return n


def _not_covered(start: np.ndarray, far: np.ndarray, size: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which seeds (in the order of their places) lie in no run whose period divides their distance."""
    out = np.ones(len(start), bool)
    for begin, length, period in runs:
        i, j = np.searchsorted(start, [begin, begin + length])
        out[i:j] &= ~((start[i:j] + far[i:j] + size <= begin + length) & (far[i:j] % period == 0))
    return out


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period."""
    n, runs = len(ids), []
    if n < LEAST:
        return runs
    again, size, names, step = next_same(ids), FIRST, ids, 1
    while size == FIRST or PERIODS * size <= n:
        recurring = (again[: n // size * size] < 2 * size).reshape(-1, size).all(axis=1)
        blocks = np.flatnonzero(recurring)
        while len(blocks) and step < size // FIRST:
            names, step = doubled(names, step), 2 * step
        for piece in range(0, len(blocks), PIECE):
            start, far = _seeds(names, blocks[piece : piece + PIECE], size)
            # Divisors come first: what they cover needs no extension.  At larger scales no distance divides another.
            for some in [far == d for d in np.unique(far).tolist()] if size == FIRST else [np.ones(len(far), bool)]:
                i, d = start[some], far[some]
                order = np.argsort(i, kind="stable")
                i, d = i[order], d[order]
                left = _not_covered(i, d, size, runs)
                done: dict[int, int] = {}
                for at, q in zip(i[left].tolist(), d[left].tolist(), strict=True):
                    if at < done.get(q, 0):
                        continue
                    before = _agree(ids[: at][::-1], ids[: at + q][::-1][: at])
                    after = at + size + _agree(ids[at + size : n - q], ids[at + size + q :])
                    done[q] = after
                    begin, length = at - before, before + after - at + q
                    if length >= max(LEAST, PERIODS * q):
                        runs.append((begin, length, q))
        size *= 2
    return sorted(set(runs), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run keeps its first period: those that no run has after it."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def most_periodic(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exponent; of equals the one of smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, runs`` of each row: the words that stay, joined by one space, and all runs by start and period."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts, found = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                runs = runs_of(numbered(words))
                stay = kept_words(len(words), runs).tolist()
                texts.append(b" ".join(w for w, s in zip(words, stay, strict=True) if s).decode("utf-8", "surrogatepass"))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(found, _RUNS)], ["doc_id", "text", "runs"])
        release()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, text string, runs array<struct<start: long, length: long, period: long>>")


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a repeated ending, in one of ten documents by its id's checksum; without an id, as they are."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * ((n - a) // len(again) + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = planted(words_of(text.as_py()), doc_id)
                runs = runs_of(numbered(words))
                start, length, period = most_periodic(runs) or (None, None, None)
                stay = kept_words(len(words), runs).tolist() if runs else None
                left = b" ".join(w for w, s in zip(words, stay, strict=True) if s) if runs else b" ".join(words)
                told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                rows.append((doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, columns, strict=True)], names)
        release()

    given = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    schema = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names)
    return given.mapInArrow(run, schema)
