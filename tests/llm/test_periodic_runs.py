"""Runs found by block matching against runs found by comparing all words at all distances."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import periodic_runs, registry

SF = "/root/testdata/sf0.001"


def by_hand(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if j > i and len(stretch) >= max(24, 3 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def periodic_words(draw):
    k, out = draw(st.sampled_from([1, 2, 3, 30])), []
    for _ in range(draw(st.integers(0, 5))):
        period = draw(st.lists(st.integers(0, k), min_size=1, max_size=40))
        out += (period * draw(st.integers(1, 9)))[: draw(st.integers(1, 250))]
        out += draw(st.lists(st.integers(0, k + 2), max_size=4))
    return out


@given(periodic_words(), st.sampled_from([1, 3, 1 << 15]))
@settings(max_examples=250, deadline=None)
def test_runs_equal_brute_force(words, piece):
    before, periodic_runs.PIECE = periodic_runs.PIECE, piece
    try:
        assert periodic_runs.runs_of(np.array(words, np.int64)) == by_hand(words)
    finally:
        periodic_runs.PIECE = before


def test_nested_and_overlapping_runs():
    a, b = [0] * 30 + [1], [2, 3] * 15
    words = a * 4 + b + [2] + a * 3
    found = periodic_runs.runs_of(np.array(words))
    assert found == by_hand(words)
    assert {p for _, _, p in found} == {1, 2, 31}


def test_a_run_needs_three_periods_and_its_length():
    for n, period, expected in [(23, 1, 0), (24, 1, 1), (29, 10, 0), (30, 10, 1), (24, 8, 1), (26, 9, 0), (27, 9, 1)]:
        words = (list(range(period)) * n)[:n]
        assert len(periodic_runs.runs_of(np.array(words))) == expected, (n, period)


@pytest.mark.parametrize("kind", ["one word", "two words", "long period", "fibonacci"])
def test_hard_texts_take_near_linear_time(kind):
    """From 20,000 to 80,000 words; the square would be 16 times as long."""
    rng = random.Random(2)

    def text(n):
        if kind == "one word":
            return np.zeros(n, np.int64)
        if kind == "two words":
            return np.array([rng.randrange(2) for _ in range(n)])
        if kind == "long period":
            return np.array(([rng.randrange(n) for _ in range(n // 4)] * 5)[:n])
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return np.array(b[:n])

    took = []
    for n in (20_000, 80_000):
        words = text(n)
        best = []
        for _ in range(2):
            began = time.process_time()
            periodic_runs.runs_of(words)
            best.append(time.process_time() - began)
        took.append(min(best))
    assert took[1] < 10 * took[0] + 0.5


def test_what_stays_and_the_greatest_exponent():
    runs = [(2, 30, 10), (5, 24, 8), (40, 31, 10)]
    stay = periodic_runs.kept_words(80, runs)
    assert stay.tolist() == [not (12 <= i < 32 or 13 <= i < 29 or 50 <= i < 71) for i in range(80)]
    assert periodic_runs.most_periodic(runs) == (40, 31, 10)
    assert periodic_runs.most_periodic([(2, 30, 10), (5, 24, 8), (5, 48, 16)]) == (2, 30, 10)
    assert periodic_runs.most_periodic([]) is None


def planted(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op13_equals_brute_force(spark):
    found = {r.doc_id: r for r in registry.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert len(found) == len(docs)
    checked = some = 0
    for doc_id, text in docs:
        words = planted((text or "").encode().split(), doc_id)
        if len(words) > 1500 and checked > 150:
            continue
        runs, r = by_hand(words), found[doc_id]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None, None, None)))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        checked, some = checked + 1, some + bool(runs)
    assert checked > 150 and some > 5


def test_collapsed_texts_of_edge_cases(spark):
    schema = "doc_id long, text string, runs string, start long"
    texts = [None, "", " \t\n", "one", "same " * 400, "a b " * 30 + "c", "x" * 60_000, "漢字 " * 25, " ".join(f"w{i}" for i in range(20_000))]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(4, "same " * 400, "clash", 1), (None, "same " * 30, "clash", 1)]
    found = periodic_runs.collapsed(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert len(found) == len(rows)
    of = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in found}
    assert of[0] == of[1] == of[2] == ("", []) and of[3] == ("one", [])
    assert of[4] == ("same", [(0, 400, 1)]) and of[5] == ("a b c", [(0, 60, 2)]) and of[7] == ("漢字", [(0, 25, 1)]) and of[None] == ("same", [(0, 30, 1)])
    assert of[6] == (texts[6], []) and of[8] == (texts[8], [])
    assert periodic_runs.collapsed(spark.createDataFrame([], schema)).count() == 0


def test_endings_are_planted_by_the_id():
    words = [f"w{i}".encode() for i in range(97)]
    hit = 0
    for doc_id in [*range(200), -5, 10**18]:
        for n in (0, 1, 2, 50, 97):
            assert periodic_runs.planted(words[:n], doc_id) == planted(words[:n], doc_id)
        hit += periodic_runs.planted(words, doc_id) != words
    assert hit > 5 and periodic_runs.planted(words, None) == words
