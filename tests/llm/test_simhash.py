"""SimHash by covering masks against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import registry, simhash

SF = "/root/testdata/sf0.001"


def by_hand(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts_of(prints, radius=3):
    """For each fingerprint, the place of the first one of its component."""
    a, first = np.array(prints, np.uint64), {}
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    for i in range(len(a)):
        waiting = [] if i in first else [i]
        while waiting:
            k = waiting.pop()
            if k not in first:
                first[k] = i
                waiting += np.flatnonzero(near[k]).tolist()
    return [first[i] for i in range(len(a))]


def test_op11_equals_all_pairs(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist())
    prints = [by_hand(t) for _, t in docs]
    want = {d: (f"{p:016x}", docs[k][0]) for (d, _), p, k in zip(docs, prints, parts_of(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op11_simhash"](spark, SF).collect()} == want


@given(st.lists(st.integers(0, 63), min_size=3, max_size=3), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_masks_cover_every_few_positions(positions, radius):
    apart = sum({1 << p for p in positions[:radius]})
    for first in (m for m in simhash.covering_masks(list(range(64)), max(3, radius)) if not m & apart):
        assert any(not (m | first) & apart for m in simhash.covering_masks(simhash.free_positions(first), max(3, radius)))
    assert any(not m & apart for m in simhash.covering_masks(list(range(64)), max(3, radius)))


def test_two_masks_leave_few_positions_free():
    for first in simhash.covering_masks(list(range(64))):
        for second in simhash.covering_masks(simhash.free_positions(first)):
            assert len(simhash.free_positions(first | second)) <= 16


def flipped(rng, value, most):
    for p in rng.sample(range(64), rng.randint(0, most)):
        value ^= 1 << p
    return value


@pytest.mark.parametrize(("most", "small", "at_once"), [(1 << 14, 64, 1 << 20), (3, 2, 8), (20, 4, 50)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, most, small, at_once):
    """Chains, clusters and strangers; small constants send them through the second masks and large buckets."""
    for name, value in (("MOST", most), ("SMALL", small), ("AT_ONCE", at_once)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(most)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for centre in prints[:4]:
        prints += [flipped(rng, centre, 3) for _ in range(50)]
    for _ in range(60):
        prints.append(flipped(rng, prints[-1], 4))
    prints = sorted({*prints, 0, (1 << 64) - 1, 7})
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    given_ = spark.createDataFrame([(signed(p),) for p in prints], "print long").repartition(3)
    label, at = np.arange(len(prints)), {signed(p): i for i, p in enumerate(prints)}
    found = simhash.links(given_).collect()
    label = simhash.joined(label, np.array([at[r.a] for r in found]), np.array([at[r.b] for r in found]))
    assert label.tolist() == parts_of(prints)


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 63)), max_size=60), st.integers(1, 7), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_buckets_may_be_cut_anywhere(rows, batch, small):
    rows = sorted((k, 1 << p) for k, p in rows)
    key, prints = np.array([k for k, _ in rows], np.int64), np.array([p for _, p in rows], np.uint64)
    batches = [(key[i : i + batch], prints[i : i + batch]) for i in range(0, len(rows), batch)]
    before, simhash.SMALL = simhash.SMALL, small
    try:
        sizes = [len(np.unique(some)) for some, label in simhash.forests(batches, 2) if len(some) and len(np.unique(label)) == 1]
        joined = sum(len(some) - len(np.unique(label)) for some, label in simhash.forests(batches, 2))
    finally:
        simhash.SMALL = before
    # Powers of two differ in two bits or none, so each bucket is one part.
    assert joined == len(rows) - len(set(key.tolist()))
    assert all(n >= 1 for n in sizes)


def test_a_bucket_of_near_copies_lists_no_pairs_twice():
    prints = np.array([1 << p | 1 << q for p in range(40) for q in range(p)], np.uint64)
    assert set(simhash.whole_bucket(prints, 3).tolist()) == set(parts_of([int(p) for p in prints]))


def test_fingerprints_of_edge_cases(spark):
    schema = "doc_id long, text string, print long, component_id long, fingerprint string, salt int"
    long = " ".join(f"w{i % 977}" for i in range(100_000))
    texts = [None, "", " \t\n", "One", "one", "a b", "A  B", "a b c", long, long + " more", "é Ä b", "x y z w"]
    rows = [(i, t, 1, 1, "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[8], (None, "one", 1, 1, "clash", 1), (None, "alone in this table", 1, 1, "clash", 1), (7, "shares an id", 1, 1, "clash", 1)]
    found = simhash.near(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert sorted(r.fingerprint for r in found) == sorted(f"{by_hand(r[1]):016x}" for r in rows)
    of = {}
    for r in found:
        of.setdefault(r.fingerprint, set()).add(r.component_id)
    assert of[f"{by_hand('one'):016x}"] == {3} and of[f"{by_hand('a b'):016x}"] == {5} and of["0" * 16] == {0}
    assert of[f"{by_hand('alone in this table'):016x}"] == {None}
    none = simhash.near(spark.createDataFrame([], schema))
    assert none.columns == ["doc_id", "fingerprint", "component_id"] and none.count() == 0


def test_pieces_of_a_long_text_add_up(monkeypatch):
    words = [f"w{i * i % 101}".encode() for i in range(500)]
    whole = simhash.fingerprint(words)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(words) == whole
