"""Each operator on small tables: edge cases against brute force."""

from __future__ import annotations

import collections
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat_format, components, exact_dedup, jaccard_join, mixing, quality_fm, shared, substring_dedup, syncmers, url_filter, warc, words

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, component_id long, score double, tokens string"


def doc_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    near = [*base[:150], "changed", *base[151:]]
    far = [rng.choice(vocabulary) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [
        " ".join(base), " ".join(near), " ".join(base), " ".join(far), None, "", " \t\n", "one", "One two  three", "one two three", " ".join(passage + far[:40]),
        " ".join([rng.choice(vocabulary) for _ in range(30)] + passage), "same " * 400, "same " * 400, "x" * 60_000, "漢字" * 500, "a b c d e f", "a b c d e f g", " ".join(rng.choice(vocabulary) for _ in range(9000)),
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t), "clash", -1, 0.5, "clash") for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, " ".join(base), "en", "s0", 1, "clash", -1, 0.5, "clash"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def word_list(text):
    return (text or "").encode().split()


# ---- exact deduplication -------------------------------------------------------------


def test_exact_dedup_keeps_the_largest_id_and_one_of_repeated_rows(spark, docs):
    index = exact_dedup.DigestIndex(spark, shared.scratch(spark, "t"))
    found = exact_dedup.dedup(docs, index).collect()
    groups = collections.defaultdict(list)
    for r in doc_rows():
        groups[r[1] or ""].append(r[0])
    assert len(found) == len(doc_rows())
    kept = collections.Counter()
    for r in found:
        ids = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).digest() == bytes(r.digest))
        assert r.keep_id == max(i for i in ids if i is not None) and r.group_size == len(ids)
        kept[bytes(r.digest)] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_against_earlier_batches(spark, docs, none):
    path = shared.scratch(spark, "t")
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    first = exact_dedup.keep_new(docs, index)
    assert first.columns == docs.columns and first.count() == len({r[1] or "" for r in doc_rows()})
    index.forget()
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    assert again.totals().count() == first.count()
    fresh = spark.createDataFrame([(100, "new"), (101, "new"), (102, "one")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.keep_new(fresh, again).collect()} == {101}
    assert exact_dedup.dedup(none, again).count() == 0 and exact_dedup.keep_new(none, again).count() == 0


@pytest.mark.parametrize("bits", [15, 24])
def test_survivors_keep_their_columns_whatever_the_bitmaps_say(spark, docs, bits, monkeypatch):
    """With few cells nearly all rows pass the bitmaps and the joins alone decide."""
    monkeypatch.setattr(exact_dedup, "digest_of", lambda c: F.unhex(F.sha2(shared.text_of(c).cast("binary"), 256)))
    clash = docs.withColumns({"keep_id": F.lit(1), "row": F.lit(2), "may_stay": F.lit(True), "told_digest": F.lit("x"), "salt": F.lit(0)})
    many = clash.unionByName(spark.range(1000, 4000).select(*[(F.col("id") if c == "doc_id" else F.concat(F.lit("t"), (F.col("id") % 2900).cast("string")) if c == "text" else F.lit(None)).cast(t).alias(c) for c, t in clash.dtypes]))
    out = exact_dedup.keep_new(many, exact_dedup.DigestIndex(spark, shared.scratch(spark, "t")), bits=bits)
    rows = [(r["doc_id"], r["text"] or "") for r in many.collect()]
    last = {}
    for i, t in rows:
        last[t] = max(last.get(t, -1), -1 if i is None else i)
    assert out.columns == many.columns
    assert collections.Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == collections.Counter((i, t) for t, i in last.items())


def test_digest_index_over_batches_retries_and_compaction(spark):
    rng = random.Random(4)
    index = exact_dedup.DigestIndex(spark, shared.scratch(spark, "t"), buckets=4)
    batches = [[(100 * b + i, f"t{rng.randrange(25)}") for i in range(30)] for b in range(4)]
    keeper, size = {}, collections.Counter()

    def run(b):
        rows = spark.createDataFrame(batches[b], "doc_id long, text string")
        return {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(rows, index, batch=f"b{b}").collect()}

    texts = dict(row for rows in batches for row in rows)
    for b, rows in enumerate(batches):
        fresh = {t for _, t in rows} - set(keeper)
        for t in fresh:
            keeper[t] = max(i for i, u in rows if u == t)
        size.update(t for _, t in rows)
        want = {(i, keeper[t], size[t], i == keeper[t]) for i, t in rows}
        assert run(b) == want
        if b in (1, 2):
            assert run(b) == want  # a batch that is run again decides as before
        if b == 2:
            index.compact()
            assert len(index.parts()) == 1 and run(b) == want
    totals = {(bytes(r.digest), r.keep_id, r.n) for r in index.totals().collect()}
    assert totals == {(hashlib.sha256(t.encode()).digest(), keeper[t], size[t]) for t in size} and set(size) <= set(texts.values())
    index.compact()
    before = index.totals().collect()
    assert sorted(map(str, before)) == sorted(map(str, index.totals().collect())) and len(before) == len(size)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_compacted_index_is_joined_without_shuffle_or_sort_of_its_side(spark, docs):
    index = exact_dedup.DigestIndex(spark, shared.scratch(spark, "t"), buckets=4)
    for b in range(3):
        exact_dedup.dedup(docs.withColumn("text", F.concat(F.col("text"), F.lit(b))), index).count()
    index.compact()
    batch = spark.range(10).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest")).repartition(4, "digest").sortWithinPartitions("digest")
    with exact_dedup.sorted_scans(spark):
        plan = plan_of(batch.join(index.before("x").where("first").hint("merge"), "digest", "left_anti"))
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    side = plan[: plan.index("FileScan")].split("SortMergeJoin")[1].splitlines()[1:]
    tail = plan[plan.index("SortMergeJoin") :].splitlines()
    index_side = [line for line in tail if "digest_index" in line or "FileScan" in line]
    assert index_side and plan.count("Sort [") == 1 and plan.count("Exchange") == 1 and side


# ---- n-gram Jaccard join ---------------------------------------------------------------


def brute_components(rows):
    sets = []
    for doc_id, text in rows:
        w = [x.decode() for x in (text or "").encode().lower().split()]
        s = {" ".join(w)} if 0 < len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
        sets.append((doc_id, s))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(sets):
        least[root(i)].append(doc_id)
    known = lambda ids: min((x for x in ids if x is not None), default=None)
    return collections.Counter((doc_id, len(s), known(least[root(i)])) for i, (doc_id, s) in enumerate(sets))


def edited_rows(rng):
    rows = []
    for n in (1, 4, 5, 7, 12, 30, 80, 200):
        base = [f"v{rng.randrange(10_000)}" for _ in range(n)]
        for k in range(8):
            edited = list(base)
            for _ in range(k * n // 60):
                edited[rng.randrange(n)] = f"v{rng.randrange(10_000)}"
            rows.append((1000 + len(rows), " ".join(edited)))
    return rows


def found_components(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect())


def test_jaccard_join_equals_all_pairs_with_null_shared_and_repeated_ids(spark, docs, none):
    rows = [(r[0], r[1]) for r in doc_rows()] + edited_rows(random.Random(8))
    rows += [(None, rows[-1][1]), (None, "no other text has these words at all"), (5, rows[-20][1]), (5, rows[0][1]), (1003, "another text of an id that is taken")]
    given_docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"class": F.lit("clash"), "own": F.lit(1), "g": F.lit(2)}).repartition(4)
    assert found_components(given_docs) == brute_components(rows)
    assert jaccard_join.join(none).count() == 0


@pytest.mark.parametrize("few,sets,elements", [(2, 5, 1_500_000), (16, 3, 400), (2, 1024, 400)])
def test_jaccard_join_in_small_chunks(spark, monkeypatch, few, sets, elements):
    """Hubs, chunk pairs and parts kept as pairs give what pairs and whole parts give."""
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", sets)
    monkeypatch.setattr(jaccard_join, "CHUNK_ELEMENTS", elements)
    monkeypatch.setattr(jaccard_join, "CHUNK_HISTOGRAMS", 7 * 128)
    monkeypatch.setattr(jaccard_join, "_candidates", lambda index, rows=jaccard_join._candidates: rows(index, few))
    rng = random.Random(2)
    rows = edited_rows(rng)
    base = [f"v{i}" for i in range(120)]
    for i in range(40):
        edited = list(base)
        edited[rng.randrange(120)] = f"u{i}"
        rows.append((i, " ".join(edited)))
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans(), st.integers(0, 9)), max_size=60), st.integers(1, 9), st.integers(1, 5))
def test_candidates_connect_all_that_share_a_key(rows, batch, few):
    """Whatever the batches: each pair under a key is given, or both are members of one hub."""
    held = sorted({(k << 1 | d, c) for k, d, c in rows})
    arrays = [(np.array([k for k, _ in part], np.int64), np.array([c for _, c in part], np.int64)) for part in (held[i : i + batch] for i in range(0, len(held), batch))]
    pairs, hubs = set(), collections.defaultdict(set)
    for hub, a, b in jaccard_join.candidate_rows(iter(arrays), few):
        for h, x, y in zip(hub.tolist(), a.tolist(), b.tolist(), strict=True):
            if h:
                hubs[x] |= {x, y}
            else:
                pairs.add((x, y))
    for k, c in held:
        for j, d in held:
            if k >> 1 == j >> 1 and c < d and not (k & 1 and j & 1):
                assert (c, d) in pairs or any({c, d} <= m for m in hubs.values())


def test_classes_of_one_name_are_told_apart(spark, monkeypatch):
    """With first halves of three bits nearly all classes share a name, and get one of both halves."""
    digest = jaccard_join.digest_of

    def short(tokens):
        first, second = digest(tokens)
        return first & 7, second

    rows = edited_rows(random.Random(4))
    name = {}
    for _, text in rows:
        s = words.shingle_set(words.words_of(text, lower=True))
        if len(s):
            name[s.tobytes()] = short(s)
    halves = spark.createDataFrame([(i, k, *name[s], 1, b"h") for i, (k, s) in enumerate((len(x) // 8, x) for x in name)], "doc_id long, n_shingles long, class long, check long, own long, histogram binary")
    named, classes, same = jaccard_join._classes(halves.unionByName(halves).withColumn("salt", F.lit(0)))
    assert classes.count() == len(name) and classes.select("class").distinct().count() == len(name) and same == {a for a, n in collections.Counter(a for a, _ in name.values()).items() if n > 1} != set()
    monkeypatch.setattr(jaccard_join, "digest_of", short)
    for s, (a, b) in name.items():
        assert jaccard_join.class_of(np.frombuffer(s, np.uint64), same) == (a ^ b if a in same else a)
    assert {r.n_rows for r in classes.collect()} == {2} and named.count() == 2 * len(name)


def test_key_counts_add_up_by_range(spark):
    rng = np.random.default_rng(3)
    parts = []
    for _ in range(5):
        costs = jaccard_join.Costs()
        costs.add(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
        costs.counts[0, 5] = 30_000
        parts.append(costs)
    rows = [(g, bytearray(part)) for c in parts for g, part in c.ranges()]
    total = jaccard_join._merged(spark.createDataFrame(rows, "g int, sketch binary").repartition(4))
    want = np.minimum(65535, sum(c.counts.astype(np.int64) for c in parts))
    assert np.array_equal(total, want) and total[0, 5] == 65535


def test_near_survivors(spark, docs, none):
    clash = docs.withColumns({"id_that_goes": F.lit(1), "may_go": F.lit(2), "component_id": F.lit(3), "a `name`": F.lit(4)})
    out = jaccard_join.keep_one(clash)
    found = jaccard_join.join(clash).collect()
    gone = {r.doc_id for r in found if r.doc_id is not None and r.doc_id != r.component_id}
    assert gone == {1, 2, 9, 13} and out.columns == clash.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(r[0] for r in doc_rows() if r[0] not in gone)
    assert jaccard_join.keep_one(none).count() == 0


PLAN = jaccard_join.Plan()


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 400), st.integers(0, 2**32), st.booleans())
def test_similar_sets_share_a_key(size, seed, sketched):
    """The pigeonhole: any pair at the threshold meets under some key, whatever the costs are."""
    rng = np.random.default_rng(seed)
    r = np.unique(rng.integers(0, 2**63, size=size, dtype=np.uint64) << np.uint64(1))
    gone, new = int(rng.integers(0, size // 5 + 1)), int(rng.integers(0, size // 4 + 1))
    while new and 100 * (len(r) - gone) < 80 * (len(r) + new):
        new -= 1
    s = np.unique(np.r_[rng.permutation(r)[gone:], rng.integers(0, 2**63, size=new, dtype=np.uint64) << np.uint64(1) | np.uint64(1)])
    both = len(np.intersect1d(r, s))
    if 100 * both < 80 * (len(r) + len(s) - both) or np.array_equal(r, s):
        return
    costs = jaccard_join.Costs()
    if sketched:
        costs.counts[:] = rng.integers(0, 60_000, costs.counts.shape)
    keys = [collections.defaultdict(set) for _ in range(2)]
    for held, x in zip(keys, (r, s), strict=True):
        for k in jaccard_join.signature_rows(x, costs, PLAN).tolist():
            held[k >> 1].add(k & 1)
    assert any(k in keys[1] and not (keys[0][k] == keys[1][k] == {1}) for k in keys[0])


def test_parts_do_not_depend_on_when_pairs_are_settled(monkeypatch):
    """Whatever number of pairs is held, a part has all that possible pairs connect."""
    rng = np.random.default_rng(0)
    for most in (0, 1, 5):
        monkeypatch.setattr(jaccard_join, "MOST_PAIRS", most)
        for _ in range(100):
            place = rng.integers(0, 60, 24)
            histograms = np.zeros((24, jaccard_join.PLACES), np.uint8)
            histograms[:, 0], histograms[:, 1] = 100 + place, 160 - place
            sizes = histograms.sum(axis=1, dtype=np.int64)
            possible = 2 * np.abs(place[:, None] - place[None, :]) <= 10 * 2 * sizes[0] // 190
            first = jaccard_join.labels_of(possible)
            alone = possible.sum(axis=1) == 1
            assert jaccard_join.possible_parts([h.tobytes() for h in histograms], sizes, 90).tolist() == np.where(alone, -1, first).tolist()


@settings(max_examples=60, deadline=None)
@given(st.integers(400, 3000), st.integers(0, 2**32))
def test_histograms_of_any_length_are_lower_bounds(size, seed):
    rng = np.random.default_rng(seed)
    r = np.unique(rng.integers(0, 2**63, size=size, dtype=np.uint64))
    s = np.unique(np.r_[rng.permutation(r)[: int(size * rng.uniform(0.7, 1))], rng.integers(0, 2**63, size=int(size * rng.uniform(0, 0.4)), dtype=np.uint64)])
    a, b = jaccard_join.histogram(r), jaccard_join.histogram(s)
    places = min(len(a), len(b))
    assert np.abs(jaccard_join.stacked([a], places) - jaccard_join.stacked([b], places)).sum() <= len(np.setxor1d(r, s))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 100)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


# ---- substring deduplication -----------------------------------------------------------


def brute_repeats(rows, size=50):
    first = {}
    for doc_id, text in rows:
        w = word_list(text)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        w = word_list(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < doc_id:
                gone.update(range(i, i + size))
        out[doc_id] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    return out


def test_substring_dedup_removes_what_brute_force_removes(spark, docs, none):
    rows = [(r[0], r[1]) for r in doc_rows() if r[0] is not None]
    want = brute_repeats(rows)
    for r in substring_dedup.remove_repeats(docs, bits=16).collect():
        if r.doc_id is None:
            assert r.text == doc_rows()[0][1] and r.spans == []
        else:
            assert r.text == want[r.doc_id]
    assert substring_dedup.remove_repeats(none, bits=16).count() == 0


def test_a_full_sketch_loses_nothing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(80))) for i in range(20)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bits=6).collect()}
    assert got == brute_repeats(rows)


def test_hot_windows_are_dealt_out_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 5)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60))] + passage + [f"w{rng.randrange(10**6)}" for _ in range(60)])) for i in rng.sample(range(-500, 500), 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()} == brute_repeats(rows)
    bits, found = substring_dedup.estimated_repeated(df)
    salted = substring_dedup.candidates(df, found, 50, 25, bits).where("salt >= 0")
    assert salted.select("h").distinct().count() >= 21 and salted.select("salt").distinct().count() > 20


def test_unique_text_passes_no_more_windows_as_a_corpus_grows(spark, monkeypatch):
    """The sketch grows with the corpus, so the share that goes to the exact pass doesn't."""
    monkeypatch.setattr(substring_dedup, "LEAST_BITS", 8)
    rng, shares = random.Random(7), []
    for n in (40, 400, 1600):
        df = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(200))) for i in range(n)], "doc_id long, text string").repartition(4)
        bits, found = substring_dedup.estimated_repeated(df)
        shares.append(substring_dedup.candidates(df, found, 50, 25, bits).count() / (151 * n))
    assert max(shares) < 0.15 and shares[2] < 2 * max(0.03, shares[0])


def test_rolling_hashes_and_anchors_follow_content():
    h = words.hashes([b"w%d" % (i % 7) for i in range(200)])
    for make in (substring_dedup.windows, substring_dedup.anchors):
        w = make(h)
        assert len(w) == 151 and all(w[i] == w[i + 7] for i in range(140))
    assert len(set(substring_dedup.windows(h).tolist())) == 7


# ---- byte-level BPE --------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    path, pattern = bpe.public_files()
    return bpe.Codec(bpe.load_ranks(path), pattern)


@pytest.fixture(scope="module")
def reference(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.public_files()[1], mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab \n'st<|>é漢😀1", max_size=200)))
def test_bpe_round_trip_and_equality(codec, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_append_and_edit_equal_encoding_afresh(codec):
    v = codec.vocabulary
    t = bpe.PrefixTable(v, b"unbeliev")
    t.append(b"ably").append(b"")
    assert t.tokens() == bpe.PrefixTable(v, b"unbelievably").tokens() == v.merged(b"unbelievably")
    assert t.replace(2, 4, b"BEL").tokens() == v.merged(b"unBELlievably")
    assert bpe.PrefixTable(v).tokens() == []


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400), st.integers(0, 400), st.integers(0, 30), st.binary(max_size=12))
def test_bpe_edits_anywhere(codec, data, begin, length, by):
    data = (data.hex().encode() + b" and therefore ") * 2
    begin = min(begin, len(data))
    end = min(len(data), begin + length)
    t = bpe.PrefixTable(codec.vocabulary, data)
    assert t.replace(begin, end, by).last == bpe.PrefixTable(codec.vocabulary, data[:begin] + by + data[end:]).last and t.data == data[:begin] + by + data[end:]


def test_bpe_edits_touch_what_is_near(codec, monkeypatch):
    v = codec.vocabulary
    data = b"internationalisation " * 2000
    t, read = bpe.PrefixTable(v, data), []
    monkeypatch.setattr(bpe.PrefixTable, "append", lambda self, more, f=bpe.PrefixTable.append: read.append(len(more)) or f(self, more))
    t.replace(21_000, 21_003, b"X")
    assert sum(read) <= 1 + 4 * v.longest and t.tokens() == v_tokens(v, data[:21_000] + b"X" + data[21_003:])


def v_tokens(v, data):
    return bpe.PrefixTable(v, data).tokens()


def test_bpe_queries_whole_texts(spark, docs, none, codec):
    path, pattern = bpe.public_files()
    texts = collections.Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in doc_rows())
    assert collections.Counter(r.decoded_sha256 for r in bpe.digests(docs, path, pattern).collect()) == texts
    back = bpe.decode(bpe.encode(docs, path, pattern), path)
    assert collections.Counter(hashlib.sha256(bytes(r.data)).hexdigest() for r in back.collect()) == texts
    assert bpe.encode(none, path, pattern).count() == 0


# ---- syncmers --------------------------------------------------------------------------


def test_fingerprints_of_edge_cases(spark, docs, none):
    found = syncmers.with_next(docs, blocks=4).withColumn("fingerprint", syncmers.fingerprint(F.col("anchored"))).collect()
    assert len(found) == len(doc_rows())
    ids = sorted((-(2**63) if r[0] is None else r[0], r[1] or "") for r in doc_rows())
    want = collections.Counter((ids[i][1], ids[(i + 1) % len(ids)][1]) for i in range(len(ids)))
    assert collections.Counter((r.text, r.next_text) for r in found) == want
    by_text = collections.defaultdict(set)
    for r in found:
        by_text[r.text].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {""}
    assert syncmers.with_next(none).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    assert syncmers.with_next(one).first().next_text == "a b c d e f g h i"


def test_shared_ids_are_each_other_s_successors(spark):
    """Rows with one id follow each other in some order, which is the same on every run."""
    rows = spark.createDataFrame([(1, f"text {i}") for i in range(9)] + [(2, "last")], "doc_id long, text string")
    told = {r.text: r.next_text for r in syncmers.with_next(rows).collect()}
    at, seen = "last", []
    while at not in seen:
        seen.append(at)
        at = told[at]
    assert len(seen) == 10 and {r.text: r.next_text for r in syncmers.with_next(rows.repartition(3)).collect()} == told


def likeness_of(spark, a, b):
    shown = [syncmers.fingerprint(syncmers.packed(syncmers.anchors(F.col(c)))) for c in ("a", "b")]
    return spark.createDataFrame([(a, b)], "a string, b string").select(syncmers.likeness(*shown).alias("x")).first().x


@pytest.mark.parametrize("alphabet", ["漢字仮名交文書記号列一二三四五六七八九十", "abcdefghijklmnopqrstuvwxyz0123456789", "абвгдежзийклмнопрстуфхцчшщ"])
def test_likeness_of_texts_without_gaps(spark, alphabet):
    """One character in front, or five that go, change few anchors."""
    rng = random.Random(1)
    text = "".join(rng.choice(alphabet) for _ in range(2000))
    other = "".join(rng.choice(alphabet) for _ in range(2000))
    assert likeness_of(spark, text, rng.choice(alphabet) + text) > 0.95
    assert likeness_of(spark, text, text[5:]) > 0.95 and likeness_of(spark, text, text[:900] + other[:30] + text[900:]) > 0.9
    assert likeness_of(spark, text, other) < 0.05 and likeness_of(spark, text, text) == 1.0


def test_anchors_are_matched_by_position(spark):
    """The same passages in another order keep what lies within them; scattered anchors match nothing."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    parts = [words[i : i + 300] for i in (0, 300, 600)]
    swapped = " ".join(parts[2] + parts[0] + parts[1])
    assert 0.9 < likeness_of(spark, " ".join(words), swapped) < 1.0
    apart = " ".join(w if i % 9 else f"{w} x{rng.randrange(10**6)}" for i, w in enumerate(words))
    assert likeness_of(spark, " ".join(words), apart) < 0.2
    shown = [syncmers.fingerprint(syncmers.packed(syncmers.anchors(F.col(c)))) for c in ("a", "b")]
    long, passage = " ".join(f"z{rng.randrange(10**6)}" for _ in range(20_000)), " ".join(words[:80])
    r = spark.createDataFrame([(long + " " + passage, passage)], "a string, b string").select(F.size(F.array_intersect(*[syncmers.links(syncmers.anchors_of(x)) for x in shown])).alias("common"), F.size(syncmers.links(syncmers.anchors_of(shown[1]))).alias("all")).first()
    assert r.common == r.all > 10  # a passage in a long text is found whole


def test_syncmers_are_context_free(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a b c {passage}"), (2, f"{passage} x y")]
    found = {r.doc_id: {a.hash for a in r.a} for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()}
    inner = {a.hash for a in spark.createDataFrame([(passage,)], "text string").select(syncmers.anchors(F.col("text")).alias("a")).first().a}
    assert inner and inner <= found[1] and inner <= found[2]


# ---- quality classifier ----------------------------------------------------------------


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.1, rng.normal(size=50), rng.normal(size=(50, 4)))
    p, x = np.array([1, 7, 20, 33]), np.array([0.5, 1.0, 0.2, 0.7])
    pairs = sum(m.v[p[i]] @ m.v[p[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(m.raw(p, x), 0.1 + m.w[p] @ x + pairs)


def test_classifier_scores_every_row_without_labels_or_meta(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (12, 0, 0), (13, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    machine = quality_fm.trained(docs, labels)
    out = quality_fm.scored(docs, machine)
    rows = out.collect()
    assert len(rows) == len(doc_rows()) and all(0 <= r["__score"] <= 1 for r in rows) and out.columns == [*docs.columns, "__score"]
    moved = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz"), "doc_id": F.col("doc_id") + 7})
    assert sorted(r["__score"] for r in quality_fm.scored(moved, machine).collect()) == sorted(r["__score"] for r in rows)
    assert quality_fm.scored(none, machine).count() == 0
    assert quality_fm.trained(docs, labels.limit(0)).score("anything") == pytest.approx(0.5, abs=0.05)


def test_a_labelled_id_that_many_documents_share_counts_once(spark, monkeypatch):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (3, 0), (4, None)], "doc_id long, quality int")
    rows = [(1, f"text {i % 3}") for i in range(500)] + [(3, "other words"), (None, "no id")]
    fitted = []
    monkeypatch.setattr(quality_fm, "fit", lambda rows: fitted.append(rows))
    monkeypatch.setattr(quality_fm, "fold", lambda c: F.lit(1))
    quality_fm.trained(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels)
    assert sorted(y for _, _, y in fitted[0]) == [0, 0, 1]


def test_classifier_learns_from_other_folds(spark):
    d = "/root/testdata/sf0.01"
    found = quality_fm.scored(*(lambda t, y: (t, quality_fm.trained(t, y)))(shared.table(spark, d, "documents"), shared.table(spark, d, "labels")), ["doc_id"])
    rows = found.join(shared.table(spark, d, "labels"), "doc_id").where(quality_fm.fold("doc_id") == 0).collect()
    good, bad = [r["__score"] for r in rows if r.quality == 1], [r["__score"] for r in rows if r.quality == 0]
    better = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert better > 0.95 and all(g >= quality_fm.THRESHOLD for g in good)


# ---- mixing ----------------------------------------------------------------------------


def test_raking_meets_all_marginals(spark):
    rows = [(s, g, t, 10 + 7 * i % 23) for i, (s, g, t) in enumerate((s, g, t) for s in "abc" for g in ("x", None) for t in "pq")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.25, "c": 0.25}, "topic": {"p": 0.3, "q": 0.7}}
    out = mixing.raked(cells, targets, rounds=40).collect()
    apart = {(r.source, r.lang, r.topic): r.lift for r in mixing.raked(cells, targets, rounds=4, most_cells=0).collect()}
    together = {(r.source, r.lang, r.topic): r.lift for r in mixing.raked(cells, targets, rounds=4).collect()}
    assert apart.keys() == together.keys() and all(apart[k] == pytest.approx(together[k]) for k in apart)
    total = sum(r.tokens for r in out)
    for column, want in targets.items():
        for value, share in want.items():
            assert sum(r.tokens * r.lift for r in out if r[column] == value) / total == pytest.approx(share, abs=1e-6)


def test_mixing_edge_cases(spark, docs, none):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(doc_rows()) and all(0 <= r.probability <= 1 for r in rows)
    expected, total = sum(r.tokens * r.probability for r in rows), sum(r.tokens for r in rows)
    assert expected == pytest.approx(mixing.BUDGET * total, rel=0.02)
    assert mixing.mixed(none).count() == 0 and mixing.sample(none).count() == 0
    clash = docs.withColumns({"topic": F.lit("clash"), "drawn": F.lit(0), "mix_topic": F.lit(1), "probability": F.lit(2), "vector": F.lit(3)})
    out = mixing.sample(clash)
    assert out.columns == clash.columns and sorted(map(str, out.collect())) == sorted(map(str, mixing.sample(clash).collect()))
    kept = collections.Counter((r.doc_id, r.source, r.lang, r.tokens) for r in rows if r.sampled)
    assert collections.Counter((r["doc_id"], r["source"], r["lang"], len(word_list(r["text"]))) for r in out.collect()) == kept


def test_rows_without_an_id_draw_by_their_text(spark):
    rows = spark.createDataFrame([(None, f"text number {i}", "s", "l") for i in range(400)], "doc_id long, text string, source string, lang string")
    assert 120 < mixing.sample(rows).count() < 280


def test_passes_add_up_whatever_the_tasks(spark):
    """A pass is one job whose tasks run side by side, and sums don't depend on how rows are dealt."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, mixing.DIMS)).astype(np.float32)
    v /= np.sqrt((v**2).sum(axis=1, keepdims=True))
    centres = v[:5]
    rows = spark.createDataFrame([(bytearray(x.tobytes()),) for x in v], "vector binary")
    found = [mixing.centre_sums(rows.repartition(n), centres) for n in (1, 7)]
    nearest = np.argmax(v @ centres.T, axis=1)
    assert np.array_equal(*found)
    assert np.allclose(found[0], [v[nearest == k].sum(axis=0, dtype=np.float64) for k in range(5)], atol=1e-5)


def test_tasks_of_a_pass_run_side_by_side(spark):
    import time

    v = np.ones((8, mixing.DIMS), np.float32) / 8

    def slow(batches):
        for batch in batches:
            if batch.num_rows:
                time.sleep(1.5)
            yield batch

    rows = spark.createDataFrame([(bytearray(x.tobytes()),) for x in v], "vector binary").repartition(8, F.monotonically_increasing_id())
    rows = rows.mapInArrow(slow, "vector binary")
    mixing.centre_sums(rows, v[:2])
    began = time.time()
    mixing.centre_sums(rows, v[:2])
    assert time.time() - began < 7  # one after the other, batches would sleep for up to 12 seconds


def test_words_are_counted_by_ranges(spark):
    texts = [f"common w{i} w{i % 40}" for i in range(300)] + [None, ""]
    weights = mixing.word_weights(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    seen = collections.Counter(w for t in texts if t for w in {int(h) >> (64 - mixing.PLACE_BITS) for h in words.hashes([x.encode() for x in t.split()])})
    n = 300
    for place, count in seen.items():
        want = np.log(n / count) if max(2, mixing.RARE * n) <= count <= max(2, mixing.COMMON * n) else 0.0
        assert weights[place] == pytest.approx(want, rel=1e-6)
    assert np.count_nonzero(weights) <= len(seen)


def test_topics_are_what_documents_are_about(spark):
    rng, rows = random.Random(5), []
    common = [f"the{i}" for i in range(20)]
    for i in range(900):
        subject = i % 8
        rows.append((i, " ".join(rng.choice(common) if rng.random() < 0.5 else f"s{subject}w{int(rng.expovariate(1 / 20)) % 200}" for _ in range(120)), f"s{i % 7}", "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    weights = mixing.word_weights(df)
    vectors = shared.written(mixing.described(df, weights), "v")
    model = mixing.fitted(vectors.select("vector"), weights)
    found = collections.defaultdict(collections.Counter)
    for r in mixing.with_topics(vectors, model).collect():
        found[r.topic][r.doc_id % 8] += 1
    assert len(found) == 8 and sum(c.most_common(1)[0][1] for c in found.values()) > 0.9 * len(rows)


# ---- URL filter ------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark, none):
    urls = ["HTTP://A.Example.com/en/7x?q=1", "http://example.net#top", "no url", None, "x://com/en/1", "http://notexample.com/en/7", "http://example.net/de/8/9", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, good int")
    rows = {r.page_id: r for r in url_filter.filtered(pages, url_filter.RULES).collect()}
    assert [(rows[i].host, rows[i].path) for i in range(8)] == [
        ("a.example.com", "/en/7x"), ("example.net", ""), ("", ""), ("", ""), ("com", "/en/1"), ("notexample.com", "/en/7"), ("example.net", "/de/8/9"), ("b:", "//c/d"),
    ]
    assert [rows[i].rule for i in range(8)] == ["example.com/en/7", None, None, None, "com/en/", "com/en/", "example.net/de/8", None]
    assert [rows[i].verdict for i in range(8)] == ["allow", "allow", "allow", "allow", "block", "block", "block", "allow"]
    assert url_filter.filtered(pages.limit(0), url_filter.RULES).count() == 0


def test_impure_templates_are_rejected_and_variables_generalised(spark):
    rows = [(i, f"http://h.org/spam/{i}.html", 0) for i in range(200)] + [(1000 + i, f"http://h.org/news/word{i}", 1) for i in range(200)]
    out = url_filter.filtered(spark.createDataFrame(rows, "page_id long, url string, good int"), {}).collect()
    assert {r.template for r in out} == {"spam/*", "news/*"}
    assert {r.verdict for r in out if r.template == "spam/*"} == {"block"} and {r.verdict for r in out if r.template == "news/*"} == {"allow"}


# ---- WARC ------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "WARC/1.1\r\n\r\n\x1f\x8b", "é" * 5000, "<p>a</p>", "<p>a</p>"]
    ids = [1, 2, 3, 4, 5, 6, None, 2]
    pages = spark.createDataFrame([(i, f"http://x/{k} \r\n" + "u" * (5 << 20 if k in (2, 5) else 0), h, "clash") for k, (i, h) in enumerate(zip(ids, html, strict=True))], "page_id long, url string, html string, digest string").repartition(3)
    folder = shared.scratch(spark, "warc")
    manifest = shared.written(warc.write(warc.roles(pages), folder, most=2000), "manifest")
    items = shared.written(warc.salvage(manifest, folder), "items")
    rows = warc.records(items).collect()
    assert len(rows) == 8 and warc.gaps(items).count() == 0 and len({r.record_id for r in rows}) == 8
    assert collections.Counter((r.payload_digest, r.payload_bytes) for r in rows) == collections.Counter((warc.base32_sha1((h or "").encode()), len((h or "").encode())) for h in html)
    answers = [r for r in rows if r.record_type == "response"]
    assert sorted(r.page_id for r in answers) == [2, 4, 5, 6]
    assert {(r.page_id, r.refers_to) for r in rows if r.record_type == "revisit"} == {(1, 2), (2, 2), (None, 2), (3, 4)}
    assert warc.write(warc.roles(pages.limit(0)), folder).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_reads_on_after_damage(packed):
    payloads = [bytes([65 + i % 26]) * (50 + i) for i in range(40)]
    records = [warc.record(i, "http://a/", p, None, False) for i, p in enumerate(payloads)]
    parts = [gzip.compress(r, mtime=0) if packed else r for r in records]
    data = bytearray(b"".join(parts))
    at = [sum(map(len, parts[:i])) for i in range(41)]
    data[at[20] + len(parts[20]) - 10] ^= 255  # in the payload or the checksum
    del data[at[10] + 5 : at[10] + 25]
    damaged = b"junk" + bytes(data) + b"tail"
    items = list(warc.read(io.BytesIO(damaged)))
    read = [i.headers["warc-record-id"] for i in items if isinstance(i, warc.Record)]
    assert read == [warc.record_id(i, warc.base32_sha1(payloads[i])) for i in range(40) if i not in (10, 20)]
    gaps = [i for i in items if isinstance(i, warc.Gap)]
    assert len(gaps) == 4 and gaps[0].start == 0 and gaps[-1].end == len(damaged)
    lost = sum(g.end - g.start for g in gaps)
    assert lost == len(damaged) - sum(len(parts[i]) for i in range(40) if i not in (10, 20))


@pytest.mark.parametrize("packed", [False, True])
def test_long_headers_and_blocks_are_read_in_bounded_memory(monkeypatch, packed):
    """Urls of 5 MiB, and blocks over the limit that is held, before, between and behind damage."""
    monkeypatch.setattr(warc, "HELD_BYTES", 300_000)
    rng = random.Random(7)
    payloads = [rng.randbytes(n) for n in (10, 3 << 20, 300_000, 5, 2 << 20, 1 << 20)]
    # A payload that holds a whole record: it is found only where the outer one fails.
    payloads[4] += warc.record(99, "http://inside/", b"inner", None, False) + bytes(1000)
    records = [warc.record(i, "http://a/" + "u" * (5 << 20 if i in (0, 3) else 3), p, None, False) for i, p in enumerate(payloads)]

    def archive(parts):
        return b"".join(gzip.compress(r, 1, mtime=0) if packed else r for r in parts)

    found = list(warc.read(io.BytesIO(archive(records))))
    assert [(f.headers["warc-target-uri"], f.payload_bytes, f.payload_digest) for f in found] == [("http://a/" + "u" * (5 << 20 if i in (0, 3) else 3), len(p), warc.base32_sha1(p)) for i, p in enumerate(payloads)]
    assert [f.block is None for f in found] == [False, True, True, False, True, True]
    broken = bytearray(records[4])
    broken[1 << 20] ^= 1
    items = list(warc.read(io.BytesIO(archive([*records[:4], bytes(broken), records[5]]))))
    read = [i.headers["warc-record-id"] for i in items if isinstance(i, warc.Record)]
    assert read == [warc.record_id(k, warc.base32_sha1(p)) for k, p in [*enumerate(payloads[:4]), (99, b"inner"), (5, payloads[5])]]
    assert any("another digest" in i.reason for i in items if isinstance(i, warc.Gap))


def test_several_long_records_in_one_member(monkeypatch):
    monkeypatch.setattr(warc, "HELD_BYTES", 50_000)
    rng = random.Random(9)
    payloads = [rng.randbytes(2_500_000 if i % 3 else 40) for i in range(7)]
    data = gzip.compress(b"".join(warc.record(i, None, p, None, False) for i, p in enumerate(payloads)), 1) + warc.record(7, None, b"plain", None, False)
    found = list(warc.read(io.BytesIO(data)))
    assert [f.payload_digest for f in found] == [warc.base32_sha1(p) for p in (*payloads, b"plain")]
    cut = data[: len(data) // 2]
    kept = [f for f in warc.read(io.BytesIO(cut)) if isinstance(f, warc.Record)]
    assert [f.payload_digest for f in kept] == [warc.base32_sha1(p) for p in payloads[: len(kept)]] and len(kept) >= 2


def test_version_lines_before_junk_are_refused_soon():
    junk = b"WARC/1.1\r\n" + b"x" * 3_000_000
    items = list(warc.read(io.BytesIO(junk + warc.record(1, None, b"p", None, False))))
    assert [type(i) for i in items] == [warc.Gap, warc.Record] and items[0].end == len(junk) and items[0].reason == "a header without colon"


def test_archives_on_disk_are_gzip_by_member_and_are_salvaged(spark, tmp_path):
    import os

    rng = random.Random(1)
    pages = spark.createDataFrame([(i, f"http://x/{i}", "".join(rng.choice("abcdef") for _ in range(900))) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/archives"
    manifest = shared.written(warc.write(warc.roles(pages).coalesce(1), folder), "manifest")
    (name,) = [r.path for r in manifest.collect()]
    path = f"{tmp_path}/archives/{name}"
    data, members, rest = open(path, "rb").read(), [], b""
    rest = data
    while rest:
        unzip = zlib.decompressobj(31)
        out = unzip.decompress(rest)
        assert unzip.eof and out.startswith(b"WARC/1.1")
        members.append(len(rest) - len(unzip.unused_data))
        rest = unzip.unused_data
    assert len(members) == 60
    damaged = bytearray(data)
    damaged[sum(members[:7]) + 40] ^= 255
    with open(path, "wb") as out:
        out.write(damaged[: sum(members[:30]) + 9] + damaged[sum(members[:30]) + 60 :])
    # A second archive is one of foreign making.
    r = lambda kind, *lines, block=b"x: y\r\n": ("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"Content-Length: {len(block)}", *lines]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nbody"
    several = r("request", "WARC-Record-ID: <urn:uuid:2>") + r("response", block=http) + b"garbage" + r("metadata", "WARC-Payload-Digest: md5:1")
    foreign = gzip.compress(r("warcinfo", "WARC-Record-ID: <urn:uuid:1>")) + gzip.compress(several) + b"\0" * 33 + gzip.compress(r("revisit", "WARC-Refers-To: <urn:uuid:7>"))
    blocks = [rng.randbytes(200_000) for _ in range(30)]
    broken = bytearray(gzip.compress(b"".join(r("resource", f"WARC-Record-ID: <urn:uuid:{k}>", f"WARC-Block-Digest: sha1:{warc.base32_sha1(b)}", block=b) for k, b in enumerate(blocks)), 1))
    broken[len(broken) * 2 // 3 + 90_000] ^= 255
    with open(f"{tmp_path}/archives/foreign.warc.gz", "wb") as out:
        out.write(foreign + broken + gzip.compress(r("conversion")))
    both = spark.createDataFrame([(name,), ("foreign.warc.gz",)], "path string")
    items = shared.written(warc.salvage(both, folder), "items")
    rows, gaps = warc.records(items).collect(), warc.gaps(items).orderBy("path", "start").collect()
    own = [x for x in rows if x.path == name]
    assert len(own) == 58 and sorted({x.page_id for x in own}) == sorted(x.page_id for x in own)
    assert sum(g.end - g.start for g in gaps if g.path == name) == members[7] + members[30] - 51
    kinds = [x.record_type for x in sorted((x for x in rows if x.path != name), key=lambda x: (x.start, x.record_id or ""))]
    assert kinds[0] == "warcinfo" and sorted(kinds[1:4]) == ["metadata", "request", "response"] and kinds[4] == "revisit" and kinds[-1] == "conversion"
    assert {f"<urn:uuid:{k}>" for k in range(18)} <= {x.record_id for x in rows} and kinds.count("resource") < 30 and {x.payload_bytes for x in rows if x.record_type == "response" and x.path != name} == {4}
    lost = [g for g in gaps if g.path != name]
    assert len(lost) == 4 and "content" in lost[0].reason and lost[1].end - lost[1].start == 33
    assert any("another digest" in g.reason for g in lost) and any("a broken member" in g.reason for g in lost) and max(g.end for g in lost) == os.path.getsize(f"{tmp_path}/archives/foreign.warc.gz") - len(gzip.compress(r("conversion")))


# ---- chat formatting -------------------------------------------------------------------


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(6):
        roles = (["system"] if c % 2 else []) + ["user", "assistant"] * (3 + c)
        rows += [(c, k, r, " ".join(rng.choice(["<|end|>", "</s>", "\\", "[INST]", "a\n", "ok", "\\<|"]) for _ in range(rng.randrange(60)))) for k, r in enumerate(roles)]
    rows += [(7, 0, None, None), (7, 0, "assistant", "tie"), (7, 0, "assistant", "tie"), (8, 0, "user\nx", "漢" * 9000), (8, 1, "assistant", "😀"), (None, 0, "assistant", "no id")]
    return rows


@pytest.mark.parametrize("budget,history", [(1024, 256), (60, 20), (8, 2)])
def test_windows_hold_each_turn_once_and_mask_repeats(spark, budget, history):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    wins = chat_format.windows(df, budget, history)
    by = collections.defaultdict(list)
    for r in chat_format.read_back(wins).collect():
        by[r.conv_id].append(r)
    want = collections.defaultdict(list)
    for c, k, r, t in conversations():
        want[c].append((k, r or "", t or ""))
    for c, turns in want.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2]))
        back = sorted(by[c], key=lambda r: r.window)
        assert [(t.role, t.text) for w in back for t in w.turns] == [(r, t) for _, r, t in turns]
        assert "".join(w.loss_text for w in back) == "".join(t for _, r, t in turns if r == "assistant")
    longest = max(len(chat_format_escaped(t or "")) for _, _, _, t in conversations())
    for r in wins.collect():
        assert r.n_tokens <= budget or r.over_budget
        assert longest > 0
    assert chat_format.windows(df.limit(0)).count() == 0


def test_one_long_turn_adds_at_most_two_windows(spark):
    turns = [(1, k, "user" if k % 2 else "assistant", "t" * 120) for k in range(40)]
    count = lambda rows: chat_format.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count()
    even = count(turns)
    assert even == 2 and count([*turns[:20], (1, 19, "zz", "u" * 3200), *turns[20:]]) <= even + 2


def chat_format_escaped(text):
    out = text.replace("\\", "\\\\")
    for c in chat_format.CONTROL:
        out = out.replace(c, c[0] + "\\" + c[1:])
    return out


def test_windows_repeat_the_system_turn_and_fit_the_budget(spark):
    rows = [(1, 0, "system", "s" * 40)] + [(1, k, "user" if k % 2 else "assistant", "t" * 100) for k in range(1, 30)]
    wins = chat_format.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200, 60).orderBy("window").collect()
    assert len(wins) > 3 and all(w.formatted.startswith("<|turn|>system") and w.n_tokens <= 200 and not w.over_budget for w in wins)
    assert wins[0].n_context == 0 and all(w.n_context >= 2 for w in wins[1:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<", "|", "<|", "</s>", "s", "[", "/", "INST]", "<<SYS>>", "\n"]), max_size=20))
def test_escaping_hides_all_control_strings(parts):
    text = "".join(parts)
    out = chat_format_escaped(text)
    assert not any(c in out for c in chat_format.CONTROL)
    back = out
    for c in reversed(chat_format.CONTROL):
        back = back.replace(c[0] + "\\" + c[1:], c)
    assert back.replace("\\\\", "\\") == text


@pytest.mark.parametrize("percent", [1, 10, 30, 40, 49, 50, 60, 80, 95])
def test_sets_that_can_link_share_a_band(percent):
    """Below 50 a set links with others of more than the next band."""
    for size in range(1, 130):
        for more in {size, size * 100 // percent, (size + size * 100 // percent) // 2}:
            assert set(jaccard_join.bands_of(size, percent)) & set(jaccard_join.bands_of(more, percent)), (size, more)
