"""N-gram Jaccard self-join by universe partitions and the pigeonhole principle.

A document is the set of its distinct word shingles, as 64-bit hashes.  Two sets
``r``, ``s`` of Jaccard similarity ``t`` or more differ in at most
``D = (1-t)/(1+t) * (|r|+|s|)`` elements.

*Classes.*  Equal sets are one class.  Sets are held equal by 128 bits of a digest;
a class is named by the first 64, and where two classes have the same name
(found by comparing the others), by both halves.  Only one row of a class takes part in the search: bitmaps of fixed size tell
which classes repeat and which of their rows speaks for them.  A bit that is set
by accident lets a copy through, which costs time and changes nothing.

*Bands.*  Sizes fall into bands of ratio ``RATIO``.  A band cuts the universe of
hashes into equal segments; a set also takes part in each higher band that holds
sizes it can link with, so every pair that can link shares the larger one's band.

*Segments.*  A difference of ``D`` elements spoils at most ``D`` segments, so of
any ``D + 1`` segments that a set has something in, one is equal in the other.
A segment's content is one key.  Keys are ordered by cost, the number of sets
that may share them, and a set indexes only its cheapest ``D + 1`` (a prefix
under one global order, so a pair's cheapest common key is in both prefixes).
Costs come from a count-min sketch over all sets, of fixed size; a poor estimate
costs time, never a link.

*One-deletion neighbourhoods.*  In the first ``q`` segments of a band a set also
indexes its content with each one element left out.  If neither equality nor a
deletion matches, at least two elements differ there, so such a segment counts
for two.  ``q`` is allotted per band by expected cost: it rises where sets would
otherwise run out of segments with content.  A set that still has too few also
indexes its empty segments, which makes the join exact in every case.

*Candidates.*  A key that at most ``FEW`` classes share gives their pairs, which
are made distinct and sifted by size and by histograms of the elements, whose
distance is a lower bound of the sets' difference.  What remains falls into
parts that can't link with each other.  A key that more share names its least
class as their hub; the members of a hub come together once, however many such
keys they share, in chunks of bounded size (a large hub's chunks two by two), and
fall into parts by the same bounds.  No pairs are written for these.

*Verification.*  The sets of each part come together, in chunks of bounded size,
and all intersections are one product of incidence matrices.  A part of several
chunks that has few pairs is verified pair by pair instead.  Only a spanning
forest of the links found leaves a task, and components join the forests.

Defined cases.  Null or empty text: an empty set, linked with nothing.  Fewer
words than a shingle: the whole sequence is the one shingle.  Each row is a node
of its own: repeated rows and equal texts link (unless empty), rows that share an
id but not the text are linked only by their texts, and so are rows with a null
``doc_id``.  ``component_id`` is the least id that isn't null among the rows
reached, or null if there is none.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.shared import bitmap, bitmap_bytes, parallelism, release, salt_mask, salt_of, salts_of, small_batches, table, text_of, without, written
from graphloom.llm.words import U64, mix, shingle_set, words_of

WORDS, PERCENT = 5, 80
RATIO = 2.0
#: Count-min sketch: rows and the logarithm of their length; 2 * 2**21 counters of 2 bytes are broadcast.
SKETCH_ROWS, SKETCH_BITS = 2, 21
#: Counters that one task adds up.
SKETCH_RANGE = 1 << 16
#: The logarithm of the length of the bitmaps of repeated classes and of their speakers; 2 * 2 MB are broadcast.
CLASS_BITS = 24
#: The share of a set that may be common passages while it still finds enough segments with content of its own.
COMMON = 0.5
#: Bands whose plans are found by drawing sets; above, segments grow in proportion.
DRAWN_BANDS = 10
#: A key of so many classes gives pairs, one of more a hub.
FEW = 16
#: The most sets, and elements, of a chunk that is verified at once, and the most bytes of histograms that are compared at once.
CHUNK_SETS, CHUNK_ELEMENTS, CHUNK_HISTOGRAMS = 1024, 1_500_000, 8192 * 128
#: Possible pairs that are held before their parts are joined.
MOST_PAIRS = 1 << 21
#: Places of a set's histogram, at least and at most.
PLACES, MOST_PLACES = 128, 4096
#: Members of parts are broadcast up to so many (56 bytes each); beyond, texts are joined to them by a shuffle.
MOST_BROADCAST = 500_000
#: Bytes of token sets that a task holds before it hands them on.
HELD_BYTES = 8 << 20


def most_different(r: int, percent: int = PERCENT) -> int:
    """Elements in which a set of size ``r`` may differ from any set that it can link with."""
    largest = r * 100 // percent  # the largest partner
    return ((100 - percent) * (r + largest)) // (100 + percent)


def band_sizes(band: int) -> tuple[int, int]:
    return max(1, math.ceil(RATIO**band)), max(1, math.ceil(RATIO ** (band + 1)) - 1)


@lru_cache(maxsize=None)
def drawn_plan(band: int, percent: int) -> tuple[int, int]:
    """``(segments, deletion segments)`` of a band.

    Weighed are the keys that a set indexes (a deletion segment of ``k``
    elements takes ``k + 1`` and counts for two), a penalty for the chance that
    a set runs out of content of its own and falls back on what many sets
    share, and a large one for the chance that it runs out of content at all
    and falls back on empty segments.  The chances come from drawing random
    sets of the band's sizes.
    """
    low, top = band_sizes(band)
    need = most_different(top, percent) + 1
    rng, best = np.random.default_rng(band), None
    trials = 400 if top < 512 else 50
    for m in sorted({max(need, math.ceil(need * f / 8)) for f in range(8, 21, 2)}):
        drawn = [(r, rng.multinomial(r, np.full(m, 1 / m), size=trials), rng.multinomial(max(1, int(r * (1 - COMMON))), np.full(m, 1 / m), size=trials)) for r in sorted({low, (low + top) // 2, top})]
        for q in sorted({0, 1, 2, 4, 8, m}):
            if q > min(m, 24):
                continue
            short = lost = keys = 0.0
            for r, whole, own in drawn:
                wanted = most_different(r, percent) + 1
                capacity = lambda x: (x > 0).sum(axis=1) + (x[:, :q] > 1).sum(axis=1)  # noqa: B023, E731
                first = whole[:, :q]
                keys += ((first > 0).sum(axis=1) + np.where(first > 1, first, 0).sum(axis=1) + np.maximum(0, wanted - (first > 0).sum(axis=1) - (first > 1).sum(axis=1))).mean() / len(drawn)
                lost += (capacity(whole) < wanted).mean() / len(drawn)
                short += (capacity(own) < wanted).mean() / len(drawn)
            cost = keys + need * short + 1000 * lost
            if best is None or cost < best[0]:
                best = (cost, m, q)
    return best[1], best[2]


class Plan:
    """``(segments, deletion segments)`` by band, found once on the driver; tasks get the table."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.drawn = [drawn_plan(band, percent) for band in range(DRAWN_BANDS)]

    def __call__(self, band: int) -> tuple[int, int]:
        if band < DRAWN_BANDS:
            return self.drawn[band]
        # Large sets fill segments alike at every size, so the last ratio of segments to keys holds.
        last, need = self.drawn[-1][0], most_different(band_sizes(DRAWN_BANDS - 1)[1], self.percent) + 1
        return math.ceil((most_different(band_sizes(band)[1], self.percent) + 1) * last / need), 0


def bands_of(size: int, percent: int = PERCENT) -> list[int]:
    if size < 1:
        return []
    first = last = int(math.floor(math.log(size, RATIO) + 1e-12))
    while size * 100 >= percent * band_sizes(last + 1)[0]:
        last += 1
    return list(range(first, last + 1))


def segment_keys(tokens: np.ndarray, band: int, plan: Plan):
    """``(exact keys of segments with content, their sizes, deletion keys, their owners, empty keys)`` of sorted tokens.

    A token's segment is its place in the range of hashes, so segments are runs.
    """
    m, q = plan(band)
    # The upper 32 bits scaled to 0..m-1.
    seg = ((tokens >> U64(32)) * U64(m)) >> U64(32)
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    ids = seg[starts].astype(np.int64)
    mixed = mix(tokens + U64(band + 1))
    sums = np.add.reduceat(mixed, starts)
    sizes = np.diff(np.r_[starts, len(tokens)])
    salt = mix(ids.astype(U64) * U64(64) + U64(band))
    exact = mix(sums ^ salt)
    chosen = np.flatnonzero((ids < q) & (sizes >= 2))
    gone, owner = [], []
    for c in chosen:
        part = mixed[starts[c] : starts[c] + sizes[c]]
        gone.append(mix((sums[c] - part) ^ salt[c]))
        owner.append(np.full(len(part), c))
    have = np.zeros(m, bool)
    have[ids] = True
    empty = mix(mix(np.flatnonzero(~have).astype(U64) * U64(64) + U64(band)))
    return ids, exact, sizes, np.concatenate(gone) if gone else np.empty(0, U64), np.concatenate(owner) if owner else np.empty(0, np.int64), empty


class Costs:
    """A count-min sketch of keys."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.uint16) if counts is None else counts

    @staticmethod
    def cells(keys: np.ndarray, row: int) -> np.ndarray:
        return ((keys >> U64(row * SKETCH_BITS)) & U64((1 << SKETCH_BITS) - 1)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for row in range(SKETCH_ROWS):
            self.put(row, np.bincount(self.cells(keys, row), minlength=1 << SKETCH_BITS))

    def put(self, row: int, more: np.ndarray) -> None:
        """Counters stop at their largest value."""
        self.counts[row] = np.minimum(self.counts[row].astype(np.int64) + more, 65535)

    def ranges(self):
        """``(range, packed counters)`` of those ranges that have any."""
        for g, part in enumerate(self.counts.reshape(-1, SKETCH_RANGE)):
            if part.any():
                yield g, zlib.compress(part.tobytes(), 1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([self.counts[row][self.cells(keys, row)] for row in range(SKETCH_ROWS)])

    def packed(self) -> bytes:
        return zlib.compress(self.counts.tobytes(), 1)

    @staticmethod
    def unpacked(data: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data), np.uint16).reshape(SKETCH_ROWS, -1)


def signature_rows(tokens: np.ndarray, costs: Costs | None, plan: Plan) -> np.ndarray:
    """The keys that a set indexes; the lowest bit tells deletions (1) from what they are compared with (0).

    A deletion meets whole contents only: it is indexed under the key of the
    content it would leave, marked as a deletion.
    """
    out = []
    may = most_different(len(tokens), plan.percent)
    if may == 0:  # it links with equal sets only
        return np.empty(0, U64)
    one = U64(1)
    for band in bands_of(len(tokens), plan.percent):
        ids, exact, sizes, gone, owner, empty = segment_keys(tokens, band, plan)
        _, q = plan(band)
        first = ids < q
        spent = int(np.where(sizes[first] >= 2, 2, 1).sum())
        out.append(exact[first] & ~one)
        out.append(gone | one)
        need = may + 1 - spent
        if need <= 0:
            continue
        rest = exact[~first] & ~one
        if len(rest) > need:
            rank = costs.of(rest) if costs is not None else np.zeros(len(rest), np.uint32)
            # Within a power of two, by hash: estimates are rough, and an order by hash spreads evenly.
            rest = rest[np.lexsort((mix(rest), np.frexp(rank.astype(np.float64))[1]))]
        out.append(rest[:need])
        need -= len(rest)
        if need > 0:
            out.append((empty & ~one)[:need])
    return np.unique(np.concatenate(out)) if out else np.empty(0, U64)


def digest_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        first, second, n = mix(tokens).sum(dtype=U64), mix(tokens ^ U64(0x5BD1E995)).sum(dtype=U64), U64(len(tokens))
        inner = mix(np.array([second + n, first ^ n], U64))
        found = mix(np.array([first + inner[0], second + inner[1]], U64)).view(np.int64)
    return int(found[0]), int(found[1])


def class_of(tokens: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """A class's name; ``shared`` are the first halves that several classes have."""
    first, second = digest_of(tokens)
    return first ^ second if first in shared else first


def own_of(known_as: int, doc_id: int | None) -> int:
    """A number for a class and an id."""
    whole = (1 << 64) - 1
    inner = mix(np.array([(0 if doc_id is None else doc_id) & whole], U64))[0]
    return int(mix(np.array([known_as & whole], U64) ^ inner)[0].astype(np.int64))


def places_of(size: int) -> int:
    """Places of a set's histogram, a power of two: of long sets more, so that sets without common elements stay apart."""
    return min(MOST_PLACES, max(PLACES, 1 << max(0, (size // 4).bit_length() - 1)))


def histogram(tokens: np.ndarray) -> bytes:
    """Elements by the lowest bits of their hash; a place stops at 255, which keeps distances lower bounds."""
    places = places_of(len(tokens))
    return np.minimum(255, np.bincount((tokens & U64(places - 1)).astype(np.int64), minlength=places)).astype(np.uint8).tobytes()


def stacked(histograms: list[bytes], places: int) -> np.ndarray:
    """Histograms of ``places`` or more places as rows of ``places``: longer ones are folded."""
    out = np.empty((len(histograms), places), np.int16)
    for k, h in enumerate(histograms):
        out[k] = np.frombuffer(h, np.uint8) if len(h) == places else np.frombuffer(h, np.uint8).reshape(-1, places).sum(axis=0)
    return out


def possible_parts(histograms: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first one of its part, or -1: parts are joined by the pairs that sizes and histograms don't rule out."""
    n, order = len(sizes), np.argsort(sizes, kind="stable")
    size, label = sizes[order], np.arange(len(sizes))
    given = [histograms[k] for k in order.tolist()]
    # A set's partners among larger ones are a run of the order.
    stop = np.searchsorted(size * percent, 100 * size, side="right")
    ends: list[np.ndarray] = []
    begins: list[np.ndarray] = []
    alone = np.ones(n, bool)

    def settle() -> None:
        """Joins the parts of the pairs found so far.  Labels are roots, so what hung on a root before follows it."""
        nonlocal label
        if begins:
            a, b = np.concatenate(begins), np.concatenate(ends)
            while len(a):
                a, b = label[a], label[b]
                apart = a != b
                a, b = a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(label, deeper := label[label]):
                    label = deeper
            begins.clear()
            ends.clear()

    waiting, begin = 0, 0
    while begin < n:
        # Sets with the same number of places stand together, and their partners have no fewer.
        places, until = len(given[begin]), begin
        while until < n and len(given[until]) == places:
            until += 1
        h = stacked(given[begin : int(stop[until - 1])], places)
        for i in range(begin, until):
            if stop[i] <= i + 1:
                continue
            most = (100 - percent) * (size[i] + size[i + 1 : stop[i]]) // (100 + percent)
            near = np.flatnonzero(np.abs(h[i + 1 - begin : stop[i] - begin] - h[i - begin]).sum(axis=1, dtype=np.int64) <= most) + i + 1
            if len(near):
                alone[i] = alone[near] = False
                begins.append(np.full(len(near), i))
                ends.append(near)
                waiting += len(near)
                if waiting > MOST_PAIRS:
                    settle()
                    waiting = 0
        begin = until
    settle()
    out = np.full(n, -1)
    out[order] = np.where(alone, -1, order[label])
    return out


def labels_of(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix, the first node of its component."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.minimum(np.where(linked, label[None, :], n).min(axis=1), label)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _scanned(docs: DataFrame, words: int, plan: Plan) -> DataFrame:
    """One pass: ``doc_id, n_shingles, class, check, own, histogram`` of each row, and each task's key counts by range.

    ``class`` and ``check`` are the halves of the set's digest; ``own`` stands for the first and the id together.
    """
    percent, names = plan.percent, ["doc_id", "n_shingles", "class", "check", "own", "histogram", "g", "sketch"]

    def run(batches):
        costs, keys, waiting = Costs(), [], 0
        for batch in batches:
            n, known, own, places = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(words_of(text.as_py(), lower=True), words)
                n.append(len(s))
                places.append(histogram(s) if len(s) else None)
                known.append(digest_of(s) if len(s) else (None, None))
                own.append(own_of(known[-1][0], doc_id) if len(s) else None)
                for band in bands_of(len(s), percent):
                    keys.append(segment_keys(s, band, plan)[1] & ~U64(1))
                    waiting += len(keys[-1])
                if waiting > 1 << 20:
                    costs.add(np.concatenate(keys))
                    keys, waiting = [], 0
            halves = [pa.array(half, pa.int64()) for half in zip(*known, strict=True)] if known else [pa.nulls(0, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *halves, pa.array(own, pa.int64()), pa.array(places, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names
            )
        if keys:
            costs.add(np.concatenate(keys))
        for g, part in costs.ranges():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.binary()), pa.array([g], pa.int32()), pa.array([part], pa.binary())], names)
        release()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class long, check long, own long, histogram binary, g int, sketch binary")


def _merged(sketches: DataFrame) -> np.ndarray:
    """Adds up the tasks' sketches, a range of cells in each task; the driver gets one row a range."""

    def merge(batches):
        at, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(total.astype(np.uint16).tobytes(), 1)], pa.binary())], ["g", "sketch"])

        for batch in batches:
            for g, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if g != at:
                    if at is not None:
                        yield done()
                    at, total = g, np.zeros(SKETCH_RANGE, np.int64)
                total = np.minimum(65535, total + np.frombuffer(zlib.decompress(data.as_py()), np.uint16))
        if at is not None:
            yield done()

    dealt = sketches.select("g", "sketch").repartition(parallelism(sketches.sparkSession), "g").sortWithinPartitions("g")
    total = Costs()
    for row in written(dealt.mapInArrow(merge, "g int, sketch binary"), "key-counts").collect():
        total.counts.reshape(-1, SKETCH_RANGE)[row["g"]] = np.frombuffer(zlib.decompress(bytes(row["sketch"])), np.uint16)
    return total.counts


def _bit(bits: np.ndarray, value: int) -> bool:
    cell = value & ((1 << CLASS_BITS) - 1)
    return bool(bits[cell >> 3] >> (cell & 7) & 1)


def _index(docs: DataFrame, sketch: np.ndarray, repeated: bytes, speakers: bytes, words: int, plan: Plan, same_name: frozenset[int]) -> DataFrame:
    """``key, class``: what each class indexes; the key's lowest bit marks deletions."""
    shared = docs.sparkSession.sparkContext.broadcast((Costs(sketch).packed(), repeated, speakers))

    def run(batches):
        costs, again, speak = Costs(Costs.unpacked(shared.value[0])), np.frombuffer(shared.value[1], np.uint8), np.frombuffer(shared.value[2], np.uint8)

        def handed(known, keys):
            k = np.concatenate(keys)
            return pa.RecordBatch.from_arrays([pa.array(((k >> U64(2)) << U64(1) | (k & U64(1))).astype(np.int64)), pa.array(np.concatenate(known))], ["key", "class"])

        for batch in batches:
            known, keys, waiting = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(words_of(text.as_py(), lower=True), words)
                if not len(s):
                    continue
                c = class_of(s, same_name)
                if _bit(again, c) and not _bit(speak, own_of(digest_of(s)[0], doc_id)):
                    continue
                k = signature_rows(s, costs, plan)
                if len(k):
                    known.append(np.full(len(k), c, np.int64))
                    keys.append(k)
                    waiting += len(k)
                if waiting > 1 << 18:
                    yield handed(known, keys)
                    known, keys, waiting = [], [], 0
            if keys:
                yield handed(known, keys)
        release()

    return docs.mapInArrow(run, "key long, class long")


def candidate_rows(batches, few: int = FEW):
    """``(hub, a, b)`` arrays from sorted ``(key, class)`` arrays: pairs of classes that few share, else hubs and members.

    Rows come sorted by key (contents before deletions) and class.  A task holds a
    batch and at most ``few`` rows before it, so a key of any number of rows
    passes through.  Two deletions need no comparison, so a key without a whole
    content joins nothing.
    """

    def stars(hub, members):
        return np.ones(len(members), bool), np.full(len(members), hub), members

    key, known = np.empty(0, np.int64), np.empty(0, np.int64)
    open_base = open_hub = None
    for more_key, more_known in batches:
        key, known = np.r_[key, more_key], np.r_[known, more_known]
        first = np.r_[True, (key[1:] != key[:-1]) | (known[1:] != known[:-1])]
        key, known = key[first], known[first]
        base = key >> 1
        if open_base is not None:
            n = int(np.searchsorted(base, open_base, side="right"))
            if n and open_hub is not None:
                yield stars(open_hub, known[:n])
            key, known, base = key[n:], known[n:], base[n:]
            if not len(key):
                continue
            open_base = open_hub = None
        starts = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
        sizes = np.diff(np.r_[starts, len(base)])
        # The last run may go on in the next batch.
        yield from _complete(key[: starts[-1]], known[: starts[-1]], starts[:-1], sizes[:-1], few)
        key, known = key[starts[-1] :], known[starts[-1] :]
        if len(key) > few:
            open_base, open_hub = int(key[0] >> 1), int(known[0]) if key[0] & 1 == 0 else None
            if open_hub is not None:
                yield stars(open_hub, known)
            key, known = key[:0], known[:0]
    if len(key):
        yield from _complete(key, known, np.array([0]), np.array([len(key)]), few)


def _complete(key, known, starts, sizes, few):
    size, lead = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    at = np.arange(len(key))
    big = (size > few) & (key[lead] & 1 == 0)
    if big.any():
        yield np.ones(int(big.sum()), bool), known[lead[big]], known[big]
    end = lead + size
    for d in range(1, few):
        i = at[(size <= few) & (at + d < end) & (key & 1 == 0)]
        if not len(i):
            break
        a, b = known[i], known[i + d]
        apart = a != b
        a, b = a[apart], b[apart]
        yield np.zeros(len(a), bool), np.minimum(a, b), np.maximum(a, b)


def _candidates(index: DataFrame, few: int = FEW) -> DataFrame:
    """``hub, a, b``: distinct pairs of classes, and (where ``hub``) hubs with their members."""

    def run(batches):
        arrays = ((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows)
        for hub, a, b in candidate_rows(arrays, few):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(hub), pa.array(a), pa.array(b)], ["hub", "a", "b"])
        release()

    dealt = index.repartition(parallelism(index.sparkSession), F.expr("shiftright(key, 1)")).sortWithinPartitions("key", "class")
    return dealt.mapInArrow(run, "hub boolean, a long, b long").distinct()


def _sifted(pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``a, b, n_a, n_b, h_a, h_b`` that sizes and histograms don't rule out, as ``a, b, n_a, n_b``."""

    def run(batches):
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            h_a, h_b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            places = np.minimum(list(map(len, h_a)), list(map(len, h_b)))
            apart = np.empty(batch.num_rows, np.int64)
            for width in np.unique(places).tolist():
                at = np.flatnonzero(places == width)
                sides = (stacked([h[k] for k in at.tolist()], width) for h in (h_a, h_b))
                apart[at] = np.abs(np.subtract(*sides)).sum(axis=1, dtype=np.int64)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(apart <= (100 - percent) * (n_a + n_b) // (100 + percent)))

    sized = pairs.where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "n_a", "n_b", "h_a", "h_b").mapInArrow(run, "a long, b long, n_a long, n_b long")


def forest(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of some sets, the first set of its component under links."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, place, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Elements that one set has alone are in no intersection.
    keep = shared[place] > 1
    owner, place = owner[keep], (np.cumsum(shared > 1) - 1)[place[keep]]
    width, step = int((shared > 1).sum()), 4096
    # A product of a step is exact in 32 bits; sums over steps, and a hundred times these, need not be.
    both = np.zeros((n, n), np.float64)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for begin in range(0, width, step):
        lo, hi = np.searchsorted(place, [begin, begin + step])
        x = np.zeros((n, min(step, width - begin)), np.float32)
        x[owner[lo:hi], place[lo:hi] - begin] = 1
        both += x @ x.T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    return labels_of(linked)


def _by_group(batches, n_key: int):
    """``(key, other columns as lists)`` of each run of rows with equal first columns; a task holds one run."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_key] != at:
                if held:
                    yield at, list(zip(*held, strict=True))
                at, held = row[:n_key], []
            held.append(row[n_key:])
    if held:
        yield at, list(zip(*held, strict=True))


def _batches(rows, names: list[str], size: int = 50_000):
    """Tuples of integers as record batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)


def _dealt(members: DataFrame, key: list[str]) -> DataFrame:
    return members.repartition(parallelism(members.sparkSession), *key).sortWithinPartitions(*key)


def _chunk_pairs(members: DataFrame, chunks: DataFrame, key: list[str], i: str = "i", j: str = "j") -> DataFrame:
    """``members`` once for each pair of chunks that it takes part in: any two members of a group meet in some pair."""
    c = F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")
    dealt = members.join(chunks, key).withColumn("own_chunk", c).withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumns({i: F.least("own_chunk", "other_chunk").cast("long"), j: F.greatest("own_chunk", "other_chunk").cast("long")}).drop("own_chunk", "other_chunk", "chunks")


def _parts(members: DataFrame, percent: int) -> DataFrame:
    """``g, i, j, part, class`` of members that some other in their group may link with; ``part`` is one's class."""
    names = ["g", "i", "j", "part", "class"]

    def rows(batches):
        for key, (known, sizes, histograms) in _by_group(batches, 3):
            if len(known) > 1:
                part = possible_parts(list(histograms), np.array(sizes), percent)
                for k in np.flatnonzero(part >= 0).tolist():
                    yield (*key, known[part[k]], known[k])

    dealt = _dealt(members, ["g", "i", "j"]).select("g", "i", "j", "class", "n_shingles", "histogram")
    return dealt.mapInArrow(lambda batches: _batches(rows(batches), names), "g long, i long, j long, part long, class long")


#: What names a group of sets that are verified together.
GROUP = ["g", "i", "j", "part", "x", "y"]


def _token_sets(docs: DataFrame, words: int, same_name: frozenset[int]) -> DataFrame:
    """``GROUP``, ``class``, ``tokens`` of ``doc_id, text, GROUP, class`` rows whose text is of the class."""

    def run(batches):
        for batch in batches:
            rows, sets, held, last = [], [], 0, (None, None, None)
            for k, text in enumerate(batch.column(1)):
                told = text.as_py()
                if told != last[0]:  # a text that is in several groups comes several times in a row
                    s = shingle_set(words_of(told, lower=True), words)
                    last = (told, class_of(s, same_name) if len(s) else None, s.tobytes())
                if last[1] == batch.column(8)[k].as_py():
                    rows.append(k)
                    sets.append(last[2])
                    held += len(last[2])
                if held > HELD_BYTES:
                    yield _with_sets(batch, rows, sets)
                    rows, sets, held = [], [], 0
            if rows:
                yield _with_sets(batch, rows, sets)
        release()

    schema = ", ".join(f"{c} long" for c in (*GROUP, "class")) + ", tokens binary"
    return docs.select("doc_id", "text", *GROUP, "class").mapInArrow(run, schema)


def _with_sets(batch: pa.RecordBatch, rows: list[int], sets: list[bytes]) -> pa.RecordBatch:
    taken = batch.select(range(2, 9)).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*taken.columns, pa.array(sets, pa.binary())], [*GROUP, "class", "tokens"])


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: a forest of the links within each group."""

    def rows(batches):
        for _, (known, tokens) in _by_group(batches, len(GROUP)):
            label = forest([np.frombuffer(t, U64) for t in tokens], percent)
            yield from ((known[k], known[f]) for k, f in enumerate(label.tolist()) if known[k] != known[f])

    return _dealt(sets, GROUP).select(*GROUP, "class", "tokens").mapInArrow(lambda batches: _batches(rows(batches), ["a", "b"]), "a long, b long")


def _chunks() -> Column:
    return F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n_shingles") / CHUNK_ELEMENTS)).cast("int").alias("chunks")


def _groups_of_pairs(possible: DataFrame) -> DataFrame:
    """``GROUP, class``: the parts into which possible pairs fall, in chunks, or as pairs where that moves fewer sets."""
    nodes = possible.select(F.col("a").alias("class"), F.col("n_a").alias("n_shingles")).unionByName(possible.select(F.col("b").alias("class"), F.col("n_b").alias("n_shingles"))).distinct()
    part_of = written(components(possible).withColumnsRenamed({"node": "class", "component": "g"}), "pair-parts")
    pairs = possible.join(part_of.withColumnRenamed("class", "a"), "a").select("a", "b", "g")
    sized = nodes.join(part_of, "class").groupBy("g").agg(F.count("*").alias("sets"), _chunks())
    sized = sized.join(pairs.groupBy("g").agg(F.count("*").alias("pairs")), "g").withColumn("apart", (F.col("chunks") > 1) & (F.col("sets") * F.col("chunks") > 2 * F.col("pairs")))
    sized = written(sized.select("g", "chunks", "apart"), "pair-part-sizes")
    number = lambda k: F.lit(k).cast("long")
    together = _chunk_pairs(part_of, sized.where(~F.col("apart")).select("g", "chunks"), ["g"], "x", "y").withColumns({"i": number(-1), "j": number(0), "part": number(0)})
    apart = pairs.join(sized.where(F.col("apart")).select("g"), "g").select(F.col("a").alias("g"), F.col("b").alias("part"), F.explode(F.array("a", "b")).alias("class"))
    return together.select(*GROUP, "class").unionByName(apart.withColumns({"i": number(-2), "j": number(0), "x": number(0), "y": number(0)}).select(*GROUP, "class"))


def _groups_of_hubs(star: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``GROUP, class``: the parts of each pair of a hub's chunks, in chunks again."""
    star = star.unionByName(star.select("g", F.col("g").alias("class")).distinct())
    sized = classes.select("class", "n_shingles", "histogram")
    star = star.join(sized.select("class", "n_shingles", F.length("histogram").alias("bytes")), "class")
    chunks = star.groupBy("g").agg(F.ceil(F.sum("bytes") / CHUNK_HISTOGRAMS).cast("int").alias("chunks"))
    parts = written(_parts(_chunk_pairs(star.select("g", "class"), chunks, ["g"]).join(sized, "class"), percent), "hub-parts")
    key = ["g", "i", "j", "part"]
    chunks = parts.join(sized.select("class", "n_shingles"), "class").groupBy(*key).agg(_chunks())
    return _chunk_pairs(parts, chunks, key, "x", "y").select(*GROUP, "class")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """Rows and classes by the names that classes end up with, and the first halves that several classes have.

    Of 2**32 classes two are expected to share one, so the driver gets a few numbers.
    """
    same_name: frozenset[int] = frozenset()
    while True:
        named = F.when(F.col("class").isin(*same_name), F.col("class").bitwiseXOR(F.col("check"))).otherwise(F.col("class")) if same_name else F.col("class")
        now = rows.withColumn("name", named)
        # One row for each class, reduced within tasks first: a class may be that of most rows.
        classes = now.where("class is not null").groupBy("name").agg(
            F.count("*").alias("n_rows"),
            F.max("n_shingles").alias("n_shingles"),
            F.max("histogram").alias("histogram"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("speaker"),
            salt_mask("salt").alias("salts"),
            (F.min(F.struct("class", "check")) != F.max(F.struct("class", "check"))).alias("several"),
            F.array(F.min("class"), F.max("class")).alias("halves"),
        )
        classes = written(classes.select(F.col("name").alias("class"), "n_rows", "n_shingles", "histogram", F.col("speaker.doc_id").alias("least_id"), F.col("speaker.own").alias("own"), "salts", "several", "halves"), "classes")
        more = {r["half"] for r in classes.where("several").select(F.explode("halves").alias("half")).collect()}
        if more <= same_name:
            return now.drop("class", "check").withColumnRenamed("name", "class"), classes.drop("several", "halves"), same_name
        same_name |= more


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row."""
    small_batches(docs.sparkSession)
    plan = Plan(percent)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    scanned = written(_scanned(given, words, plan), "shingle-sets")
    sketch = _merged(scanned.where("g is not null"))
    rows = scanned.where("g is null").select("doc_id", "n_shingles", "class", "check", "own", "histogram").withColumn("salt", salt_of("doc_id", "own"))
    rows, classes, same_name = _classes(rows)
    again = classes.where("n_rows > 1")
    repeated, speakers = (bitmap_bytes(bitmap(again, F.col(c), CLASS_BITS), CLASS_BITS) for c in ("class", "own"))

    found = written(_candidates(_index(given, sketch, repeated, speakers, words, plan, same_name)), "candidates")
    side = lambda s: classes.select(F.col("class").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("histogram").alias(f"h_{s}"))
    possible = written(_sifted(found.where("not hub").join(side("a"), "a").join(side("b"), "b"), percent), "possible")
    star = found.where("hub and a <> b").select(F.col("a").alias("g"), F.col("b").alias("class"))
    groups = written(_groups_of_pairs(possible).unionByName(_groups_of_hubs(star, classes, percent)), "groups")
    members = written(groups.join(classes.select("class", F.col("least_id").alias("speaker_id")), "class"), "members")
    few = members.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    told = given.join(F.broadcast(members) if few else members, F.col("doc_id").eqNullSafe(F.col("speaker_id")))
    links = written(_linked(_token_sets(told, words, same_name), percent), "links")

    named = written(components(links), "components")
    reached = named.join(classes.select(F.col("class").alias("node"), "least_id"), "node")
    least = reached.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("node").alias("class"), "component_id")
    told = classes.join(named, "class", "left").select("class", F.coalesce("component_id", "least_id").alias("component_id"), salts_of("salts").alias("salt"))
    full = rows.where("class is not null").select("doc_id", "n_shingles", "class", "salt").join(told, ["class", "salt"]).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near duplicates keeps one document, with all their columns.

    The rows of the component's least id stay.  Rows with a null id stay; where
    rows share an id but not the text, all go or none: those whose id is the least
    of some component that one of them is in.
    """
    found = written(join(docs).where("doc_id is not null"), "near-components")
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    gone = found.where("doc_id <> component_id").select("doc_id").distinct().join(stay, "doc_id", "left_anti")
    return without(docs, written(gone, "near-copies"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * both_n >= 80 * (na + nb - both_n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.a)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT a, min(c) AS component_id FROM reach GROUP BY 1) m ON m.a = s.doc_id
"""
