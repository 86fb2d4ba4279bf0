"""Document fingerprints from closed syncmers, matched by position.

A text is cut into tokens: a word of at most ``WORD`` characters between gaps is
one; a longer run without gaps (as in scripts that don't set any) is cut after
each character outside ASCII and after each of ``CUTS``, so its tokens follow
from the characters beside them and not from where the run began.

A k-mer (``K`` tokens) is a closed syncmer if the least hash among its inner
s-mers (``S`` tokens) lies at its first or last place.  Whether a k-mer is chosen
depends on the k-mer alone, so equal passages give equal anchors wherever they
stand, and two neighbouring anchors are at most ``K - S`` tokens apart.

The fingerprint lists every anchor in order, as nine hexadecimal digits: eight of
its hash and one for its distance from the anchor before (for the first, from the
start).  Two fingerprints are matched by position: a link is two neighbouring
anchors and their distance, so it agrees only where the same anchors follow each
other as far apart; where the passage stands doesn't matter.  The likeness of two
fingerprints is their links' Jaccard similarity, exact up to hash collisions.

A document meets its successor in a block of neighbouring ids, to which texts
move once.

Defined cases.  Null text counts as empty; empty texts and texts without tokens
have the empty fingerprint, and two empty fingerprints are alike by 1, an empty
and another by 0.  A text of fewer than ``K`` tokens has one anchor, its whole
token sequence, and a fingerprint of one anchor has one link, that anchor.  Very
long texts have anchors all along; links that recur count once.  Equal texts have
equal fingerprints.  Rows with equal ids (a null id is the least) follow each
other by a hash of their texts.  A table of one row is its own next one, an empty table gives an
empty result.  Other columns are ignored.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import parallelism, table, text_of

K, S, WORD = 8, 2, 24
#: Characters after which long runs are cut: of random letters or digits about every fifth.
CUTS = "aeiouAEIOU02468"
_GAP, _END = r"\x20\x09-\x0D", CUTS + r"\x{80}-\x{10FFFF}"
TOKEN = rf"(?<![^{_GAP}])[^{_GAP}]{{1,{WORD}}}+(?![^{_GAP}])|[^{_GAP}{_END}]*+[{_END}]|[^{_GAP}{_END}]++"
#: Most blocks into which ids are ranged; the list of their bounds travels with the plan.
MAX_BLOCKS = 4096


def tokens(text: Column) -> Column:
    """Hashes of a text's tokens."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """``array<struct<pos int, hash int>>`` of the closed syncmers; ``pos`` counts tokens from 0.

    Hash arrays are bound to lambda variables, so that each is computed once.
    """
    edge = k - s  # the last place of an s-mer in a k-mer
    smers = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - s), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(s)]))
    places = lambda w: F.sequence(F.lit(0), F.size(w) - k)
    short = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash")
    kmer = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])

    def chosen(m, i):
        inner = F.least(*[F.get(m, i + j) for j in range(1, edge)])
        return F.least(F.get(m, i), F.get(m, i + edge)) <= inner

    def found(w):
        with_smers = F.transform(F.array(smers(w)), lambda m: F.transform(F.filter(places(w), lambda i: chosen(m, i)), lambda i: F.struct(i.alias("pos"), short(kmer(w, i)))))
        return F.element_at(with_smers, 1)

    whole = lambda w: F.array(F.struct(F.lit(0).alias("pos"), short(F.xxhash64(w))))
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    of = lambda w: F.when(F.size(w) >= k, found(w)).when(F.size(w) > 0, whole(w)).otherwise(none)
    return F.element_at(F.transform(F.array(tokens(text)), of), 1)


def packed(found: Column) -> Column:
    """Anchors as longs: the distance from the anchor before (from the start, for the first) above 32 bits of hash."""

    def of(a):
        gap = lambda x, i: (x["pos"] - F.coalesce(F.get(a, i - 1)["pos"], F.lit(0))).cast("long")
        return F.transform(a, lambda x, i: x["hash"].bitwiseOR(F.shiftleft(gap(x, i), 32)))

    return F.element_at(F.transform(F.array(found), of), 1)


def fingerprint(anchored: Column) -> Column:
    """All packed anchors in order, nine hexadecimal digits each."""
    return F.array_join(F.transform(anchored, lambda x: F.lower(F.lpad(F.hex(x), 9, "0"))), "")


def anchors_of(shown: Column) -> Column:
    """The packed anchors that a fingerprint lists."""
    return F.transform(F.regexp_extract_all(shown, F.lit("[0-9a-f]{9}"), F.lit(0)), lambda p: F.conv(p, 16, 10).cast("long"))


def links(anchored: Column) -> Column:
    """Distinct links of packed anchors: hashes of two neighbours and their distance; of a single anchor, itself."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))

    def of(a):
        linked = F.transform(F.sequence(F.lit(0), F.size(a) - 2), lambda i: F.xxhash64(low(F.get(a, i)), F.get(a, i + 1)))
        return F.array_distinct(F.when(F.size(a) > 1, linked).otherwise(F.transform(a, low)))

    return F.element_at(F.transform(F.array(anchored), of), 1)


def alike(a: Column, b: Column) -> Column:
    """0 to 1, from two texts' links."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / F.greatest(F.lit(1), F.size(a) + F.size(b) - common))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints."""
    return alike(links(anchors_of(a)), links(anchors_of(b)))


def _below(cuts: list[int], key: Column, step: int = 64) -> Column:
    """How many of some sorted numbers aren't above ``key``: first among every ``step``-th, then among those between two of these."""
    count = lambda numbers: F.size(F.filter(numbers, lambda c: c <= key))
    listed = lambda numbers: F.array(*map(F.lit, numbers)).cast("array<bigint>")
    whole = count(listed(cuts[step - 1 :: step]))
    return whole * step + count(F.slice(listed(cuts), whole * step + 1, step - 1))


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """``doc_id, text, anchored, next_text, next_anchored``: the next document by id, after the last the first.

    Ids are ranged into blocks of about equal numbers; a block also gets the
    first row of the block after it, so texts move once.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    # Equal ids follow each other by this number of their texts.
    base = base.withColumns({"key": F.coalesce("doc_id", F.lit(-(2**63))), "tie": F.xxhash64("text")})
    n = min(MAX_BLOCKS, blocks or 2 * parallelism(spark))
    cuts = base.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000).alias("b")).first()["b"]
    cuts = sorted(set(cuts or []))
    base = base.withColumn("block", _below(cuts, F.col("key")))
    # Each block's first id is told to the block before it as well; one id a block, so the list is bounded.
    heads = sorted(tuple(r) for r in base.groupBy("block").agg(F.min("key")).collect())
    blocks_before = {key: heads[i - 1][0] for i, (_, key) in enumerate(heads)}  # the first's is the last
    told = F.create_map(*[F.lit(x) for pair in blocks_before.items() for x in pair]).cast("map<bigint,int>")
    place = lambda b, ghost: F.struct(b.cast("int").alias("block"), F.lit(ghost).alias("ghost"))
    both = F.when(F.col("key").isin(list(blocks_before)), F.array(place(F.col("block"), False), place(told[F.col("key")], True)))
    base = base.withColumn("anchored", packed(anchors(F.col("text"))))
    rows = base.withColumn("at", F.explode(F.coalesce(both, F.array(place(F.col("block"), False))))).select("doc_id", "key", "tie", "text", "anchored", "at.block", "at.ghost")
    w = Window.partitionBy("block").orderBy("ghost", "key", "tie")
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next_anchored": F.lead("anchored").over(w)})
    return rows.where("not ghost").select("doc_id", "text", "anchored", "next_text", "next_anchored")


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(table(spark, sf_dir, "documents"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    d = d.withColumn("edited_anchored", packed(anchors(F.col("edited"))))
    own = links(F.col("anchored"))
    return d.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("anchored")).alias("fingerprint"),
        fingerprint(F.col("edited_anchored")).alias("edited_fingerprint"),
        alike(own, links(F.col("edited_anchored"))).alias("near_edited"),
        alike(own, links(F.col("next_anchored"))).alias("near_next"),
    )
