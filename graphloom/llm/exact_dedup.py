"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of the text.  A
batch is reduced to one row per digest (partial aggregation, so a text that a
third of all rows share costs one row per task) and joined to the index by a
sort-merge anti-join; the digests that remain are appended as first seen.  Of
digests that the index knows, the batch's count is appended, so sizes of groups
hold over any number of batches.

*Runs again.*  A batch has a name.  What it appends is a partition of that name,
which a second run replaces, and a run never looks at rows of its own name: it
decides as the first run did.  ``compact`` merges all partitions into one with
one file a bucket; rows keep their batch's name, so this holds after it too.
Readers count a row once however often a merge that broke off has written it.
Over a compacted index the joins need neither a shuffle nor a sort of its side.

*Texts stay where they are.*  Signatures alone are grouped.  ``keep_new`` then
passes rows on by two bitmaps of fixed size, of the digests that are repeated or
known and of the rows kept among them; only a row with both bits set is joined,
so of a hot text hardly more than the row that stays is ever shuffled.

Defined cases.  Null text counts as empty, and empty texts equal each other.  Of
equal texts in one batch the largest ``doc_id`` stays; a text that the index
held before keeps the row it had.  Of repeated rows (same id and text) one is
kept, any where other columns differ.  Rows without a ``doc_id`` stay only where
no row of the text has one.  Very long texts become 32 bytes before anything
moves.  An empty table gives an empty result.  Other columns are never looked
at, and helper columns get names that no column has.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import bitmap, listed, marked, new_name, parallelism, salt_mask, salt_of, salts_of, scratch, table, text_of, written

#: The logarithm of the length of the bitmaps; 2 * 2 MB are broadcast.
BITS = 24
#: The partition of a compacted index.
MERGED = "merged-"
_SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """While this holds, scans of a table with one file a bucket are known to be sorted."""
    before = spark.conf.get(_SORTED_SCANS)
    spark.conf.set(_SORTED_SCANS, "true")
    try:
        yield
    finally:
        spark.conf.set(_SORTED_SCANS, before)


class DigestIndex:
    """Digests seen so far, by batch: ``digest binary, keep_id long, n long, first boolean, batch string, part string``.

    ``first`` marks the batch that first had the digest, whose ``keep_id`` stays.
    ``path`` is where the table's files lie; a later session that gives the same
    path and ``buckets`` finds the index again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or parallelism(spark)
        self.name = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
        columns = "digest BINARY, keep_id BIGINT, n BIGINT, first BOOLEAN, batch STRING, part STRING"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) "
            f"USING parquet PARTITIONED BY (part) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        # Partitions that an earlier session wrote are found in the folder; a write of no rows makes that where it is missing.
        spark.createDataFrame([], columns).write.mode("append").partitionBy("part").parquet(path)
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def parts(self) -> list[str]:
        return [r[0].removeprefix("part=") for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("part")

    def before(self, batch: str) -> DataFrame:
        """What other batches have put here."""
        return self.rows().where(F.col("batch") != batch)

    def totals(self) -> DataFrame:
        """``digest, keep_id, n`` over all batches."""
        once = self.rows().groupBy("digest", "batch").agg(F.max("n").alias("n"), F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id"))
        return once.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def _put(self, rows: DataFrame, part: str, how: str = "OVERWRITE") -> None:
        """One file a bucket, in place of what the partition had."""
        view = f"{self.name}_rows"
        rows.select("digest", "keep_id", "n", "first", "batch").repartition(self.buckets, "digest").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT {how} TABLE {self.name} PARTITION (part = '{part}') SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)
        self.spark.catalog.refreshTable(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """A batch that was merged before is there already."""
        merged = self.spark.table(self.name).where(F.col("part").startswith(MERGED) & (F.col("batch") == batch))
        if merged.limit(1).count() == 0:
            self._put(rows.withColumn("batch", F.lit(batch)), batch)

    def compact(self) -> None:
        old = self.parts()
        if len(old) < 2:
            return
        merged = self.rows().groupBy("digest", "batch").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n"), F.max("first").alias("first"))
        self._put(merged, f"{MERGED}{uuid.uuid4().hex}", "INTO")
        none = self.spark.createDataFrame([], "digest binary, keep_id long, n long, first boolean, batch string")
        for part in old:
            # Of an external table, dropping a partition would leave its files for the next session to find.
            self._put(none, part)
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (part = '{part}')")

    def forget(self) -> None:
        """Drops the table's entry in the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest_of(text_col: str) -> Column:
    return F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, row``: texts become 32 bytes before anything moves; ``row`` tells repeated rows apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"), F.monotonically_increasing_id().alias("row"))


def decided(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """Signatures, and ``digest, n, salts, keep_id, keep_row, group_size`` of each digest; the index has the batch then.

    ``keep_row`` is null where another batch had the text first.
    """
    batch = uuid.uuid4().hex if batch is None else batch
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch.startswith(MERGED):
        raise ValueError(f"not a name for a batch: {batch}")
    sigs = written(signatures(docs, id_col, text_col).withColumn("salt", salt_of("doc_id", "row")), "digests")
    groups = sigs.groupBy("digest").agg(
        # A struct without an id is the least.
        F.max(F.struct("doc_id", "row")).alias("last"),
        F.count("*").alias("n"),
        salt_mask("salt").alias("salts"),
    )
    groups = written(groups.select("digest", "n", "salts", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row")), "batch")
    with sorted_scans(docs.sparkSession):
        before = index.before(batch)
        fresh = groups.join(before.where(F.col("first")).hint("merge"), "digest", "left_anti").select("digest", "keep_id", "n", F.lit(True).alias("first"))
        known = groups.select("digest", F.col("n").alias("n_here")).join(before.hint("merge"), "digest")
        once = known.groupBy("digest", "n_here", "batch").agg(F.max("n").alias("n"), F.max("first").alias("first"), F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id"))
        known = once.groupBy("digest", "n_here").agg(F.sum("n").alias("n_before"), F.max("first").alias("seen"), F.max("keep_id").alias("old_id"))
        known = written(known, "known")
        fresh = written(fresh, "fresh")
    more = known.where(F.col("seen")).select("digest", F.lit(None).cast("long").alias("keep_id"), F.col("n_here").alias("n"), F.lit(False).alias("first"))
    index.append(fresh.unionByName(more), batch)
    seen = F.coalesce("seen", F.lit(False))
    groups = groups.join(known.drop("n_here"), "digest", "left").select(
        "digest",
        "n",
        "salts",
        F.when(seen, F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(~seen, F.col("keep_row")).alias("keep_row"),
        (F.col("n") + F.coalesce("n_before", F.lit(0))).alias("group_size"),
    )
    return sigs, written(groups, "keepers")


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Append a batch to the index; report ``doc_id, digest, keep_id, group_size, kept`` for each row."""
    sigs, groups = decided(docs, index, id_col, text_col, batch)
    told = groups.select("digest", "keep_id", "keep_row", "group_size", salts_of("salts").alias("salt"))
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept")
    return sigs.join(told, ["digest", "salt"]).select("doc_id", "digest", "keep_id", "group_size", kept)


def keep_new(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    _, groups = decided(docs, index, id_col, text_col, batch)
    digest, repeated, kept, first, told_digest, told_id = (new_name(docs, c) for c in ("digest_of_text", "may_repeat", "may_stay", "row_of_copies", "told_digest", "told_id"))
    many = written(bitmap(groups.where("keep_row is null or n > 1"), F.xxhash64("digest"), bits), "bitmap")
    # A text that stands alone may share the bit of one that doesn't; its row is among those that stay.
    told = marked(groups, F.xxhash64("digest"), many, bits, repeated).where(F.col(repeated) & F.col("keep_row").isNotNull())
    told = written(told.select(F.col("digest").alias(told_digest), F.col("keep_id").alias(told_id)), "stay")
    kept_rows = written(bitmap(told, F.xxhash64(told_digest, told_id), bits), "bitmap")

    given = marked(docs.withColumn(digest, digest_of(text_col)), F.xxhash64(digest), many, bits, repeated)
    alone = given.where(~F.col(repeated)).select(*listed(docs))
    number = F.col(id_col).cast("long")
    copies = marked(given.where(F.col(repeated)), F.xxhash64(F.col(digest), number), kept_rows, bits, kept).where(F.col(kept))
    joined = copies.join(told, (F.col(digest) == F.col(told_digest)) & number.eqNullSafe(F.col(told_id)), "left_semi")
    joined = joined.withColumn(first, F.row_number().over(Window.partitionBy(digest).orderBy(digest)))
    return alone.unionByName(joined.where(F.col(first) == 1).select(*listed(docs)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, scratch(spark, "digest-index"))
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), index, batch="documents")
    index.forget()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
