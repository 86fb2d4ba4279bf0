"""What the operators of this subpackage share: tables, the shared folder, salts and bitmaps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Salts over which the rows of one key are dealt; as many as a long has usable bits.
SALTS = 62
#: Bytes of an Arrow batch of texts; both sides of a Python worker hold one, and pools keep what the largest took.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bits of one row of a bitmap: what ``bitmap_construct_agg`` makes.
PAGE = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only in a local session where that is unset (as in tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to ``BATCH_BYTES``, so that long texts take bounded memory."""
    now = spark.conf.get(_BATCH).lower()
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def release() -> None:
    """At the end of a task in Python: gives memory that is free but held back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def salt_of(*columns: str) -> Column:
    """Deals rows over ``SALTS`` values."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salt_mask(salt: str) -> Column:
    """Aggregates which salts occur."""
    return F.bit_or(F.expr(f"shiftleft(1L, {salt})"))


def salts_of(mask: str) -> Column:
    """One row for each salt of a mask: a group's figures go to its rows by ``(key, salt)``, so a hot key's rows stay dealt out."""
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> shiftright({mask}, i) & 1L = 1L)"))


def bitmap(rows: DataFrame, value: Column, bits: int) -> DataFrame:
    """``page, bits``: a bit for each cell that a (long) value falls in; ``2**bits`` cells whatever the number of rows."""
    cell = value.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    cells = rows.select(cell.alias("cell")).where("cell is not null")
    return cells.groupBy(F.expr(f"cast(cell div {PAGE} as int)").alias("page")).agg(F.bitmap_construct_agg(F.expr(f"cell % {PAGE}")).alias("bits"))


def bitmap_bytes(pages: DataFrame, bits: int) -> bytes:
    """The whole bitmap, for tasks in Python; cell ``c`` is bit ``c % 8`` of byte ``c // 8``."""
    found = {r["page"]: bytes(r["bits"]) for r in pages.collect()}
    return b"".join(found.get(p, bytes(PAGE // 8)) for p in range(max(1, (1 << bits) // PAGE)))[: max(1, (1 << bits) // 8)]


def marked(df: DataFrame, value: Column, pages: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether the value's bit is set.  Broadcast are at most ``2**bits / 8`` bytes."""
    cell, page, held = new_name(df, "cell_of_row"), new_name(df, "page_of_bits"), new_name(df, "bits_of_page")
    told = F.broadcast(pages.select(F.col("page").alias(page), F.col("bits").alias(held)))
    given = df.withColumn(cell, value.bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    joined = given.join(told, F.expr(f"cast(`{cell}` div {PAGE} as int)") == F.col(page), "left")
    bit = F.expr(f"shiftright(cast(conv(hex(substring(`{held}`, cast(`{cell}` % {PAGE} div 8 as int) + 1, 1)), 16, 10) as int), cast(`{cell}` % 8 as int)) & 1 = 1")
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop(cell, page, held)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", bits: int = 24) -> DataFrame:
    """The rows of ``docs`` whose id isn't the (only) column of ``ids``; rows with a null id stay.

    Only rows whose id may be among ``ids``, by a bitmap of fixed size, are joined:
    where few go, hardly any text moves.
    """
    gone, flag = new_name(docs, "id_that_goes"), new_name(docs, "may_go")
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias(gone))
    number = F.col(id_col).cast("long")
    seen = marked(docs, F.xxhash64(number), written(bitmap(ids, F.xxhash64(gone), bits), "bitmap"), bits, flag)
    stay = seen.where(~F.col(flag)).drop(flag)
    maybe = seen.where(F.col(flag)).drop(flag)
    return stay.unionByName(maybe.join(ids, number == F.col(gone), "left_anti")).select(*listed(docs))
