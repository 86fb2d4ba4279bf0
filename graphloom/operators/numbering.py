"""Dense numbers over a total order, without one task for everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.shared_folder import written

#: Up to so many rows (counted first) one task numbers them.
SMALL = 50_000
#: How far Spark shifts a task's number in the ids that it gives to rows.
TASK_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 0, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name`` = ``start, start + 1, ...`` in ``order``, which should be total; columns to ``drop`` only order.

    Large inputs are ranged over tasks by the order's columns and sorted there. Rows
    are written once, each with its task and place in it; the tasks' counts (one
    number a task) give the offsets.
    """
    spark = df.sparkSession
    if df.limit(SMALL + 1).count() <= SMALL:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long")).drop(*drop)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id counts a task's rows in their order; its upper bits name the task.
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    kept = written(ranged.drop(*drop), "numbered")
    task = F.shiftright("__place", TASK_BITS).cast("int")
    sizes = {r["task"]: r["count"] for r in kept.groupBy(task.alias("task")).count().collect()}
    at, offsets = start, []
    for k in range(max(sizes) + 1):
        offsets.append(at - (k << TASK_BITS))
        at += sizes.get(k, 0)
    shift = F.element_at(F.lit(offsets).cast("array<bigint>"), task + 1)
    return kept.select(*[c for c in df.columns if c not in drop], (F.col("__place") + shift).alias(name))
