"""Token budgets: rows in rank order are shown until one doesn't fit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within_budget(rows: DataFrame, order: list, tokens, limit: int, spent: int = 0) -> DataFrame:
    """The longest prefix in ``order`` whose tokens fit; where nothing is spent yet, the first row always fits.

    Each row costs at least a token, so the prefix is found among the first
    ``limit`` rows: a top-k, not a sort of everything.
    """
    top = rows.withColumn("__tokens", tokens).orderBy(*order).limit(max(1, limit))
    w = Window.orderBy(*order)
    run = top.withColumn("__used", F.sum("__tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) + spent).withColumn("__no", F.row_number().over(w))
    fits = F.col("__used") <= limit
    if spent == 0:
        fits = fits | (F.col("__no") == 1)
    # A row after the first misfit doesn't count even if it would fit.
    run = run.withColumn("__ok", F.min(fits.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("__ok = 1").drop("__tokens", "__used", "__no", "__ok")


def tokens_of(text: str) -> int:
    """Four UTF-16 units a token, at least 1 unless empty."""
    units = len(text.encode("utf-16-le", "surrogatepass")) // 2
    return math.ceil(units / 4)


class Budget:
    """Running count for the nested views, which are rendered from a bounded prefix on the driver."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0

    def fits(self, text: str) -> bool:
        return self.used == 0 or self.used + tokens_of(text) <= self.limit

    def spend(self, text: str) -> bool:
        """Spend if it fits."""
        if not self.fits(text):
            return False
        self.used += tokens_of(text)
        return True

    def charge(self, text: str) -> None:
        self.used += tokens_of(text)
