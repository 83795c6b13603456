"""A key join that survives one key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least rows of a hot key, and the most keys that may count as hot: what is broadcast never grows beyond it.
HOT_ROWS, MOST_HOT = 200_000, 10_000


def hot_split_join(left: DataFrame, right: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` left-joined with ``right``, whose keys are unique; both may hold nulls, which match nothing.

    Keys with at least `hot_rows` rows on the left, and with at least one in `MOST_HOT` of all rows, are joined by
    broadcast: there are at most `MOST_HOT` of them, whatever the data. The others are shuffled on the key. No row is
    dropped or repeated.
    """
    on = list(on)
    every = left.where(F.col(on[-1]).isNotNull()).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total = F.broadcast(every.agg(F.sum("_rows").alias("_total")))  # one row
    counts = every.where(F.col("_rows") >= hot_rows).join(total, F.lit(True)).where(F.col("_rows") >= F.col("_total") / MOST_HOT).drop("_rows", "_total")
    hot = F.broadcast(counts.withColumn("_hot", F.lit(True)))
    extra = [c for c in right.columns if c not in on]
    marked = left.join(hot, on, "left")
    hot_right = F.broadcast(right.join(F.broadcast(counts), on, "left_semi"))
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, on, "left")
    warm = marked.where(F.col("_hot")).drop("_hot").join(hot_right, on, "left")
    order = [*left.columns, *extra]
    return cold.select(*order).unionByName(warm.select(*order))
