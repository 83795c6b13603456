"""Overlapping and gapped intervals: merged stretches and the gaps between them.

A mergeable aggregate of sorted, disjoint intervals, combined in a reduction tree over line ranges:

1. (key, start) keeps the greatest end. A hash aggregate with map-side combine and one number of state, so a key
   with a third of all rows is reduced before it is shuffled; for equal starts only the greatest end matters.
2. In each (key, block of `BLOCK` lines) the starts are sorted once; a start beyond the greatest end so far begins an
   island. The islands of a block are its sorted disjoint list, of at most `BLOCK` / 2 intervals.
3. The lists are merged along the key by running windows that carry the greatest end of the blocks before: what a list
   adds to it is cut out in one pass. Windows spill, and no list ever grows with the rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def covered_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Maximal covered stretches of each key and the gaps between successive ones.

    Returns keys, kind (``covered`` or ``gap``), start, end; both ends belong to the interval.

    Rows whose start or end is null, below 1 or reversed are ignored, and so are rows with a null key. Repeated rows,
    ties and nested spans change nothing. An empty table gives an empty result. Other columns are not read, so their
    names may be anything. Nothing comes out before the first or after the last stretch.
    """
    keys = list(keys)
    named = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    ks = [f"k{i}" for i in range(len(keys))]
    valid = (F.col("s") >= 1) & (F.col("s") <= F.col("e"))
    for k in ks:
        valid &= F.col(k).isNotNull()
    starts = named.where(valid).groupBy(*ks, "s").agg(F.max("e").alias("e"))
    within = Window.partitionBy(*ks, "block").orderBy("s")
    before = F.max("e").over(within.rowsBetween(Window.unboundedPreceding, -1))
    marked = starts.withColumn("block", F.floor(F.col("s") / BLOCK)).withColumn("begins", F.coalesce((F.col("s") > before + 1).cast("int"), F.lit(1)))
    islands = marked.withColumn("island", F.sum("begins").over(within)).groupBy(*ks, "block", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    lists = islands.groupBy(*ks, "block").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("xs"))
    down = Window.partitionBy(*ks).orderBy("block")
    up = Window.partitionBy(*ks).orderBy(F.col("block").desc())
    top = F.element_at("xs", -1)["e"]
    carried = lists.withColumn("carry", F.max(top).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = carried.withColumn("new", F.filter("xs", lambda x: F.col("carry").isNull() | (x["s"] > F.col("carry") + 1)))
    # where the stretch that is open at the block's start ends: intervals of the block that only continue it may prolong it
    held = F.filter("xs", lambda x: x["s"] <= F.col("carry") + 1)
    fresh = fresh.withColumn("reach", F.greatest(F.col("carry"), F.try_element_at(held, F.lit(-1))["e"]))
    closed = (
        fresh.withColumn("next", F.last(F.when(F.size("new") > 0, F.col("reach")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("most", F.max(top).over(up.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.size("new") > 0)
    )
    n = F.size("new")
    last_end = F.coalesce(F.col("next"), F.col("most"))
    stretches = F.transform(
        "new",
        lambda x, i: F.struct(F.lit("covered").alias("kind"), x["s"].alias("start"), F.when(i == n - 1, last_end).otherwise(x["e"]).alias("end")),
    )
    gaps = F.filter(
        F.transform(
            "new",
            lambda x, i: F.struct(
                F.lit("gap").alias("kind"), (F.when(i == 0, F.col("reach")).otherwise(F.try_element_at("new", i)["e"]) + 1).alias("start"), (x["s"] - 1).alias("end")
            ),
        ),
        lambda g: g["start"].isNotNull(),
    )
    rows = closed.select(*ks, F.inline(F.concat(stretches, gaps)))
    return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "kind", "start", "end")
