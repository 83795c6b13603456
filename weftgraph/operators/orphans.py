"""References to records that do not exist, or came only later, and what hangs below them.

A fixpoint cascade down the foreign-key graph: direct orphans first, then, by semi-joins, the records that refer to
an orphaned record, and so on until no new one appears. Each round joins only with the records orphaned in the round
before. Where no orphaned table is itself referred to, the fixpoint is reached at once and no round is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.skew import HOT_ROWS, hot_split_join
from weftgraph.sources.tables import materialize

MISSING, LATE = "missing", "late"
DIRECT, INHERITED = "direct", "inherited"


def orphan_cascade(refs: DataFrame, keys: DataFrame, parents: dict[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Orphaned references with their state, kind and depth.

    refs: ref_table, ref_key, own_key (under which others refer to this record, or null), key (null: no reference),
    ref_time (null: never late). keys: parent_table, key, since; repeated keys count once, with the earliest `since`.
    parents: for each ref_table the table it refers to.

    Returns ref_table, ref_key, key, ref_time, state (``missing``, ``late``; null if only inherited), kind
    (``direct``, ``inherited``) and depth (0 for direct). Late references are direct but not passed on: their record
    exists. Rows that come twice come out once. Empty tables give an empty result; other columns are dropped first,
    so their names do not matter. A cycle of records that exist is no orphan.
    """
    table = F.create_map(*[F.lit(x) for pair in parents.items() for x in pair])[F.col("ref_table")]
    refs = refs.select("ref_table", "ref_key", "own_key", "key", "ref_time", table.alias("parent_table")).where(F.col("key").isNotNull())
    known = keys.where(F.col("key").isNotNull()).groupBy("parent_table", "key").agg(F.min("since").alias("since"), F.lit(True).alias("found"))
    joined = hot_split_join(refs, known, ["parent_table", "key"], hot_rows)
    state = F.when(F.col("found").isNull(), MISSING).when(F.col("since") > F.col("ref_time"), LATE)
    out = ["ref_table", "ref_key", "own_key", "key", "ref_time", "state", "kind", "depth"]
    direct = joined.withColumns({"state": state, "kind": F.lit(DIRECT), "depth": F.lit(0)}).where(F.col("state").isNotNull()).select(*out).distinct()
    if not set(parents) & set(parents.values()):
        return direct.drop("own_key")
    done = direct = materialize(direct)
    frontier = direct.where(F.col("state") == MISSING)
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        orphaned = frontier.where(F.col("own_key").isNotNull()).select(F.col("ref_table").alias("parent_table"), F.col("own_key").alias("key")).distinct()
        fresh = (
            refs.join(orphaned, ["parent_table", "key"], "left_semi")
            .withColumns({"state": F.lit(None).cast("string"), "kind": F.lit(INHERITED), "depth": F.lit(depth)})
            .select(*out)
            .distinct()
            .join(done.select("ref_table", "ref_key", "key"), ["ref_table", "ref_key", "key"], "left_anti")
        )
        frontier = materialize(fresh.select(*out))
        done = materialize(done.unionByName(frontier)) if depth % 8 == 0 else done.unionByName(frontier)
    return done.drop("own_key")


def earliest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One row of each key with the earliest time, by a hash aggregate; a key without any time keeps null."""
    return df.groupBy(*keys).agg(F.min(time).alias(time))


def latest_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; ties by all of `order`, nulls last."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
