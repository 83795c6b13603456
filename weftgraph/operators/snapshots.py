"""What changed between full snapshots, by Merkle trees over hash ranges of the keys.

Each row becomes (key, 128-bit digest). The keys of a snapshot fall into hash ranges: a leaf is a prefix of the key's
hash, of as many bits as leave about `LEAF_ROWS` rows in a leaf, the levels above have `STEP_BITS` fewer each, and the
root is all. The digest of a range is the count with the bitwise xor of its rows' digests, which does not depend on order
and combines map-side. Trees are compared from the root down: only ranges whose digests differ are opened, and rows are
compared only in differing leaves. Rows and leaves are written once; a snapshot that takes part in several pairs is
hashed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import squeeze_fast
from weftgraph.sources.tables import materialize

LEAF_ROWS, STEP_BITS, MOST_BITS = 32, 6, 36
_DIFFERS = "n <> 0 or d1 <> 0 or d2 <> 0"


def row_digest(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two independent 64-bit hashes of a row's content; null equals empty and runs of blanks count as one."""
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        number = kinds[c] in ("double", "float")
        text = F.coalesce((F.col(c) + F.lit(0.0)).cast("string"), F.lit("")) if number else squeeze_fast(F.col(c).cast("string"))
        parts.append(text)
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("h2")]


def digest_rows(snapshots: DataFrame, snapshot: Column, key: str, columns: Sequence[str]) -> DataFrame:
    """snap, key, h1, h2, place: one row of each snapshot and key. Of rows that contradict each other the digests combine, so order is irrelevant."""
    h1, h2 = row_digest(snapshots, columns)
    rows = snapshots.select(snapshot.alias("snap"), F.col(key).alias("key"), h1, h2).where(F.col("snap").isNotNull() & F.col("key").isNotNull())
    once = rows.distinct().groupBy("snap", "key").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    return once.withColumn("place", F.shiftrightunsigned(F.xxhash64("key"), 64 - MOST_BITS))


def _prefix(place: Column, bits: Column) -> Column:
    """The first `bits` bits of a place; the others are zero."""
    low = (F.lit(MOST_BITS) - bits).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", place, low), low)


def _compared(ranges: DataFrame, level: int) -> DataFrame:
    """pair and range at a level wherever digests differ or only one side has the range."""
    at = _prefix(F.col("leaf"), F.least(F.lit(level), F.col("bits")))
    found = ranges.groupBy("pair", at.alias("range")).agg(F.sum(F.col("side") * F.col("n")).alias("n"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    return found.where(_DIFFERS).select("pair", "range")


def diff_snapshots(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changes of each pair: pair, key, change (``added``, ``removed``, ``changed``).

    rows: of `digest_rows`. pairs: pair, new, old. A pair of which either snapshot has no rows is left out; one that names
    several snapshots is compared for each. Rows that come twice count once, empty tables give an empty result, keys and
    contents may hold anything.
    """
    rows = materialize(rows)
    sizes = rows.groupBy("snap").agg(F.count(F.lit(1)).alias("rows"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("rows") / LEAF_ROWS)), F.lit(0)), F.lit(MOST_BITS)).cast("int")
    sizes = materialize(sizes.select("snap", bits.alias("bits")))
    named = pairs.select("pair", "new", "old", F.xxhash64("pair", "new", "old").alias("id")).distinct()
    size = lambda k: sizes.select(F.col("snap").alias(k), F.col("bits").alias(f"_{k}"))
    known = named.join(size("new"), "new").join(size("old"), "old").withColumn("bits", F.least("_new", "_old"))
    side = materialize(known.select("pair", "id", "bits", F.inline(F.array(F.struct(F.col("new").alias("snap"), F.lit(1).alias("side")), F.struct(F.col("old").alias("snap"), F.lit(-1).alias("side"))))))
    # the key is part of a digest: equal contents under two keys must not cancel out in a range
    d1, d2 = F.xxhash64("key", "h1", "h2"), F.xxhash64("h2", "key", "h1")
    leaf = _prefix(F.col("place"), F.col("bits")).alias("leaf")
    placed = rows.join(sizes, "snap")
    leaves = placed.groupBy("snap", leaf).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(d1).alias("d1"), F.bit_xor(d2).alias("d2"))
    ranges = materialize(side.select(F.col("id").alias("pair"), "bits", "snap", "side").join(leaves, "snap"))
    deepest = side.agg(F.max("bits")).first()[0] or 0
    levels = [*range(0, deepest, STEP_BITS), deepest]
    for k, level in enumerate(levels):
        differing = _compared(ranges, level)
        held = _prefix(F.col("leaf"), F.least(F.lit(level), F.col("bits"))).alias("range")
        ranges = ranges.withColumn("range", held).join(differing, ["pair", "range"], "left_semi").drop("range")
        if level < levels[-1] and k % 2:
            ranges = materialize(ranges)
    opened = placed.withColumn("leaf", leaf).join(ranges.select("pair", "snap", "side", "leaf"), ["snap", "leaf"])
    both = opened.groupBy("pair", "key").agg(F.max("side").alias("hi"), F.min("side").alias("lo"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    change = F.when(F.col("lo") == 1, "added").when(F.col("hi") == -1, "removed").when((F.col("x1") != 0) | (F.col("x2") != 0), "changed")
    found = both.select(F.col("pair").alias("id"), "key", change.alias("change")).where(F.col("change").isNotNull())
    return found.join(side.where("side = 1").select("id", "pair"), "id").select("pair", "key", "change").distinct()


def consecutive_pairs(changesets: DataFrame, version: str, parent: str, snapshot: Column) -> DataFrame:
    """pair (the version), new, old: each changeset with that of its parent. Repeated rows count once; a version without a parent in the table has no pair."""
    log = changesets.select(F.col(version).alias("v"), F.col(parent).alias("p"), snapshot.alias("snap")).where(F.col("v").isNotNull()).distinct()
    old = log.select(F.col("v").alias("p"), F.col("snap").alias("old")).distinct()
    return log.where(F.col("p") != F.col("v")).join(old, "p").select(F.col("v").alias("pair"), F.col("snap").alias("new"), "old").distinct()
