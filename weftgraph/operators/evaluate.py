"""Measures of retrieval and answering runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.intervals import covered_and_gaps
from weftgraph.sources.tables import materialize


def split_of(key: Column, parts: int = 5) -> Column:
    """The split of a key: the first eight hex digits of its SHA-256, modulo."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")


def freeze(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first `n` rows of each group: a frozen sample."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def recall_at(gold: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """qid with hit, recall and all_gold over documents: gold (qid, doc), hits (qid, doc, rank)."""
    seen = hits.where(F.col("rank") <= k).select("qid", "doc").distinct().withColumn("_hit", F.lit(1))
    g = gold.select("qid", "doc").distinct().join(seen, ["qid", "doc"], "left").groupBy("qid").agg(F.count("_hit").alias("found"), F.count(F.lit(1)).alias("gold"))
    return g.select("qid", (F.col("found") > 0).cast("int").alias("hit"), F.round(F.col("found") / F.col("gold"), 9).alias("recall"), (F.col("found") == F.col("gold")).cast("int").alias("all_gold"))


def reciprocal_rank(gold: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """qid and rr: one over the rank of the first gold document, 0 where none is among the first `k`."""
    first = hits.where(F.col("rank") <= k).join(gold.select("qid", "doc").distinct(), ["qid", "doc"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return gold.select("qid").distinct().join(first, "qid", "left").select("qid", F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 9).alias("rr"))


def span_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans (id, path, start, end) of one path that share a line: an equi join on blocks of lines, then the exact test.

    Each span is listed under the blocks of 64 lines it lies in, so only spans near each other meet; a pair is
    reported under the first block both lie in.
    """
    width = 64
    cut = lambda df, k: df.where("start >= 1 and start <= end").select(F.col("id").alias(f"id_{k}"), "path", F.col("start").alias(f"start_{k}"), F.col("end").alias(f"end_{k}"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("block"))
    met = cut(a, "a").join(cut(b, "b"), ["path", "block"]).where("start_a <= end_b and start_b <= end_a")
    return met.where(F.col("block") == F.floor(F.greatest("start_a", "start_b") / width)).select("path", "id_a", "id_b")


def visible_facts(facts: DataFrame, shown: DataFrame) -> DataFrame:
    """fact_id and visible: whether the union of the spans shown of its document covers it whole. facts: fact_id, doc, start, end; shown: doc, start, end."""
    merged = covered_and_gaps(shown, ["doc"], "start", "end").where("kind = 'covered'").select("doc", F.col("start").alias("s"), F.col("end").alias("e"))
    hit = facts.join(merged, "doc").where("s <= start and end <= e").select("fact_id").distinct().withColumn("_v", F.lit(1))
    return facts.select("fact_id").distinct().join(hit, "fact_id", "left").select("fact_id", F.coalesce("_v", F.lit(0)).alias("visible"))


def paired(rows: DataFrame, key: str, arm: str, score: str, base: str, other: str) -> DataFrame:
    """One row: questions gained, lost and tied from arm `base` to arm `other`; a question counts once per arm with its best score."""
    best = rows.groupBy(key, arm).agg(F.max(score).alias("score"))
    a = best.where(F.col(arm) == base).select(key, F.col("score").alias("a"))
    b = best.where(F.col(arm) == other).select(key, F.col("score").alias("b"))
    return a.join(b, key).agg(F.count_if(F.col("b") > F.col("a")).alias("gains"), F.count_if(F.col("b") < F.col("a")).alias("losses"), F.count_if(F.col("b") == F.col("a")).alias("ties"))


def quantiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank and interpolated quantiles of a value by group."""
    return rows.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
        F.round(F.percentile(value, 0.5), 9).alias("q50"),
        F.round(F.percentile(value, 0.9), 9).alias("q90"),
    )


def shingle_pairs(rows: DataFrame, key: str, text: str, least: float = 0.85, width: int = 5) -> DataFrame:
    """id_a < id_b of texts whose sets of `width`-word shingles are alike to `least`; classes of equal sets stand as their least id.

    Exact: hashed shingles are ordered from rare to frequent, and two sets that alike share one of their first
    (1 - least) * n + 1. Returns id_a, id_b, similarity of representatives; `shingle_classes` has the members.
    """
    # the row whose id names the class stands for it
    sets = materialize(shingle_classes(rows, key, text, width).where("id = class_id").select("class_id", F.col("shingles").alias("g")))
    counts = sets.select(F.explode("g").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ordered = sets.select("class_id", F.size("g").alias("size"), F.explode("g").alias("s")).join(counts, "s").where("n > 1")
    w = Window.partitionBy("class_id").orderBy("n", "s")
    # shingles of one set only never meet another set; they take places of the prefix all the same
    alone = F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("class_id"))
    place = F.row_number().over(w) + alone
    prefix = ordered.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("class_id", "size", "s")
    other = prefix.select(F.col("class_id").alias("b"), F.col("size").alias("size_b"), "s")
    met = prefix.withColumnRenamed("class_id", "a").join(other, "s").where((F.col("a") < F.col("b")) & (F.least("size", "size_b") >= F.greatest("size", "size_b") * least - 1e-9)).select("a", "b").distinct()
    got = met.join(sets.select(F.col("class_id").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("g").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return got.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round(common / (F.size("ga") + F.size("gb") - common), 9).alias("similarity")).where(F.col("similarity") >= least)


def shingle_classes(rows: DataFrame, key: str, text: str, width: int = 5) -> DataFrame:
    """id, class_id (least id of the texts with the same shingles) and the hashed shingles, for texts of at least `width` words."""
    from weftgraph.functions.text import words

    own = rows.select(F.col(key).alias("id"), words(F.col(text)).alias("w")).where(F.size("w") >= width).dropDuplicates(["id"])
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(width)), " "))))
    hashed = own.select("id", F.array_sort(grams).alias("shingles"))
    return hashed.withColumn("class_id", F.min("id").over(Window.partitionBy(F.xxhash64("shingles"), F.size("shingles"))))


def overlap_at(gold: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """qid and overlap: the share of the first `k` hits that are gold, of at most `k` and at least one."""
    first = hits.where(F.col("rank") <= k).select("qid", "doc").distinct()
    met = first.join(gold.select("qid", "doc").distinct().withColumn("_g", F.lit(1)), ["qid", "doc"], "left")
    return met.groupBy("qid").agg(F.round(F.count("_g") / F.greatest(F.count(F.lit(1)), F.lit(1)), 9).alias("overlap"))


def event_summary(events: DataFrame, group: str, failed: Column, empty: Column, seconds: str) -> DataFrame:
    """Of each group: events, share of failed and of empty ones, mean and greatest time of those that did not fail."""
    ok = F.when(~failed, F.col(seconds))
    return events.groupBy(group).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg(failed.cast("double")), 9).alias("error_rate"), F.round(F.avg(empty.cast("double")), 9).alias("empty_rate"), F.round(F.avg(ok), 6).alias("mean_seconds"), F.max(ok).alias("max_seconds"))
