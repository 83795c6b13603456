"""Lineage of ids, differences between two generations, and the log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.tables import materialize

#: Categories of a node between two generations, in the order they are listed.
CATEGORIES = ("added", "deleted", "merged_into", "split_into", "migrated", "renamed", "content", "unchanged")
EDGE_CHANGES = ("edge_added", "edge_dropped")
CONTENT = ("summary", "description", "confidence")
EDGE_KEY = ["source_id", "target_id", "kind"]


def latest_of(ids: DataFrame, lineage: DataFrame) -> DataFrame:
    """id and latest: followed from one successor to the next (newest created_at, then least new id) until there is none; on a cycle the node before it closes.

    Steps are doubled until they end, so a chain of n ids needs about log n rounds. What has not ended after as many
    steps as there are ids leads into a cycle, and is walked step by step until it closes.
    """
    newest = F.min_by("new_uuid", F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), F.col("new_uuid").alias("u")))
    step = materialize(lineage.where("new_uuid <> old_uuid").groupBy(F.col("old_uuid").alias("at")).agg(newest.alias("next")))
    own, size, length = ids.select("id").distinct(), step.count(), 1
    hop = materialize(step.join(step.select(F.col("at").alias("next"), F.lit(True).alias("open")), "next", "left").select("at", "next", F.coalesce("open", F.lit(False)).alias("open")))
    while length <= size and not hop.where("open").isEmpty():
        further = hop.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("open").alias("_open"))
        hop = materialize(hop.join(further, "next", "left").select("at", F.coalesce("_next", "next").alias("next"), F.coalesce("_open", F.lit(False)).alias("open")))
        length *= 2
    joined = materialize(own.join(hop.withColumnRenamed("at", "id"), "id", "left"))
    done = joined.where("not coalesce(open, false)").select("id", F.coalesce("next", "id").alias("latest"))
    now = joined.where("open").select("id", F.col("id").alias("at"), F.array("id").alias("seen"))
    while not now.isEmpty():
        walked = materialize(now.join(step, "at").withColumn("stop", F.array_contains("seen", F.col("next"))))
        done = done.unionByName(walked.where("stop").select("id", F.col("at").alias("latest")))
        now = walked.where("not stop").select("id", F.col("next").alias("at"), F.array_append("seen", F.col("next")).alias("seen"))
    return done


def terminals(ids: DataFrame, lineage: DataFrame) -> DataFrame:
    """id and terminal: every id without a successor that can be reached from it; ids on a pure cycle have none. Rounds end when nothing new is reached."""
    step = materialize(lineage.select(F.col("old_uuid").alias("at"), F.col("new_uuid").alias("next")).distinct())
    reach = frontier = materialize(ids.select("id", F.col("id").alias("at")).distinct())
    rounds = 0
    while not frontier.isEmpty():
        frontier = materialize(frontier.join(step, "at").select("id", F.col("next").alias("at")).distinct().join(reach, ["id", "at"], "left_anti"))
        rounds += 1
        reach = materialize(reach.unionByName(frontier)) if rounds % 8 == 0 else reach.unionByName(frontier)
    return reach.join(step.select("at").distinct(), "at", "left_anti").select("id", F.col("at").alias("terminal"))


def diff_nodes(old: DataFrame, new: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """id, category, changed (fields) and targets (ids a gone node lives on in) of every node of two generations.

    A node of both is migrated (domain or subdomain), else renamed, else of other content, else unchanged. A gone node
    was merged into its one live terminal, split into several, or deleted. A new node that is a target in the lineage
    is not listed as added. With one generation empty all nodes are added or deleted.
    """
    fields = ["domain", "subdomain", "name", *CONTENT]
    a = old.select("id", F.lit(True).alias("in_old"), *[F.col(c).alias(f"o_{c}") for c in fields])
    b = new.select("id", F.lit(True).alias("in_new"), *[F.col(c).alias(f"n_{c}") for c in fields])
    both = a.join(b, "id", "full")
    differs = {c: ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")) for c in fields}
    kept = F.when(differs["domain"] | differs["subdomain"], "migrated").when(differs["name"], "renamed").when(differs["summary"] | differs["description"] | differs["confidence"], "content").otherwise("unchanged")
    category = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").otherwise(kept)
    rows = both.withColumns({"category": category, "changed": F.when(F.col("in_old") & F.col("in_new"), F.array_compact(F.array(*[F.when(d, F.lit(c)) for c, d in differs.items()])))})
    rows = rows.select("id", "category", "changed")
    if lineage is None:
        return rows.withColumn("targets", F.lit(None).cast("array<string>"))
    gone = rows.where("category = 'deleted'").select("id")
    live = terminals(gone, lineage).where("terminal <> id").join(new.select(F.col("id").alias("terminal")), "terminal", "left_semi")
    ends = live.groupBy("id").agg(F.array_sort(F.collect_set("terminal")).alias("targets"))
    made = lineage.select(F.col("new_uuid").alias("id")).distinct().withColumn("_made", F.lit(True))
    joined = rows.join(ends, "id", "left").join(made, "id", "left").where((F.col("category") != "added") | F.col("_made").isNull())
    moved = F.when(F.size("targets") == 1, "merged_into").when(F.size("targets") > 1, "split_into")
    return joined.select("id", F.coalesce(moved, "category").alias("category"), "changed", "targets")


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Identities added or dropped, by (source, target, kind)."""
    a, b = old.select(*EDGE_KEY).distinct(), new.select(*EDGE_KEY).distinct()
    return b.join(a, EDGE_KEY, "left_anti").withColumn("change", F.lit(EDGE_CHANGES[0])).unionByName(a.join(b, EDGE_KEY, "left_anti").withColumn("change", F.lit(EDGE_CHANGES[1])))


def diff_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """change and n for each of the ten changes, zero where there is none."""
    keys = nodes.sparkSession.createDataFrame([(k, c) for k, c in enumerate((*CATEGORIES, *EDGE_CHANGES))], "ord int, change string")
    counts = nodes.select(F.col("category").alias("change")).unionByName(edges.select("change")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    return keys.join(counts, "change", "left").select("ord", "change", F.coalesce("n", F.lit(0)).alias("n"))


def affected_documents(changes: DataFrame, sources: DataFrame, most: int = 200) -> DataFrame:
    """Files of changed nodes that still exist, in order, at most `most` (a bound of the report itself)."""
    ids = changes.where(~F.col("category").isin("unchanged", "deleted")).select(F.col("id").alias("node_uuid"))
    return sources.join(ids, "node_uuid", "left_semi").where("file_path <> ''").select("file_path").distinct().orderBy("file_path").limit(most)


def render(changes: DataFrame) -> DataFrame:
    """One row with the report: counts by category, then each changed node as a line."""
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    line = F.concat_ws(" ", F.lit("-"), "category", "id", F.concat_ws(",", "changed"), F.concat_ws(",", "targets"))
    rows = changes.where("category <> 'unchanged'").select(F.struct(order.alias("o"), "id", F.trim(line).alias("line")).alias("r"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("markdown"))


def shorten(text: Column, lines: int = 80) -> Column:
    """The first lines of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")


def change_ratio(log: DataFrame, docs_total: int) -> DataFrame:
    """`log` (seq, docs_changed) with the running share of changed documents, never above 1. One row per run: the window is as long as the log."""
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("ratio", F.least(F.lit(1.0), F.sum("docs_changed").over(w) / F.lit(max(1, docs_total))))


def keep_last(history: DataFrame, order: str, most: int = 50, group: str | None = None) -> DataFrame:
    """The last entries of a history, of each group if one is named."""
    if group is None:
        return history.orderBy(F.col(order).desc()).limit(most)
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    return history.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def lineage_rows(lineage: DataFrame) -> DataFrame:
    """All lineage rows in order of time, new and old id."""
    return lineage.orderBy("created_at", "new_uuid", "old_uuid")


def listed(changes: DataFrame) -> DataFrame:
    """`changes` but the unchanged ones with ord (rank of the category), line and json, in order of ord and id: the report by rows, however many there are."""
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    line = F.concat_ws(" ", F.lit("-"), "category", "id", F.concat_ws(",", "changed"), F.concat_ws(",", "targets"))
    text = F.to_json(F.struct("category", "id", F.coalesce("changed", F.array().cast("array<string>")).alias("changed"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets")))
    rows = changes.where("category <> 'unchanged'").select(order.cast("int").alias("ord"), "id", "category", F.trim(line).alias("line"), text.alias("json"))
    return rows.orderBy("ord", "id")


def why(ids: DataFrame, lineage: DataFrame) -> DataFrame:
    """id with its predecessors, successors and terminals (sorted arrays, empty where there are none)."""
    arr = lambda df, c: df.groupBy("id").agg(F.array_sort(F.collect_set("v")).alias(c))
    before = arr(lineage.select(F.col("new_uuid").alias("id"), F.col("old_uuid").alias("v")), "predecessors")
    after = arr(lineage.select(F.col("old_uuid").alias("id"), F.col("new_uuid").alias("v")), "successors")
    ends = arr(terminals(ids, lineage).where("terminal <> id").withColumnRenamed("terminal", "v"), "terminals")
    joined = ids.select("id").distinct()
    for df in (before, after, ends):
        joined = joined.join(df, "id", "left")
    none = F.array().cast("array<string>")
    return joined.select("id", *[F.coalesce(c, none).alias(c) for c in ("predecessors", "successors", "terminals")])


def record(version: str, parent: str | None, node_changes: DataFrame, edge_changes: DataFrame, sources: DataFrame, measures: DataFrame) -> DataFrame:
    """One changeset as a row: versions, the ten counts, the number of affected documents, and the sample of measures (of `structure`)."""
    counts = diff_counts(node_changes, edge_changes)
    wide = counts.agg(*[F.max(F.when(F.col("change") == c, F.col("n"))).alias(f"n_{c}") for c in (*CATEGORIES, *EDGE_CHANGES)])
    docs = affected_documents(node_changes, sources).agg(F.count(F.lit(1)).alias("docs_affected"))
    one = wide.join(F.broadcast(docs), F.lit(True)).join(F.broadcast(measures), F.lit(True))  # one row each
    return one.select(F.lit(version).alias("kb_version"), F.lit(parent).cast("string").alias("parent_version"), "*")
