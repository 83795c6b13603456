"""Changes to a graph, each computing the next generation of a table; nothing is altered in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.schemas import CONTENT_LABELS, DEFAULT_CONFIDENCE, LINEAGE_REASONS, PROVENANCES

HUMAN = "human_curated"
EDGE_KEY = ["source_id", "target_id", "kind"]
SOURCE_KEY = ["node_uuid", "member_id", "file_path"]


def fill_confidence(c: Column) -> Column:
    """Outside [0, 1], not a number or null: the default."""
    return F.when(c.between(0, 1) & ~F.isnan(c), c).otherwise(DEFAULT_CONFIDENCE)


def fill_provenance(c: Column) -> Column:
    return F.when(c.isin(*PROVENANCES), c).otherwise("llm_inferred")


# Nodes


def insert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """`nodes` with `new`; an id that exists already fails the job when it runs."""
    clash = new.join(nodes.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    checked = new.join(F.broadcast(clash.select(F.when(F.col("n") > 0, F.raise_error(F.lit("node ids exist already"))).otherwise(F.lit(True)).alias("_ok"))), F.lit(True)).where("_ok").drop("_ok")
    return nodes.unionByName(checked, allowMissingColumns=True)


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """All columns of `changes` but file_slug and created_at replace those of the node; ids without a node are left to `missing_ids`."""
    columns = [c for c in changes.columns if c not in ("id", "file_slug", "created_at")]
    joined = nodes.join(changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns]), "id", "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def missing_ids(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.select("id").join(nodes.select("id"), "id", "left_anti").distinct()


def update_machine_content(nodes: DataFrame, changes: DataFrame, fields: Sequence[str] = ("summary", "description", "confidence"), now: Column | None = None) -> DataFrame:
    """New content for nodes no human has edited; updated_at moves only where content differs."""
    now = F.localtimestamp() if now is None else now
    joined = nodes.join(changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields]), "id", "left")
    open_ = F.coalesce(F.col("_hit") & (F.col("provenance") != HUMAN), F.lit(False))
    differs = F.lit(False)
    for c in fields:
        differs |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = {c: F.when(open_, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    stamp = F.when(open_ & differs, now).otherwise(F.col("updated_at"))
    return joined.select(*[out[c].alias(c) if c in out else (stamp.alias(c) if c == "updated_at" else F.col(c)) for c in nodes.columns])


def delete_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_anti")


def delete_subdomain(nodes: DataFrame, domain: str, subdomain: str) -> DataFrame:
    return nodes.where(~((F.col("domain") == domain) & (F.col("subdomain") == subdomain)))


def edit_content(nodes: DataFrame, sources: DataFrame, edits: DataFrame, fields: Sequence[str] = ("name", "summary", "description")) -> tuple[DataFrame, DataFrame]:
    """Fields a human set (null: untouched), now human-curated; and the documents affected."""
    joined = nodes.join(edits.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields]), "id", "left")
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields} | {"provenance": F.when(F.col("_hit"), HUMAN).otherwise(F.col("provenance"))}
    new = joined.select(*[out.get(c, F.col(c)).alias(c) for c in nodes.columns])
    docs = sources.join(edits.select(F.col("id").alias("node_uuid")), "node_uuid", "left_semi").where("file_path <> ''").select("file_path").distinct()
    return new, docs


# Edges


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One row per (source, target, kind): the least id and its created_at survive with the payload of the row added last."""
    payload = [c for c in edges.columns if c not in (*EDGE_KEY, "id", "created_at")]
    first = F.min(F.struct("id", "created_at"))
    last = F.max(F.struct("id", *payload))
    grouped = edges.groupBy(*EDGE_KEY).agg(first.alias("_first"), last.alias("_last"))
    return grouped.select(*[F.col(c) if c in EDGE_KEY else F.col(f"_first.{c}") if c in ("id", "created_at") else F.col(f"_last.{c}") for c in edges.columns])


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """`new` (its ids above all others) put into `edges`; identities that exist keep id and created_at."""
    return collapse_edges(edges.unionByName(new, allowMissingColumns=True))


def upsert_checked(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """As `upsert_edges`, for edges of which both endpoints exist; confidence and provenance are filled."""
    ids = nodes.select("id").distinct()
    checked = (
        new.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        .withColumns({"confidence": fill_confidence(F.col("confidence")), "provenance": fill_provenance(F.col("provenance"))})
    )
    return upsert_edges(edges, checked)


def delete_between(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti")


def delete_by_endpoint(edges: DataFrame, ids: DataFrame, end: str) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_anti")


def delete_by_subdomain(edges: DataFrame, nodes: DataFrame, domain: str, subdomain: str, content_only: bool = False) -> DataFrame:
    """Edges without those that start in a subdomain, of its entities and concepts only if asked for."""
    own = nodes.where((F.col("domain") == domain) & (F.col("subdomain") == subdomain))
    if content_only:
        own = own.where(F.col("label").isin(*CONTENT_LABELS))
    return delete_by_endpoint(edges, own, "source_id")


def replace_semantic(edges: DataFrame, candidates: DataFrame, nodes: DataFrame, domain: str, subdomain: str) -> DataFrame:
    """Semantic edges of a subdomain made equal to `candidates`; identities with a human-curated row stay as they are.

    Candidates from outside the subdomain or with empty, equal or missing endpoints are dropped, confidence and provenance filled, and of one
    identity a row with an id is preferred. Existing identities take only description and confidence.
    """
    content = nodes.where(F.col("label").isin(*CONTENT_LABELS))
    own = content.where((F.col("domain") == domain) & (F.col("subdomain") == subdomain)).select(F.col("id").alias("source_id"))
    ids = nodes.select("id").distinct()
    good = (
        candidates.where("source_id <> '' and target_id <> '' and source_id <> target_id")
        .join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        .withColumns({"confidence": fill_confidence(F.col("confidence")), "provenance": fill_provenance(F.col("provenance"))})
    )
    w = Window.partitionBy(*EDGE_KEY).orderBy((F.coalesce("id", F.lit(0)) != 0).desc(), "id", F.col("confidence").desc())
    good = good.join(own.distinct(), "source_id", "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    scope = edges.join(own.distinct(), "source_id", "left_semi")
    outside = edges.join(own.distinct(), "source_id", "left_anti")
    human = scope.where(F.col("provenance") == HUMAN).select(*EDGE_KEY).distinct()
    kept = scope.join(human, EDGE_KEY, "left_semi")
    open_ = collapse_edges(scope.join(human, EDGE_KEY, "left_anti"))
    wanted = good.join(human, EDGE_KEY, "left_anti").select(*EDGE_KEY, F.col("description").alias("_d"), F.col("confidence").alias("_c"), F.col("provenance").alias("_p"))
    joined = open_.withColumn("_old", F.lit(True)).join(wanted, EDGE_KEY, "right")
    new = joined.select(
        *[
            F.col("_d").alias(c) if c == "description" else F.col("_c").alias(c) if c == "confidence" else F.when(F.col("_old"), F.col(c)).otherwise(F.col("_p")).alias(c) if c == "provenance" else F.col(c)
            for c in edges.columns
        ]
    )
    return outside.unionByName(kept).unionByName(new)


# Sources


def span_rank(start: Column, end: Column) -> Column:
    """0 a valid span, 1 a part of one, 2 none."""
    return F.when((start >= 1) & (end >= start), 0).when((F.coalesce(start, F.lit(0)) > 0) | (F.coalesce(end, F.lit(0)) > 0), 1).otherwise(2)


def collapse_sources(rows: DataFrame) -> DataFrame:
    """One row per (node, member, file): the earliest valid span, else a partial one, else none."""
    w = Window.partitionBy(*SOURCE_KEY).orderBy(span_rank(F.col("start_line"), F.col("end_line")), F.col("start_line").asc_nulls_last(), F.col("end_line").asc_nulls_last(), "skill")
    return rows.select(*SOURCE_KEY, "skill", "start_line", "end_line").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_report(rows: DataFrame) -> DataFrame:
    """attempted, kept, repeated rows, and keys of more than one skill (which the writer refuses)."""
    keys = rows.groupBy(*SOURCE_KEY).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("skill").alias("skills"))
    return keys.agg(F.sum("n").alias("attempted"), F.count(F.lit(1)).alias("kept"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"), F.count_if(F.col("skills") > 1).alias("conflicting"))


def delete_sources(sources: DataFrame, gone: DataFrame) -> DataFrame:
    """Sources without those of (node, file), or of the node where `gone` has no file_path."""
    on = ["node_uuid", "file_path"] if "file_path" in gone.columns else ["node_uuid"]
    return sources.join(gone.select(*on).distinct(), on, "left_anti")


def move_documents(table: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows of any table with a file_path, with the paths of `moves` (old_path, new_path) renamed; a moved path keeps its rows."""
    joined = table.join(moves.select(F.col("old_path").alias("file_path"), "new_path"), "file_path", "left")
    return joined.select(*[F.coalesce("new_path", "file_path").alias(c) if c == "file_path" else F.col(c) for c in table.columns])


def skills_of_nodes(sources: DataFrame) -> DataFrame:
    """id and source_refs: the sorted skills of a node, joined by commas."""
    return sources.where("skill <> ''").groupBy(F.col("node_uuid").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("skill")), ",").alias("source_refs"))


def skills_of_domains(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same for domains, by the nodes in them."""
    own = nodes.select(F.col("id").alias("node_uuid"), "domain")
    return sources.where("skill <> ''").join(own, "node_uuid").groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("skill")), ",").alias("source_refs"))


def stale_provides(edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """``provides`` edges from a skill to a domain that none of the skill's sources supports any more, but those of humans."""
    live = sources.where("skill <> ''").join(nodes.select(F.col("id").alias("node_uuid"), "domain"), "node_uuid").select(F.concat(F.lit("skill::"), "skill").alias("source_id"), F.concat(F.lit("domain::"), "domain").alias("target_id")).distinct()
    return edges.where((F.col("kind") == "provides") & (F.col("provenance") != HUMAN)).join(live, ["source_id", "target_id"], "left_anti")


def delete_documents(nodes: DataFrame, edges: DataFrame, sources: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Sources of deleted files taken out, by reference counting, for all files at once.

    A node goes with its edges if it had a source in a deleted file, has none left, is not human-curated and has no
    human-curated edge. Nodes that stay get new source_refs. Returns nodes, edges, sources, deleted (ids) and docs:
    files of the neighbours of deleted nodes.
    """
    touched = sources.join(gone.select("file_path").distinct(), "file_path", "left_semi").select(F.col("node_uuid").alias("id")).distinct()
    left = sources.join(gone.select("file_path").distinct(), "file_path", "left_anti")
    human_edges = edges.where(F.col("provenance") == HUMAN)
    guarded = human_edges.select(F.col("source_id").alias("id")).union(human_edges.select(F.col("target_id").alias("id"))).distinct()
    deleted = (
        touched.join(left.select(F.col("node_uuid").alias("id")).distinct(), "id", "left_anti")
        .join(guarded, "id", "left_anti")
        .join(nodes.where(F.col("provenance") != HUMAN).select("id"), "id", "left_semi")
    )
    refs = touched.join(skills_of_nodes(left).withColumnRenamed("source_refs", "_refs"), "id", "left").withColumn("_touched", F.lit(True))
    kept = nodes.join(deleted, "id", "left_anti").join(refs, "id", "left")
    new_nodes = kept.select(*[F.when(F.col("_touched"), F.col("_refs")).otherwise(F.col(c)).alias(c) if c == "source_refs" else F.col(c) for c in nodes.columns])
    new_edges = edges.join(deleted.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(deleted.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*edges.columns)
    return {"nodes": new_nodes, "edges": new_edges, "sources": left.select(*sources.columns), "deleted": deleted, "docs": neighbour_docs(edges, left, deleted)}


def neighbour_docs(edges: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Files of the nodes next to the given ones, in either direction."""
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("node_uuid"))
    into = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("node_uuid"))
    return sources.join(out.union(into).distinct(), "node_uuid", "left_semi").where("file_path <> ''").select("file_path").distinct()


# Lineage, conflicts, file states, versions


def valid_lineage(rows: DataFrame) -> DataFrame:
    """Lineage rows without empty ends, loops on themselves or unknown reasons, each pair once."""
    return rows.where((F.trim("new_uuid") != "") & (F.trim("old_uuid") != "") & (F.col("new_uuid") != F.col("old_uuid")) & F.col("reason").isin(*LINEAGE_REASONS)).dropDuplicates(["new_uuid", "old_uuid"])


def resolve_conflicts(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status, note and author of `decisions` (by id) put into the reports."""
    fields = ["resolution_status", "resolution_note", "resolved_by"]
    joined = conflicts.join(decisions.select("id", *[F.col(c).alias(f"_{c}") for c in fields]), "id", "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in conflicts.columns])


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """One row per key, the latest; of equal times the new one. For file states, manifests and the like."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), F.col("_new").desc())
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)), allowMissingColumns=True)


def changed_files(states: DataFrame, current: DataFrame) -> DataFrame:
    """repo_url, file_path, changed (no record counts as changed) and skip (only an equal record may be skipped)."""
    joined = current.alias("c").join(states.select("repo_url", "file_path", F.col("content_hash").alias("_old")), ["repo_url", "file_path"], "left")
    return joined.select("repo_url", "file_path", F.coalesce(F.col("_old") != F.col("content_hash"), F.lit(True)).alias("changed"), F.coalesce(F.col("_old") == F.col("content_hash"), F.lit(False)).alias("skip"))


# Structural operations


def merge_nodes(nodes: DataFrame, edges: DataFrame, sources: DataFrame, sets: DataFrame) -> dict[str, DataFrame]:
    """Nodes of each set (set_id, id) made one: the one with most members survives, of equal ones the least id.

    Sources and edges are moved to the survivor, edges that would join it to itself go, and if any member was
    human-curated so is the survivor. Returns nodes, edges, sources and lineage (``merged``).
    """
    members = sources.groupBy(F.col("node_uuid").alias("id")).agg(F.count_distinct("member_id").alias("members"))
    sized = sets.join(nodes.select("id", "provenance"), "id").join(members, "id", "left").withColumn("members", F.coalesce("members", F.lit(0)))
    w = Window.partitionBy("set_id").orderBy(F.col("members").desc(), "id")
    ranked = sized.withColumns({"survivor": F.first("id").over(w), "human": F.max((F.col("provenance") == HUMAN).cast("int")).over(Window.partitionBy("set_id"))})
    moved = ranked.where("id <> survivor").select("id", "survivor")
    human = ranked.where("human = 1").select(F.col("survivor").alias("id"), F.lit(True).alias("_human")).distinct()
    new_nodes = nodes.join(moved, "id", "left_anti").join(human, "id", "left")
    new_nodes = new_nodes.select(*[F.when(F.col("_human"), HUMAN).otherwise(F.col(c)).alias(c) if c == "provenance" else F.col(c) for c in nodes.columns])
    return {"nodes": new_nodes, "edges": remap_edges(edges, moved), "sources": remap_sources(sources, moved), "lineage": moved.select(F.col("survivor").alias("new_uuid"), F.col("id").alias("old_uuid"), F.lit("merged").alias("reason"))}


def remap_edges(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Endpoints replaced by their survivor; loops go and equal identities become one."""
    a = moved.select(F.col("id").alias("source_id"), F.col("survivor").alias("_a"))
    b = moved.select(F.col("id").alias("target_id"), F.col("survivor").alias("_b"))
    joined = edges.join(a, "source_id", "left").join(b, "target_id", "left").withColumn("_moved", F.col("_a").isNotNull() | F.col("_b").isNotNull())
    joined = joined.withColumns({"source_id": F.coalesce("_a", "source_id"), "target_id": F.coalesce("_b", "target_id")}).where(~F.col("_moved") | (F.col("source_id") != F.col("target_id")))
    return collapse_edges(joined.select(*edges.columns))


def remap_sources(sources: DataFrame, moved: DataFrame) -> DataFrame:
    joined = sources.join(moved.select(F.col("id").alias("node_uuid"), "survivor"), "node_uuid", "left")
    return collapse_sources(joined.withColumn("node_uuid", F.coalesce("survivor", "node_uuid")).select(*sources.columns))


def split_nodes(nodes: DataFrame, sources: DataFrame, parts: DataFrame, uuid: Column) -> dict[str, DataFrame]:
    """Nodes split by their members: parts has id (the node), name, members (array). `uuid` makes an id of members.

    The parts of a node must hold each of its members once; nodes whose parts do not are left as they are (``rejected``).
    Returns nodes, sources, lineage (``split``), rejected.
    """
    rows = parts.select("id", "name", F.explode("members").alias("member_id"))
    have = sources.select(F.col("node_uuid").alias("id"), "member_id").distinct()
    given = rows.groupBy("id").agg(F.count(F.lit(1)).alias("given"), F.count_distinct("member_id").alias("once"))
    both = rows.select("id", "member_id").distinct().join(have, ["id", "member_id"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("known"))
    total = have.groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    ok = given.join(both, "id").join(total, "id").where("given = once and once = known and known = total").select("id")
    good = parts.join(ok, "id", "left_semi").withColumn("new_id", uuid)
    lineage = good.select(F.col("new_id").alias("new_uuid"), F.col("id").alias("old_uuid"), F.lit("split").alias("reason"))
    made = good.select("id", F.col("name").alias("_name"), "new_id").join(nodes, "id").withColumns({"id": F.col("new_id"), "name": F.col("_name")}).select(*nodes.columns)
    target = good.select(F.col("id").alias("node_uuid"), "new_id", F.explode("members").alias("member_id"))
    moved = sources.join(target, ["node_uuid", "member_id"]).withColumn("node_uuid", F.col("new_id")).select(*sources.columns)
    kept = sources.join(ok.withColumnRenamed("id", "node_uuid"), "node_uuid", "left_anti").select(*sources.columns)
    return {"nodes": nodes.join(ok, "id", "left_anti").unionByName(made), "sources": kept.unionByName(moved), "lineage": lineage, "rejected": parts.join(ok, "id", "left_anti").select("id").distinct()}


def move_subdomains(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes of (from_domain, from_subdomain) put into (to_domain, to_subdomain): merging and demoting."""
    m = moves.select(F.col("from_domain").alias("domain"), F.col("from_subdomain").alias("subdomain"), "to_domain", "to_subdomain")
    joined = nodes.join(m, ["domain", "subdomain"], "left")
    return joined.select(*[F.coalesce(f"to_{c}", c).alias(c) if c in ("domain", "subdomain") else F.col(c) for c in nodes.columns])


def reassign_nodes(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Single nodes (id, to_domain, to_subdomain) given another owner: migrating, splitting a subdomain, promoting."""
    joined = nodes.join(targets.select("id", "to_domain", "to_subdomain"), "id", "left")
    return joined.select(*[F.coalesce(f"to_{c}", c).alias(c) if c in ("domain", "subdomain") else F.col(c) for c in nodes.columns])


def empty_subdomains(nodes: DataFrame) -> DataFrame:
    """Subdomain nodes with no entity or concept left in them."""
    used = nodes.where(F.col("label").isin(*CONTENT_LABELS)).select("domain", "subdomain").distinct()
    return nodes.where(F.col("label") == "Subdomain").join(used, ["domain", "subdomain"], "left_anti").select("id")


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """`edges` with `new`, in which parallel edges may come; columns that are missing are null."""
    return edges.unionByName(new, allowMissingColumns=True)


def delete_references(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Cross references without those to the given target entities."""
    return refs.join(entities.select("target_entity").distinct(), "target_entity", "left_anti")


def missing_decisions(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ids of decisions on reports that do not exist (which the writer refuses)."""
    return decisions.select("id").join(conflicts.select("id"), "id", "left_anti").distinct()


def set_manifest(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """key and value: those of `changes` (one row per key) replace or join the others."""
    return manifest.select("key", "value").join(changes.select("key"), "key", "left_anti").unionByName(changes.select("key", "value"))


def drop_states(states: DataFrame, repo_url: str, file_path: str) -> DataFrame:
    """File states without that of one file."""
    return states.where(~((F.col("repo_url") == repo_url) & (F.col("file_path") == file_path)))


def insert_identity(known: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`known` with rows of keys it lacks; a key that is there with another value fails the job when it runs."""
    met = new.join(known.select(*keys, F.col(value).alias("_known")), list(keys), "left")
    ok = F.when(F.col("_known").isNotNull() & (F.col("_known") != F.col(value)), F.raise_error(F.concat(F.lit("another identity is stored for "), F.concat_ws("/", *keys)))).otherwise(F.col("_known").isNull())
    return known.unionByName(met.where(ok).drop("_known").dropDuplicates(list(keys)))


def swap_composes(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``composes`` edges of subdomains to nodes that are given another owner (id, to_domain, to_subdomain), from the new subdomain instead; human-curated ones stay."""
    t = targets.select(F.col("id").alias("target_id"), F.concat(F.lit("subdomain::"), "to_domain", F.lit("::"), "to_subdomain").alias("_new"))
    structural = (F.col("kind") == "composes") & F.startswith("source_id", F.lit("subdomain::")) & (F.col("provenance") != HUMAN)
    joined = edges.join(t, "target_id", "left")
    return collapse_edges(joined.withColumn("source_id", F.when(structural & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("source_id"))).select(*edges.columns))


def rename_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes with the names of `names` (id, name); a blank name changes nothing."""
    return update_nodes(nodes, names.where("trim(name) <> ''"))


def touched_nodes(*parts: DataFrame) -> DataFrame:
    """Distinct ids of several tables of ids: changed, added, fused, moved nodes and those of changed relations."""
    out = parts[0].select("id")
    for p in parts[1:]:
        out = out.unionByName(p.select("id"))
    return out.where("id is not null").distinct()


def sync_provenance(nodes: DataFrame, edges: DataFrame, sources: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the source_refs of touched nodes and of their domains computed again, and edges without stale ``provides``."""
    own = touched.select("id").distinct().withColumn("_own", F.lit(True))
    domains = nodes.join(own, "id").where("domain is not null").select("domain").distinct()
    per_node = own.join(skills_of_nodes(sources).withColumnRenamed("source_refs", "_refs"), "id", "left")
    per_domain = domains.join(skills_of_domains(sources, nodes), "domain", "left").select(F.concat(F.lit("domain::"), "domain").alias("id"), F.lit(True).alias("_dom"), F.col("source_refs").alias("_drefs"))
    joined = nodes.join(per_node, "id", "left").join(per_domain, "id", "left")
    refs = F.when(F.col("_dom"), F.coalesce("_drefs", F.lit(""))).when(F.col("_own"), F.coalesce("_refs", F.lit(""))).otherwise(F.col("source_refs"))
    fresh = joined.select(*[refs.alias(c) if c == "source_refs" else F.col(c) for c in nodes.columns])
    stale = stale_provides(edges, nodes, sources).join(domains.select(F.concat(F.lit("domain::"), "domain").alias("target_id")), "target_id", "left_semi").select("id")
    return fresh, edges.join(stale, "id", "left_anti")


def apply_batch(nodes: DataFrame, edges: DataFrame, sources: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, new_sources: DataFrame) -> dict[str, DataFrame]:
    """One incremental run: nodes updated or inserted, sources and checked edges upserted, provenance of all that was touched computed again.

    Nodes a human has edited keep their content. Only touched nodes and their domains are computed again.
    """
    known = nodes.select("id").distinct()
    updated = update_machine_content(nodes, new_nodes.join(known, "id", "left_semi"))
    every = updated.unionByName(new_nodes.join(known, "id", "left_anti"), allowMissingColumns=True).select(*nodes.columns)
    held = collapse_sources(sources.unionByName(new_sources.select(*sources.columns)))
    linked = upsert_checked(edges, new_edges, every)
    touched = touched_nodes(new_nodes, new_sources.select(F.col("node_uuid").alias("id")), new_edges.select(F.col("source_id").alias("id")), new_edges.select(F.col("target_id").alias("id")))
    fresh, kept = sync_provenance(every, linked, held, touched)
    return {"nodes": fresh, "edges": kept, "sources": held, "touched": touched}


def recomputed_relations(edges: DataFrame, selected: DataFrame, nodes: DataFrame, scope: DataFrame) -> DataFrame:
    """Edges after relations of dirty subdomains (scope: domain, subdomain) were selected anew.

    Machine edges that start in the scope are replaced by the selected ones: an identity that exists keeps its id,
    created_at and confidence, others come new; what was not selected goes. Human-curated edges, and all edges outside
    the scope, stay as they are.
    """
    own = nodes.where(F.col("label").isin(*CONTENT_LABELS)).join(scope.select("domain", "subdomain").distinct(), ["domain", "subdomain"], "left_semi").select(F.col("id").alias("source_id")).distinct()
    mine = (F.col("provenance") != HUMAN) & (F.col("kind") != "provides")
    inside = edges.join(own, "source_id", "left_semi")
    old = collapse_edges(inside.where(mine))
    kept = edges.join(own, "source_id", "left_anti").unionByName(inside.where(~F.coalesce(mine, F.lit(False))))
    human = inside.where(F.col("provenance") == HUMAN).select(*EDGE_KEY).distinct()
    wanted = selected.join(own, "source_id", "left_semi").where("source_id <> target_id").groupBy(*EDGE_KEY).agg(F.max("confidence").alias("_c"), F.min("description").alias("_d")).join(human, EDGE_KEY, "left_anti")
    joined = wanted.join(old.withColumn("_old", F.lit(True)), EDGE_KEY, "left")
    pick = {"confidence": F.coalesce(F.col("confidence"), fill_confidence(F.col("_c"))), "description": F.coalesce(F.col("_d"), F.col("description")), "provenance": F.when(F.col("_old"), F.col("provenance")).otherwise("llm_inferred")}
    return kept.unionByName(joined.select(*[pick.get(c, F.col(c)).alias(c) for c in edges.columns]))
