"""Queries that compute the next generation of a table, and what must be computed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import build, graph, mutate
from weftgraph.plans.registry import query
from weftgraph.plans.relational import CONTENT


@query("x11_uncovered_units", "SELECT DISTINCT member_id AS unit_id, skill, file_path FROM s WHERE member_id NOT IN (SELECT member_id FROM s WHERE node_uuid IN (SELECT id FROM n))")
def _(g):
    units = g.sources.select(F.col("member_id").alias("unit_id"), "skill", "file_path").distinct()
    owned = g.sources.join(g.nodes.select(F.col("id").alias("node_uuid")), "node_uuid", "left_semi").select(F.array("member_id").alias("members"))
    return build.uncovered(units, owned)


@query("c8_dirty_subdomains", "WITH touched AS (SELECT DISTINCT target_id AS id FROM e WHERE kind = 'triggers'), more AS (SELECT id FROM touched UNION SELECT source_id FROM e WHERE provenance <> 'human_curated' AND target_id IN (SELECT id FROM touched)) SELECT DISTINCT domain, subdomain FROM n WHERE id IN (SELECT id FROM more) AND subdomain IS NOT NULL")
def _(g):
    return build.dirty_closure(g.edges.where("kind = 'triggers'").select(F.col("target_id").alias("id")).distinct(), g.nodes, g.edges)


@query("c9_changed_relation_files", "WITH ch AS (SELECT DISTINCT source_id, target_id FROM e WHERE created_at >= TIMESTAMP '2026-01-01' OR created_at IS NULL), ends AS (SELECT source_id AS id FROM ch UNION SELECT target_id FROM ch) SELECT DISTINCT file_path FROM s WHERE node_uuid IN (SELECT id FROM ends) AND file_path <> ''")
def _(g):
    keyed = g.edges.withColumn("kind", F.concat_ws("#", "kind", "id"))
    return build.changed_relation_documents(keyed.where("created_at < timestamp_ntz'2026-01-01'"), keyed, g.sources)


@query("c14_reassigned_nodes", f"SELECT id, CASE WHEN label IN {CONTENT} AND confidence < 0.5 THEN 'low' ELSE subdomain END AS subdomain FROM n")
def _(g):
    low = graph.semantic_nodes(g.nodes).where("confidence < 0.5").select("id", F.col("domain").alias("to_domain"), F.lit("low").alias("to_subdomain"))
    return mutate.reassign_nodes(g.nodes, low).select("id", "subdomain")


@query("c15_moved_subdomains", "WITH f AS (SELECT domain, min(subdomain) AS first FROM n WHERE label = 'Subdomain' GROUP BY domain) SELECT n.id, n.domain, CASE WHEN f.first = n.subdomain THEN 'merged' ELSE n.subdomain END AS subdomain FROM n LEFT JOIN f ON f.domain = n.domain")
def _(g):
    first = g.nodes.where("label = 'Subdomain'").groupBy("domain").agg(F.min("subdomain").alias("first"))
    moves = first.select(F.col("domain").alias("from_domain"), F.col("first").alias("from_subdomain"), F.col("domain").alias("to_domain"), F.lit("merged").alias("to_subdomain"))
    return mutate.move_subdomains(g.nodes, moves).select("id", "domain", "subdomain")


@query("k4_nodes_deleted", f"SELECT id FROM n WHERE id NOT IN (SELECT id FROM n WHERE label IN {CONTENT} AND confidence < 0.3)")
def _(g):
    return mutate.delete_nodes(g.nodes, g.nodes.where(F.col("label").isin("Entity", "Concept") & (F.col("confidence") < 0.3))).select("id")


@query("k11_edges_by_endpoint", "SELECT id FROM e WHERE target_id IS NULL OR target_id NOT IN (SELECT id FROM n WHERE label = 'Concept')")
def _(g):
    return mutate.delete_by_endpoint(g.edges, g.nodes.where("label = 'Concept'"), "target_id").select("id")


@query("k14_sources_left", "SELECT node_uuid, member_id, file_path FROM s WHERE node_uuid NOT IN (SELECT id FROM n WHERE label = 'Concept')")
def _(g):
    return mutate.delete_sources(g.sources, g.nodes.where("label = 'Concept'").select(F.col("id").alias("node_uuid"))).select("node_uuid", "member_id", "file_path")


@query("k19_latest_states", "SELECT file_path, max(indexed_at) AS indexed_at FROM documents WHERE file_path IS NOT NULL GROUP BY file_path")
def _(g):
    rows = g.raw("documents").where("file_path is not null").select("file_path", "indexed_at")
    return mutate.upsert_latest(rows.where("indexed_at < timestamp_ntz'2026-01-01' or indexed_at is null"), rows.where("indexed_at >= timestamp_ntz'2026-01-01'"), ["file_path"], "indexed_at").select("file_path", "indexed_at")


@query("k22_content_edit", "SELECT id, CASE WHEN label = 'Concept' THEN 'edited ' || name ELSE name END AS name, CASE WHEN label = 'Concept' THEN 'human_curated' ELSE provenance END AS provenance FROM n")
def _(g):
    none = F.lit(None).cast("string")
    edits = g.nodes.where("label = 'Concept'").select("id", F.concat(F.lit("edited "), "name").alias("name"), none.alias("summary"), none.alias("description"))
    return mutate.edit_content(g.nodes, g.sources, edits)[0].select("id", "name", "provenance")


@query("k32_checked_upsert", "WITH r AS (SELECT source_id, target_id, kind, id, confidence FROM e UNION ALL SELECT source_id, target_id, 'contradicts', id + 1000000000, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0.8 END FROM e WHERE kind = 'references' AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)) SELECT source_id, target_id, kind, min(id) AS id, arg_max(confidence, id) AS confidence FROM r GROUP BY source_id, target_id, kind")
def _(g):
    new = g.edges.where("kind = 'references'").withColumns({"kind": F.lit("contradicts"), "id": F.col("id") + 1_000_000_000})
    return mutate.upsert_checked(g.edges, new, g.nodes).select("source_id", "target_id", "kind", "id", "confidence")
