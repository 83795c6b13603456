"""Scans, lookups, predicates, joins, aggregations, orderings and set operations over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import identity
from weftgraph.functions.text import base_name, slug
from weftgraph.operators import evaluate, graph, mutate, search
from weftgraph.plans.registry import query
from weftgraph.sources import documents, schemas
from weftgraph.sources.graph import Graph

PRIORITY = "CASE kind WHEN 'triggers' THEN 0 WHEN 'depends_on' THEN 1 WHEN 'references' THEN 2 ELSE 3 END"
SEMANTIC = "(" + ", ".join(f"'{k}'" for k in schemas.SEMANTIC_KINDS) + ")"
CONTENT = "('Entity', 'Concept')"
HUB = "(SELECT target_id FROM e GROUP BY target_id ORDER BY count(*) DESC, target_id LIMIT 1)"
SLUG = "regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{Nd}}]+', '-', 'g'), '^-+|-+$', '', 'g')"


def hub(g: Graph) -> DataFrame:
    """The node most edges lead to: one row, id."""
    return g.edges.groupBy(F.col("target_id").alias("id")).count().orderBy(F.col("count").desc(), "id").limit(1).select("id")


@query("s1_nodes", "SELECT id, label, name, domain, subdomain, confidence FROM n")
def _(g):
    return g.nodes.select("id", "label", "name", "domain", "subdomain", "confidence")


@query("s2_edges", "SELECT id, source_id, target_id, kind, confidence FROM e")
def _(g):
    return g.edges.select("id", "source_id", "target_id", "kind", "confidence").orderBy("id")


@query("s3_node_by_id", "SELECT id, label, name FROM n WHERE id = (SELECT min(id) FROM nodes WHERE label = 'Entity')")
def _(g):
    wanted = g.raw("nodes").where("label = 'Entity'").agg(F.min("id").alias("id"))
    return g.nodes.join(F.broadcast(wanted), "id", "left_semi").select("id", "label", "name")


@query("s4_nodes_by_ids", "SELECT id, label, name FROM n WHERE id IN (SELECT target_id FROM e WHERE kind = 'triggers')")
def _(g):
    return g.nodes.join(g.edges.where("kind = 'triggers'").select(F.col("target_id").alias("id")), "id", "left_semi").select("id", "label", "name")


@query("s5_nodes_by_domain", "SELECT id, domain, name FROM n WHERE domain = (SELECT min(domain) FROM nodes WHERE label = 'Domain')")
def _(g):
    first = g.raw("nodes").where("label = 'Domain'").agg(F.min("domain").alias("domain"))
    return g.nodes.join(F.broadcast(first), "domain").select("id", "domain", "name")


@query("s6_nodes_by_subdomain", "SELECT id, domain, subdomain FROM n WHERE (domain, subdomain) = (SELECT (domain, subdomain) FROM nodes WHERE label = 'Subdomain' ORDER BY id LIMIT 1)")
def _(g):
    one = g.raw("nodes").where("label = 'Subdomain'").agg(F.min_by(F.struct("domain", "subdomain"), "id").alias("d")).select("d.*")
    return g.nodes.join(F.broadcast(one), ["domain", "subdomain"]).select("id", "domain", "subdomain")


@query("s7_outgoing", f"SELECT id, source_id, target_id, kind, row_number() OVER (PARTITION BY source_id ORDER BY {PRIORITY}, id) AS ord FROM e WHERE confidence >= 0.5 AND source_id IN (SELECT id FROM n)")
def _(g):
    return graph.outgoing(g.edges, g.nodes, 0.5).select("id", "source_id", "target_id", "kind", "ord")


@query("s8_incoming", f"SELECT id, source_id, kind FROM e WHERE target_id = {HUB} AND confidence >= 0.5")
def _(g):
    return graph.incoming(g.edges, hub(g), 0.5).select("id", "source_id", "kind")


@query("s9_between", "SELECT source_id, target_id, count(*) AS n_edges, min(id) AS first_id FROM e GROUP BY source_id, target_id HAVING count(*) > 1")
def _(g):
    return g.edges.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n_edges"), F.min("id").alias("first_id")).where("n_edges > 1")


@query("s10_sources_by_node", "SELECT node_uuid, member_id, file_path, row_number() OVER (PARTITION BY node_uuid ORDER BY member_id, file_path) AS ord FROM s")
def _(g):
    return g.sources.select("node_uuid", "member_id", "file_path", F.row_number().over(Window.partitionBy("node_uuid").orderBy("member_id", "file_path")).alias("ord"))


@query("s11_sources_by_file", "SELECT file_path, node_uuid, member_id, row_number() OVER (PARTITION BY file_path ORDER BY node_uuid, member_id) AS ord FROM s")
def _(g):
    return g.sources.select("file_path", "node_uuid", "member_id", F.row_number().over(Window.partitionBy("file_path").orderBy("node_uuid", "member_id")).alias("ord"))


@query("s12_sources", "SELECT * FROM s")
def _(g):
    return g.sources.orderBy("node_uuid", "member_id", "file_path")


@query("s14_unresolved_references", "SELECT id, source_entity, target_entity FROM x WHERE target_node_id IS NULL")
def _(g):
    return g.cross_references.where("target_node_id is null").select("id", "source_entity", "target_entity")


@query("s15_external_links", "SELECT id, source_entity, target_entity, created_at FROM x WHERE resolution_status = 'external_kg'")
def _(g):
    return g.cross_references.where("resolution_status = 'external_kg'").select("id", "source_entity", "target_entity", "created_at").orderBy("created_at", "id")


@query("s16_references_by_source", "SELECT source_entity, count(*) AS n_refs, count(target_node_id) AS n_resolved FROM x GROUP BY source_entity")
def _(g):
    return g.cross_references.groupBy("source_entity").agg(F.count(F.lit(1)).alias("n_refs"), F.count("target_node_id").alias("n_resolved"))


@query("s18_file_states", "SELECT file_path, max(indexed_at) AS indexed_at, arg_max(md5(coalesce(text, '')), (indexed_at, doc_id)) AS content_hash FROM documents WHERE file_path IS NOT NULL GROUP BY file_path")
def _(g):
    rows = g.raw("documents").where("file_path is not null").select("file_path", "indexed_at", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return rows.groupBy("file_path").agg(F.max("indexed_at").alias("indexed_at"), F.max_by("h", F.struct("indexed_at", "doc_id")).alias("content_hash"))


@query("s19_manifest_value", "SELECT trigger_reason AS key, coalesce(max(json_extract_string(try_cast(diff_json AS JSON), '$.nodes[0].change')), '') AS value FROM c WHERE trigger_reason IS NOT NULL GROUP BY trigger_reason")
def _(g):
    whole = F.try_parse_json("diff_json").isNotNull()
    value = F.when(whole, F.get_json_object("diff_json", "$.nodes[0].change"))
    return g.changesets.where("trigger_reason is not null").groupBy(F.col("trigger_reason").alias("key")).agg(F.coalesce(F.max(value), F.lit("")).alias("value"))


@query("s20_current_version", "SELECT kb_version FROM c ORDER BY seq DESC LIMIT 1")
def _(g):
    return g.changesets.agg(F.max_by("kb_version", "seq").alias("kb_version"))


@query("s21_evolution", "SELECT seq, kb_version, parent_version, tool, ts FROM c")
def _(g):
    return g.changesets.select("seq", "kb_version", "parent_version", "tool", "ts").orderBy("seq")


@query("s22_latest_changeset", "SELECT tool, max(seq) AS seq, arg_max(kb_version, seq) AS kb_version FROM c GROUP BY tool")
def _(g):
    return g.changesets.groupBy("tool").agg(F.max("seq").alias("seq"), F.max_by("kb_version", "seq").alias("kb_version"))


@query("s25_glob", r"SELECT doc_id, regexp_full_match(file_path, '(?:.*/)?[^/]*-repair-[^/]*\.md') AS matched FROM documents WHERE file_path IS NOT NULL")
def _(g):
    return g.raw("documents").where("file_path is not null").select("doc_id", documents.matches_glob(F.col("file_path"), "**/*-repair-*.md").alias("matched"))


@query("s26_front_matter", r"SELECT doc_id, nullif(regexp_extract(regexp_extract(text, '(?s)\A---\r?\n(.*?)\r?\n---', 1), '(?m)^name:[ \t]*([^\r\n]*?)[ \t]*\r?$', 1), '') AS name FROM documents WHERE text IS NOT NULL")
def _(g):
    return g.raw("documents").where("text is not null").select("doc_id", documents.front_matter(F.col("text"))["name"].alias("name"))


@query("s28_viewer_counts", "SELECT count(*) AS n_nodes, count(DISTINCT domain) AS n_domains FROM n")
def _(g):
    return g.nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("domain").alias("n_domains"))


@query("s29_history_entries", "SELECT seq, CAST(coalesce(json_array_length(try_cast(diff_json AS JSON), '$.nodes'), 0) AS BIGINT) AS n_entries FROM c")
def _(g):
    parsed = F.from_json("diff_json", "nodes array<struct<id:string,change:string>>")
    whole = F.try_parse_json("diff_json").isNotNull()
    return g.changesets.select("seq", F.when(whole & parsed["nodes"].isNotNull(), F.size(parsed["nodes"])).otherwise(0).cast("long").alias("n_entries"))


@query("f_domain_scope", "SELECT e.id, n.domain FROM e JOIN n ON n.id = e.target_id WHERE n.domain IN (SELECT domain FROM n GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 3)")
def _(g):
    top = g.nodes.groupBy("domain").count().orderBy(F.col("count").desc(), "domain").limit(3).select("domain")
    inside = g.nodes.join(F.broadcast(top), "domain", "left_semi").select(F.col("id").alias("target_id"), "domain")
    return g.edges.join(inside, "target_id").select("id", "domain")


@query("f_label_filter", "SELECT label, count(*) AS n FROM n WHERE label IN ('Entity', 'Concept') GROUP BY label")
def _(g):
    return g.nodes.where(F.col("label").isin(*schemas.CONTENT_LABELS)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("f_confidence_floor", "SELECT kind, count(*) AS n FROM e WHERE confidence >= 0.7 GROUP BY kind")
def _(g):
    return g.edges.where("confidence >= 0.7").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("f_semantic_edges", f"SELECT DISTINCT source_id, target_id, kind FROM e WHERE kind IN {SEMANTIC} AND source_id <> target_id AND source_id IN (SELECT id FROM n WHERE label IN {CONTENT}) AND target_id IN (SELECT id FROM n WHERE label IN {CONTENT})")
def _(g):
    return graph.semantic_edges(g.nodes, g.edges)


@query("f_enum_checks", "SELECT count(*) FILTER (WHERE kind NOT IN ('composes', 'depends_on', 'references', 'triggers', 'generalizes', 'contradicts', 'provides')) AS bad_kind, count(*) FILTER (WHERE provenance NOT IN ('extraction', 'llm_inferred', 'human_curated')) AS bad_provenance, count(*) FILTER (WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false)) AS bad_confidence FROM e")
def _(g):
    return g.edges.agg(
        F.count_if(~F.col("kind").isin(*schemas.KINDS)).alias("bad_kind"),
        F.count_if(~F.col("provenance").isin(*schemas.PROVENANCES)).alias("bad_provenance"),
        F.count_if(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("bad_confidence"),
    )


@query("f_safe_paths", r"""SELECT file_path, count(*) AS n FROM node_sources WHERE file_path IS NOT NULL AND NOT regexp_matches(file_path, '[\\:%\x00-\x1f]|^/|^\s|\s$|(^|/)\.{1,2}(/|$)|//') AND file_path <> '' GROUP BY file_path""")
def _(g):
    return g.raw("node_sources").where(documents.safe_path(F.col("file_path"))).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@query("f_edge_defaults", "SELECT id, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0.8 END AS confidence, CASE WHEN provenance IN ('extraction', 'llm_inferred', 'human_curated') THEN provenance ELSE 'llm_inferred' END AS provenance FROM e")
def _(g):
    return g.edges.select("id", mutate.fill_confidence(F.col("confidence")).alias("confidence"), mutate.fill_provenance(F.col("provenance")).alias("provenance"))


@query("f_integrity", "SELECT (SELECT count(*) FROM e WHERE source_id NOT IN (SELECT id FROM n) OR target_id NOT IN (SELECT id FROM n)) AS dangling_edges, (SELECT count(*) FROM s JOIN n ON n.id = s.node_uuid WHERE n.label NOT IN ('Entity', 'Concept')) AS sources_on_structure")
def _(g):
    ids = g.nodes.select("id")
    bad = g.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select("id").unionByName(g.edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select("id")).distinct()
    wrong = g.sources.join(g.nodes.where(~F.col("label").isin(*schemas.CONTENT_LABELS)).select(F.col("id").alias("node_uuid")), "node_uuid", "left_semi")
    return bad.agg(F.count(F.lit(1)).alias("dangling_edges")).join(F.broadcast(wrong.agg(F.count(F.lit(1)).alias("sources_on_structure"))), F.lit(True))


@query("f_contract", "SELECT 'nodes' AS table_name, 0 AS n_violations UNION ALL SELECT 'edges', 0 UNION ALL SELECT 'changesets', (SELECT count(*) FROM (VALUES ('id'), ('source_id'), ('target_id'), ('kind'), ('description'), ('properties'), ('provenance'), ('confidence'), ('source_refs'), ('bidirectional'), ('cardinality'), ('created_at')) v(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE changesets))) UNION ALL SELECT 'retyped', 2")
def _(g):
    """The contract of two tables; a table without its columns, and one with two columns of another type, break it."""
    have = [("nodes", g.raw("nodes"), schemas.NODES), ("edges", g.raw("edges"), schemas.EDGES), ("changesets", g.raw("changesets"), schemas.EDGES), ("retyped", g.raw("edges").withColumns({"confidence": F.lit("x"), "kind": F.lit(1)}), schemas.EDGES)]
    return g.spark.createDataFrame([(t, len(schemas.violations(df, s))) for t, df, s in have], "table_name string, n_violations int")


@query("j2_skills_of_domains", "SELECT DISTINCT n.domain, s.skill FROM s JOIN n ON n.id = s.node_uuid")
def _(g):
    return g.sources.join(g.nodes.select(F.col("id").alias("node_uuid"), "domain"), "node_uuid").select("domain", "skill").distinct()


@query("j3_edges_of_subdomains", f"SELECT n.domain, n.subdomain, count(*) AS n_edges FROM e JOIN n ON n.id = e.source_id WHERE n.label IN {CONTENT} GROUP BY n.domain, n.subdomain")
def _(g):
    own = graph.semantic_nodes(g.nodes).select(F.col("id").alias("source_id"), "domain", "subdomain")
    return g.edges.join(own, "source_id").groupBy("domain", "subdomain").agg(F.count(F.lit(1)).alias("n_edges"))


@query("j4_neighbour_files", f"SELECT DISTINCT file_path FROM s WHERE node_uuid IN (SELECT source_id FROM e WHERE target_id = {HUB} UNION SELECT target_id FROM e WHERE source_id = {HUB}) AND file_path <> ''")
def _(g):
    return mutate.neighbour_docs(g.edges, g.sources, hub(g))


@query("j9_span_overlap", "SELECT DISTINCT a.file_path AS path, a.node_uuid || '|' || a.member_id AS id_a, b.node_uuid || '|' || b.member_id AS id_b FROM s a JOIN s b ON a.file_path = b.file_path AND a.start_line <= b.end_line AND b.start_line <= a.end_line WHERE a.start_line >= 1 AND a.start_line <= a.end_line AND b.start_line >= 1 AND b.start_line <= b.end_line AND a.node_uuid || '|' || a.member_id < b.node_uuid || '|' || b.member_id")
def _(g):
    spans = g.sources.select(F.concat_ws("|", "node_uuid", "member_id").alias("id"), F.col("file_path").alias("path"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return evaluate.span_overlap(spans, spans).where("id_a < id_b").distinct()


@query("a1_edges_by_kind", "SELECT kind, count(*) AS n FROM e GROUP BY kind")
def _(g):
    return g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("a2_status", "SELECT 'label' AS what, label AS key, count(*) AS n FROM n GROUP BY label UNION ALL SELECT 'domain', domain, count(*) FROM n GROUP BY domain UNION ALL SELECT 'kind', kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'total', 'nodes', count(*) FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM e")
def _(g):
    nodes = g.nodes.groupBy("label", "domain").agg(F.count(F.lit(1)).alias("n"))
    item = lambda what, key, df: df.groupBy(F.lit(what).alias("what"), F.col(key).alias("key")).agg(F.sum("n").alias("n"))
    kinds = g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    total = lambda key, df: df.agg(F.sum("n").alias("n")).select(F.lit("total").alias("what"), F.lit(key).alias("key"), "n")
    return item("label", "label", nodes).unionByName(item("domain", "domain", nodes)).unionByName(item("kind", "kind", kinds)).unionByName(total("nodes", nodes)).unionByName(total("edges", kinds))


@query("a3_files_per_node", "SELECT node_uuid, count(DISTINCT file_path) AS n_files FROM s GROUP BY node_uuid")
def _(g):
    return g.sources.groupBy("node_uuid").agg(F.count_distinct("file_path").alias("n_files"))


@query("a4_skills_per_node", "SELECT node_uuid AS id, string_agg(DISTINCT skill, ',' ORDER BY skill) AS source_refs FROM s WHERE skill <> '' GROUP BY node_uuid")
def _(g):
    return mutate.skills_of_nodes(g.sources)


@query("a5_files_of_nodes", "SELECT node_uuid, string_agg(DISTINCT file_path, '|' ORDER BY file_path) AS files FROM s WHERE file_path <> '' GROUP BY node_uuid")
def _(g):
    return g.sources.where("file_path <> ''").groupBy("node_uuid").agg(F.array_join(F.array_sort(F.collect_set("file_path")), "|").alias("files"))


@query("a6_domains", "SELECT domain, arg_min(summary, id) FILTER (WHERE summary <> '') AS summary, count(DISTINCT nullif(subdomain, '')) AS n_subdomains, 'full' AS coverage FROM n GROUP BY domain")
def _(g):
    first = F.min_by("summary", F.when(F.col("summary") != "", F.col("id")))
    return g.nodes.groupBy("domain").agg(first.alias("summary"), F.count_distinct(F.nullif("subdomain", F.lit(""))).alias("n_subdomains"), F.lit("full").alias("coverage"))


@query("a7_domain_coverage", "SELECT domain, count(*) > 0 AS covered, count(*) FILTER (WHERE label IN ('Entity', 'Concept')) AS n_content FROM n GROUP BY domain")
def _(g):
    return g.nodes.groupBy("domain").agg((F.count(F.lit(1)) > 0).alias("covered"), F.count_if(F.col("label").isin(*schemas.CONTENT_LABELS)).alias("n_content"))


@query("a10_change_counts", "SELECT column_name AS change, CAST(sum(coalesce(v, 0)) AS BIGINT) AS n FROM (UNPIVOT (SELECT n_added, n_deleted, n_merged, n_split, n_migrated, n_renamed, n_content, n_edge_added, n_edge_dropped FROM c) ON COLUMNS(*) INTO NAME column_name VALUE v) GROUP BY column_name")
def _(g):
    names = ["n_added", "n_deleted", "n_merged", "n_split", "n_migrated", "n_renamed", "n_content", "n_edge_added", "n_edge_dropped"]
    return g.changesets.select(*names).unpivot([], names, "change", "v").groupBy("change").agg(F.sum(F.coalesce("v", F.lit(0))).alias("n"))


@query("a11_top_domains", "SELECT domain, count(*) AS n FROM n GROUP BY domain ORDER BY n DESC, domain LIMIT 10")
def _(g):
    return g.nodes.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "domain").limit(10)


@query("a15_cumulative_change", "SELECT seq, least(1.0, sum(coalesce(n_content, 0)) OVER (ORDER BY seq) / 1000.0) AS ratio FROM c")
def _(g):
    from weftgraph.operators.temporal import change_ratio

    return change_ratio(g.changesets.select("seq", F.coalesce("n_content", F.lit(0)).alias("docs_changed")), 1000).select("seq", "ratio")


@query("a17_centrality", "WITH d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY id), f AS (SELECT n.id, coalesce(degree, 0) AS degree FROM n LEFT JOIN d ON d.id = n.id) SELECT id, degree, round(degree / greatest((SELECT max(degree) FROM f), 1), 9) AS centrality FROM f")
def _(g):
    return graph.centrality(g.nodes, g.edges)


@query("a18_run_rates", "SELECT arm, count(*) AS n_runs, round(avg(CASE WHEN lower(trim(status)) = 'ok' THEN 0.0 ELSE 1.0 END), 9) AS error_rate, round(avg(CASE WHEN coalesce(trim(answer), '') = '' THEN 1.0 ELSE 0.0 END), 9) AS empty_rate FROM (SELECT DISTINCT result_id, arm, status, answer FROM results) GROUP BY arm")
def _(g):
    once = g.raw("results").select("result_id", "arm", "status", "answer").distinct()
    failed, empty = F.lower(F.trim("status")) == "ok", F.coalesce(F.trim("answer"), F.lit("")) == ""
    return once.groupBy("arm").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.avg(F.when(failed, 0.0).otherwise(1.0)), 9).alias("error_rate"), F.round(F.avg(F.when(empty, 1.0).otherwise(0.0)), 9).alias("empty_rate"))


@query("a19_latency", "SELECT arm, quantile_disc(elapsed_seconds, 0.5) AS p50, quantile_disc(elapsed_seconds, 0.95) AS p95, round(quantile_cont(elapsed_seconds, 0.5), 9) AS q50, round(quantile_cont(elapsed_seconds, 0.9), 9) AS q90 FROM (SELECT DISTINCT result_id, arm, elapsed_seconds FROM results) WHERE elapsed_seconds IS NOT NULL GROUP BY arm")
def _(g):
    return evaluate.quantiles(g.raw("results").select("result_id", "arm", "elapsed_seconds").distinct(), "arm", "elapsed_seconds")


@query("a21_groupings", "SELECT arm, harness_protocol, count(*) AS n FROM (SELECT DISTINCT result_id, arm, harness_protocol FROM results) GROUP BY GROUPING SETS ((arm), (harness_protocol), ())")
def _(g):
    once = g.raw("results").select("result_id", "arm", "harness_protocol").distinct()
    return once.groupingSets([["arm"], ["harness_protocol"], []], "arm", "harness_protocol").agg(F.count(F.lit(1)).alias("n"))


@query("a22_lowest_confidence", "SELECT s.node_uuid AS id, CASE WHEN least(1.0, min(n.confidence)) <= 0 THEN 0.8 ELSE least(1.0, min(n.confidence)) END AS confidence FROM s JOIN n ON n.id = s.node_uuid GROUP BY s.node_uuid")
def _(g):
    from weftgraph.operators.resolve import lowest_confidence

    rows = g.sources.join(g.nodes.select(F.col("id").alias("node_uuid"), "confidence"), "node_uuid").select(F.col("node_uuid").alias("id"), "confidence")
    return lowest_confidence(rows, "id")


@query("o6_token_budget", r"WITH t AS (SELECT domain, id, greatest(floor(len(regexp_extract_all(coalesce(summary, ''), '\p{Han}')) * 1.5 + len(regexp_extract_all(regexp_replace(coalesce(summary, ''), '\p{Han}', ' ', 'g'), '\S+')) * 1.3), 1) AS cost FROM n), w AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY domain ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT domain, id, CAST(cost AS INTEGER) AS cost FROM w WHERE before <= 200")
def _(g):
    rows = g.nodes.select("domain", "id", search.token_estimate(F.coalesce("summary", F.lit(""))).alias("cost"))
    return search.within_budget(rows, ["domain"], ["id"], F.col("cost"), 200)


@query("o7_pack", "WITH w AS (SELECT domain, id, summary, 300 - coalesce(sum(length(summary)) OVER (PARTITION BY domain ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM n WHERE summary <> '') SELECT domain, id, left(summary, CAST(room AS INTEGER)) AS summary FROM w WHERE room > 0")
def _(g):
    return search.pack(g.nodes.where("summary <> ''").select("domain", "id", "summary"), ["domain"], ["id"], "summary", 300)


@query("o8_cap_per_group", "WITH r AS (SELECT domain, subdomain, id, confidence, row_number() OVER (PARTITION BY domain, subdomain ORDER BY confidence DESC, id) AS k FROM n) SELECT domain, id, place FROM (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, id) AS place FROM r WHERE k <= 2) WHERE place <= 10")
def _(g):
    rows = g.nodes.select("domain", "subdomain", "id", (-F.col("confidence")).alias("o"))
    return search.cap_per_group(rows, "domain", "subdomain", ["o", "id"], 2, 10).select("domain", "id", "place")


@query("o10_last_history", "SELECT tool, seq FROM (SELECT tool, seq, row_number() OVER (PARTITION BY tool ORDER BY seq DESC) AS k FROM c) WHERE k <= 50")
def _(g):
    from weftgraph.operators.temporal import keep_last

    return keep_last(g.changesets.select("tool", "seq"), "seq", 50, "tool")


@query("o11_first_edge", "SELECT source_id, target_id, kind, min(id) AS id FROM e GROUP BY source_id, target_id, kind")
def _(g):
    return g.edges.groupBy("source_id", "target_id", "kind").agg(F.min("id").alias("id"))


@query("u8_undirected", "SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, min(id) AS edge_id FROM e WHERE source_id <> target_id GROUP BY 1, 2")
def _(g):
    return graph.undirected(g.edges)


@query("u3_united_skills", "SELECT n.domain, string_agg(DISTINCT s.skill, ',' ORDER BY s.skill) AS source_refs FROM s JOIN n ON n.id = s.node_uuid WHERE s.skill <> '' GROUP BY n.domain")
def _(g):
    return mutate.skills_of_domains(g.sources, g.nodes)


@query("u6_relations_once", "SELECT source_id, target_id, kind, coalesce(description, '') AS description, min(id) AS id FROM e GROUP BY source_id, target_id, kind, coalesce(description, '')")
def _(g):
    return g.edges.groupBy("source_id", "target_id", "kind", F.coalesce("description", F.lit("")).alias("description")).agg(F.min("id").alias("id"))


_SHINGLE = r"""WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
k AS (SELECT doc_id, count(*) AS n, string_agg(g, '|' ORDER BY g) AS whole FROM g GROUP BY doc_id),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM k)"""


@query("u9_shingle_pairs", _SHINGLE + """, rep AS (SELECT DISTINCT class_id, n FROM cls),
c2 AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT class_id FROM rep) AND b.doc_id IN (SELECT class_id FROM rep) GROUP BY 1, 2)
SELECT a AS id_a, b AS id_b, round(common / (x.n + y.n - common), 9) AS similarity FROM c2 JOIN rep x ON x.class_id = a JOIN rep y ON y.class_id = b WHERE round(common / (x.n + y.n - common), 9) >= 0.85""")
def _(g):
    return evaluate.shingle_pairs(g.raw("documents"), "doc_id", "text")


@query("u9_shingle_classes", _SHINGLE + " SELECT doc_id AS id, class_id FROM cls")
def _(g):
    return evaluate.shingle_classes(g.raw("documents"), "doc_id", "text").select("id", "class_id")


@query("m4_paired_arms", "WITH b AS (SELECT question_id, arm, max(CASE WHEN lower(trim(status)) = 'ok' THEN len(citations) ELSE 0 END) AS score FROM results WHERE arm IS NOT NULL GROUP BY question_id, arm) SELECT count(*) FILTER (WHERE y.score > x.score) AS gains, count(*) FILTER (WHERE y.score < x.score) AS losses, count(*) FILTER (WHERE y.score = x.score) AS ties FROM b x JOIN b y USING (question_id) WHERE x.arm = 'raw' AND y.arm = 'graph'")
def _(g):
    score = F.when(F.lower(F.trim("status")) == "ok", F.nullif(F.size("citations"), F.lit(-1))).otherwise(0)
    rows = g.raw("results").where("arm is not null").select("question_id", "arm", score.alias("score"))
    return evaluate.paired(rows, "question_id", "arm", "score", "raw", "graph")


@query("m5_split", "SELECT DISTINCT question_id, CAST(CAST('0x' || left(sha256(question_id), 8) AS BIGINT) % 5 AS INTEGER) AS split FROM results WHERE question_id IS NOT NULL")
def _(g):
    return g.raw("results").where("question_id is not null").select("question_id", evaluate.split_of(F.col("question_id")).alias("split")).distinct()


@query("m6_freeze", "SELECT arm, question_id FROM (SELECT arm, question_id, row_number() OVER (PARTITION BY arm ORDER BY question_id) AS k FROM (SELECT DISTINCT arm, question_id FROM results)) WHERE k <= 20")
def _(g):
    return evaluate.freeze(g.raw("results").select("arm", "question_id").distinct(), "arm", "question_id", 20)


@query("m7_citation_overlap", "SELECT result_id, round(len([y for y in citations if NOT coalesce(list_contains(coalesce(invalid_citations, []), y), false)]) / greatest(len(citations), 1), 9) AS valid_share FROM (SELECT DISTINCT result_id, citations, invalid_citations FROM results) WHERE citations IS NOT NULL")
def _(g):
    once = g.raw("results").where("citations is not null").select("result_id", "citations", "invalid_citations").distinct()
    invalid = F.coalesce("invalid_citations", F.array().cast("array<string>"))
    good = F.filter("citations", lambda x: ~F.coalesce(F.array_contains(invalid, x), F.lit(False)))
    return once.select("result_id", F.round(F.size(good) / F.greatest(F.size("citations"), F.lit(1)), 9).alias("valid_share"))


@query("m8_totals", "SELECT arm, round(sum(elapsed_seconds), 6) AS seconds, CAST(sum(len(citations)) AS BIGINT) AS citations FROM (SELECT DISTINCT result_id, arm, elapsed_seconds, citations FROM results) GROUP BY arm")
def _(g):
    once = g.raw("results").select("result_id", "arm", "elapsed_seconds", "citations").distinct()
    return once.groupBy("arm").agg(F.round(F.sum("elapsed_seconds"), 6).alias("seconds"), F.sum(F.nullif(F.size("citations"), F.lit(-1))).alias("citations"))


@query("x5_node_sources_report", r"""SELECT node_uuid, count(DISTINCT file_path) FILTER (WHERE ok) AS n_files, count(*) FILTER (WHERE NOT ok) AS n_omitted, CASE WHEN count(*) FILTER (WHERE ok AND span) > 0 THEN 'available' ELSE 'unknown' END AS span_status
FROM (SELECT node_uuid, file_path, coalesce(start_line >= 1 AND end_line >= start_line, false) AS span, NOT regexp_matches(file_path, '[\\:%\x00-\x1f]|^/|(^|/)\.{1,2}(/|$)|//') AND file_path <> '' AS ok FROM s) GROUP BY node_uuid""")
def _(g):
    ok = ~F.col("file_path").rlike(r"[\\:%\x00-\x1f]|^/|(^|/)\.{1,2}(/|$)|//") & (F.col("file_path") != "")
    span = mutate.span_rank(F.col("start_line"), F.col("end_line")) == 0
    rows = g.sources.select("node_uuid", "file_path", ok.alias("ok"), span.alias("span"))
    return rows.groupBy("node_uuid").agg(
        F.count_distinct(F.when(F.col("ok"), F.col("file_path"))).alias("n_files"), F.count_if(~F.col("ok")).alias("n_omitted"),
        F.when(F.count_if(F.col("ok") & F.col("span")) > 0, "available").otherwise("unknown").alias("span_status"),
    )


@query("fn_slug", f"SELECT id, {SLUG.format('name')} AS slug FROM n WHERE name IS NOT NULL")
def _(g):
    return g.nodes.where("name is not null").select("id", slug(F.col("name")).alias("slug"))


@query("fn_comma_list", "SELECT id, array_to_string([y for y in [trim(z) for z in string_split(source_refs, ',')] if y <> ''], '|') AS refs FROM n WHERE source_refs IS NOT NULL")
def _(g):
    parts = F.filter(F.transform(F.split("source_refs", ","), lambda x: F.trim(x)), lambda x: x != "")
    return g.nodes.where("source_refs is not null").select("id", F.array_join(parts, "|").alias("refs"))


@query("fn_base_name", r"SELECT seq, regexp_extract(snapshot_file, '([^/\\]*)$', 1) AS file FROM c WHERE snapshot_file IS NOT NULL")
def _(g):
    return g.changesets.where("snapshot_file is not null").select("seq", base_name(F.col("snapshot_file")).alias("file"))


@query("fn_sanitize", "SELECT seq, regexp_replace(kb_version, '[^A-Za-z0-9._-]', '-', 'g') AS part FROM c")
def _(g):
    return g.changesets.select("seq", F.regexp_replace("kb_version", "[^A-Za-z0-9._-]", "-").alias("part"))


@query("fn_digests", "SELECT chunk_id, sha256(text) AS digest FROM (SELECT DISTINCT chunk_id, text FROM chunks) WHERE text IS NOT NULL")
def _(g):
    return g.raw("chunks").where("text is not null").select("chunk_id", "text").distinct().select("chunk_id", F.sha2("text", 256).alias("digest"))


@query("fn_truncate", "SELECT id, CASE WHEN length(summary) > 40 THEN left(summary, 40) || '…' ELSE summary END AS short FROM n WHERE summary IS NOT NULL")
def _(g):
    return g.nodes.where("summary is not null").select("id", F.when(F.length("summary") > 40, F.concat(F.substring("summary", 1, 40), F.lit("…"))).otherwise(F.col("summary")).alias("short"))


@query("fn_han_spacing", r"SELECT id, trim(regexp_replace(name || ' ' || coalesce(summary, ''), '(\p{Han})', ' \1 ', 'g')) AS text FROM n WHERE name IS NOT NULL")
def _(g):
    from weftgraph.functions.text import space_han

    return g.nodes.where("name is not null").select("id", F.trim(space_han(F.concat("name", F.lit(" "), F.coalesce("summary", F.lit(""))))).alias("text"))


@query("fn_char_chunks", "WITH t AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE length(text) > 0), p AS (SELECT chunk_id, text, unnest(range(0, greatest(length(text) - 1 - CASE WHEN length(text) > 1800 THEN 200 ELSE length(text) END, 0) + 1, 1600)) AS a FROM t) SELECT chunk_id AS key, CAST(a AS INTEGER) AS start_char, CAST(least(a + 1800, length(text)) AS INTEGER) AS end_char, CAST(1 + length(left(text, a)) - length(replace(left(text, a), chr(10), '')) AS INTEGER) AS start_line FROM p")
def _(g):
    return documents.char_chunks(g.raw("chunks").select("chunk_id", "text").distinct(), "chunk_id", "text").select("key", "start_char", "end_char", "start_line")


@query("fn_token_windows", "WITH t AS (SELECT chunk_id, k FROM (SELECT DISTINCT chunk_id, text, len(regexp_extract_all(text, '\\S+')) AS k FROM chunks WHERE text IS NOT NULL)), w AS (SELECT chunk_id, k, unnest(range(0, greatest(k - 1 - CASE WHEN k > 256 THEN 32 ELSE k END, 0) + 1, 224)) AS a FROM t WHERE k > 0) SELECT chunk_id AS key, CAST(a / 224 AS INTEGER) AS piece, CAST(a AS INTEGER) AS first_token, CAST(least(256, k - a) AS INTEGER) AS n_tokens FROM w")
def _(g):
    return documents.token_windows(g.raw("chunks").select("chunk_id", "text").distinct(), "chunk_id", "text").select("key", "piece", "first_token", "n_tokens")


@query("fn_timestamps", "SELECT id, created_at FROM n WHERE created_at IS NOT NULL")
def _(g):
    text = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return g.nodes.where("created_at is not null").select("id", schemas.timestamp(text).cast("timestamp_ntz").alias("created_at"))


@query("k6_collapsed_edges", "SELECT source_id, target_id, kind, min(id) AS id, arg_max(confidence, id) AS confidence FROM e GROUP BY source_id, target_id, kind")
def _(g):
    return mutate.collapse_edges(g.edges).select("source_id", "target_id", "kind", "id", "confidence")


@query("k3_machine_update", "SELECT id, CASE WHEN provenance = 'human_curated' THEN summary ELSE upper(summary) END AS summary, provenance FROM n")
def _(g):
    new = g.nodes.select("id", F.upper("summary").alias("summary"), "description", "confidence")
    return mutate.update_machine_content(g.nodes, new).select("id", "summary", "provenance")


@query("k8_delete_subdomain_edges", f"SELECT e.id FROM e WHERE source_id IS NULL OR source_id NOT IN (SELECT id FROM n WHERE (domain, subdomain) = (SELECT (domain, subdomain) FROM nodes WHERE label = 'Subdomain' ORDER BY id LIMIT 1) AND label IN {CONTENT})")
def _(g):
    one = g.raw("nodes").where("label = 'Subdomain'").agg(F.min_by(F.struct("domain", "subdomain"), "id").alias("d")).first()[0]
    return mutate.delete_by_subdomain(g.edges, g.nodes, one["domain"], one["subdomain"], content_only=True).select("id")


@query("k10_replace_semantic")
def _(g):
    one = g.raw("nodes").where("label = 'Subdomain'").agg(F.min_by(F.struct("domain", "subdomain"), "id").alias("d")).first()[0]
    new = g.edges.where("confidence >= 0.6").withColumn("id", F.lit(0).cast("long"))
    return mutate.replace_semantic(g.edges, new, g.nodes, one["domain"], one["subdomain"]).select("source_id", "target_id", "kind", "confidence", "provenance")


@query("k12_source_upsert", "WITH r AS (SELECT node_uuid, member_id, file_path, count(*) AS n, count(DISTINCT skill) AS k FROM node_sources GROUP BY 1, 2, 3) SELECT CAST(sum(n) AS BIGINT) AS attempted, count(*) AS kept, CAST(sum(n) - count(*) AS BIGINT) AS repeated, count(*) FILTER (WHERE k > 1) AS conflicting FROM r")
def _(g):
    return mutate.upsert_report(g.raw("node_sources"))


_GONE = "gone AS (SELECT DISTINCT file_path FROM s WHERE file_path LIKE '%/guides/%')"


@query("k23_delete_documents", f"""WITH {_GONE}, touched AS (SELECT DISTINCT node_uuid AS id FROM s WHERE file_path IN (SELECT * FROM gone)), left_ AS (SELECT * FROM s WHERE file_path NOT IN (SELECT * FROM gone)),
guarded AS (SELECT source_id AS id FROM e WHERE provenance = 'human_curated' UNION SELECT target_id FROM e WHERE provenance = 'human_curated')
SELECT n.id FROM n JOIN touched ON touched.id = n.id WHERE n.provenance <> 'human_curated' AND n.id NOT IN (SELECT node_uuid FROM left_) AND n.id NOT IN (SELECT id FROM guarded WHERE id IS NOT NULL)""")
def _(g):
    gone = g.sources.where("file_path like '%/guides/%'").select("file_path").distinct()
    return mutate.delete_documents(g.nodes, g.edges, g.sources, gone)["deleted"]


@query("k23_nodes_left", f"""WITH {_GONE}, touched AS (SELECT DISTINCT node_uuid AS id FROM s WHERE file_path IN (SELECT * FROM gone)), left_ AS (SELECT * FROM s WHERE file_path NOT IN (SELECT * FROM gone)),
guarded AS (SELECT source_id AS id FROM e WHERE provenance = 'human_curated' UNION SELECT target_id FROM e WHERE provenance = 'human_curated'),
dead AS (SELECT n.id FROM n JOIN touched ON touched.id = n.id WHERE n.provenance <> 'human_curated' AND n.id NOT IN (SELECT node_uuid FROM left_) AND n.id NOT IN (SELECT id FROM guarded WHERE id IS NOT NULL)),
refs AS (SELECT node_uuid AS id, string_agg(DISTINCT skill, ',' ORDER BY skill) AS refs FROM left_ WHERE skill <> '' GROUP BY node_uuid)
SELECT n.id, CASE WHEN n.id IN (SELECT id FROM touched) THEN refs.refs ELSE n.source_refs END AS source_refs FROM n LEFT JOIN refs ON refs.id = n.id WHERE n.id NOT IN (SELECT id FROM dead)""")
def _(g):
    gone = g.sources.where("file_path like '%/guides/%'").select("file_path").distinct()
    return mutate.delete_documents(g.nodes, g.edges, g.sources, gone)["nodes"].select("id", "source_refs")


@query("k26_move_documents", "SELECT node_uuid, member_id, replace(file_path, '/references/', '/refs/') AS file_path FROM s")
def _(g):
    moves = g.sources.where("file_path like '%/references/%'").select(F.col("file_path").alias("old_path"), F.replace("file_path", F.lit("/references/"), F.lit("/refs/")).alias("new_path")).distinct()
    return mutate.move_documents(g.sources, moves).select("node_uuid", "member_id", "file_path")


@query("c10_shared_nodes", "SELECT file_path, node_uuid, count(*) OVER (PARTITION BY node_uuid) >= 2 AS shared, file_path = min(file_path) OVER (PARTITION BY node_uuid) AS \"primary\" FROM (SELECT DISTINCT file_path, node_uuid FROM s)")
def _(g):
    return documents.shared_nodes(g.sources)


_MERGE = f"same AS (SELECT lower(name) AS set_id, id FROM n WHERE label IN {CONTENT} AND name <> ''), sets AS (SELECT set_id, id FROM same WHERE set_id IN (SELECT set_id FROM same GROUP BY set_id HAVING count(*) > 1)), m AS (SELECT node_uuid AS id, count(DISTINCT member_id) AS k FROM s GROUP BY 1), r AS (SELECT set_id, sets.id, first_value(sets.id) OVER (PARTITION BY set_id ORDER BY coalesce(k, 0) DESC, sets.id) AS survivor FROM sets LEFT JOIN m ON m.id = sets.id)"


def _same_names(g: Graph) -> DataFrame:
    named = graph.semantic_nodes(g.nodes).where("name <> ''").select(F.lower("name").alias("set_id"), "id")
    return named.join(named.groupBy("set_id").count().where("count > 1"), "set_id", "left_semi")


@query("c12_merge_lineage", f"WITH {_MERGE} SELECT survivor AS new_uuid, id AS old_uuid, 'merged' AS reason FROM r WHERE id <> survivor")
def _(g):
    return mutate.merge_nodes(g.nodes, g.edges, g.sources, _same_names(g))["lineage"]


@query("c12_merged_edges", f"WITH {_MERGE}, moved AS (SELECT id, survivor FROM r WHERE id <> survivor), mapped AS (SELECT coalesce(a.survivor, e.source_id) AS source_id, coalesce(b.survivor, e.target_id) AS target_id, kind, e.id, a.survivor IS NOT NULL OR b.survivor IS NOT NULL AS moved FROM e LEFT JOIN moved a ON a.id = e.source_id LEFT JOIN moved b ON b.id = e.target_id) SELECT source_id, target_id, kind, min(id) AS id FROM mapped WHERE NOT moved OR source_id <> target_id GROUP BY 1, 2, 3")
def _(g):
    return mutate.merge_nodes(g.nodes, g.edges, g.sources, _same_names(g))["edges"].select("source_id", "target_id", "kind", "id")


@query("c19_empty_subdomains", f"SELECT id FROM n WHERE label = 'Subdomain' AND (domain, subdomain) NOT IN (SELECT (domain, subdomain) FROM n WHERE label IN {CONTENT})")
def _(g):
    return mutate.empty_subdomains(g.nodes)


@query("k25_stale_provides", "SELECT e.id FROM e WHERE kind = 'provides' AND provenance <> 'human_curated' AND (source_id, target_id) NOT IN (SELECT DISTINCT ('skill::' || s.skill, 'domain::' || n.domain) FROM s JOIN n ON n.id = s.node_uuid WHERE s.skill <> '')")
def _(g):
    return mutate.stale_provides(g.edges, g.nodes, g.sources).select("id")
