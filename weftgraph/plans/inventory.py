"""Mutations, lineage, identity, building and measures over rows made from the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import fulltext, identity, text
from weftgraph.operators import build, evaluate, graph, mutate, resolve, search, temporal
from weftgraph.operators.recall import recall
from weftgraph.plans.knowledge import _BM25, _CATEGORY, _FOLD, _LATEST, _SCORES, _STARTS, _STRUCT_AS, SEARCH_FIELDS, TEXT_QUERIES, _entries, _latest_pair, _query_rows, node_index
from weftgraph.plans.registry import query
from weftgraph.plans.relational import CONTENT, HUB, PRIORITY, SEMANTIC, hub
from weftgraph.sources import documents
from weftgraph.sources.graph import Graph

TS = "TIMESTAMP '2026-01-01'"


def _none():
    return F.lit(None).cast("string")


def lineage(g: Graph) -> DataFrame:
    """The log of versions as lineage rows."""
    return g.changesets.where("parent_version <> ''").select(F.col("kb_version").alias("new_uuid"), F.col("parent_version").alias("old_uuid"), F.lit("merged").alias("reason"), F.col("ts").alias("created_at"))


_LINEAGE = "l AS (SELECT kb_version AS new_uuid, parent_version AS old_uuid, 'merged' AS reason, ts AS created_at FROM c WHERE parent_version <> '')"


def conflicts(g: Graph) -> DataFrame:
    return g.cross_references.select("id", F.col("target_entity").alias("entity_name"), F.col("source_entity").alias("conflicting_sources"), "kind", "resolution_status", F.col("reason").alias("resolution_note"), _none().alias("resolved_by"))


def members(g: Graph) -> DataFrame:
    """id and members of every node with sources."""
    return g.sources.groupBy(F.col("node_uuid").alias("id")).agg(F.array_sort(F.collect_set("member_id")).alias("members"))


_MEMBERS = "m AS (SELECT node_uuid AS id, list_sort(list_distinct(list(member_id))) AS members FROM s GROUP BY node_uuid)"
_CONCEPTS = "SELECT id FROM n WHERE label = 'Concept'"

def _uuid(name: str) -> str:
    digest = f"sha1(unhex('{identity.NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || substr('89ab', CAST('0x' || substr({digest}, 17, 1) AS INT) % 4 + 1, 1) || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12))"


# Scans


@query("s13_lineage", f"WITH {_LINEAGE} SELECT * FROM l")
def _(g):
    return temporal.lineage_rows(lineage(g))


@query("s17_unresolved_conflicts", "SELECT id, target_entity AS entity_name FROM x WHERE resolution_status = 'unresolved'")
def _(g):
    return resolve.unresolved_conflicts(conflicts(g)).select("id", "entity_name")


@query("s24_reference_files", "SELECT DISTINCT regexp_extract(file_path, '^(.*?)/(?:references|reference|docs|guides)/[^/]+(?:/[^/]+)*$', 1) AS skill, file_path AS path FROM s WHERE regexp_extract(file_path, '^(.*?)/(?:references|reference|docs|guides)/[^/]+(?:/[^/]+)*$', 1) <> ''")
def _(g):
    return documents.reference_files(g.sources, "file_path")


@query("s27_generation", "SELECT source_id, target_id, kind FROM e")
def _(g):
    """The edges as they are read back from a published generation."""
    from weftgraph.sources.tables import shared_dir
    from weftgraph.streaming.incremental import Generations

    import uuid

    gens = Generations(g.spark, f"{shared_dir(g.spark)}/generations-{uuid.uuid4().hex}")
    gens.publish(g.edges.select("source_id", "target_id", "kind"), 0)
    return gens.read()


@query("x2_file_states", "SELECT skill AS repo_url, file_path, max(indexed_at) AS indexed_at FROM documents WHERE skill IS NOT NULL AND file_path IS NOT NULL AND NOT (skill = 'shared-glossary' AND file_path = (SELECT min(file_path) FROM documents WHERE skill = 'shared-glossary')) GROUP BY ALL")
def _(g):
    states = g.raw("documents").where("skill is not null and file_path is not null").groupBy(F.col("skill").alias("repo_url"), "file_path").agg(F.max("indexed_at").alias("indexed_at"))
    first = states.where("repo_url = 'shared-glossary'").agg(F.min("file_path")).first()[0]
    return mutate.drop_states(states, "shared-glossary", first or "").orderBy("repo_url", "file_path")


@query("x3_identities", "SELECT DISTINCT skill AS repo_url, 'git:' || lower(skill) AS identity FROM documents WHERE skill IS NOT NULL")
def _(g):
    rows = g.raw("documents").where("skill is not null").select(F.col("skill").alias("repo_url"), F.concat(F.lit("git:"), F.lower("skill")).alias("identity")).distinct()
    return mutate.insert_identity(rows.where("repo_url < 'm'"), rows, ["repo_url"], "identity")


# Mutations


@query("k1_inserted_nodes", "SELECT id, name FROM n UNION ALL SELECT 'copy::' || id, name FROM n WHERE label = 'Concept'")
def _(g):
    return mutate.insert_nodes(g.nodes, g.nodes.where("label = 'Concept'").withColumn("id", F.concat(F.lit("copy::"), "id"))).select("id", "name")


@query("k2_updated_nodes", "SELECT id, CASE WHEN label = 'Concept' THEN 'new ' || name ELSE summary END AS summary, file_slug FROM n")
def _(g):
    new = g.nodes.where("label = 'Concept'").withColumns({"summary": F.concat(F.lit("new "), "name"), "file_slug": F.lit("ignored")})
    return mutate.update_nodes(g.nodes, new).select("id", "summary", "file_slug")


@query("k2_missing_ids", "SELECT DISTINCT target_id AS id FROM e WHERE target_id IS NOT NULL AND target_id NOT IN (SELECT id FROM n)")
def _(g):
    return mutate.missing_ids(g.nodes, g.edges.where("target_id is not null").select(F.col("target_id").alias("id")))


@query("k5_inserted_edges", "SELECT id, source_id, target_id, kind FROM e UNION ALL SELECT id + 1000000000, target_id, source_id, kind FROM e WHERE kind = 'contradicts'")
def _(g):
    new = g.edges.where("kind = 'contradicts'").select((F.col("id") + 1_000_000_000).alias("id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "kind")
    return mutate.insert_edges(g.edges, new).select("id", "source_id", "target_id", "kind")


@query("k7_edges_between", "SELECT id FROM e WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.kind = 'depends_on' AND d.confidence < 0.5 AND d.source_id = e.source_id AND d.target_id = e.target_id AND d.kind = e.kind)")
def _(g):
    return mutate.delete_between(g.edges, g.edges.where("kind = 'depends_on' and confidence < 0.5")).select("id")


@query("k8_subdomain_edges", "SELECT e.id FROM e WHERE source_id IS NULL OR source_id NOT IN (SELECT id FROM n WHERE (domain, subdomain) = (SELECT (domain, subdomain) FROM nodes WHERE label = 'Subdomain' ORDER BY id LIMIT 1))")
def _(g):
    one = g.raw("nodes").where("label = 'Subdomain'").agg(F.min_by(F.struct("domain", "subdomain"), "id").alias("d")).first()[0]
    return mutate.delete_by_subdomain(g.edges, g.nodes, one["domain"], one["subdomain"]).select("id")


@query("k11_edges_by_source", f"SELECT id FROM e WHERE source_id IS NULL OR source_id NOT IN ({_CONCEPTS})")
def _(g):
    return mutate.delete_by_endpoint(g.edges, g.nodes.where("label = 'Concept'"), "source_id").select("id")


@query("k15_valid_lineage", f"WITH {_LINEAGE}, r AS (SELECT new_uuid, old_uuid, reason FROM l UNION ALL SELECT old_uuid, old_uuid, 'merged' FROM l UNION ALL SELECT new_uuid, ' ', 'split' FROM l UNION ALL SELECT new_uuid, old_uuid || 'x', 'moved' FROM l UNION ALL SELECT new_uuid, old_uuid || 'y', 'split' FROM l) SELECT DISTINCT new_uuid, old_uuid, reason FROM r WHERE trim(new_uuid) <> '' AND trim(old_uuid) <> '' AND new_uuid <> old_uuid AND reason IN ('merged', 'split')")
def _(g):
    own = lineage(g).select("new_uuid", "old_uuid", "reason")
    variants = [own, own.withColumn("new_uuid", F.col("old_uuid")), own.withColumns({"old_uuid": F.lit(" "), "reason": F.lit("split")}), own.withColumns({"old_uuid": F.concat("old_uuid", F.lit("x")), "reason": F.lit("moved")}), own.withColumns({"old_uuid": F.concat("old_uuid", F.lit("y")), "reason": F.lit("split")})]
    rows = variants[0]
    for v in variants[1:]:
        rows = rows.unionByName(v)
    return mutate.valid_lineage(rows)


_LIKE = "r AS (SELECT CAST(id AS VARCHAR) AS id, target_entity FROM x UNION ALL SELECT 'within:' || id, substr(synonyms, 3, 9) FROM n WHERE length(synonyms) > 12 UNION ALL SELECT 'id:' || id, id FROM n WHERE label = 'Concept' UNION ALL SELECT 'wild:' || id, substr(synonyms, 1, 3) || '%' || substr(synonyms, 6, 4) FROM n WHERE length(synonyms) > 14)"


@query("k16_planted_references", f"WITH {_LIKE}, by_name AS (SELECT name, min(id) AS id FROM n WHERE name <> '' GROUP BY name), t AS (SELECT DISTINCT target_entity FROM r), syn AS (SELECT target_entity, min(n.id) AS id FROM t JOIN n ON n.synonyms <> '' AND lower(n.synonyms) LIKE '%' || lower(target_entity) || '%' WHERE target_entity <> '' GROUP BY 1) SELECT r.id, coalesce(a.id, b.id, syn.id) AS resolved_id, CASE WHEN coalesce(a.id, b.id, syn.id) IS NULL THEN 'external_kg' ELSE 'resolved' END AS resolution FROM r LEFT JOIN by_name a ON a.name = target_entity LEFT JOIN (SELECT DISTINCT id FROM n) b ON b.id = target_entity LEFT JOIN syn USING (target_entity)")
def _(g):
    """Cross references, and names that stand within the synonyms, are ids, or hold a wildcard."""
    refs = g.cross_references.select(F.col("id").cast("string").alias("id"), "target_entity")
    syn = F.col("synonyms")
    within = g.nodes.where("length(synonyms) > 12").select(F.concat(F.lit("within:"), "id").alias("id"), F.substring(syn, 3, 9).alias("target_entity"))
    ids = g.nodes.where("label = 'Concept'").select(F.concat(F.lit("id:"), "id").alias("id"), F.col("id").alias("target_entity"))
    wild = g.nodes.where("length(synonyms) > 14").select(F.concat(F.lit("wild:"), "id").alias("id"), F.concat(F.substring(syn, 1, 3), F.lit("%"), F.substring(syn, 6, 4)).alias("target_entity"))
    return resolve.resolve_references(refs.unionByName(within).unionByName(ids).unionByName(wild), g.nodes).select("id", "resolved_id", "resolution")


@query("k17_references_left", f"SELECT id FROM x WHERE target_entity IS NULL OR target_entity NOT IN (SELECT name FROM n WHERE label = 'Concept' AND name IS NOT NULL)")
def _(g):
    return mutate.delete_references(g.cross_references, g.nodes.where("label = 'Concept'").select(F.col("name").alias("target_entity"))).select("id")


@query("k18_decided_conflicts", "SELECT id, CASE WHEN kind = 'depends_on' THEN 'resolved' ELSE resolution_status END AS resolution_status, CASE WHEN kind = 'depends_on' THEN 'curator' END AS resolved_by FROM x")
def _(g):
    own = conflicts(g)
    decisions = own.where("kind = 'depends_on'").select("id", F.lit("resolved").alias("resolution_status"), F.lit("by rule").alias("resolution_note"), F.lit("curator").alias("resolved_by"))
    return mutate.resolve_conflicts(own, decisions).select("id", "resolution_status", "resolved_by")


@query("k18_missing_decisions", "SELECT DISTINCT -id AS id FROM x WHERE id > 0")
def _(g):
    own = conflicts(g)
    return mutate.missing_decisions(own, own.where("id > 0").select((-F.col("id")).alias("id")).unionByName(own.select("id")))


@query("k20_manifest", "WITH m AS (SELECT tool AS key, max(kb_version) AS value FROM c WHERE tool IS NOT NULL GROUP BY tool), u AS (SELECT tool AS key, CAST(count(*) AS VARCHAR) AS value FROM c WHERE tool = 'ingest' GROUP BY tool UNION ALL SELECT 'schema', '5') SELECT * FROM m WHERE key NOT IN (SELECT key FROM u) UNION ALL SELECT * FROM u")
def _(g):
    manifest = g.changesets.where("tool is not null").groupBy(F.col("tool").alias("key")).agg(F.max("kb_version").alias("value"))
    changes = g.changesets.where("tool = 'ingest'").groupBy(F.col("tool").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value")).unionByName(g.spark.createDataFrame([("schema", "5")], "key string, value string"))
    return mutate.set_manifest(manifest, changes)


@query("k21_version_stamps", "SELECT seq, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z' AS version FROM c WHERE ts IS NOT NULL")
def _(g):
    return g.changesets.where("ts is not null").select("seq", identity.rfc3339_nano(F.col("ts")).alias("version"))


_BATCH = """nn AS (SELECT id, upper(summary) AS summary FROM n WHERE label = 'Concept' AND domain IS NOT NULL), add_ AS (SELECT 'new::' || id AS id, domain FROM n WHERE label = 'Concept' AND domain IS NOT NULL),
every AS (SELECT n.id, n.domain, n.source_refs, CASE WHEN nn.id IS NOT NULL AND n.provenance <> 'human_curated' THEN nn.summary ELSE n.summary END AS summary FROM n LEFT JOIN nn ON nn.id = n.id UNION ALL SELECT id, domain, NULL, NULL FROM add_),
src AS (SELECT node_uuid, skill FROM s UNION ALL SELECT 'new::' || node_uuid, 'fresh' FROM s WHERE 'new::' || node_uuid IN (SELECT id FROM add_)),
touched AS (SELECT id FROM nn UNION SELECT id FROM add_ UNION SELECT node_uuid FROM src WHERE node_uuid LIKE 'new::%'),
own AS (SELECT node_uuid AS id, string_agg(DISTINCT skill, ',' ORDER BY skill) AS refs FROM src WHERE skill <> '' GROUP BY 1),
doms AS (SELECT DISTINCT domain FROM every WHERE id IN (SELECT id FROM touched) AND domain IS NOT NULL),
dref AS (SELECT doms.domain, string_agg(DISTINCT src.skill, ',' ORDER BY src.skill) AS refs FROM doms LEFT JOIN every ON every.domain = doms.domain LEFT JOIN src ON src.node_uuid = every.id AND src.skill <> '' GROUP BY 1)"""


@query("k30_incremental", f"WITH {_BATCH} SELECT every.id, every.summary, CASE WHEN every.id IN (SELECT 'domain::' || domain FROM doms) THEN coalesce((SELECT refs FROM dref WHERE 'domain::' || dref.domain = every.id), '') WHEN every.id IN (SELECT id FROM touched) THEN coalesce(own.refs, '') ELSE every.source_refs END AS source_refs FROM every LEFT JOIN own ON own.id = every.id")
def _(g):
    """Concepts get new summaries, and a new node beside each: contents, sources and provenance after one run."""
    concepts = g.nodes.where("label = 'Concept' and domain is not null")
    changed = concepts.withColumn("summary", F.upper("summary"))
    added = concepts.select(F.concat(F.lit("new::"), "id").alias("id"), "domain", *[F.lit(None).cast(g.nodes.schema[c].dataType).alias(c) for c in g.nodes.columns if c not in ("id", "domain")])
    new_sources = g.sources.join(concepts.select(F.col("id").alias("node_uuid")), "node_uuid", "left_semi").withColumns({"node_uuid": F.concat(F.lit("new::"), "node_uuid"), "skill": F.lit("fresh")})
    out = mutate.apply_batch(g.nodes, g.edges, g.sources, changed.unionByName(added.select(*changed.columns)), g.edges.limit(0), new_sources)
    return out["nodes"].select("id", "summary", "source_refs")


@query("k31_provides_left", f"WITH t AS ({_CONCEPTS}), doms AS (SELECT DISTINCT 'domain::' || domain AS id FROM n WHERE id IN (SELECT id FROM t) AND domain IS NOT NULL) SELECT id FROM e WHERE NOT (coalesce(kind = 'provides' AND provenance <> 'human_curated' AND target_id IN (SELECT id FROM doms), false) AND NOT EXISTS (SELECT 1 FROM s JOIN n ON n.id = s.node_uuid WHERE s.skill <> '' AND 'skill::' || s.skill = e.source_id AND 'domain::' || n.domain = e.target_id))")
def _(g):
    return mutate.sync_provenance(g.nodes, g.edges, g.sources, g.nodes.where("label = 'Concept'").select("id"))[1].select("id")


_WIDE = ", ".join(f"CAST(count(*) FILTER (WHERE category = '{c}') AS BIGINT) AS n_{c}" for c in temporal.CATEGORIES)
_EDGES = "eo AS (SELECT DISTINCT source_id, target_id, kind FROM e WHERE created_at < TIMESTAMP '2026-01-01' OR kind = 'contradicts'), ew AS (SELECT DISTINCT source_id, target_id, kind FROM e WHERE kind <> 'contradicts')"


def _edge_versions(g: Graph) -> tuple[DataFrame, DataFrame]:
    return g.edges.where("created_at < timestamp_ntz'2026-01-01' or kind = 'contradicts'"), g.edges.where("kind <> 'contradicts'")


@query("k33_changeset", _STRUCT_AS + f", {_LATEST[0:0]}" + (_LATEST + f", {_EDGES}, d AS (SELECT coalesce(o.id, w.id) AS id, {_CATEGORY} AS category FROM o FULL JOIN w ON o.id = w.id), docs AS (SELECT DISTINCT file_path FROM s WHERE node_uuid IN (SELECT id FROM d WHERE category NOT IN ('unchanged', 'deleted')) AND file_path <> '' ORDER BY file_path LIMIT 200) SELECT 'v2' AS kb_version, 'v1' AS parent_version, {_WIDE}, (SELECT count(*) FROM (SELECT * FROM ew EXCEPT SELECT * FROM eo)) AS n_edge_added, (SELECT count(*) FROM (SELECT * FROM eo EXCEPT SELECT * FROM ew)) AS n_edge_dropped, (SELECT count(*) FROM docs) AS docs_affected, (SELECT node_count FROM structure_) AS node_count, (SELECT edge_count FROM structure_) AS edge_count FROM d"))
def _(g):
    """The newest pair of snapshots, with the edges of two moments, recorded as one changeset with its sample of measures."""
    changes = temporal.diff_nodes(*_latest_pair(g))
    measures = graph.structure(g.nodes, g.edges).select("node_count", "edge_count")
    return temporal.record("v2", "v1", changes, temporal.diff_edges(*_edge_versions(g)), g.sources, measures)


@query("u1_edges_both_ways", f"WITH {_EDGES} SELECT *, 'edge_added' AS change FROM (SELECT * FROM ew EXCEPT SELECT * FROM eo) UNION ALL SELECT *, 'edge_dropped' FROM (SELECT * FROM eo EXCEPT SELECT * FROM ew)")
def _(g):
    return temporal.diff_edges(*_edge_versions(g))


@query("l7_metric_sample", _STRUCT_AS + ", v AS (SELECT arg_max(kb_version, seq) AS version FROM c) SELECT v.version, node_count, edge_count, singleton_count, subdomain_count, modularity_q FROM structure_, v")
def _(g):
    version = g.changesets.agg(F.max_by("kb_version", "seq").alias("version"))
    return graph.structure(g.nodes, g.edges).join(F.broadcast(version), F.lit(True)).select("version", "node_count", "edge_count", "singleton_count", "subdomain_count", "modularity_q")


# Documents


_BODY = "'# ' || name || CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || summary ELSE '' END"
_BLOCK = f"'<!-- kg:uuid=' || id || ' -->' || chr(10) || {_BODY} || chr(10) || '<!-- /kg -->'"
_VIEWS = f"v AS (SELECT DISTINCT s.file_path, n.id, {_BODY} AS body, {_BLOCK} AS block FROM s JOIN n ON n.id = s.node_uuid WHERE s.file_path <> '' AND n.name IS NOT NULL)"


@query("k36_rendered", f"WITH {_VIEWS} SELECT file_path, string_agg(block, chr(10) || chr(10) ORDER BY id) AS text FROM v GROUP BY file_path")
def _(g):
    return documents.render_blocks(g.nodes, g.sources)


def _parsed(g: Graph) -> DataFrame:
    return documents.blocks(documents.render_blocks(g.nodes, g.sources), "file_path", "text")


@query("c1_blocks", f"WITH {_VIEWS} SELECT file_path AS path, 'block' AS kind, id AS uuid, body FROM v WHERE regexp_full_match(id, '[0-9a-f-]+')")
def _(g):
    """Documents rendered and read again: each node's block with its body."""
    return _parsed(g).where("kind = 'block'").select("path", "kind", "uuid", "body")


@query("c5_baseline", f"WITH {_VIEWS} SELECT file_path AS path, id AS uuid, sha256(regexp_replace(regexp_replace(body, '[ \\t\\r]+(\\n|$)', '\\1', 'g'), '\\n+$', '')) AS editable_hash FROM v WHERE regexp_full_match(id, '[0-9a-f-]+')")
def _(g):
    return documents.sidecar(_parsed(g))


_EDITED = f"{_VIEWS}, b AS (SELECT * FROM v WHERE regexp_full_match(id, '[0-9a-f-]+')), k AS (SELECT id, label, provenance FROM n), r AS (SELECT file_path AS path, b.id AS uuid, CASE WHEN label = 'Concept' AND provenance = 'human_curated' THEN 'C2' WHEN label = 'Concept' THEN 'C1' END AS change FROM b JOIN k ON k.id = b.id UNION ALL SELECT DISTINCT file_path, NULL, 'C4' FROM b)"


def _edits(g: Graph) -> DataFrame:
    """Concepts edited in every document, those of humans taken out, and a line of text added to each document."""
    baseline, parsed = documents.sidecar(_parsed(g)), _parsed(g).where("kind = 'block'")
    which = g.nodes.where("label = 'Concept'").select(F.col("id").alias("uuid"), F.when(F.col("provenance") == "human_curated", "gone").otherwise("edited").alias("what"))
    now = parsed.join(which, "uuid", "left").where("what is null or what <> 'gone'").withColumn("body", F.when(F.col("what") == "edited", F.concat("body", F.lit(" more"))).otherwise(F.col("body"))).select(*parsed.columns)
    outside = parsed.select("path").distinct().select("path", F.lit("outside").alias("kind"), _none().alias("uuid"), F.lit(1).alias("first_line"), F.lit(1).alias("last_line"), F.lit("new text").alias("body"))
    return documents.classify_edits(now.unionByName(outside), baseline)


@query("c2_edits", f"WITH {_EDITED} SELECT path, uuid, change FROM r WHERE change IS NOT NULL")
def _(g):
    return _edits(g)


@query("c4_dispatched", f"WITH {_EDITED} SELECT change, CASE WHEN change IN ('C1', 'C2') THEN 'bypass' ELSE 'pipeline' END AS plan, count(*) AS n FROM r WHERE change IS NOT NULL GROUP BY ALL")
def _(g):
    return documents.dispatch(_edits(g)).groupBy("change", "plan").agg(F.count(F.lit(1)).alias("n"))


@query("c3_rebound", f"WITH {_VIEWS} SELECT DISTINCT file_path AS path, id AS old_uuid, substr(id, 1, 35) || '0' AS new_uuid FROM v JOIN n USING (id) WHERE regexp_full_match(id, '[0-9a-f-]{{36}}') AND label = 'Concept' AND right(id, 1) <> '0' AND NOT EXISTS (SELECT 1 FROM v o WHERE o.file_path = v.file_path AND o.id <> v.id AND o.body = v.body)")
def _(g):
    """Concepts whose blocks stand under another id; bodies that come twice in a document are left out on both sides."""
    parsed = _parsed(g).where("kind = 'block'")
    concepts = g.nodes.where("label = 'Concept' and length(id) = 36 and right(id, 1) <> '0'").select(F.col("id").alias("uuid"), F.lit(True).alias("_c"))
    once = parsed.groupBy("path", "body").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("path", "body")
    own = parsed.join(once, ["path", "body"], "left_semi")
    now = own.join(concepts, "uuid", "left").withColumn("uuid", F.when(F.col("_c"), F.concat(F.substring("uuid", 1, 35), F.lit("0"))).otherwise(F.col("uuid"))).select(*parsed.columns)
    return documents.rebound(now, documents.sidecar(own))


@query("c7_moves", f"WITH {_VIEWS}, b AS (SELECT file_path, id, block FROM v WHERE regexp_full_match(id, '[0-9a-f-]+')), sets AS (SELECT file_path, string_agg(id, ',' ORDER BY id) AS ids FROM b GROUP BY 1), gone AS (SELECT * FROM sets WHERE file_path LIKE '%/references/%'), n2 AS (SELECT a.file_path AS old_path, replace(b.file_path, '/references/', '/moved/') AS new_path, count(*) OVER (PARTITION BY a.file_path) AS k, a.file_path = b.file_path AS same FROM gone a JOIN gone b USING (ids)) SELECT old_path, new_path, CASE WHEN k = 1 THEN 'move' ELSE 'ambiguous' END AS state FROM n2")
def _(g):
    """Documents of a folder that was renamed: a move where one new document has the same blocks."""
    baseline = documents.sidecar(_parsed(g))
    present = baseline.withColumn("path", F.replace("path", F.lit("/references/"), F.lit("/moved/")))
    return documents.planned_moves(baseline, present)


@query("f_safe_sources", r"""SELECT node_uuid, member_id, file_path FROM s WHERE file_path <> '' AND NOT regexp_matches(file_path, '[\\:%\x00-\x1f]|^/|^\s|\s$|(^|/)\.{1,2}(/|$)|//')""")
def _(g):
    return g.sources.where(documents.safe_path(F.col("file_path"))).select("node_uuid", "member_id", "file_path")


@query("x1_changed_files", "SELECT file_path, max(CASE WHEN indexed_at >= TIMESTAMP '2026-01-01' THEN 1 ELSE 0 END) = 1 OR md5(file_path) < '8' AS changed FROM documents WHERE file_path IS NOT NULL AND indexed_at IS NOT NULL GROUP BY file_path")
def _(g):
    rows = g.raw("documents").where("file_path is not null and indexed_at is not null").groupBy("file_path").agg(F.max("indexed_at").alias("t"))
    url, digest = F.lit("repo").alias("repo_url"), F.md5("file_path")
    now = rows.select(url, "file_path", digest.alias("content_hash"))
    old = rows.where("t < timestamp_ntz'2026-01-01'").select(url, "file_path", F.when(digest < "8", F.lit("older")).otherwise(digest).alias("content_hash"))
    return mutate.changed_files(old, now).select("file_path", "changed")


# Structural operations


@query("c14_composes", f"WITH t AS (SELECT id, domain FROM n WHERE label IN {CONTENT} AND confidence < 0.5 AND domain IS NOT NULL), r AS (SELECT CASE WHEN e.kind = 'composes' AND e.source_id LIKE 'subdomain::%' AND e.provenance <> 'human_curated' AND t.id IS NOT NULL THEN 'subdomain::' || t.domain || '::low' ELSE e.source_id END AS source_id, target_id, kind, e.id FROM e LEFT JOIN t ON t.id = e.target_id) SELECT source_id, target_id, kind, min(id) AS id FROM r GROUP BY ALL")
def _(g):
    low = graph.semantic_nodes(g.nodes).where("confidence < 0.5 and domain is not null").select("id", F.col("domain").alias("to_domain"), F.lit("low").alias("to_subdomain"))
    return mutate.swap_composes(g.edges, g.nodes, low).select("source_id", "target_id", "kind", "id")


@query("c16_split_subdomains", f"SELECT id, CASE WHEN label IN {CONTENT} AND name < 'M' THEN subdomain || '-a' ELSE subdomain END AS subdomain FROM n")
def _(g):
    half = graph.semantic_nodes(g.nodes).where("name < 'M'").select("id", F.col("domain").alias("to_domain"), F.concat("subdomain", F.lit("-a")).alias("to_subdomain"))
    return mutate.reassign_nodes(g.nodes, half).select("id", "subdomain")


@query("c17_promoted", f"WITH one AS (SELECT id, domain, subdomain, left(name, 1) AS community FROM n WHERE label = 'Entity' AND name <> '' AND subdomain IS NOT NULL ORDER BY id LIMIT 1) SELECT n.id, CASE WHEN n.label IN {CONTENT} AND n.name <> '' AND left(n.name, 1) = one.community AND n.domain = one.domain AND n.subdomain = one.subdomain THEN 'promoted' ELSE n.subdomain END AS subdomain FROM n, one")
def _(g):
    communities = graph.semantic_nodes(g.nodes).where("name <> ''").select("id", F.substring("name", 1, 1).alias("community"))
    first = g.nodes.where("label = 'Entity' and name <> '' and subdomain is not null").agg(F.min("id")).first()[0]
    return build.promote(g.nodes, communities, first or "", "promoted").select("id", "subdomain")


@query("c18_renamed", "SELECT id, CASE WHEN label = 'Concept' AND confidence >= 0.5 THEN 'renamed ' || id ELSE name END AS name FROM n")
def _(g):
    names = g.nodes.where("label = 'Concept'").select("id", F.when(F.col("confidence") >= 0.5, F.concat(F.lit("renamed "), "id")).otherwise(F.lit(" ")).alias("name"))
    return mutate.rename_nodes(g.nodes, names).select("id", "name")


@query("c13_split_check", f"WITH {_MEMBERS}, p AS (SELECT m.id, members FROM m JOIN n ON n.id = m.id WHERE label IN {CONTENT} AND len(members) > 1) SELECT {_uuid('members[1]')} AS new_uuid, id AS old_uuid, 'split' AS reason FROM p UNION ALL SELECT {_uuid(chr(39) + chr(39) + ' || array_to_string(members[2:], ' + chr(39) + ',' + chr(39) + ')')}, id, 'split' FROM p")
def _(g):
    """Every node with at least two members, split into its first member and the others."""
    own = members(g).join(graph.semantic_nodes(g.nodes).select("id"), "id", "left_semi").where("size(members) > 1")
    parts = own.select("id", F.explode(F.array(F.struct(F.lit("a").alias("name"), F.slice("members", 1, 1).alias("members")), F.struct(F.lit("b").alias("name"), F.slice(F.col("members"), F.lit(2), F.size("members") - 1).alias("members")))).alias("p")).select("id", "p.name", "p.members")
    return mutate.split_nodes(g.nodes, g.sources, parts, identity.node_uuid(F.col("members")))["lineage"]


@query("u7_inexact_parts", f"WITH {_MEMBERS} SELECT m.id FROM m WHERE len(members) >= 3")
def _(g):
    """Splits that leave a member out, of nodes with three or more: all are rejected."""
    own = members(g).where("size(members) >= 3")
    parts = own.select("id", F.explode(F.array(F.struct(F.lit("a").alias("name"), F.slice("members", 1, 1).alias("members")), F.struct(F.lit("b").alias("name"), F.slice("members", 2, 1).alias("members")))).alias("p")).select("id", "p.name", "p.members")
    return mutate.split_nodes(g.nodes, g.sources, parts, identity.node_uuid(F.col("members")))["rejected"]


_PATCH = f"WITH {_MEMBERS}, p AS (SELECT n.id, n.label, n.name, len(m.members) AS k FROM n JOIN m ON m.id = n.id)"


@query("c11_patch_violations", _PATCH + " SELECT 'merge:' || id AS pos, 'fewer than two nodes' AS rule FROM p UNION ALL SELECT 'lost:' || id, 'unknown node' FROM p UNION ALL SELECT 'odd:' || id, 'unknown operation' FROM p UNION ALL SELECT 'rename:' || id, 'no name' FROM p UNION ALL SELECT 'split:' || id, 'parts are no partition' FROM p WHERE k >= 2")
def _(g):
    """Operations with one fault each, and as many without any."""
    own = g.nodes.select("id").join(members(g), "id")
    empty = F.array().cast("array<string>")
    parts = lambda *m: F.array(*[F.struct(F.lit("x").alias("name"), a.alias("members")) for a in m])
    first, rest = F.slice("members", 1, 1), F.slice(F.col("members"), F.lit(2), F.size("members"))

    def op(tag, kind, ids=empty, node="id", name="x", split=None):
        return own.select(F.concat(F.lit(f"{tag}:"), "id").alias("pos"), F.lit(kind).alias("op"), ids.alias("members"), F.lit(name).alias("name"), (F.col("id") if node == "id" else F.lit(node)).alias("node"), (split if split is not None else parts(empty)).alias("parts"))

    ops = [op("merge", "merge_nodes", F.array("id", "id")), op("lost", "remigrate_node", node="nowhere"), op("odd", "explode_node"), op("rename", "rename", name=" "), op("split", "split_node", split=parts(first)), op("good", "split_node", split=parts(first, rest)), op("fine", "rename")]
    rows = ops[0]
    for o in ops[1:]:
        rows = rows.unionByName(o)
    return build.validate_patch(rows, g.nodes, g.sources).where("not (pos like 'split:%' and rule <> 'parts are no partition')")


@query("x18_recomputed", f"WITH sc AS (SELECT DISTINCT domain, subdomain FROM n WHERE label = 'Concept' AND subdomain IS NOT NULL AND domain IS NOT NULL), own AS (SELECT DISTINCT id FROM n WHERE label IN {CONTENT} AND (domain, subdomain) IN (SELECT (domain, subdomain) FROM sc)), ins AS (SELECT * FROM e WHERE source_id IN (SELECT id FROM own)), old AS (SELECT source_id, target_id, kind, min(id) AS id, arg_max(confidence, id) AS confidence FROM ins WHERE provenance <> 'human_curated' AND kind <> 'provides' GROUP BY ALL), sel AS (SELECT source_id, target_id, 'triggers' AS kind, max(confidence) AS c FROM ins WHERE kind IN ('references', 'triggers') AND source_id <> target_id GROUP BY ALL), w AS (SELECT * FROM sel WHERE (source_id, target_id, kind) NOT IN (SELECT (source_id, target_id, kind) FROM ins WHERE provenance = 'human_curated')) SELECT source_id, target_id, kind, confidence FROM e WHERE source_id IS NULL OR source_id NOT IN (SELECT id FROM own) UNION ALL SELECT source_id, target_id, kind, confidence FROM ins WHERE NOT coalesce(provenance <> 'human_curated' AND kind <> 'provides', false) UNION ALL SELECT w.source_id, w.target_id, w.kind, coalesce(old.confidence, CASE WHEN c BETWEEN 0 AND 1 THEN c ELSE 0.8 END) FROM w LEFT JOIN old USING (source_id, target_id, kind)")
def _(g):
    scope = g.nodes.where("label = 'Concept' and subdomain is not null and domain is not null").select("domain", "subdomain").distinct()
    selected = g.edges.where("kind in ('references', 'triggers')").withColumn("kind", F.lit("triggers"))
    return mutate.recomputed_relations(g.edges, selected, g.nodes, scope).select("source_id", "target_id", "kind", "confidence")


@query("x19_touched", f"SELECT id FROM n WHERE label = 'Concept' UNION SELECT node_uuid FROM s WHERE start_line > 50 AND node_uuid IS NOT NULL UNION SELECT source_id FROM e WHERE created_at >= {TS} AND source_id IS NOT NULL UNION SELECT target_id FROM e WHERE created_at >= {TS} AND target_id IS NOT NULL")
def _(g):
    late = g.edges.where("created_at >= timestamp_ntz'2026-01-01'")
    return mutate.touched_nodes(g.nodes.where("label = 'Concept'"), g.sources.where("start_line > 50").select(F.col("node_uuid").alias("id")), late.select(F.col("source_id").alias("id")), late.select(F.col("target_id").alias("id")))


# Search and graph

_HYBRID = f"""top AS (SELECT qid, id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS place FROM hits),
st10 AS (SELECT qid, id, place, CASE WHEN max(-rank) OVER (PARTITION BY qid) > 0 THEN -rank / max(-rank) OVER (PARTITION BY qid) ELSE 1.0 END AS text FROM top WHERE place <= 10),
walk AS (SELECT qid, id, 0 AS depth FROM st10 UNION SELECT qid, e.target_id, depth + 1 FROM walk JOIN e ON e.source_id = walk.id WHERE depth < 2 AND confidence >= 0 AND e.target_id IN (SELECT id FROM n)),
found AS (SELECT qid, id, min(depth) AS depth FROM walk GROUP BY qid, id),
scored_ AS (SELECT found.qid, found.id, found.depth, round(0.6 * coalesce(st10.text, 0) + 0.4 / greatest(found.depth, 1), 9) AS score FROM found LEFT JOIN st10 ON st10.qid = found.qid AND st10.id = found.id)"""
_EVERY = 1_000_000_000


@query("o2_hybrid_whole", f"{_BM25}, {_HYBRID} SELECT qid, CAST(place AS INTEGER) AS place, id, score, CAST(depth AS INTEGER) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM scored_) WHERE place <= 10", recursive=True)
def _(g):
    """The search by text and graph where the traversal may reach everything within its depth."""
    hits = node_index(g).score(search.query_frame(g.spark, TEXT_QUERIES))
    return search.hybrid(g.nodes, g.edges, hits, reach=_EVERY)


@query("g2_impact_whole", f"{_BM25}, top AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS place FROM hits), walk AS (SELECT qid, id, 0 AS depth FROM top WHERE place <= 3 UNION SELECT qid, e.target_id, depth + 1 FROM walk JOIN e ON e.source_id = walk.id WHERE depth < 5 AND confidence >= 0.3 AND e.target_id IN (SELECT id FROM n)) SELECT qid, id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY qid, id", recursive=True)
def _(g):
    """What depends on the three best hits, to the greatest depth, without a bound on nodes."""
    hits = node_index(g).score(search.query_frame(g.spark, TEXT_QUERIES))
    return search.impact(g.nodes, g.edges, hits, 9, 0.3, reach=_EVERY)


@query("f19_ablation", f"{_BM25}, {_HYBRID}, best AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM scored_) WHERE place <= 10) SELECT qid, count(*) FILTER (WHERE st10.id IS NOT NULL) AS n_text, count(*) FILTER (WHERE st10.id IS NULL) AS n_graph_only FROM best LEFT JOIN st10 USING (qid, id) GROUP BY qid", recursive=True)
def _(g):
    """For each query how many results text alone gives, and how many only the graph adds."""
    hits = node_index(g).score(search.query_frame(g.spark, TEXT_QUERIES))
    best = search.hybrid(g.nodes, g.edges, hits, reach=_EVERY)
    plain = search.top_k(hits, 10).select("qid", "id", F.lit(True).alias("_text"))
    return best.join(plain, ["qid", "id"], "left").groupBy("qid").agg(F.count_if(F.col("_text")).alias("n_text"), F.count_if(F.col("_text").isNull()).alias("n_graph_only"))


def _label_hits(label: str, tag: str) -> str:
    fields = " UNION ALL ".join(f"SELECT id, {k} AS col, {_FOLD.format(c)} AS w FROM n WHERE label = '{label}'" for k, c in enumerate(SEARCH_FIELDS))
    body = f"tok AS ({fields}), post AS (SELECT id, col, unnest(w) AS term, unnest(range(len(w))) AS pos FROM tok), lens AS (SELECT id, sum(len(w)) AS size FROM tok GROUP BY id), {_SCORES}"
    return f"(WITH {body}, hits AS (SELECT scored.* FROM scored JOIN (SELECT qid, count(DISTINCT atom) AS need FROM q GROUP BY qid) USING (qid) WHERE atoms = need), t AS (SELECT qid, id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS place FROM hits) SELECT '{tag}' AS kb, qid, id, round(CASE WHEN max(-rank) OVER (PARTITION BY qid) > 0 THEN -rank / max(-rank) OVER (PARTITION BY qid) ELSE 1.0 END, 9) AS score FROM t WHERE place <= 10)"


@query("o5_federated", f"WITH q(qid, atom, k, j, term) AS (VALUES {_query_rows()}), parts AS (SELECT * FROM {_label_hits('Entity', 'entities')} UNION ALL SELECT * FROM {_label_hits('Concept', 'concepts')}) SELECT kb, qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id, kb) AS place FROM parts) WHERE place <= 10")
def _(g):
    """Two graphs searched alone, their hits as one list."""
    parts = {}
    for kb, label in (("entities", "Entity"), ("concepts", "Concept")):
        hits = search.Index(g.nodes.where(F.col("label") == label), "id", SEARCH_FIELDS).score(search.query_frame(g.spark, TEXT_QUERIES))
        parts[kb] = search.strengths(search.top_k(hits, 10)).select("qid", "id", F.round("text", 9).alias("score"))
    return search.federate(parts).select("kb", "qid", "id", F.round("score", 6).alias("score"))


_CHUNK_Q = f"unit AS (SELECT DISTINCT result_id AS qid, {_FOLD.format('question')} AS w FROM results WHERE result_id % 20 = 0), q AS (SELECT DISTINCT qid, term, term AS atom, 1 AS k, 0 AS j FROM (SELECT qid, unnest(w) AS term FROM unit))"


@query("f15_chunks", f"WITH own AS (SELECT DISTINCT chunk_id AS id, text FROM chunks WHERE chunk_id IS NOT NULL), tok AS (SELECT id, 0 AS col, {_FOLD.format('text')} AS w FROM own), post AS (SELECT id, col, unnest(w) AS term, unnest(range(len(w))) AS pos FROM tok), lens AS (SELECT id, sum(len(w)) AS size FROM tok GROUP BY id), {_CHUNK_Q}, {_SCORES} SELECT qid, id, CAST(place AS INTEGER) AS place FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS place FROM scored) WHERE place <= 10")
def _(g):
    """Every question whose row's id is divisible by 20 recalls its ten best chunks from all."""
    asked = g.raw("results").where("result_id % 20 = 0").select(F.col("result_id").alias("qid"), F.col("question").alias("text"))
    return recall(g.raw("chunks"), "chunk_id", ["text"], asked, 10)


@query("f17_char_windows", "WITH t AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE length(text) > 0), p AS (SELECT chunk_id, text, unnest(range(0, greatest(length(text) - 1 - CASE WHEN length(text) > 1800 THEN 200 ELSE length(text) END, 0) + 1, 1600)) AS a FROM t), w AS (SELECT chunk_id || '#' || a AS id, lower(substr(text, CAST(a + 1 AS INT), 1800)) AS t FROM p), r AS (SELECT id, CAST(contains(t, 'ledger') AS INT) + CAST(contains(t, 'quota') AS INT) AS matched, round(((length(t) - length(replace(t, 'ledger', ''))) / 6 + (length(t) - length(replace(t, 'quota', ''))) / 5) / length(t), 9) AS density FROM w) SELECT id, matched, density FROM r WHERE matched > 0 ORDER BY matched DESC, density DESC, id LIMIT 20")
def _(g):
    windows = documents.char_chunks(g.raw("chunks").select("chunk_id", "text").distinct(), "chunk_id", "text")
    return search.lexical(windows.withColumn("id", F.concat_ws("#", "key", "start_char")), "id", "text", ["ledger", "quota"], 20)


@query("g6_subgraph", f"WITH starts AS {_STARTS}, out_ AS (SELECT starts.qid, e.id AS edge_id, e.target_id FROM e JOIN starts ON e.source_id = starts.id WHERE confidence >= 0.3 AND target_id <> source_id AND target_id IN (SELECT id FROM n)) SELECT qid, 'entity' AS part, id, 0 AS hop FROM starts UNION ALL SELECT DISTINCT qid, 'entity', target_id, 1 FROM out_ UNION ALL SELECT qid, 'relation', CAST(edge_id AS VARCHAR), 1 FROM out_")
def _(g):
    """The neighbourhoods of the starts as parts with their hop."""
    found, reported = graph.bfs(g.nodes, g.edges, _entries(g), 1, 0.3, limit=_EVERY)
    return graph.subgraph(found, reported).select("qid", "part", "id", "hop")


@query("g10_components", f"WITH own AS (SELECT DISTINCT id FROM n WHERE label IN {CONTENT}), sem AS (SELECT DISTINCT source_id AS a, target_id AS b FROM e WHERE kind = 'contradicts' AND source_id <> target_id AND source_id IN (SELECT id FROM own) AND target_id IN (SELECT id FROM own)), both_ways AS (SELECT a, b FROM sem UNION SELECT b, a FROM sem), reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a) SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a", recursive=True)
def _(g):
    """Each node with the component it belongs to, by contradictions alone (so that SQL can follow)."""
    return graph.connected_components(graph.semantic_edges(g.nodes, g.edges).where("kind = 'contradicts'"), "source_id", "target_id")


@query("g13_codec", "WITH d AS (SELECT DISTINCT domain || '::' || subdomain || '::' || name AS id, domain, subdomain, name FROM n WHERE name IS NOT NULL AND subdomain IS NOT NULL AND domain IS NOT NULL AND NOT contains(name, '::')) SELECT id, domain, subdomain, name FROM d")
def _(g):
    rows = g.nodes.where("name is not null and subdomain is not null and domain is not null and not contains(name, '::')").select(graph.node_id("domain", "subdomain", "name").alias("id")).distinct()
    return rows.select("id", *graph.node_parts("id"))


# Time


_GONE = f"{_LATEST}, d0 AS (SELECT coalesce(o.id, w.id) AS id, {_CATEGORY} AS category FROM o FULL JOIN w ON o.id = w.id), first_ AS (SELECT min(id) AS id, max(id) AS last FROM d0 WHERE category <> 'deleted'), lin AS (SELECT d0.id AS old_uuid, first_.id AS new_uuid FROM d0, first_ WHERE category = 'deleted' UNION SELECT d0.id, first_.last FROM d0, first_ WHERE category = 'deleted' AND right(d0.id, 1) < '8'), ends AS (SELECT old_uuid AS id, count(DISTINCT new_uuid) AS k FROM lin GROUP BY 1), d AS (SELECT d0.id, CASE WHEN k = 1 THEN 'merged_into' WHEN k > 1 THEN 'split_into' ELSE category END AS category FROM d0 LEFT JOIN ends ON ends.id = d0.id WHERE NOT (category = 'added' AND d0.id IN (SELECT new_uuid FROM lin)))"


def _diff_with_lineage(g: Graph) -> DataFrame:
    """The newest pair of snapshots where gone nodes live on in the first, and half of them in the last node that is there too."""
    old, new = _latest_pair(g)
    plain = temporal.diff_nodes(old, new)
    ends = plain.where("category <> 'deleted'").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    gone = plain.where("category = 'deleted'").select("id").join(F.broadcast(ends), F.lit(True))
    rows = gone.select(F.col("id").alias("old_uuid"), F.col("first").alias("new_uuid")).unionByName(gone.where("right(id, 1) < '8'").select(F.col("id").alias("old_uuid"), F.col("last").alias("new_uuid"))).distinct()
    return temporal.diff_nodes(old, new, rows)


@query("l5_gone_nodes", f"WITH {_GONE} SELECT id, category FROM d")
def _(g):
    return _diff_with_lineage(g).select("id", "category")


_RANK = " ".join(f"WHEN '{c}' THEN {k + 1}" for k, c in enumerate(temporal.CATEGORIES))


@query("l6_listed", f"WITH {_LATEST}, d AS (SELECT coalesce(o.id, w.id) AS id, {_CATEGORY} AS category FROM o FULL JOIN w ON o.id = w.id) SELECT CAST(CASE category {_RANK} END AS INTEGER) AS ord, id, category FROM d WHERE category <> 'unchanged'")
def _(g):
    return temporal.listed(temporal.diff_nodes(*_latest_pair(g))).select("ord", "id", "category")


@query("l10_lineage_of", f"WITH RECURSIVE_ {_LINEAGE}, ids AS (SELECT DISTINCT kb_version AS id FROM c WHERE kb_version IS NOT NULL), walk AS (SELECT id, id AS cur FROM ids UNION SELECT walk.id, l.new_uuid FROM walk JOIN l ON l.old_uuid = walk.cur), t AS (SELECT id, string_agg(DISTINCT cur, ',' ORDER BY cur) AS terminals FROM walk WHERE cur <> id AND cur NOT IN (SELECT old_uuid FROM l) GROUP BY id), p AS (SELECT new_uuid AS id, string_agg(DISTINCT old_uuid, ',' ORDER BY old_uuid) AS v FROM l GROUP BY 1), a AS (SELECT old_uuid AS id, string_agg(DISTINCT new_uuid, ',' ORDER BY new_uuid) AS v FROM l GROUP BY 1) SELECT ids.id, coalesce(p.v, '') AS predecessors, coalesce(a.v, '') AS successors, coalesce(t.terminals, '') AS terminals FROM ids LEFT JOIN p USING (id) LEFT JOIN a USING (id) LEFT JOIN t USING (id)".replace("RECURSIVE_ ", ""), recursive=True)
def _(g):
    found = temporal.why(g.changesets.where("kb_version is not null").select(F.col("kb_version").alias("id")), lineage(g))
    return found.select("id", *[F.array_join(c, ",").alias(c) for c in ("predecessors", "successors", "terminals")])


# Resolution and building


@query("e4_node_uuids", f"WITH {_MEMBERS} SELECT id, {_uuid(chr(39) + chr(39) + ' || array_to_string(members, ' + chr(39) + ',' + chr(39) + ')')} AS uuid FROM m")
def _(g):
    return members(g).select("id", identity.node_uuid(F.col("members")).alias("uuid"))


@query("e8_semantic_keys", "SELECT id, to_json([label, name, summary, description, '']) AS key FROM n")
def _(g):
    return g.nodes.select("id", identity.semantic_key(F.col("label"), F.col("name"), F.col("summary"), F.col("description"), F.array().cast("array<string>")).alias("key"))


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(name, ''), lambda z: CAST(unicode(z) AS UBIGINT))), lambda h, z: (xor(h, z) * 16777619) % 4294967296)"
_DJB = "list_reduce(list_prepend(CAST(5381 AS UBIGINT), list_transform(string_split(name, ''), lambda z: CAST(unicode(z) AS UBIGINT))), lambda h, z: (h * 33 + z) % 4294967296)"


@query("fn12_hashes", f"SELECT id, CAST({_FNV} AS BIGINT) AS fnv, CAST({_DJB} AS BIGINT) AS djb FROM n WHERE name <> ''")
def _(g):
    return g.nodes.where("name <> ''").select("id", identity.fnv1a32(F.col("name")).alias("fnv"), identity.djb2(F.col("name")).alias("djb"))


_BASE = "regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), 40), '-+$', '')"


_SLUGS = f"b AS (SELECT id, domain, subdomain, label, CASE WHEN {_BASE} <> '' THEN {_BASE} WHEN name IS NOT NULL THEN 'node-' || printf('%x', CAST({_FNV} AS BIGINT)) END AS slug FROM n WHERE name <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY domain NULLS FIRST, subdomain NULLS FIRST, label NULLS FIRST, id) AS k FROM b)"


@query("e7_file_slugs", f"WITH {_SLUGS} SELECT id, CASE WHEN k = 1 THEN slug WHEN slug || '-' || k IN (SELECT slug FROM k WHERE k = 1) THEN slug || '-' || k || '-' || left(sha1(id), 6) ELSE slug || '-' || k END AS file_slug FROM k")
def _(g):
    """File slugs of all named nodes, made unique in order of place and id."""
    return resolve.numbered_slugs(g.nodes.where("name <> ''").select("id", "name", "domain", "subdomain", "label"), identity.file_slug(F.col("name")), ["domain", "subdomain", "label", "id"])


@query("e7_slug_bases", f"SELECT id, CASE WHEN {_BASE} <> '' THEN {_BASE} ELSE 'node-' || printf('%x', CAST({_FNV} AS BIGINT)) END AS slug FROM n WHERE name <> ''")
def _(g):
    return g.nodes.where("name <> ''").select("id", identity.file_slug(F.col("name")).alias("slug"))


@query("e11_empty_members", f"SELECT id FROM n WHERE label IN {CONTENT} AND id NOT IN (SELECT node_uuid FROM s WHERE node_uuid IS NOT NULL)")
def _(g):
    return resolve.empty_members(graph.semantic_nodes(g.nodes).select("id").join(members(g), "id", "left"))


@query("e13_merged_domains", "WITH d AS (SELECT lower(n.domain) AS slug, s.skill, n.subdomain FROM s JOIN n ON n.id = s.node_uuid WHERE n.domain <> '') SELECT slug, string_agg(DISTINCT skill, ',' ORDER BY skill) FILTER (WHERE skill IS NOT NULL) AS skills, string_agg(DISTINCT subdomain, ',' ORDER BY subdomain) FILTER (WHERE subdomain IS NOT NULL) AS subdomains FROM d GROUP BY slug")
def _(g):
    """Domains, written in two ways by their skills, made one."""
    rows = g.sources.join(g.nodes.where("domain <> ''").select(F.col("id").alias("node_uuid"), "domain", "subdomain"), "node_uuid")
    shouted = F.when(F.col("skill") < "m", F.upper("domain")).otherwise(F.col("domain"))
    domains = rows.groupBy(shouted.alias("name"), F.lower("domain").alias("slug")).agg(F.collect_set("skill").alias("skills"), F.collect_set("subdomain").alias("subdomains"))
    return build.merge_domains(domains).select("slug", *[F.nullif(F.array_join(c, ","), F.lit("")).alias(c) for c in ("skills", "subdomains")])


@query("e14_flat_units", "WITH r AS (SELECT domain AS id, id AS file_path, summary, confidence FROM n WHERE domain IS NOT NULL), t AS (SELECT id, summary, min(file_path) AS first FROM r WHERE trim(summary) <> '' GROUP BY 1, 2) SELECT r.id, coalesce((SELECT string_agg(summary, chr(10) || chr(10) ORDER BY first, summary) FROM t WHERE t.id = r.id), '') AS content, min(CASE WHEN confidence > 0 THEN confidence END) AS confidence FROM r GROUP BY r.id")
def _(g):
    rows = g.nodes.where("domain is not null").select(F.col("domain").alias("id"), F.col("id").alias("file_path"), F.lit("k").alias("skill"), F.lit("entity").alias("tag"), "name", F.col("summary").alias("content"), F.lit("").alias("detail"), "confidence")
    return build.flatten_units(rows).select("id", "content", "confidence")


_UNITS = "u AS (SELECT DISTINCT member_id AS unit_id, CASE WHEN contains(member_id, '-entity-') THEN 'entity' ELSE 'concept' END AS tag, CAST('0x' || left(md5(member_id), 2) AS INT) % 7 AS k FROM s), one AS (SELECT min(id) AS entity FROM n WHERE label = 'Entity'), sub AS (SELECT min(id) AS id FROM n WHERE label = 'Subdomain')"


def _decisions(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A decision for each unit by its hash: sound ones, one of each fault, none, or two."""
    k = F.pmod(F.conv(F.substring(F.md5("unit_id"), 1, 2), 16, 10).cast("int"), F.lit(7))
    units = g.sources.select(F.col("member_id").alias("unit_id")).distinct().select("unit_id", F.when(F.contains("unit_id", F.lit("-entity-")), "entity").otherwise("concept").alias("tag"), k.alias("k"))
    ends = g.nodes.agg(F.min(F.when(F.col("label") == "Entity", F.col("id"))).alias("e"), F.min(F.when(F.col("label") == "Subdomain", F.col("id"))).alias("s")).first()
    aliases = g.spark.createDataFrame([("e1", ends.e, "Entity"), ("s1", ends.s, "Subdomain")], "alias string, id string, label string")
    groups = g.spark.createDataFrame([("g1",)], "group_id string")
    action = F.when(F.col("k") == 0, "merge_into").when(F.col("k") == 1, "attach").when(F.col("k") == 2, "fuse").when(F.col("k") == 3, "new_subdomain").otherwise("burn")
    alias = F.when(F.col("k") == 0, "e1").when(F.col("k") == 1, "s1")
    rows = units.where("k <> 5").select("unit_id", action.alias("action"), alias.alias("alias"), F.when(F.col("k") == 2, F.when(F.col("tag") == "entity", "g1").otherwise("g9")).alias("group_id"), F.when((F.col("k") == 3) & (F.col("tag") == "concept"), F.lit(" ")).otherwise(F.lit("name")).alias("name"), "tag")
    rows = rows.where("action <> 'burn'").unionByName(rows.where("action = 'burn'").withColumn("k2", F.lit(1)).drop("k2"))
    twice = units.where("k = 6").select("unit_id", F.lit("new_subdomain").alias("action"), _none().alias("alias"), _none().alias("group_id"), F.lit("name").alias("name"), "tag")
    return rows.join(units.where("k = 6").select("unit_id"), "unit_id", "left_anti").unionByName(twice).unionByName(twice), units, aliases, groups


@query("e16_violations", f"WITH {_UNITS} SELECT unit_id, CASE k WHEN 0 THEN 'alias does not fit' WHEN 2 THEN 'undefined group' WHEN 3 THEN 'no name' WHEN 4 THEN 'unknown action' WHEN 5 THEN 'no decision' ELSE 'several decisions' END AS rule FROM u WHERE k IN (4, 5, 6) OR (k IN (0, 2, 3) AND tag = 'concept')")
def _(g):
    return build.validate_decisions(*_decisions(g))


@query("a14_alignment_gaps", f"WITH {_UNITS} SELECT unit_id, CASE k WHEN 5 THEN 'missing' ELSE 'repeated' END AS state FROM u WHERE k IN (5, 6)")
def _(g):
    decisions, units, _, _ = _decisions(g)
    return build.alignment_gaps(units, decisions)


@query("e17_pending", f"WITH {_UNITS} SELECT unit_id, tag, {_uuid('unit_id')} AS id FROM u WHERE k = 1 AND {_uuid('unit_id')} NOT IN (SELECT id FROM n)")
def _(g):
    """Units attached to a subdomain become nodes with the id of their member."""
    decisions, units, aliases, _ = _decisions(g)
    attached = decisions.where("action = 'attach'").withColumn("summary", F.lit(""))
    detail = units.select("unit_id", "tag", F.lit("k").alias("skill"), F.lit("f").alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit("c").alias("content"), F.lit(0.5).alias("confidence"), F.lit("n").alias("name"))
    pending, _ = build.materialize_decisions(attached, detail, aliases, g.nodes)
    return pending.select(F.element_at("members", 1).alias("unit_id"), F.lower("label").alias("tag"), "id")


@query("e18_assertions", "SELECT source_id, target_id, kind, CAST(count(DISTINCT coalesce(description, '')) AS INTEGER) AS n FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY source_id, target_id, kind")
def _(g):
    rows = g.edges.where("source_id is not null and target_id is not null").select("source_id", "target_id", "kind", _none().alias("state"), _none().alias("quote"), F.col("description").alias("text"))
    parsed = F.from_json("assertions", "array<struct<state:string,quote:string,text:string>>")
    return build.coalesce_assertions(rows).select("source_id", "target_id", "kind", F.size(parsed).alias("n"))


@query("e19_accepted", f"WITH r AS (SELECT id AS relation_id, source_id, target_id FROM e WHERE kind IN {SEMANTIC} AND source_id <> target_id AND confidence >= 0.5), f AS (SELECT node_uuid, file_path FROM s WHERE file_path <> '' GROUP BY ALL) SELECT relation_id FROM r WHERE source_id IN (SELECT node_uuid FROM f) AND target_id IN (SELECT node_uuid FROM f WHERE file_path LIKE '%/references/%')")
def _(g):
    """A relation holds if a file of its source holds the first quote and a reference file of its target the second."""
    candidates = g.edges.select(F.col("id").alias("relation_id"), "source_id", "target_id", "kind", (F.col("confidence") >= 0.5).alias("verdict"), F.array(F.concat(F.lit("<"), "source_id", F.lit(">")), F.concat(F.lit("["), "target_id", F.lit("]"))).alias("quotes"))
    own = g.sources.where("file_path <> ''").select(F.col("node_uuid").alias("id"), "file_path").distinct()
    plain = own.select("id", F.concat("file_path", F.lit("#"), "id").alias("file_path"), F.concat(F.lit("<"), "id", F.lit("> "), F.when(F.contains("file_path", F.lit("/references/")), F.concat(F.lit("["), "id", F.lit("]"))).otherwise("")).alias("content"))
    return build.accepted_relations(candidates, plain.select("id", "file_path"), plain.select("file_path", "content")).select("relation_id")


@query("e20_relation_hashes", "SELECT id, sha256('[\"' || source_id || '\",\"' || target_id || '\",\"' || kind || '\",\"\"]') AS hash FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND NOT regexp_matches(source_id || target_id, '[\"\\\\]')")
def _(g):
    rows = g.edges.where("source_id is not null and target_id is not null").where(~F.concat("source_id", "target_id").rlike(r'["\\]'))
    return rows.select("id", identity.relation_hash(F.col("source_id"), F.col("target_id"), F.col("kind"), F.lit("")).alias("hash"))


@query("e21_repositories", "SELECT DISTINCT skill, 'git:code.example.org/Team/' || skill AS identity FROM documents WHERE skill IS NOT NULL")
def _(g):
    """One repository written as https, ssh and scp address."""
    rows = g.raw("documents").where("skill is not null").select("skill").distinct()
    forms = F.array(F.concat(F.lit("https://Code.Example.org/Team/"), "skill", F.lit(".git")), F.concat(F.lit("ssh://git@code.example.org:22/Team/"), "skill"), F.concat(F.lit("git@code.example.org:Team/"), "skill", F.lit(".git")), F.concat(F.lit(" https://user@code.example.org/Team/"), "skill", F.lit("/ ")))
    return rows.select("skill", F.explode(forms).alias("url")).select("skill", identity.repository_identity(F.col("url")).alias("identity")).distinct()


@query("f_valid_relations", f"SELECT id FROM e WHERE kind IN {SEMANTIC} AND confidence BETWEEN 0 AND 1 AND trim(source_id) <> '' AND trim(target_id) <> ''")
def _(g):
    return resolve.valid_relations(g.edges).select("id")


@query("f_incomplete", f"WITH {_MEMBERS} SELECT n.id, CASE WHEN m.members IS NULL THEN 'no member' WHEN len(list_filter(m.members, lambda z: contains(z, '-entity-'))) < len(m.members) THEN 'unknown member' WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence' ELSE 'no description' END AS rule FROM n LEFT JOIN m ON m.id = n.id WHERE label IN {CONTENT} AND (m.members IS NULL OR len(list_filter(m.members, lambda z: contains(z, '-entity-'))) < len(m.members) OR NOT coalesce(confidence BETWEEN 0 AND 1, false) OR coalesce(trim(description), '') = '')")
def _(g):
    own = graph.semantic_nodes(g.nodes).select("id", "confidence", "description").join(members(g), "id", "left")
    units = g.sources.where("contains(member_id, '-entity-')").select(F.col("member_id").alias("unit_id"))
    return resolve.complete(own, units)[1]


@query("a13_incidences", "WITH i AS (SELECT DISTINCT skill, file_path, member_id FROM s), k AS (SELECT DISTINCT member_id FROM s WHERE node_uuid IN (SELECT id FROM n)) SELECT count(*) AS incidences, count(k.member_id) AS covered_incidences, count(DISTINCT i.member_id) AS units, count(DISTINCT k.member_id) AS covered_units FROM i LEFT JOIN k USING (member_id)")
def _(g):
    units = g.sources.select("skill", "file_path", F.col("member_id").alias("unit_id"))
    owned = g.sources.join(g.nodes.select(F.col("id").alias("node_uuid")), "node_uuid", "left_semi").select(F.col("member_id").alias("unit_id"))
    return build.incidence_coverage(units, owned)


@query("x8_member_details", f"WITH {_MEMBERS}, d AS (SELECT id, unnest(members) AS u, unnest(range(len(members))) AS p FROM m), t AS (SELECT id, 'about ' || left(u, 12) AS d, min(p) AS p FROM d WHERE contains(u, '-entity-') GROUP BY 1, 2) SELECT id, string_agg(d, chr(10) || chr(10) ORDER BY p) AS details FROM t GROUP BY id")
def _(g):
    units = g.sources.select(F.col("member_id").alias("unit_id")).distinct().select("unit_id", F.when(F.contains("unit_id", F.lit("-entity-")), F.concat(F.lit("about "), F.substring("unit_id", 1, 12))).otherwise(" ").alias("detail"))
    return resolve.exact_member_details(members(g), units)


@query("x9_member_skills", f"WITH {_MEMBERS}, sk AS (SELECT member_id, max(skill) AS skill FROM s WHERE skill <> '' GROUP BY 1), d AS (SELECT id, unnest(members) AS u, unnest(range(len(members))) AS p FROM m), t AS (SELECT id, skill, min(p) AS p FROM d JOIN sk ON sk.member_id = d.u GROUP BY 1, 2) SELECT id, string_agg(skill, ',' ORDER BY p, skill) AS skills FROM t GROUP BY id")
def _(g):
    units = g.sources.where("skill <> ''").select(F.col("member_id").alias("unit_id"), "skill", F.col("skill").alias("pos"))
    return resolve.skills_of_members(members(g), units).select("id", F.array_join("skills", ",").alias("skills"))


@query("x10_assigned", f"WITH {_MEMBERS}, a AS (SELECT n.name, n.domain, {_uuid(chr(39) + chr(39) + ' || array_to_string(m.members, ' + chr(39) + ',' + chr(39) + ')')} AS uuid FROM n JOIN m ON m.id = n.id WHERE n.name <> '' AND n.domain IS NOT NULL), k AS (SELECT name, count(DISTINCT uuid) AS c, min(uuid) AS uuid FROM a GROUP BY 1) SELECT x.id, p.uuid AS source_id, q.uuid AS target_id FROM x JOIN k p ON p.name = x.source_entity AND p.c = 1 JOIN k q ON q.name = x.target_entity AND q.c = 1 WHERE p.uuid <> q.uuid")
def _(g):
    named = g.nodes.where("name <> '' and domain is not null").select(F.lit("all").alias("scope"), F.col("name").alias("alias"), "id").join(members(g), "id").drop("id")
    rels = g.cross_references.select("id", F.lit("all").alias("scope"), F.col("source_entity").alias("source"), F.col("target_entity").alias("target"))
    return resolve.assign_uuids(named, rels)[1].select("id", "source_id", "target_id")


@query("x12_retained", f"WITH {_MEMBERS} SELECT n.id, CAST(len(members) + CASE WHEN label = 'Concept' THEN 1 ELSE 0 END AS INTEGER) AS n_members FROM n JOIN m ON m.id = n.id WHERE name IS NOT NULL")
def _(g):
    """Every node is offered one more member under its alias; offers for entities give another label and are refused."""
    nodes = g.nodes.where("name is not null").select("id", "name", "label").join(members(g), "id").withColumn("alias", F.concat(F.lit("retained#"), "id"))
    offers = nodes.select("alias", "name", F.lit("Concept").alias("label"), F.array(F.lit("one more")).alias("members"))
    return build.attach_retained(nodes, offers).select("id", F.size("members").alias("n_members"))


@query("x13_extracted", "SELECT seq AS key, CAST(pos AS INTEGER) AS pos, id, change FROM (SELECT seq, unnest(range(CAST(json_array_length(j, '$.nodes') AS BIGINT))) AS pos, unnest(json_extract_string(j, '$.nodes[*].id')) AS id, unnest(json_extract_string(j, '$.nodes[*].change')) AS change FROM (SELECT seq, try_cast(diff_json AS JSON) AS j FROM c) WHERE json_type(j, '$.nodes') = 'ARRAY') WHERE trim(id) <> ''")
def _(g):
    return build.parse_extraction(g.changesets, "seq", "diff_json", "id:string,change:string")


@query("x15_masked", "SELECT id, CASE WHEN source_id = target_id THEN 'u1 to u1' ELSE 'u1 to u2' END AS masked FROM e WHERE regexp_full_match(source_id, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') AND regexp_full_match(target_id, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}')")
def _(g):
    pattern = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    rows = g.edges.where(F.col("source_id").rlike(pattern) & F.col("target_id").rlike(pattern)).select("id", F.concat("source_id", F.lit(" to "), F.upper("target_id")).alias("text"))
    return build.mask_ids(rows, "text").select("id", "masked")


_REL = "names AS (SELECT name, min(id) AS one, count(DISTINCT id) AS k FROM n WHERE name <> '' GROUP BY name), r AS (SELECT x.id, CASE WHEN a.k = 1 THEN a.one END AS s, CASE WHEN b.k = 1 THEN b.one END AS t, x.kind FROM x LEFT JOIN names a ON a.name = x.source_entity LEFT JOIN names b ON b.name = x.target_entity)"


@query("x16_rejected", f"WITH {_REL} SELECT id, CASE WHEN s IS NULL OR t IS NULL THEN 'endpoint' WHEN s = t THEN 'self' WHEN NOT coalesce(kind IN {SEMANTIC}, false) THEN 'kind' END AS rule FROM r WHERE s IS NULL OR t IS NULL OR s = t OR NOT coalesce(kind IN {SEMANTIC}, false)")
def _(g):
    names = g.nodes.where("name <> ''").select(F.lit("all").alias("scope"), F.col("name").alias("alias"), "id")
    rels = g.cross_references.select("id", F.lit("all").alias("scope"), F.col("source_entity").alias("source"), F.col("target_entity").alias("target"), "kind", F.lit(0.5).alias("confidence"))
    return resolve.relation_candidates(rels, names)[1].select("id", "rule")


@query("x17_selected", "SELECT n.domain AS owner, e.source_id, e.target_id, e.kind, coalesce(e.description, '') AS description, min(e.id) AS relation_id FROM e JOIN n ON n.id = e.source_id WHERE n.domain IS NOT NULL GROUP BY ALL")
def _(g):
    selections = g.edges.select(F.col("id").alias("relation_id"), "source_id").join(g.nodes.where("domain is not null").select(F.col("id").alias("source_id"), F.col("domain").alias("owner")), "source_id").select("relation_id", "owner")
    return resolve.apply_selections(g.edges.withColumnRenamed("id", "relation_id"), selections)


# Scalar functions


@query("fn2_whole_words", "SELECT id, regexp_replace(regexp_replace(summary, '(^|[^A-Za-z0-9])lease($|[^A-Za-z0-9])', '\\1term of use\\2', 'g'), '(^|[^A-Za-z0-9])hub($|[^A-Za-z0-9])', '\\1node\\2', 'g') AS summary FROM n WHERE summary IS NOT NULL")
def _(g):
    return g.nodes.where("summary is not null").select("id", fulltext.expand_words(F.col("summary"), {"hub": "node", "lease": "term of use"}).alias("summary"))


@query("fn4_names", "SELECT id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name FROM n WHERE name IS NOT NULL")
def _(g):
    quoted = F.concat(F.lit(" \"`"), F.replace("name", F.lit(" "), F.lit("  ")), F.lit("`\" "))
    return g.nodes.where("name is not null").select("id", build.normalize_name(quoted).alias("name"))


@query("fn5_persisted", "SELECT id, CASE WHEN trim(name) <> '' THEN trim(name) END AS name, regexp_replace(regexp_replace(description, '[ \\t\\r]+(\\n|$)', '\\1', 'g'), '\\n+$', '') AS description FROM n WHERE label = 'Entity'")
def _(g):
    return g.nodes.where("label = 'Entity'").select("id", build.persisted_name(F.concat(F.lit(" "), "name", F.lit("\t"))).alias("name"), build.persisted_summary(F.col("description")).alias("description"))


@query("fn6_fences", "SELECT id, regexp_replace(summary, '^\\s+|\\s+$', '', 'g') AS summary FROM n WHERE trim(summary) <> '' AND NOT contains(summary, '`')")
def _(g):
    fenced = F.concat(F.lit(" ```json\n"), F.trim("summary"), F.lit("\n```\n"))
    return g.nodes.where("trim(summary) <> '' and not contains(summary, '`')").select("id", build.without_fence(fenced).alias("summary"))


@query("fn8_compatible", r"SELECT id, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS name FROM n WHERE regexp_full_match(name, '[ -~]*')")
def _(g):
    wide = F.translate("name", "abcdefghij", "ａｂｃｄｅｆｇｈｉｊ")
    return g.nodes.where(F.col("name").rlike("^[ -~]*$")).select("id", text.fold_compatible(wide).alias("name"))


@query("fn10_first", "SELECT id, coalesce(CASE WHEN trim(description) <> '' THEN description END, CASE WHEN trim(summary) <> '' THEN summary END, CASE WHEN trim(name) <> '' THEN name END) AS text FROM n")
def _(g):
    return g.nodes.select("id", build.first_non_blank(F.col("description"), F.col("summary"), F.col("name")).alias("text"))


@query("fn20_strict", "SELECT seq, json_valid(diff_json) AND json_type(try_cast(diff_json AS JSON)) = 'OBJECT' AS plain, false AS doubled FROM c WHERE diff_json IS NOT NULL AND json_valid(diff_json) AND json_type(try_cast(diff_json AS JSON)) = 'OBJECT'")
def _(g):
    doubled = F.concat(F.lit('{"a":1,"b":'), "diff_json", F.lit(',"a":2}'))
    return g.changesets.where("diff_json is not null").select("seq", text.strict_object(F.col("diff_json")).alias("plain"), text.strict_object(doubled).alias("doubled")).where("plain")


@query("fn22_canonical", "SELECT id, json_object('confidence', confidence, 'kind', kind, 'source_id', source_id) AS json FROM e WHERE confidence IS NULL OR confidence IN (0.5, 0.25, 0.75)")
def _(g):
    return g.edges.where("confidence is null or confidence in (0.5D, 0.25D, 0.75D)").select("id", identity.canonical_json("source_id", "kind", "confidence").alias("json"))


@query("fn23_spans", "SELECT node_uuid, member_id, file_path, CASE WHEN start_line >= 1 AND end_line >= start_line THEN start_line END AS start_line, CASE WHEN start_line >= 1 AND end_line >= start_line THEN end_line END AS end_line FROM s")
def _(g):
    return g.sources.select("node_uuid", "member_id", "file_path", *[c.alias(k) for k, c in build.normalize_span(F.col("start_line"), F.col("end_line")).items()])


@query("u4_united", "SELECT DISTINCT result_id, list_sort(list_distinct(list_concat(coalesce(citations, []), coalesce(invalid_citations, [])))) AS refs FROM results")
def _(g):
    none = F.array().cast("array<string>")
    return g.raw("results").select("result_id", F.array_sort(F.array_union(F.coalesce("citations", none), F.coalesce("invalid_citations", none))).alias("refs")).distinct()


@query("u5_equal_sets", "WITH a AS (SELECT file_path, list_sort(list_distinct(list(node_uuid))) AS ids FROM s GROUP BY 1), b AS (SELECT file_path, list_sort(list_distinct(list(node_uuid))) AS ids FROM s WHERE start_line IS NULL OR start_line <> 1 GROUP BY 1) SELECT a.file_path, coalesce(a.ids = b.ids, false) AS equal FROM a LEFT JOIN b USING (file_path)")
def _(g):
    sets = lambda df, c: df.groupBy("file_path").agg(F.array_sort(F.collect_set("node_uuid")).alias(c))
    both = sets(g.sources, "a").join(sets(g.sources.where("start_line is null or start_line <> 1"), "b"), "file_path", "left")
    return both.select("file_path", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))


# Measures

_GOLD = "gold AS (SELECT DISTINCT question_id AS qid, unnest(citations) AS doc FROM results WHERE arm = 'raw' AND question_id IS NOT NULL), h0 AS (SELECT question_id AS qid, unnest(citations) AS doc, unnest(range(1, len(citations) + 1)) AS rank FROM results WHERE arm = 'graph' AND question_id IS NOT NULL), hits AS (SELECT qid, doc, min(rank) AS rank FROM h0 GROUP BY 1, 2)"


def _gold(g: Graph) -> tuple[DataFrame, DataFrame]:
    """What the raw arm cites as gold, what the graph arm cites as hits in its order."""
    rows = g.raw("results").where("question_id is not null")
    gold = rows.where("arm = 'raw'").select(F.col("question_id").alias("qid"), F.explode("citations").alias("doc")).distinct()
    hits = rows.where("arm = 'graph'").select(F.col("question_id").alias("qid"), F.posexplode("citations").alias("p", "doc")).groupBy("qid", "doc").agg((F.min("p") + 1).alias("rank"))
    return gold, hits


@query("m1_recall", f"WITH {_GOLD} SELECT gold.qid, CAST(count(hits.doc) > 0 AS INTEGER) AS hit, round(count(hits.doc) / count(*), 9) AS recall, CAST(count(hits.doc) = count(*) AS INTEGER) AS all_gold FROM gold LEFT JOIN hits ON hits.qid = gold.qid AND hits.doc = gold.doc AND rank <= 5 GROUP BY gold.qid")
def _(g):
    return evaluate.recall_at(*_gold(g), 5)


@query("m2_visible_facts", "WITH f AS (SELECT node_uuid || '|' || member_id || '|' || file_path AS fact_id, file_path AS doc, start_line AS a, end_line AS b FROM s WHERE start_line >= 1 AND end_line >= start_line AND contains(member_id, '-entity-')), sp AS (SELECT file_path AS doc, start_line AS a, end_line AS b FROM s WHERE start_line >= 1 AND end_line >= start_line AND NOT contains(member_id, '-entity-')), m AS (SELECT *, max(b) OVER (PARTITION BY doc ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp), i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY a, b) AS island FROM m), cov AS (SELECT doc, min(a) AS a, max(b) AS b FROM i GROUP BY doc, island) SELECT fact_id, CAST(EXISTS (SELECT 1 FROM cov WHERE cov.doc = f.doc AND cov.a <= f.a AND f.b <= cov.b) AS INTEGER) AS visible FROM f")
def _(g):
    spans = g.sources.where("start_line >= 1 and end_line >= start_line")
    facts = spans.where("contains(member_id, '-entity-')").select(F.concat_ws("|", "node_uuid", "member_id", "file_path").alias("fact_id"), F.col("file_path").alias("doc"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    shown = spans.where("not contains(member_id, '-entity-')").select(F.col("file_path").alias("doc"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return evaluate.visible_facts(facts, shown)


@query("m3_ranks", f"WITH {_GOLD}, f AS (SELECT gold.qid, min(rank) AS rank FROM gold LEFT JOIN hits ON hits.qid = gold.qid AND hits.doc = gold.doc AND rank <= 10 GROUP BY 1) SELECT qid, round(coalesce(1 / rank, 0), 9) AS rr FROM f")
def _(g):
    return evaluate.reciprocal_rank(*_gold(g), 10)


@query("m3_overlap", f"WITH {_GOLD} SELECT hits.qid, round(count(gold.doc) / count(*), 9) AS overlap FROM hits LEFT JOIN gold ON gold.qid = hits.qid AND gold.doc = hits.doc WHERE rank <= 10 GROUP BY hits.qid")
def _(g):
    return evaluate.overlap_at(*_gold(g), 10)


@query("a23_events", "SELECT arm, count(*) AS n_events, round(avg(CASE WHEN coalesce(lower(trim(status)), '') <> 'ok' THEN 1.0 ELSE 0.0 END), 9) AS error_rate, round(avg(CASE WHEN coalesce(trim(answer), '') = '' THEN 1.0 ELSE 0.0 END), 9) AS empty_rate, round(avg(elapsed_seconds) FILTER (WHERE lower(trim(status)) = 'ok'), 6) AS mean_seconds, max(elapsed_seconds) FILTER (WHERE lower(trim(status)) = 'ok') AS max_seconds FROM (SELECT DISTINCT result_id, arm, status, answer, elapsed_seconds FROM results) GROUP BY arm")
def _(g):
    once = g.raw("results").select("result_id", "arm", "status", "answer", "elapsed_seconds").distinct()
    failed = F.coalesce(F.lower(F.trim("status")), F.lit("")) != "ok"
    return evaluate.event_summary(once, "arm", failed, F.coalesce(F.trim("answer"), F.lit("")) == "", "elapsed_seconds")


_PART = "CAST('0x' || substr(md5(json_object('kind', kind, 'source_id', source_id, 'target_id', target_id)), {}, 15) AS BIGINT)"


@query("m12_table_identity", f"WITH r AS (SELECT {_PART.format(1)} AS a, {_PART.format(16)} AS b FROM e) SELECT count(*) AS n, sha256(count(*) || '|' || bit_xor(a) || '|' || bit_xor(b) || '|' || CAST(sum(a % 2147483648) AS BIGINT)) AS digest FROM r")
def _(g):
    return identity.table_identity(g.edges.select("source_id", "target_id", "kind"))
