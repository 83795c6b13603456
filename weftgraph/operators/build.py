"""From annotated units to a graph: flattening, validation of proposals, materialization, ingest, structural patches.

What a model proposed is an input table everywhere; the code decides. Rows that break a rule come out in a reject table
with the rule's name, or fail the whole proposal where the rule says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import identity
from weftgraph.functions.text import slug, strip
from weftgraph.operators import mutate
from weftgraph.operators.resolve import lowest_confidence
from weftgraph.sources.schemas import SEMANTIC_KINDS

UNITS = "skill string, file_path string, items array<struct<id:string,tag:string,name:string,content:string,detail:string,confidence:double,start_line:int,end_line:int>>"
ACTIONS = ("merge_into", "attach", "fuse", "new_subdomain")
PATCH = "array<struct<op:string,members:array<string>,name:string,node:string,to_domain:string,to_subdomain:string,parts:array<struct<name:string,members:array<string>>>,sources:array<string>,source:string,target:string,kind:string>>"
PATCH_OPS = ("merge_nodes", "split_node", "remigrate_node", "merge_subdomain", "split_subdomain", "promote", "demote", "drop_edge", "rename")
#: The label, its id prefix and what its edges to the level below are called.
STRUCTURE = {"Skill": "skill::", "Domain": "domain::", "Subdomain": "subdomain::"}


def normalize_name(c: Column) -> Column:
    """A name without outer quotes, backticks and blanks, inner blanks single."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip(c), r"^[\"'`“”‘’\s]+|[\"'`“”‘’\s]+$", ""), r"\s+", " "))


def units(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units of annotated documents (id, skill, file_path, tag, name, content, detail, confidence, span) and the rejected ones with a reason.

    A document with any malformed item is rejected as a whole. Spans that are not 1 <= start <= end become null.
    """
    rows = documents.select("skill", "file_path", F.inline("items")).withColumn("name", normalize_name(F.col("name")))
    reason = F.when(~F.coalesce(F.col("tag").isin("entity", "concept"), F.lit(False)), "tag").when(F.coalesce(F.col("name"), F.lit("")) == "", "name").when(F.coalesce(F.trim("content"), F.lit("")) == "", "content")
    marked = rows.withColumn("reason", reason)
    bad = marked.where("reason is not null").groupBy("skill", "file_path").agg(F.min("reason").alias("reason"))
    good = marked.join(bad.select("skill", "file_path"), ["skill", "file_path"], "left_anti")
    valid = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))
    unit = F.coalesce(F.nullif("id", F.lit("")), identity.unit_id(F.col("skill"), F.col("tag"), F.col("name"), F.col("content"), F.col("detail")))
    spans = {c: F.when(valid, F.col(c)) for c in ("start_line", "end_line")}
    return good.withColumns({"id": unit, **spans}).drop("reason"), bad


def flatten_units(rows: DataFrame) -> DataFrame:
    """One row per unit id: distinct texts joined by an empty line in order of file, the least positive confidence."""
    order = F.struct("file_path", "content")
    texts = lambda c: F.array_join(F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("file_path", F.col(c).alias("t")))), lambda x: x["t"]), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")), "\n\n").alias(c)
    return rows.groupBy("id").agg(F.min_by("skill", order).alias("skill"), F.min_by("tag", order).alias("tag"), F.min_by("name", order).alias("name"), texts("content"), texts("detail"), F.min(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("confidence"))


def merge_domains(domains: DataFrame) -> DataFrame:
    """Domains (name, slug, skills, subdomains) with equal slug made one; of equal names with different slugs the least slug; skills and subdomains united. A blank slug is made from the name."""
    named = domains.withColumn("slug", F.coalesce(F.nullif("slug", F.lit("")), slug(F.col("name"))))
    least = named.withColumn("slug", F.min("slug").over(Window.partitionBy(F.lower("name"))))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return least.groupBy("slug").agg(F.min("name").alias("name"), united("skills"), united("subdomains"))


def validate_decisions(decisions: DataFrame, units: DataFrame, aliases: DataFrame, groups: DataFrame) -> DataFrame:
    """Violations of proposals: unit_id and rule; an empty result means the whole proposal stands.

    decisions: unit_id, action, alias, group_id, name, tag. aliases: alias, id, label. groups: group_id. Every unit has
    exactly one decision, of a known action; merges hit an alias of a fitting label; fusions a defined group; a new
    subdomain has a name.
    """
    per_unit = units.select("unit_id", "tag").join(decisions.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")), "unit_id", "left")
    once = per_unit.where("n is null or n <> 1").select("unit_id", F.when(F.col("n").isNull(), "no decision").otherwise("several decisions").alias("rule"))
    unknown = decisions.join(units.select("unit_id"), "unit_id", "left_anti").select("unit_id", F.lit("unknown unit").alias("rule"))
    rows = decisions.join(units.select("unit_id", F.col("tag").alias("unit_tag")), "unit_id").join(aliases, "alias", "left").join(groups.select("group_id").distinct().withColumn("_group", F.lit(True)), "group_id", "left")
    rule = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action")
        .when((F.col("action") == "merge_into") & (F.col("id").isNull() | (F.lower("label") != F.col("unit_tag"))), "alias does not fit")
        .when((F.col("action") == "attach") & (F.col("id").isNull() | (F.col("label") != "Subdomain")), "alias is no subdomain")
        .when((F.col("action") == "fuse") & F.col("_group").isNull(), "undefined group")
        .when(F.col("action").isin("attach", "fuse", "new_subdomain") & (F.coalesce(F.trim("name"), F.lit("")) == ""), "no name")
    )
    return once.unionByName(unknown).unionByName(rows.withColumn("rule", rule).where("rule is not null").select("unit_id", "rule")).distinct()


def materialize_decisions(decisions: DataFrame, units: DataFrame, aliases: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending nodes and source rows of valid proposals.

    A merge keeps the node's id. Units of one fusion group, or one attached unit, become a node with the id of its
    members; where a node has that id already the proposal is a merge into it. The confidence is the least of the
    members, a blank summary the first member's content. decisions also have summary; units have skill, file_path, span,
    tag, content and confidence.
    """
    named = decisions.withColumnRenamed("name", "new_name").drop("tag")
    rows = named.join(units.drop("name"), "unit_id").join(aliases.select("alias", F.col("id").alias("target")), "alias", "left")
    merged = rows.where("action = 'merge_into'").select(F.col("target").alias("id"), "unit_id", "skill", "file_path", "start_line", "end_line")
    group = F.when(F.col("action") == "fuse", F.concat(F.lit("g:"), "group_id")).otherwise(F.concat(F.lit("u:"), "unit_id"))
    fresh = rows.where("action <> 'merge_into'").withColumn("_group", group)
    first = F.struct("unit_id", "content")
    made = fresh.groupBy("_group").agg(F.array_sort(F.collect_set("unit_id")).alias("members"), F.min_by("new_name", first).alias("name"), F.min("tag").alias("tag"), F.min_by("target", first).alias("home"), F.min_by(F.coalesce(F.nullif("summary", F.lit("")), "content"), first).alias("summary"))
    low = lowest_confidence(fresh.select("_group", "confidence"), "_group")
    with_id = made.join(low, "_group").withColumn("id", identity.node_uuid(F.col("members")))
    known = nodes.select("id").distinct().withColumn("_known", F.lit(True))
    pending = with_id.join(known, "id", "left").where("_known is null").select("id", F.initcap("tag").alias("label"), "name", "summary", "home", "confidence", "members")
    sources = fresh.join(with_id.select("_group", "id"), "_group").select("id", "unit_id", "skill", "file_path", "start_line", "end_line")
    every = merged.unionByName(sources).withColumnsRenamed({"id": "node_uuid", "unit_id": "member_id"})
    return pending, mutate.collapse_sources(every)


def coalesce_assertions(rows: DataFrame) -> DataFrame:
    """source_id, target_id, kind, assertions: the distinct assertions on an edge as one canonical JSON list; text without proof is kept as ``legacy_unverified``."""
    item = F.struct(F.coalesce("state", F.lit("legacy_unverified")).alias("state"), F.coalesce("quote", F.lit("")).alias("quote"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("source_id", "target_id", "kind").agg(F.to_json(F.array_sort(F.collect_set(item))).alias("assertions"))


def accepted_relations(candidates: DataFrame, members: DataFrame, originals: DataFrame) -> DataFrame:
    """Relations across scopes that hold: the verdict is positive, and for each end a member's frozen source has the quote.

    candidates: relation_id, source_id, target_id, kind, verdict, quotes (array). members: id, file_path. originals:
    file_path, content (one per path; contradicting ones are left out).
    """
    frozen = originals.groupBy("file_path").agg(F.count_distinct("content").alias("n"), F.min("content").alias("content")).where("n = 1").drop("n")
    own = members.select("id", "file_path").distinct().join(frozen, "file_path")
    rows = candidates.where(F.col("verdict") & F.col("kind").isin(*SEMANTIC_KINDS) & (F.col("source_id") != F.col("target_id")))
    ends = rows.select("relation_id", "quotes", F.explode(F.array("source_id", "target_id")).alias("id")).select("relation_id", "id", F.explode("quotes").alias("quote")).where("trim(quote) <> ''")
    shown = ends.join(own, "id").where(F.contains("content", F.col("quote"))).groupBy("relation_id").agg(F.count_distinct("id").alias("n")).where("n = 2")
    return rows.join(shown.select("relation_id"), "relation_id", "left_semi")


def ingest(tree: DataFrame) -> dict[str, DataFrame]:
    """Nodes, edges and sources of an extraction tree: domain, subdomain, nodes array<struct<id,label,name,summary,description,confidence,skills,members>>, relations array<struct<source_id,target_id,kind,description,confidence>>.

    Skills, domains and subdomains become nodes of their own; skills provide domains, and each level composes the
    next. Relations with a missing end are dropped. A skill node has its own name as domain.
    """
    content = tree.select("domain", "subdomain", F.inline("nodes"))
    empty = F.lit(None).cast("string")
    skills = content.select("domain", F.explode("skills").alias("skill")).where("skill <> ''").distinct()
    domain_id, sub_id = F.concat(F.lit("domain::"), "domain"), F.concat(F.lit("subdomain::"), "domain", F.lit("::"), "subdomain")
    structural = lambda i, label, name, domain, sub: [i.alias("id"), F.lit(label).alias("label"), name.alias("name"), F.lit("").alias("summary"), empty.alias("description"), domain.alias("domain"), sub.alias("subdomain"), F.lit(1.0).alias("confidence")]
    nodes = (
        content.select("id", "label", "name", "summary", "description", "domain", "subdomain", mutate.fill_confidence(F.col("confidence")).alias("confidence"))
        .unionByName(tree.select("domain").distinct().select(*structural(domain_id, "Domain", F.col("domain"), F.col("domain"), empty)))
        .unionByName(tree.select("domain", "subdomain").distinct().select(*structural(sub_id, "Subdomain", F.col("subdomain"), F.col("domain"), F.col("subdomain"))))
        .unionByName(skills.select("skill").distinct().select(*structural(F.concat(F.lit("skill::"), "skill"), "Skill", F.col("skill"), F.col("skill"), empty)))
    )
    edge = lambda a, b, kind: [a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("kind"), empty.alias("description"), F.lit(1.0).alias("confidence"), F.lit("extraction").alias("provenance")]
    ids = content.select("id").distinct()
    relations = tree.select(F.inline("relations")).where("source_id <> target_id")
    held = relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    edges = (
        skills.select(*edge(F.concat(F.lit("skill::"), "skill"), domain_id, "provides"))
        .unionByName(tree.select("domain", "subdomain").distinct().select(*edge(domain_id, sub_id, "composes")))
        .unionByName(content.select(*edge(sub_id, F.col("id"), "composes")))
        .unionByName(held.select("source_id", "target_id", "kind", "description", mutate.fill_confidence(F.col("confidence")).alias("confidence"), F.lit("llm_inferred").alias("provenance")))
    )
    return {"nodes": nodes.dropDuplicates(["id"]), "edges": edges.dropDuplicates(["source_id", "target_id", "kind"]), "sources": content.select(F.col("id").alias("node_uuid"), F.explode("members").alias("member_id")).distinct()}


def dirty_closure(touched: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, subdomain) to compute again: those of touched nodes, and of the sources of machine edges that lead to them."""
    into = edges.where(F.col("provenance") != mutate.HUMAN).join(touched.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return nodes.join(touched.select("id").unionByName(into).distinct(), "id", "left_semi").where("subdomain is not null").select("domain", "subdomain").distinct()


def changed_relation_documents(old: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """Files of the ends of edges that are new, gone or differ in description or confidence."""
    key = mutate.EDGE_KEY
    payload = F.struct("description", "confidence")
    both = old.select(*key, payload.alias("a")).join(new.select(*key, payload.alias("b")), key, "full").where("not (a <=> b)")
    ends = both.select(F.explode(F.array("source_id", "target_id")).alias("node_uuid")).distinct()
    return sources.join(ends, "node_uuid", "left_semi").where("file_path <> ''").select("file_path").distinct()


def parse_patch(text: Column) -> Column:
    """The operations of a patch in a text, with or without a code fence around it; null where it is no valid JSON."""
    bare = F.regexp_replace(F.trim(text), r"(?s)\A```\w*\s*|\s*```\z", "")
    return F.from_json(bare, f"struct<ops:{PATCH}>")["ops"]


def validate_patch(ops: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """pos and rule of each operation that may not be applied: ops has pos and the fields of `PATCH`."""
    ids = nodes.select(F.col("id").alias("m")).distinct()
    named = ops.select("pos", "op", F.explode_outer(F.coalesce(F.when(F.col("op") == "merge_nodes", F.col("members")), F.array("node"))).alias("m")).where(F.col("op").isin("merge_nodes", "split_node", "remigrate_node", "promote", "rename"))
    lost = named.join(ids, "m", "left_anti").select("pos", F.lit("unknown node").alias("rule"))
    few = ops.where("op = 'merge_nodes' and size(array_distinct(members)) < 2").select("pos", F.lit("fewer than two nodes").alias("rule"))
    odd = ops.where(~F.coalesce(F.col("op").isin(*PATCH_OPS), F.lit(False))).select("pos", F.lit("unknown operation").alias("rule"))
    blank = ops.where("op = 'rename' and coalesce(trim(name), '') = ''").select("pos", F.lit("no name").alias("rule"))
    parts = ops.where("op = 'split_node'").select("pos", F.col("node").alias("node_uuid"), F.explode(F.flatten(F.transform("parts", lambda p: p["members"]))).alias("member_id"))
    given = parts.groupBy("pos", "node_uuid").agg(F.count(F.lit(1)).alias("given"), F.count_distinct("member_id").alias("once"))
    have = sources.select("node_uuid", "member_id").distinct()
    known = parts.distinct().join(have, ["node_uuid", "member_id"]).groupBy("pos").agg(F.count(F.lit(1)).alias("known"))
    total = have.groupBy("node_uuid").agg(F.count(F.lit(1)).alias("total"))
    inexact = given.join(known, "pos", "left").join(total, "node_uuid", "left").where("not (given = once and once <=> known and known <=> total)").select("pos", F.lit("parts are no partition").alias("rule"))
    return lost.unionByName(few).unionByName(odd).unionByName(blank).unionByName(inexact).distinct()


def promote(nodes: DataFrame, communities: DataFrame, node_id: str, subdomain: str) -> DataFrame:
    """A node and those of its community in the same subdomain, put into a new subdomain of their domain."""
    one = nodes.where(F.col("id") == node_id).select("domain", "subdomain", "id").join(communities, "id").select("domain", "subdomain", "community")
    peers = nodes.join(communities, "id").join(F.broadcast(one), ["domain", "subdomain", "community"]).select("id", F.col("domain").alias("to_domain"), F.lit(subdomain).alias("to_subdomain"))
    return mutate.reassign_nodes(nodes, peers)


def backfill_sources(hits: DataFrame, node_files: DataFrame, chunk_ranks: DataFrame) -> DataFrame:
    """qid, place, id, chunk_id: for each hit the best chunk of its files; a chunk goes to the first hit that has it, other hits keep the node alone.

    hits: qid, place, id. node_files: id, file_path. chunk_ranks: qid, chunk_id, file_path, rank.
    """
    met = hits.join(node_files.distinct(), "id").join(chunk_ranks, ["qid", "file_path"])
    best = met.groupBy("qid", "place", "id").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id"))
    w = Window.partitionBy("qid", "chunk_id").orderBy("place")
    first = best.withColumn("_n", F.row_number().over(w)).select("qid", "place", "id", F.when(F.col("_n") == 1, F.col("chunk_id")).alias("chunk_id"))
    return hits.join(first, ["qid", "place", "id"], "left")


def uncovered(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """unit_id, skill, file_path of units no node has as a member."""
    used = nodes.select(F.explode("members").alias("unit_id")).distinct()
    return units.join(used, "unit_id", "left_anti").select("unit_id", "skill", "file_path")


def attach_retained(nodes: DataFrame, proposals: DataFrame) -> DataFrame:
    """Members added to nodes under an alias, only where name and label equal the target's. proposals: alias, name, label, members; nodes have alias."""
    ok = proposals.join(nodes.select("alias", "name", "label"), ["alias", "name", "label"], "left_semi").groupBy("alias").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("_more"))
    joined = nodes.join(ok, "alias", "left")
    return joined.withColumn("members", F.when(F.col("_more").isNotNull(), F.array_union("members", F.col("_more"))).otherwise(F.col("members"))).drop("_more")


def mask_ids(rows: DataFrame, text: str) -> DataFrame:
    """`rows` with every UUID in a text replaced by an alias ``u1``, ``u2`` … in order of appearance, and aliases: the map back."""
    pattern = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda u: F.lower(u)))
    pairs = F.transform(found, lambda u, i: F.struct(u.alias("u"), F.concat(F.lit("u"), (i + 1).cast("string")).alias("a")))
    masked = F.aggregate(pairs, F.col(text), lambda t, p: F.regexp_replace(t, F.concat(F.lit("(?i)"), p["u"]), p["a"]))
    return rows.withColumns({"masked": masked, "aliases": F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["a"], p["u"])))})


def normalize_span(start: Column, end: Column) -> dict[str, Column]:
    """Start and end where 1 <= start <= end, else null."""
    ok = (start >= 1) & (end >= start)
    return {"start_line": F.when(ok, start), "end_line": F.when(ok, end)}


def persisted_name(c: Column) -> Column:
    """A name without outer blanks; null where nothing is left or a control or format sign is in it."""
    name = strip(c)
    return F.when((name != "") & ~name.rlike(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"), name)


def persisted_summary(c: Column) -> Column:
    """A text without blanks at line ends and without empty lines at its end; what stands before a line stays."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t\r]+$", ""), r"\n+\z", "")


def without_fence(c: Column) -> Column:
    """The content of a text that is one fenced block; another text as it is."""
    return F.regexp_replace(strip(c), r"(?s)\A```\w*\s*|\s*```\z", "")


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def incidence_coverage(units: DataFrame, members: DataFrame) -> DataFrame:
    """One row: incidences (skill, file_path, unit_id) and units, how many of each a node has as member. members: unit_id."""
    own = units.select("skill", "file_path", "unit_id").distinct().join(members.select("unit_id").distinct().withColumn("hit", F.lit(1)), "unit_id", "left")
    return own.agg(F.count(F.lit(1)).alias("incidences"), F.count("hit").alias("covered_incidences"), F.count_distinct("unit_id").alias("units"), F.count_distinct(F.when(F.col("hit") == 1, F.col("unit_id"))).alias("covered_units"))


def alignment_gaps(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """unit_id and state of units whose decision is missing or that are decided more than once, and of decisions without a unit."""
    many = decisions.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))
    both = units.select("unit_id").distinct().withColumn("_unit", F.lit(True)).join(many, "unit_id", "full")
    state = F.when(F.col("_unit").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.withColumn("state", state).where("state is not null").select("unit_id", "state")


def parse_extraction(rows: DataFrame, key: str, text: str, item: str) -> DataFrame:
    """key, pos and the fields of each sound item of the JSON list ``nodes`` of a text: items without an id are dropped one by one, a text that is no JSON gives nothing, others stay."""
    parsed = F.from_json(F.when(F.try_parse_json(F.col(text)).isNotNull(), F.col(text)), f"nodes array<struct<{item}>>")["nodes"]
    return rows.select(F.col(key).alias("key"), F.posexplode(parsed).alias("pos", "item")).select("key", "pos", "item.*").where("coalesce(trim(id), '') <> ''")
