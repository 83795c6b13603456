"""Graph operators: bounded search outwards, neighbours, structural measures, communities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.schemas import CONTENT_LABELS, SEMANTIC_KINDS, kind_priority
from weftgraph.sources.tables import materialize, release

#: Lower or upper bounds of a healthy graph; a bound given as 0 means the default.
THRESHOLDS = {"modularity": 0.3, "singleton_ratio": 0.4, "edge_node_ratio": 3.0, "change_ratio": 0.20, "changed_docs": 5}


def outgoing(edges: DataFrame, ids: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Edges that leave the ids, in the order they are followed: ord from 1 for each source."""
    w = Window.partitionBy("source_id").orderBy(kind_priority(F.col("kind")), "id")
    own = ids.select(F.col("id").alias("source_id")).distinct()
    return edges.where(F.col("confidence") >= min_confidence).join(own, "source_id", "left_semi").withColumn("ord", F.row_number().over(w))


def incoming(edges: DataFrame, ids: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    own = ids.select(F.col("id").alias("target_id")).distinct()
    return edges.where(F.col("confidence") >= min_confidence).join(own, "target_id", "left_semi")


def bfs(nodes: DataFrame, edges: DataFrame, entries: DataFrame, max_depth: int = 2, min_confidence: float = 0.0, limit: int = 100, domains: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Bounded breadth-first search along outgoing edges for many queries at once, level by level.

    entries: qid, id, pos (order of the entry nodes). Returns (qid, id, depth) of the nodes reached and (qid, ord,
    edge_id, source_id, target_id, kind, depth) of the edges reported. Edges are followed by kind priority, then id.
    The limit is tested before a node is expanded, so the last expansion may exceed it. Entry nodes are not tested
    for their domain; one that does not exist is expanded but not reported. Edges to nodes expanded before are not
    reported, parallel edges and those to waiting nodes are. At most `max_depth` rounds of joins; what a round reads was
    written by the rounds before, so its plan stays the same, however many there were.
    """
    max_depth, limit = max_depth if max_depth > 0 else 2, limit if limit > 0 else 100
    exists = nodes.select("id", "domain").dropDuplicates(["id"])
    inside = exists.where(F.col("domain").isin(list(domains))) if domains else exists
    usable = edges.where(F.col("confidence") >= min_confidence).select(F.col("id").alias("edge_id"), "source_id", "target_id", "kind", kind_priority(F.col("kind")).alias("prio"))
    usable = materialize(usable.join(inside.select(F.col("id").alias("target_id")), "target_id", "left_semi"))
    by_pos = Window.partitionBy("qid").orderBy("pos")
    level = materialize(entries.groupBy("qid", "id").agg(F.min("pos").alias("pos")).withColumn("pos", F.row_number().over(by_pos)))
    found = materialize(level.join(exists.select("id"), "id", "left_semi").select("qid", "id", F.lit(0).alias("depth")))
    earlier = reported = None
    for depth in range(max_depth):
        known = found.groupBy("qid").agg(F.count(F.lit(1)).alias("known"))
        reach = level.withColumnRenamed("id", "source_id").join(usable, "source_id")
        if earlier is not None:
            reach = reach.join(earlier, ["qid", "target_id"], "left_anti")
        here = level.select("qid", F.col("id").alias("target_id"), F.col("pos").alias("own_pos"))
        reach = materialize(reach.join(here, ["qid", "target_id"], "left").where("own_pos is null or own_pos > pos"))
        fresh = reach.where("own_pos is null").groupBy("qid", "target_id").agg(F.min("pos").alias("pos")).groupBy("qid", "pos").agg(F.count(F.lit(1)).alias("new"))
        running = F.coalesce(F.sum("new").over(by_pos.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parents = level.select("qid", "pos").join(fresh, ["qid", "pos"], "left").join(known, "qid", "left")
        parents = materialize(parents.select("qid", "pos", (F.coalesce("known", F.lit(0)) + running).alias("before")))
        kept = reach.join(parents.where(F.col("before") < limit).select("qid", "pos"), ["qid", "pos"], "left_semi")
        step = materialize(kept.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "prio", "edge_id"))))
        release(reach)
        edges_here = step.select("qid", "ord", "edge_id", "source_id", "target_id", "kind", F.lit(depth + 1).alias("depth"))
        reported = edges_here if reported is None else reported.unionByName(edges_here)
        cut = parents.where(F.col("before") >= limit).select("qid", F.lit(True).alias("cut")).distinct()
        nxt = step.where("own_pos is null").groupBy("qid", F.col("target_id").alias("id")).agg(F.min("ord").alias("pos"))
        nxt = materialize(nxt.join(cut, "qid", "left").withColumn("pos", F.row_number().over(by_pos)))
        found = found.unionByName(nxt.select("qid", "id", F.lit(depth + 1).alias("depth")))
        expanded = level.select("qid", F.col("id").alias("target_id"))
        earlier = expanded if earlier is None else earlier.unionByName(expanded)
        level = nxt.where("cut is null").select("qid", "id", "pos")
    order = Window.partitionBy("qid").orderBy("depth", "ord")
    return found, reported.withColumn("ord", F.row_number().over(order))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, neighbour, relation: the nodes next to each node in either direction; of several edges the first counts, outgoing before incoming, whose relation reads ``incoming: kind``."""
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour"), "kind", F.lit(0).alias("way"), F.col("id").alias("edge_id"))
    into = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbour"), F.concat(F.lit("incoming: "), "kind").alias("kind"), F.lit(1).alias("way"), F.col("id").alias("edge_id"))
    both = out.unionByName(into).join(nodes.select(F.col("id").alias("neighbour")).distinct(), "neighbour", "left_semi")
    best = both.groupBy("id", "neighbour").agg(F.min(F.struct("way", "edge_id", "kind")).alias("b"))
    return best.select("id", "neighbour", F.col("b.kind").alias("relation"))


def relation_paths(edges: DataFrame) -> DataFrame:
    """source_id and relations: its edges as ``kind -> target``, in the order they are followed."""
    item = F.struct(kind_priority(F.col("kind")).alias("p"), F.col("id").alias("e"), F.concat("kind", F.lit(" -> "), "target_id").alias("text"))
    return edges.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]).alias("relations"))


def semantic_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").isin(*CONTENT_LABELS))


def semantic_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (source_id, target_id, kind) of semantic kinds between entities and concepts, without loops."""
    ids = semantic_nodes(nodes).select("id").distinct()
    return (
        edges.where(F.col("kind").isin(*SEMANTIC_KINDS) & (F.col("source_id") != F.col("target_id")))
        .join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        .select("source_id", "target_id", "kind").distinct()
    )


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree; an edge counts at both ends."""
    return _ends(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree and its share of the greatest degree; nodes without an edge have 0."""
    deg = nodes.select("id").distinct().join(degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    top = deg.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    return deg.join(F.broadcast(top), F.lit(True)).select("id", "degree", F.round(F.col("degree") / F.col("top"), 9).alias("centrality"))


def modularity_terms(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """community, internal (edges inside) and degree (of its nodes), over all edges, parallel ones counted."""
    a = membership.select(F.col("id").alias("source_id"), F.col("community").alias("ca"))
    b = membership.select(F.col("id").alias("target_id"), F.col("community").alias("cb"))
    joined = edges.join(a, "source_id").join(b, "target_id")
    rows = joined.select(F.inline(F.array(
        F.struct(F.col("ca").alias("community"), (F.col("ca") == F.col("cb")).cast("long").alias("internal"), F.lit(1).alias("degree")),
        F.struct(F.col("cb").alias("community"), F.lit(0).cast("long").alias("internal"), F.lit(1).alias("degree")),
    )))
    return rows.groupBy("community").agg(F.sum("internal").alias("internal"), F.sum("degree").alias("degree"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row with q: 0 for a graph without edges."""
    terms = modularity_terms(edges, membership)
    m2 = F.sum("degree")
    # sum(L_c / m - (d_c / 2m)^2) in one pass over the terms
    return terms.agg(F.coalesce(F.sum("internal") * 2 / m2 - F.sum(F.col("degree").cast("double") * F.col("degree")) / (m2 * m2), F.lit(0.0)).alias("q"))


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of structural measures of the semantic graph: counts, ratios and modularity by subdomain."""
    own = materialize(semantic_nodes(nodes).select("id", F.concat_ws("/", "domain", "subdomain").alias("community")).dropDuplicates(["id"]))
    sem = materialize(semantic_edges(nodes, edges))
    counts = own.agg(F.count(F.lit(1)).alias("node_count"), F.count_distinct("community").alias("subdomain_count"))
    touched = own.join(_ends(sem).distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("singleton_count"))
    total = sem.agg(F.count(F.lit(1)).alias("edge_count"))
    q = modularity(sem, own)
    one = lambda df: F.broadcast(df)  # noqa: E731 - one row each
    joined = counts.join(one(touched), F.lit(True)).join(one(total), F.lit(True)).join(one(q), F.lit(True))
    n = F.greatest(F.col("node_count"), F.lit(1))
    return joined.select("node_count", "edge_count", "subdomain_count", "singleton_count", F.round(F.col("singleton_count") / n, 9).alias("singleton_ratio"), F.round(F.col("edge_count") / n, 9).alias("edge_node_ratio"), F.round("q", 9).alias("modularity_q"))


def breaches(measures: DataFrame, thresholds: dict[str, float] | None = None, change_ratio: float = 0.0, changed_docs: int = 0) -> DataFrame:
    """`measures` with breached: the bounds that are strictly passed; the change bound needs ratio and documents."""
    t = {k: (thresholds or {}).get(k) or v for k, v in THRESHOLDS.items()}
    marks = [
        F.when(F.col("modularity_q") < t["modularity"], F.lit("modularity")),
        F.when(F.col("singleton_ratio") > t["singleton_ratio"], F.lit("singleton_ratio")),
        F.when(F.col("edge_node_ratio") > t["edge_node_ratio"], F.lit("edge_node_ratio")),
        F.lit("change_ratio" if change_ratio > t["change_ratio"] and changed_docs > t["changed_docs"] else None).cast("string"),
    ]
    return measures.withColumn("breached", F.array_compact(F.array(*marks)))


def ghosts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints without a node, with the parts of ids of the form ``domain::subdomain::name``."""
    parts = F.split("id", "::")
    full = F.size(parts) >= 3
    dangling = _ends(edges).where("id is not null").distinct().join(nodes.select("id"), "id", "left_anti")
    return dangling.select("id", F.when(full, parts[0]).alias("domain"), F.when(full, parts[1]).alias("subdomain"), F.when(full, parts[2]).otherwise(F.col("id")).alias("name"))


def undirected(edges: DataFrame) -> DataFrame:
    """a < b of every linked pair, once; the edge with the least id stands for it."""
    pairs = edges.where(F.col("source_id") != F.col("target_id")).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "id")
    return pairs.groupBy("a", "b").agg(F.min("id").alias("edge_id"))


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """id and component (its least id) of every id in a pair.

    Each round lowers a node's label to the least of its neighbours' labels (one step on), and so the label of the node
    that stood for it; then labels jump to their label's label. Whatever the order of the ids on a path, whole stretches
    are joined at once, about log n rounds in all. Rounds end when no label has changed, never before; each round is a
    written table.
    """
    ends = materialize(pairs.select(F.col(a).alias("id"), F.col(b).alias("other")).unionByName(pairs.select(F.col(b).alias("id"), F.col(a).alias("other"))))
    label = materialize(ends.select("id").distinct().withColumn("component", F.col("id")))
    while True:
        further = label.select(F.col("id").alias("component"), F.col("component").alias("least"))
        ahead = label.join(further, "component").select("id", "component", "least")
        near = ends.join(ahead.select(F.col("id").alias("other"), "least"), "other").groupBy("id").agg(F.min("least").alias("near"))
        offers = ahead.join(near, "id").select(F.inline(F.array(
            F.struct("id", F.least("near", "least").alias("to"), F.col("component").alias("was")),
            F.struct(F.col("component").alias("id"), F.col("near").alias("to"), F.lit(None).cast(label.schema["component"].dataType).alias("was")),
        )))
        new = materialize(offers.groupBy("id").agg(F.min("to").alias("to"), F.max("was").alias("was")).select("id", F.least("to", "was").alias("component"), (F.col("to") < F.col("was")).alias("changed")))
        label = new.select("id", "component")
        if new.where("changed").isEmpty():
            return label


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and community: local moves towards higher modularity, then the same over communities, until no move gains.

    The graph is simple and undirected with weight 1. A node moves to the neighbouring community of greatest gain, of
    equal ones the least id, and only where the gain beats staying. In each round half of the nodes (by hash) may move,
    so that two neighbours rarely swap; see `_local_moves` for what ends the rounds. Passes over the graph of communities
    end when one moves nothing. Nodes without an edge stay alone. Every step is an aggregation or a join on ids; no
    component is gathered in one task.
    """
    one = F.lit(1).cast("long").alias("w")
    links = undirected(edges).select("a", "b", one)
    own = nodes.select("id").distinct()
    member = materialize(own.withColumn("community", F.col("id")))
    graph = links.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
    while True:
        graph = materialize(graph)
        total = graph.agg(F.sum("w")).first()[0]
        label = _local_moves(graph, total) if total else None
        if label is None:
            break
        member = materialize(member.join(label.select(F.col("id").alias("community"), F.col("community").alias("_to")), "community", "left").select("id", F.coalesce("_to", "community").alias("community")))
        to_u, to_v = (label.select(F.col("id").alias(c), F.col("community").alias(f"_{c}")) for c in ("u", "v"))
        graph = graph.join(to_u, "u").join(to_v, "v").groupBy(F.col("_u").alias("u"), F.col("_v").alias("v")).agg(F.sum("w").alias("w"))
    least = Window.partitionBy("community")
    return member.select("id", F.min("id").over(least).alias("community"))


def _local_moves(graph: DataFrame, total: int) -> DataFrame | None:
    """Labels after which no single move gains, or None if none does from the start.

    Gains and modularity are whole numbers (times `total`, the sum of weights in both ways), so they compare exactly. A
    round counts only if modularity rises: first the moves of half of the nodes are tried, then of an eighth, and if
    neither helps those that share no community with a better one, which raise it by the sum of their gains. So
    modularity rises in each round and the rounds end.
    """
    outer = graph.where("u <> v")
    label = materialize(graph.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")).withColumn("community", F.col("id")))
    q, moved, r = _quality(graph, label, total), False, 0
    while True:
        weight = label.groupBy(F.col("community").alias("cand")).agg(F.sum("k").alias("tot"))
        to = outer.join(label.select(F.col("id").alias("v"), "community"), "v").groupBy(F.col("u").alias("id"), F.col("community").alias("cand")).agg(F.sum("w").alias("w"))
        mine = label.select("id", "k", F.col("community").alias("now"))
        stay = mine.select("id", F.col("now").alias("cand"), F.lit(0).cast("long").alias("w"))
        options = to.unionByName(stay).groupBy("id", "cand").agg(F.sum("w").alias("w")).join(mine, "id").join(weight, "cand")
        here = F.col("cand") == F.col("now")
        gain = F.col("w") * total - F.col("k") * (F.col("tot") - F.when(here, F.col("k")).otherwise(0))
        best = options.groupBy("id", "k", "now").agg(F.max(F.when(here, gain)).alias("stay"), F.min(F.struct((-gain).alias("g"), (~here).alias("s"), "cand")).alias("b"))
        best = materialize(best.select("id", "k", "now", F.col("b.cand").alias("to"), (-F.col("b.g") - F.col("stay")).alias("gain")))
        movers = best.where("to <> now")
        if movers.isEmpty():
            return label if moved else None
        for parts in (2, 8, 0):
            if parts:
                go = movers.where(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(parts)) == 0).select("id", F.col("to").alias("_to"))
            else:
                rank = F.struct(F.col("gain"), F.col("id"))
                ends = movers.select("id", rank.alias("rank"), F.explode(F.array("now", "to")).alias("c"))
                go = ends.groupBy("c").agg(F.max("rank").alias("m")).groupBy(F.col("m.id").alias("id")).count().where("count = 2").join(movers, "id").select("id", F.col("to").alias("_to"))
            tried = materialize(best.join(go, "id", "left").select("id", "k", F.coalesce("_to", "now").alias("community")))
            higher = _quality(graph, tried, total)
            if higher > q:
                break
        label, q, moved, r = tried, higher, True, r + 1


def _quality(graph: DataFrame, label: DataFrame, total: int) -> int:
    """Modularity of the labels, times the square of `total`."""
    a, b = (label.select(F.col("id").alias(c), F.col("community").alias(f"_{c}")) for c in ("u", "v"))
    inside = graph.join(a, "u").join(b, "v").where("_u = _v").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    tot = label.groupBy("community").agg(F.sum("k").alias("tot"))
    return inside * total - int(tot.agg(F.sum((F.col("tot") * F.col("tot")).cast("decimal(38,0)"))).first()[0])


def subgraph(found: DataFrame, reported: DataFrame) -> DataFrame:
    """qid, part (``entity`` or ``relation``), id and hop of a search's result: a relation's hop is that of its farther end; entities come before relations, each by hop."""
    depth = lambda c: found.select("qid", F.col("id").alias(c), F.col("depth").alias(f"_{c}"))
    entities = found.select("qid", F.lit(0).alias("ord"), F.lit("entity").alias("part"), "id", F.col("depth").alias("hop"))
    joined = reported.select("qid", "edge_id", "source_id", "target_id").join(depth("source_id"), ["qid", "source_id"], "left").join(depth("target_id"), ["qid", "target_id"], "left")
    relations = joined.select("qid", F.lit(1).alias("ord"), F.lit("relation").alias("part"), F.col("edge_id").cast("string").alias("id"), F.greatest("_source_id", "_target_id").alias("hop"))
    return entities.unionByName(relations)


def node_parts(c: str) -> list:
    """domain, subdomain and name of an id of the form ``domain::subdomain::name``; an id of another form is a name alone."""
    parts = F.split(c, "::")
    full = F.size(parts) >= 3
    return [F.when(full, parts[0]).alias("domain"), F.when(full, parts[1]).alias("subdomain"), F.when(full, parts[2]).otherwise(F.col(c)).alias("name")]


def node_id(domain: str, subdomain: str, name: str):
    """The id that `node_parts` reads."""
    return F.concat_ws("::", domain, subdomain, name)
