"""What a user asks of a knowledge base: one function for each command and tool, each returning a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.fulltext import rewrite
from weftgraph.operators import graph, search, temporal
from weftgraph.sources.graph import Graph

DEPTHS = ("summary", "entity", "neighborhood", "subgraph")


class KnowledgeBase:
    """Read-only questions to one graph. The index is built when it is first needed and kept in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str = "default", abbreviations: dict[str, str] | None = None, min_confidence: float = 0.0) -> None:
        self.graph, self.name = Graph(spark, sf_dir), name
        self.spark, self.abbreviations, self.min_confidence = spark, abbreviations or {}, min_confidence

    @cached_property
    def index(self) -> search.Index:
        return search.Index.of_table(self.graph.raw("nodes"), self.graph.nodes, "id", list(search.FIELDS))

    def _hits(self, query: str, syntax: str = "text") -> DataFrame:
        if not query.strip():
            raise ValueError("blank query")
        if syntax not in ("text", "boolean"):
            raise ValueError(f"unknown syntax: {syntax}")
        if syntax == "boolean":
            return search.match(self.index, query).select(F.lit("q").alias("qid"), "id", F.lit(-1.0).alias("rank"))
        return self.index.score(search.query_frame(self.spark, {"q": rewrite(query, self.abbreviations)}))

    def find(self, query: str, limit: int = 10, domains: Sequence[str] = (), labels: Sequence[str] = (), syntax: str = "text") -> DataFrame:
        """Nodes for a query with score, depth and the edges that lead to them; at most ten."""
        if not 0 < limit <= 50:
            limit = 10
        hits = self._hits(query, syntax)
        if domains or labels:  # after the statistics of the whole index
            own = self.graph.nodes
            own = own.where(F.col("domain").isin(list(domains))) if domains else own
            own = own.where(F.col("label").isin(list(labels))) if labels else own
            hits = hits.join(own.select("id"), "id", "left_semi")
        best = search.hybrid(self.graph.nodes, self.graph.edges, hits, limit, min_confidence=self.min_confidence, domains=domains)
        into = graph.incoming(self.graph.edges, best).groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source_id", "kind"))).alias("incoming"))
        return best.join(self.graph.nodes.select("id", "label", "name", "summary", "domain"), "id").join(into, "id", "left").drop("qid").orderBy("place")

    def impact(self, query: str, depth: int = 2, min_confidence: float = 0.0) -> DataFrame:
        """What depends on the three best nodes of a query, by depth and id."""
        found = search.impact(self.graph.nodes, self.graph.edges, self._hits(query), depth, min_confidence)
        return found.join(self.graph.nodes.select("id", "label", "name", "domain"), "id").drop("qid").orderBy("depth", "id")

    def query(self, text: str, depth: str = "summary", max_tokens: int = 0) -> DataFrame:
        """Results in one of four depths, within a budget of estimated tokens (the row that passes it is kept)."""
        if depth not in DEPTHS:
            raise ValueError(f"depth must be one of {', '.join(DEPTHS)}")
        if max_tokens < 0:
            raise ValueError("max_tokens is negative")
        best = self.find(text)
        if depth == "summary":
            rows = best.select("place", "id", "name", F.coalesce("summary", F.lit("")).alias("text"))
        elif depth == "entity":
            more = self.graph.nodes.select("id", F.concat_ws("\n", "summary", "description").alias("text"))
            rows = best.select("place", "id", "name").join(more, "id").select("place", "id", "name", "text")
        elif depth == "neighborhood":
            near = graph.neighbours(self.graph.edges, self.graph.nodes).join(self.graph.nodes.select(F.col("id").alias("neighbour"), F.col("name").alias("other")), "neighbour")
            text_ = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "relation", "other"))), "\n").alias("text")
            rows = best.select("place", "id", "name").join(near.groupBy("id").agg(text_), "id", "left").select("place", "id", "name", F.coalesce("text", F.lit("")).alias("text"))
        else:
            rel = graph.relation_paths(self.graph.edges).select(F.col("source_id").alias("id"), F.array_join("relations", "\n").alias("text"))
            rows = best.select("place", "id", "name").join(rel, "id", "left").select("place", "id", "name", F.coalesce("text", F.lit("")).alias("text"))
        costed = rows.withColumn("tokens", search.token_estimate(F.concat_ws(" ", "id", "name", "text"))).withColumn("all", F.lit(1))
        return search.within_budget(costed, ["all"], ["place"], F.col("tokens"), max_tokens).drop("all").orderBy("place")

    def show(self, node_id: str, lineage: DataFrame | None = None) -> DataFrame:
        """A node with its edges; an id that is gone is followed through the lineage."""
        ids = self.spark.createDataFrame([(node_id.strip().lower(),)], "id string")
        if lineage is not None:
            gone = ids.join(self.graph.nodes.select("id"), "id", "left_anti")
            ids = ids.join(self.graph.nodes.select("id"), "id", "left_semi").unionByName(temporal.latest_of(gone, lineage).select(F.col("latest").alias("id")))
        out = self.graph.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("kind", "target_id"))).alias("outgoing"))
        into = graph.incoming(self.graph.edges, ids).groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("kind", "source_id"))).alias("incoming"))
        return self.graph.nodes.join(ids, "id", "left_semi").join(out, "id", "left").join(into, "id", "left")

    resolve_node = show

    def status(self) -> DataFrame:
        """Counts by label, domain and kind, and in all: what, key, n."""
        from weftgraph.plans.registry import QUERIES

        return QUERIES["a2_status"](self.spark, self.graph.sf_dir)

    def why(self, node_id: str) -> DataFrame:
        """Where a node comes from: its members and spans."""
        return self.graph.sources.where(F.col("node_uuid") == node_id.strip().lower()).orderBy("member_id", "file_path")

    def timeline(self) -> DataFrame:
        return self.graph.changesets.select("seq", "ts", "tool", "kb_version", "parent_version", "trigger_reason", "summary").orderBy("seq")

    def changeset(self, version: str) -> DataFrame:
        """What a version changed, from the snapshots."""
        from weftgraph.plans.problems import p6_found

        return p6_found(self.spark, self.graph.sf_dir).where(F.col("kb_version") == version)

    def sentinel(self, thresholds: dict[str, float] | None = None, change_ratio: float = 0.0, changed_docs: int = 0) -> DataFrame:
        return graph.breaches(graph.structure(self.graph.nodes, self.graph.edges), thresholds, change_ratio, changed_docs)

    def list_domains(self) -> DataFrame:
        from weftgraph.plans.registry import QUERIES

        return QUERIES["a6_domains"](self.spark, self.graph.sf_dir)


def list_knowledge_bases(bases: Sequence[KnowledgeBase]) -> DataFrame:
    """kb, n_nodes, n_edges of each."""
    parts = [b.graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(F.broadcast(b.graph.edges.agg(F.count(F.lit(1)).alias("n_edges"))), F.lit(True)).select(F.lit(b.name).alias("kb"), "n_nodes", "n_edges") for b in bases]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def federated(bases: Sequence[KnowledgeBase], ask: Callable[[KnowledgeBase], DataFrame], limit: int = 10) -> tuple[DataFrame, dict[str, str]]:
    """Results (with score and id) of all bases as one list, and why a base failed; only if all fail is it an error."""
    parts, failed = {}, {}
    for b in bases:
        try:
            parts[b.name] = ask(b).select(F.lit("q").alias("qid"), "id", "score")
        except Exception as e:
            failed[b.name] = str(e)
    if not parts:
        raise RuntimeError("; ".join(f"{k}: {v}" for k, v in failed.items()))
    return search.federate(parts, limit).drop("qid"), failed
