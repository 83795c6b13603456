"""The graph as the operators read it: repeated deliveries taken out, keys in one form."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import node_key, source_path
from weftgraph.sources.tables import table


@dataclass
class Graph:
    """Nodes, edges and sources of one data folder. Every table is a plan, read when it is used."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def nodes(self) -> DataFrame:
        """One row for each id: rows that come twice are equal, so only the id is compared and only the columns a query uses are read."""
        return self.raw("nodes").dropDuplicates(["id"])

    @cached_property
    def edges(self) -> DataFrame:
        """One row for each edge id, the latest delivered; endpoints in lower case without outer blanks."""
        w = Window.partitionBy("id").orderBy(F.col("ingested_at").desc_nulls_last(), "source_id", "target_id")
        once = self.raw("edges").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        return once.withColumns({"source_id": node_key(F.col("source_id")), "target_id": node_key(F.col("target_id"))})

    @cached_property
    def sources(self) -> DataFrame:
        """One row for each (node, member, file): the one with the earliest valid span."""
        from weftgraph.operators.mutate import collapse_sources

        rows = self.raw("node_sources").withColumns({"node_uuid": node_key(F.col("node_uuid")), "file_path": source_path(F.col("file_path"))})
        return collapse_sources(rows)

    @cached_property
    def cross_references(self) -> DataFrame:
        return self.raw("cross_references").withColumn("target_node_id", node_key(F.col("target_node_id"))).distinct()

    @cached_property
    def changesets(self) -> DataFrame:
        """One row for each sequence number; the newest by time where they differ."""
        w = Window.partitionBy("seq").orderBy(F.col("ts").desc_nulls_last(), "snapshot_file")
        return self.raw("changesets").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


_BLANK = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"


def _key(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')), '')"


_EDGE_REST = "kind, description, properties, provenance, confidence, source_refs, bidirectional, cardinality, created_at, ingested_at"
#: The same tables for the SQL that checks the queries.
GRAPH_SQL = rf"""n AS (SELECT DISTINCT * FROM nodes),
e AS (SELECT id, {_key('source_id')} AS source_id, {_key('target_id')} AS target_id, {_EDGE_REST} FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, source_id, target_id) AS rn FROM edges) WHERE rn = 1),
s AS (SELECT node_uuid, member_id, skill, file_path, start_line, end_line FROM (
  SELECT *, row_number() OVER (PARTITION BY node_uuid, member_id, file_path ORDER BY
    CASE WHEN start_line >= 1 AND end_line >= start_line THEN 0 WHEN coalesce(start_line, 0) > 0 OR coalesce(end_line, 0) > 0 THEN 1 ELSE 2 END, start_line NULLS LAST, end_line NULLS LAST, skill) AS rn
  FROM (SELECT {_key('node_uuid')} AS node_uuid, member_id, skill, regexp_replace(regexp_replace(file_path, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'), '^\./', '') AS file_path, start_line, end_line FROM node_sources)) WHERE rn = 1),
x AS (SELECT DISTINCT id, source_entity, target_entity, {_key('target_node_id')} AS target_node_id, kind, reason, resolution_status, created_at FROM cross_references),
c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ts DESC NULLS LAST, snapshot_file) AS rn FROM changesets) WHERE rn = 1)"""
