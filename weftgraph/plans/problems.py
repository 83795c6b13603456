"""The general data problems: intervals, missing references, changes between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import base_name, node_key, source_path
from weftgraph.operators.intervals import covered_and_gaps
from weftgraph.operators.orphans import earliest, orphan_cascade
from weftgraph.operators.snapshots import consecutive_pairs, diff_snapshots, digest_rows
from weftgraph.sources.tables import table

#: Columns whose change makes a node a changed one.
SNAPSHOT_COLUMNS = ["label", "name", "summary", "description", "domain", "subdomain", "confidence"]

_BLANK = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"


def _squeeze(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '[{_BLANK}]+', ' ', 'g'))"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered stretches and gaps of each file."""
    spans = table(spark, sf_dir, "node_sources").select(source_path(F.col("file_path")).alias("file_path"), "start_line", "end_line")
    out = covered_and_gaps(spans, ["file_path"], "start_line", "end_line")
    return out.select("file_path", "kind", F.col("start").cast("int").alias("start_line"), F.col("end").cast("int").alias("end_line"))


P3_FOUND = f"""
WITH spans AS (
  SELECT regexp_replace({_strip('file_path')}, '^\\./', '') AS file_path, start_line AS s, end_line AS e
  FROM node_sources WHERE file_path IS NOT NULL AND start_line >= 1 AND start_line <= end_line),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
islands AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY s, e) AS island FROM marked),
covered AS (SELECT file_path, island, min(s) AS s, max(e) AS e FROM islands GROUP BY file_path, island)
SELECT file_path, 'covered' AS kind, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line FROM covered
UNION ALL
SELECT file_path, 'gap', CAST(e + 1 AS INTEGER), CAST(n - 1 AS INTEGER)
FROM (SELECT *, lead(s) OVER (PARTITION BY file_path ORDER BY s) AS n FROM covered) WHERE n IS NOT NULL
"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    edges = table(spark, sf_dir, "edges").select(
        F.lit("edges").alias("ref_table"), F.col("id").cast("string").alias("ref_key"), none.alias("own_key"), node_key(F.col("target_id")).alias("key"), F.col("created_at").alias("ref_time")
    )
    cross = table(spark, sf_dir, "cross_references").select(
        F.lit("cross_references").alias("ref_table"), F.col("id").cast("string").alias("ref_key"), none.alias("own_key"), node_key(F.col("target_node_id")).alias("key"), F.col("created_at").alias("ref_time")
    )
    natural = ["node_uuid", "member_id", "file_path"]
    sources = earliest(table(spark, sf_dir, "node_sources").select(*natural, "ingested_at"), natural, "ingested_at").select(
        F.lit("node_sources").alias("ref_table"),
        F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in natural]).alias("ref_key"),
        none.alias("own_key"),
        node_key(F.col("node_uuid")).alias("key"),
        F.col("ingested_at").alias("ref_time"),
    )
    return edges.unionByName(cross).unionByName(sources)


def _node_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes").select(F.lit("nodes").alias("parent_table"), node_key(F.col("id")).alias("key"), F.col("created_at").alias("since"))
    found = orphan_cascade(_references(spark, sf_dir), nodes, {"edges": "nodes", "cross_references": "nodes", "node_sources": "nodes"})
    return found.withColumn("period", F.coalesce(F.date_format("ref_time", "yyyy-MM"), F.lit("unknown")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to nodes that are missing or came only later, by table and month."""
    return _node_orphans(spark, sf_dir).select("ref_table", "ref_key", "state", "period").distinct()


P4_FOUND = f"""
WITH known AS (SELECT lower({_strip('id')}) AS key, min(created_at) AS since FROM nodes GROUP BY 1),
refs AS (
  SELECT 'edges' AS ref_table, CAST(id AS VARCHAR) AS ref_key, lower({_strip('target_id')}) AS key, created_at AS t FROM edges
  UNION ALL SELECT 'cross_references', CAST(id AS VARCHAR), lower({_strip('target_node_id')}), created_at FROM cross_references
  UNION ALL SELECT 'node_sources', node_uuid || '|' || member_id || '|' || file_path, lower({_strip('node_uuid')}), min(ingested_at)
  FROM node_sources GROUP BY node_uuid, member_id, file_path)
SELECT DISTINCT ref_table, ref_key, CASE WHEN known.key IS NULL THEN 'missing' ELSE 'late' END AS state,
  coalesce(strftime(t, '%Y-%m'), 'unknown') AS period
FROM refs LEFT JOIN known ON refs.key = known.key
WHERE refs.key IS NOT NULL AND refs.key <> '' AND (known.key IS NULL OR since > t)
"""


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and late references per table, month and kind: no table refers to one of these, so each orphan is a direct one."""
    once = _node_orphans(spark, sf_dir).select("ref_table", "ref_key", "state", "period", "kind").distinct()
    return once.groupBy("ref_table", "period", "state", "kind").agg(F.count(F.lit(1)).alias("n_refs"))


P4_REPORT = f"SELECT ref_table, period, state, 'direct' AS kind, count(*) AS n_refs FROM ({P4_FOUND}) GROUP BY ref_table, period, state"


def p4_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changesets without their parent, those below them, and the snapshot rows of either: direct and inherited orphans."""
    log = table(spark, sf_dir, "changesets").select("kb_version", "parent_version", base_name(F.col("snapshot_file")).alias("file"), "ts")
    changes = log.select(
        F.lit("changesets").alias("ref_table"), F.col("kb_version").alias("ref_key"), F.col("kb_version").alias("own_key"), F.nullif("parent_version", F.lit("")).alias("key"), F.col("ts").alias("ref_time")
    ).distinct()
    owner = log.where("kb_version is not null").groupBy("file").agg(F.min("kb_version").alias("owner"))
    rows = table(spark, sf_dir, "node_snapshots").select(base_name(F.col("snapshot_file")).alias("file")).distinct().join(owner, "file", "left")
    snaps = rows.select(
        F.lit("node_snapshots").alias("ref_table"), F.col("file").alias("ref_key"), F.lit(None).cast("string").alias("own_key"), F.coalesce("owner", "file").alias("key"), F.lit(None).cast("timestamp_ntz").alias("ref_time")
    )
    keys = log.select(F.lit("changesets").alias("parent_table"), F.col("kb_version").alias("key"), F.lit(None).cast("timestamp_ntz").alias("since"))
    found = orphan_cascade(changes.unionByName(snaps), keys, {"changesets": "changesets", "node_snapshots": "changesets"})
    return found.select("ref_table", "ref_key", "kind", "depth")


P4_CASCADE = f"""
WITH RECURSIVE log AS (
  SELECT DISTINCT kb_version AS v, nullif(parent_version, '') AS p, regexp_extract({_strip('snapshot_file')}, '([^/\\\\]*)$', 1) AS file FROM changesets),
owner AS (SELECT file, min(v) AS v FROM log GROUP BY file),
direct AS (SELECT DISTINCT v, 0 AS depth FROM log WHERE p IS NOT NULL AND p NOT IN (SELECT v FROM log)),
below AS (
  SELECT v, depth FROM direct
  UNION
  SELECT log.v, below.depth + 1 FROM below JOIN log ON log.p = below.v),
orphans AS (SELECT v, min(depth) AS depth FROM below GROUP BY v),
files AS (SELECT DISTINCT regexp_extract({_strip('snapshot_file')}, '([^/\\\\]*)$', 1) AS file FROM node_snapshots)
SELECT 'changesets' AS ref_table, v AS ref_key, CASE depth WHEN 0 THEN 'direct' ELSE 'inherited' END AS kind, CAST(depth AS INTEGER) AS depth FROM orphans
UNION ALL
SELECT 'node_snapshots', file, CASE WHEN owner.v IS NULL THEN 'direct' ELSE 'inherited' END, CAST(CASE WHEN owner.v IS NULL THEN 0 ELSE orphans.depth + 1 END AS INTEGER)
FROM files LEFT JOIN owner USING (file) LEFT JOIN orphans ON orphans.v = owner.v WHERE owner.v IS NULL OR orphans.v IS NOT NULL
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes added, removed or changed by each changeset, from the snapshots alone."""
    snapshots = table(spark, sf_dir, "node_snapshots")
    rows = digest_rows(snapshots, base_name(F.col("snapshot_file")), "id", SNAPSHOT_COLUMNS)
    pairs = consecutive_pairs(table(spark, sf_dir, "changesets"), "kb_version", "parent_version", base_name(F.col("snapshot_file")))
    return diff_snapshots(rows, pairs).select(F.col("pair").alias("kb_version"), F.col("key").alias("node_id"), "change")


P6_FOUND = f"""
WITH log AS (
  SELECT DISTINCT kb_version AS v, parent_version AS p, regexp_extract({_strip('snapshot_file')}, '([^/\\\\]*)$', 1) AS file FROM changesets),
snap AS (
  SELECT DISTINCT regexp_extract({_strip('snapshot_file')}, '([^/\\\\]*)$', 1) AS file, id,
    {', '.join(_squeeze(c) + f' AS {c}' for c in SNAPSHOT_COLUMNS[:-1])}, confidence
  FROM node_snapshots),
pairs AS (
  SELECT a.v, a.file AS new, b.file AS old FROM log a JOIN log b ON a.p = b.v
  WHERE a.v <> b.v AND a.file IN (SELECT file FROM snap) AND b.file IN (SELECT file FROM snap)),
n AS (SELECT pairs.v, snap.* FROM pairs JOIN snap ON snap.file = pairs.new),
o AS (SELECT pairs.v, snap.* FROM pairs JOIN snap ON snap.file = pairs.old)
SELECT coalesce(n.v, o.v) AS kb_version, coalesce(n.id, o.id) AS node_id,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.v = o.v AND n.id = o.id
WHERE o.id IS NULL OR n.id IS NULL OR {' OR '.join(f'n.{c} IS DISTINCT FROM o.{c}' for c in SNAPSHOT_COLUMNS)}
"""

QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_report": p4_report, "p4_cascade": p4_cascade, "p6_found": p6_found}
SQL = {"p3_found": P3_FOUND, "p4_found": P4_FOUND, "p4_report": P4_REPORT, "p4_cascade": P4_CASCADE, "p6_found": P6_FOUND}
