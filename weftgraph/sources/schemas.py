"""Declared schemas, enumerations and the contract a data folder must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations of the data model.
LABELS = ("Entity", "Concept", "Skill", "Domain", "Subdomain")
CONTENT_LABELS = ("Entity", "Concept")
KINDS = ("composes", "depends_on", "references", "triggers", "generalizes", "contradicts", "provides")
SEMANTIC_KINDS = tuple(k for k in KINDS if k != "provides")
PROVENANCES = ("extraction", "llm_inferred", "human_curated")
LINEAGE_REASONS = ("merged", "split")
KIND_PRIORITY = {"triggers": 0, "depends_on": 1, "references": 2}
DEFAULT_CONFIDENCE = 0.8


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp_ntz": T.TimestampNTZType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, text.split(", "))])


NODES = _schema(
    "id string, label string, name string, summary string, synonyms string, domain string, subdomain string, description string, properties string, tags string, related_entities string, confidence double, provenance string, source_refs string, file_slug string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
EDGES = _schema(
    "id long, source_id string, target_id string, kind string, description string, properties string, provenance string, confidence double, source_refs string, bidirectional int, cardinality string, created_at timestamp_ntz"
)
NODE_SOURCES = _schema("node_uuid string, member_id string, skill string, file_path string, start_line int, end_line int")
LINEAGE = _schema("new_uuid string, old_uuid string, reason string, created_at timestamp_ntz")
CROSS_REFERENCES = _schema("id long, source_entity string, target_entity string, target_node_id string, kind string, reason string, resolution_status string, created_at timestamp_ntz")
CONFLICTS = _schema("id long, entity_name string, conflicting_sources string, resolution_status string, resolution_note string, resolved_by string, created_at timestamp_ntz")
FILE_STATES = _schema("repo_url string, file_path string, content_hash string, indexed_at timestamp_ntz")
KB_VERSIONS = _schema("version string, updated_at timestamp_ntz")
MANIFEST = _schema("key string, value string")
CONTRACT = {"nodes": NODES, "edges": EDGES, "node_sources": NODE_SOURCES, "cross_references": CROSS_REFERENCES}


def violations(df: DataFrame, declared: T.StructType) -> list[str]:
    """What keeps a table from its declared schema: columns that are missing or of another type. More columns are fine."""
    have = dict(df.dtypes)
    out = []
    for f in declared.fields:
        kind = f.dataType.simpleString()
        if f.name not in have:
            out.append(f"{f.name} is missing")
        elif have[f.name] != kind and {have[f.name], kind} != {"timestamp", "timestamp_ntz"}:
            out.append(f"{f.name} is {have[f.name]}, not {kind}")
    return out


def require(df: DataFrame, declared: T.StructType) -> DataFrame:
    """`df` in the declared column order; fails closed where it does not meet the schema."""
    if found := violations(df, declared):
        raise ValueError("; ".join(found))
    return df.select(*declared.fieldNames())


def with_missing(df: DataFrame, declared: T.StructType) -> DataFrame:
    """Older tables lack columns: they are added as null."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in declared.fields if f.name not in df.columns})


def kind_priority(kind: Column) -> Column:
    """Order in which relation kinds are followed."""
    out = F.lit(3)
    for k, v in KIND_PRIORITY.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def is_valid_edge(df_prefix: str = "") -> Column:
    """The checks an edge row must pass."""
    c = lambda x: F.col(df_prefix + x)
    return F.coalesce(c("kind").isin(*KINDS) & c("provenance").isin(*PROVENANCES) & c("confidence").between(0, 1) & (F.trim(c("source_id")) != "") & (F.trim(c("target_id")) != ""), F.lit(False))


def is_valid_node() -> Column:
    return F.coalesce(F.col("label").isin(*LABELS) & F.col("provenance").isin(*PROVENANCES) & F.col("confidence").between(0, 1) & (F.trim("id") != ""), F.lit(False))


def timestamp(c: Column) -> Column:
    """The three accepted layouts of a time as text; null where none fits."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX")), F.try_to_timestamp(c))
