from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.functions import identity
from weftgraph.operators import mutate, temporal

N = "id string, label string, name string, summary string, description string, domain string, subdomain string, confidence double, provenance string, source_refs string, updated_at timestamp_ntz"
E = "id long, source_id string, target_id string, kind string, description string, confidence double, provenance string, created_at timestamp_ntz"
S = "node_uuid string, member_id string, file_path string, skill string, start_line int, end_line int"


def node(i, prov="llm_inferred", sub="s", label="Entity"):
    return (i, label, f"name {i}", "sum", None, "d", sub, 0.5, prov, None, None)


def graph(spark):
    nodes = spark.createDataFrame([node("a"), node("b"), node("c", "human_curated"), node("h"), node("z", sub="t")], N)
    edges = spark.createDataFrame([(1, "a", "b", "references", "x", 0.5, "llm_inferred", None), (2, "a", "b", "references", "y", 0.6, "llm_inferred", None), (3, "b", "h", "references", None, 0.7, "human_curated", None), (4, "a", "c", "triggers", None, 0.7, "llm_inferred", None), (5, "z", "a", "references", None, 0.2, "llm_inferred", None)], E)
    sources = spark.createDataFrame([("a", "m1", "f1", "sk1", 1, 2), ("b", "m2", "f1", "sk1", 1, 2), ("b", "m3", "f2", "sk2", None, None), ("c", "m4", "f1", "sk1", 3, 4), ("h", "m5", "f1", "sk1", 3, 4), ("z", "m6", "f3", "sk3", 3, 4)], S)
    return nodes, edges, sources


def test_collapse_keeps_the_least_id_and_the_last_payload(spark):
    nodes, edges, _ = graph(spark)
    got = {(r.source_id, r.target_id): (r.id, r.description, r.confidence) for r in mutate.collapse_edges(edges).collect()}
    assert got["a", "b"] == (1, "y", 0.6) and len(got) == 4
    new = spark.createDataFrame([(9, "a", "b", "references", "new", 7.0, "odd", None), (10, "a", "none", "references", None, 0.5, "extraction", None)], E)
    done = {(r.source_id, r.target_id): (r.id, r.description, r.confidence, r.provenance) for r in mutate.upsert_checked(edges, new, nodes).collect()}
    assert done["a", "b"] == (1, "new", 0.8, "llm_inferred") and ("a", "none") not in done


def test_deleted_documents_count_references(spark):
    nodes, edges, sources = graph(spark)
    done = mutate.delete_documents(nodes, edges, sources, spark.createDataFrame([("f1",)], "file_path string"))
    assert rows(done["deleted"]) == [("a",)]  # b has f2 left, c is curated, h has a curated edge
    assert {r.id: r.source_refs for r in done["nodes"].collect()} == {"b": "sk2", "c": None, "h": None, "z": None}
    assert sorted(r.id for r in done["edges"].collect()) == [3]
    assert rows(done["docs"]) == [("f2",), ("f3",)]


def test_replace_semantic_keeps_human_edges(spark):
    nodes, edges, _ = graph(spark)
    new = spark.createDataFrame([(0, "b", "h", "references", "machine", 0.1, "extraction", None), (0, "a", "c", "triggers", "better", 0.9, "extraction", None), (0, "a", "h", "triggers", None, float("nan"), "extraction", None), (0, "a", "a", "triggers", None, 0.3, "extraction", None), (0, "a", "gone", "triggers", None, 0.3, "extraction", None)], E)
    got = {(r.source_id, r.target_id): (r.id, r.description, r.confidence, r.provenance) for r in mutate.replace_semantic(edges, new, nodes, "d", "s").collect()}
    assert got == {("b", "h"): (3, None, 0.7, "human_curated"), ("a", "c"): (4, "better", 0.9, "llm_inferred"), ("a", "h"): (None, None, 0.8, "extraction"), ("z", "a"): (5, None, 0.2, "llm_inferred")}


def test_machine_content_spares_humans(spark):
    nodes, _, _ = graph(spark)
    new = spark.createDataFrame([("a", "new", None, 0.5), ("c", "new", None, 0.5), ("b", "sum", None, 0.5)], "id string, summary string, description string, confidence double")
    got = {r.id: (r.summary, r.updated_at is None) for r in mutate.update_machine_content(nodes, new).collect()}
    assert got["a"] == ("new", False) and got["c"] == ("sum", True) and got["b"] == ("sum", True)


def test_merge_and_split(spark):
    nodes, edges, sources = graph(spark)
    done = mutate.merge_nodes(nodes, edges, sources, spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "c")], "set_id string, id string"))
    assert rows(done["lineage"]) == [("b", "a", "merged"), ("b", "c", "merged")]
    assert {r.id: r.provenance for r in done["nodes"].collect()} == {"b": "human_curated", "h": "llm_inferred", "z": "llm_inferred"}
    assert sorted((r.source_id, r.target_id, r.id) for r in done["edges"].collect()) == [("b", "h", 3), ("z", "b", 5)]
    assert {r.node_uuid for r in done["sources"].collect()} == {"b", "h", "z"}
    parts = spark.createDataFrame([("b", "one", ["m2"]), ("b", "two", ["m3"]), ("a", "part", ["m1", "unknown"])], "id string, name string, members array<string>")
    cut = mutate.split_nodes(nodes, sources, parts, identity.node_uuid(F.col("members")))
    assert rows(cut["rejected"]) == [("a",)] and cut["lineage"].count() == 2 and cut["nodes"].where("name in ('one', 'two')").count() == 2
    assert cut["sources"].count() == 6 and cut["sources"].where("node_uuid = 'b'").count() == 0


def test_sources_keep_the_earliest_valid_span(spark):
    df = spark.createDataFrame([("a", "m", "f", "s", 9, 10), ("a", "m", "f", "s", 3, 4), ("a", "m", "f", "s", 1, None), ("b", "m", "f", "s", None, None), ("b", "m", "f", "t", 5, 2)], S.replace("file_path string, skill string", "file_path string, skill string"))
    assert rows(mutate.collapse_sources(df).select("node_uuid", "start_line", "end_line")) == [("a", 3, 4), ("b", 5, 2)]
    assert mutate.upsert_report(df).first().asDict() == {"attempted": 5, "kept": 2, "repeated": 3, "conflicting": 1}


def test_diff_with_lineage_and_cycles(spark):
    n = "id string, domain string, subdomain string, name string, summary string, description string, confidence double"
    old = spark.createDataFrame([(i, "d", "s", i, "x", None, 0.5) for i in ("same", "text", "moved", "named", "gone", "merged", "cut", "loop1")], n)
    new = spark.createDataFrame([("same", "d", "s", "same", "x", None, 0.5), ("text", "d", "s", "text", "y", None, 0.5), ("moved", "d", "t", "moved", "y", None, 0.5), ("named", "d", "s", "other", "x", None, 0.5), ("p1", "d", "s", "p1", "x", None, 0.5), ("p2", "d", "s", "p2", "x", None, 0.5), ("fresh", "d", "s", "f", "x", None, 0.5)], n)
    lin = spark.createDataFrame([("same", "merged", "merged"), ("p1", "cut", "split"), ("p2", "cut", "split"), ("loop2", "loop1", "merged"), ("loop1", "loop2", "merged")], "new_uuid string, old_uuid string, reason string")
    got = {r.id: (r.category, r.changed, r.targets) for r in temporal.diff_nodes(old, new, lin).collect()}
    assert {k: v[0] for k, v in got.items()} == {"same": "unchanged", "text": "content", "moved": "migrated", "named": "renamed", "gone": "deleted", "merged": "merged_into", "cut": "split_into", "loop1": "deleted", "fresh": "added"}
    assert got["text"][1] == ["summary"] and got["cut"][2] == ["p1", "p2"]
    lines = temporal.render(temporal.diff_nodes(old, new, lin)).first().markdown.split("\n")
    assert lines[0].startswith("- added fresh") and len(lines) == 8


def test_latest_follows_the_newest_successor_and_stops_on_cycles(spark):
    from datetime import datetime

    lin = spark.createDataFrame([("b", "a", datetime(2025, 1, 1)), ("c", "a", datetime(2025, 2, 1)), ("d", "c", datetime(2025, 1, 1)), ("y", "x", datetime(2025, 1, 1)), ("x", "y", datetime(2025, 1, 1))], "new_uuid string, old_uuid string, created_at timestamp_ntz")
    ids = spark.createDataFrame([("a",), ("b",), ("x",), ("alone",)], "id string")
    assert rows(temporal.latest_of(ids, lin)) == [("a", "d"), ("alone", "alone"), ("b", "b"), ("x", "y")]
