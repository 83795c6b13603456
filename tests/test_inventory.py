"""Rules of small operators on rows written by hand; the queries compare them with SQL on whole tables."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.functions import fulltext, identity, text
from weftgraph.operators import build, graph, mutate, resolve, search, skew, temporal
from weftgraph.sources import documents, tables


def test_identity_is_inserted_once_and_never_changed(spark):
    known = spark.createDataFrame([("a", "x")], "repo_url string, identity string")
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "repo_url string, identity string")
    assert rows(mutate.insert_identity(known, new, ["repo_url"], "identity")) == [("a", "x"), ("b", "y")]
    with pytest.raises(Exception, match="another identity"):
        mutate.insert_identity(known, spark.createDataFrame([("a", "z")], "repo_url string, identity string"), ["repo_url"], "identity").collect()


def test_a_batch_keeps_what_humans_wrote(spark):
    cols = "id string, label string, domain string, subdomain string, name string, summary string, description string, confidence double, provenance string, source_refs string, updated_at timestamp_ntz"
    node = lambda i, s, p="extraction": (i, "Entity", "d", "s", i, s, None, 0.5, p, "", None)
    nodes = spark.createDataFrame([node("a", "old"), node("b", "mine", "human_curated"), ("domain::d", "Domain", "d", None, "d", None, None, 1.0, "extraction", "k", None)], cols)
    edges = spark.createDataFrame([(1, "skill::gone", "domain::d", "provides", "extraction", 1.0, None), (2, "a", "b", "references", "extraction", 0.5, None)], "id long, source_id string, target_id string, kind string, provenance string, confidence double, created_at timestamp_ntz")
    sources = spark.createDataFrame([("a", "m", "f", "k", 1, 2)], "node_uuid string, member_id string, file_path string, skill string, start_line int, end_line int")
    out = mutate.apply_batch(nodes, edges, sources, spark.createDataFrame([node("a", "new"), node("b", "new"), node("c", "fresh")], cols), spark.createDataFrame([(9, "c", "nowhere", "references", "extraction", 0.5, None)], edges.schema), spark.createDataFrame([("c", "m2", "g", "l", 1, 2)], sources.schema))
    got = {r.id: (r.summary, r.source_refs) for r in out["nodes"].collect()}
    assert got == {"a": ("new", "k"), "b": ("mine", ""), "c": ("fresh", "l"), "domain::d": (None, "k,l")}
    assert [r.id for r in out["edges"].collect()] == [2]


def test_recomputed_relations_keep_id_and_confidence(spark):
    nodes = spark.createDataFrame([("a", "Entity", "d", "s"), ("b", "Entity", "d", "t"), ("c", "Concept", "d", "t")], "id string, label string, domain string, subdomain string")
    shape = "id long, source_id string, target_id string, kind string, provenance string, confidence double, description string, created_at timestamp_ntz"
    edges = spark.createDataFrame([(1, "a", "b", "references", "extraction", 0.9, "x", None), (2, "a", "c", "triggers", "extraction", 0.4, "y", None), (3, "a", "c", "composes", "human_curated", 0.4, "z", None), (4, "b", "c", "triggers", "extraction", 0.4, "w", None)], shape)
    new = spark.createDataFrame([(None, "a", "b", "references", None, 0.1, "n", None), (None, "a", "c", "depends_on", None, 7.0, "m", None), (None, "a", "c", "composes", None, 0.1, "q", None), (None, "b", "c", "references", None, 0.1, "o", None)], shape)
    out = mutate.recomputed_relations(edges, new, nodes, spark.createDataFrame([("d", "s")], "domain string, subdomain string"))
    assert sorted((r.id or 0, r.kind, r.confidence, r.description) for r in out.collect()) == [(0, "depends_on", 0.8, "m"), (1, "references", 0.9, "n"), (3, "composes", 0.4, "z"), (4, "triggers", 0.4, "w")]


def test_small_expressions(spark):
    df = spark.createDataFrame([(" n​x ", "```json\n{}\n```\n", "Ｆull  Width", '{"a":1,"b":{"c":1,"c":2}}', "2025-01-02 03:04:05.120")], "a string, b string, c string, d string, t string")
    got = df.select(
        build.persisted_name(F.col("a")), build.without_fence(F.col("b")), text.fold_compatible(F.col("c")), text.strict_object(F.col("d")), identity.rfc3339_nano(F.to_timestamp_ntz("t")), fulltext.expand_words(F.lit("ab abc AB ab."), {"ab": "x$1"}), identity.djb2(F.lit("ab")),
    ).first()
    assert tuple(got) == (None, "{}", "full width", False, "2025-01-02T03:04:05.12Z", "x$1 abc AB x$1.", (5381 * 33 + 97) * 33 + 98)


def test_blocks_rendered_and_read_again(spark):
    nodes = spark.createDataFrame([("aa-1", "One", "text"), ("bb-2", "Two", None), ("cc-3", None, "x")], "id string, name string, summary string")
    sources = spark.createDataFrame([("aa-1", "f"), ("bb-2", "f"), ("bb-2", "g"), ("cc-3", "g"), ("aa-1", "")], "node_uuid string, file_path string")
    parsed = documents.blocks(documents.render_blocks(nodes, sources), "file_path", "text")
    assert rows(parsed.select("path", "kind", "uuid", "body")) == [("f", "block", "aa-1", "# One\ntext"), ("f", "block", "bb-2", "# Two"), ("g", "block", "bb-2", "# Two")]
    assert rows(documents.classify_edits(parsed, documents.sidecar(parsed))) == []


def test_reports_and_lineage_of_ids(spark):
    lin = spark.createDataFrame([("b", "a", None), ("c", "b", None), ("d", "b", None), ("y", "x", None), ("x", "y", None)], "new_uuid string, old_uuid string, created_at timestamp_ntz")
    ids = spark.createDataFrame([("a",), ("b",), ("x",), ("z",)], "id string")
    got = {r.id: (r.predecessors, r.successors, r.terminals) for r in temporal.why(ids, lin).collect()}
    assert got == {"a": ([], ["b"], ["c", "d"]), "b": (["a"], ["c", "d"], ["c", "d"]), "x": (["y"], ["y"], []), "z": ([], [], [])}
    fields = "id string, domain string, subdomain string, name string, summary string, description string, confidence double"
    old = spark.createDataFrame([("a", "d", "s", "n", "x", None, 1.0), ("b", "d", "s", "n", "x", None, 1.0)], fields)
    new = spark.createDataFrame([("b", "d", "s", "m", "x", None, 1.0), ("c", "d", "s", "n", "x", None, 1.0)], fields)
    lines = temporal.listed(temporal.diff_nodes(old, new)).collect()
    assert [(r.id, r.category) for r in lines] == [("c", "added"), ("a", "deleted"), ("b", "renamed")] and lines[2].line == "- renamed b name" and '"changed":["name"]' in lines[2].json


def test_hot_keys_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HOT", 2)
    left = spark.createDataFrame([(k, i) for i in range(30) for k in ("a", "b", "c", None)], "k string, i int")
    right = spark.createDataFrame([("a", 1), ("c", 3)], "k string, v int")
    got = skew.hot_split_join(left, right, ["k"], hot_rows=1)
    assert got.count() == 120 and {(r.k, r.v) for r in got.collect()} == {("a", 1), ("b", None), ("c", 3), (None, None)}


def test_a_kept_index_is_read_until_its_table_changes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([("1", "red apple"), ("2", "green pear")], "id string, text string").write.parquet(path)
    table = spark.read.parquet(path)
    first, mark = search.Index.of_table(table, table, "id", ["text"]), tables.fingerprint(table)
    again = search.Index.of_table(table, table.where("false"), "id", ["text"])
    ask = search.query_frame(spark, {"q": "apple"})
    assert [r.id for r in again.score(ask).collect()] == [r.id for r in first.score(ask).collect()] == ["1"]
    spark.createDataFrame([("3", "yellow apple")], "id string, text string").write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    assert tables.fingerprint(table) != mark and search.Index.of_table(table, table, "id", ["text"]).score(ask).count() == 2


def test_ranks_that_are_no_ranks_fail(spark):
    for bad in (1.0, float("nan"), float("-inf")):
        with pytest.raises(Exception, match="not finite"):
            search.strengths(spark.createDataFrame([("q", "a", bad)], "qid string, id string, rank double")).collect()
    flat = search.strengths(spark.createDataFrame([("q", "a", 0.0), ("q", "b", 0.0)], "qid string, id string, rank double"))
    assert {r.text for r in flat.collect()} == {1.0}


def test_components_of_parts_and_rules_of_candidates(spark):
    found = spark.createDataFrame([("q", "a", 0), ("q", "b", 1)], "qid string, id string, depth int")
    edges = spark.createDataFrame([("q", 7, "a", "b")], "qid string, edge_id long, source_id string, target_id string")
    assert rows(graph.subgraph(found, edges).select("part", "id", "hop")) == [("entity", "a", 0), ("entity", "b", 1), ("relation", "7", 1)]
    nodes = spark.createDataFrame([("a", ["u"], 0.5, "d"), ("b", ["u", "w"], 0.5, "d"), ("c", [], 0.5, "d"), ("d", ["u"], None, "d"), ("e", ["u"], 0.5, " ")], "id string, members array<string>, confidence double, description string")
    good, bad = resolve.complete(nodes, spark.createDataFrame([("u",)], "unit_id string"))
    assert [r.id for r in good.collect()] == ["a"] and rows(bad) == [("b", "unknown member"), ("c", "no member"), ("d", "confidence"), ("e", "no description")]
