from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.operators import build

ID = "11111111-1111-5111-8111-111111111111"


def test_units_are_checked_and_flattened(spark):
    docs = spark.createDataFrame(
        [("s", "f1", [("u1", "entity", ' "Name" ', "c1", "d1", 0.5, 3, 1), ("", "concept", "Other", "c", None, 0.9, 1, 2)]), ("s", "f2", [("u1", "entity", "Name", "c2", "d1", 0.0, 1, 1)]), ("s", "f3", [("u3", "odd", "n", "c", None, 1.0, None, None), ("u4", "entity", "n", "c", None, 1.0, None, None)])], build.UNITS
    )
    good, bad = build.units(docs)
    assert rows(bad) == [("s", "f3", "tag")]
    assert sorted((r.name, r.start_line) for r in good.collect() if r.file_path == "f1") == [("Name", None), ("Other", 1)]
    flat = {r.id: (r.content, r.detail, r.confidence) for r in build.flatten_units(good).collect()}
    assert flat["u1"] == ("c1\n\nc2", "d1", 0.5) and len(flat) == 2


def test_decisions(spark):
    units = spark.createDataFrame([("a", "entity", "N", "first", 0.9, "s", "f", 1, 2), ("b", "entity", "N", "second", 0.4, "s", "f", 3, 4), ("c", "entity", "N", "third", -1.0, "s", "f", 5, 6), ("d", "concept", "N", "x", 0.5, "s", "f", 1, 1)], "unit_id string, tag string, name string, content string, confidence double, skill string, file_path string, start_line int, end_line int")
    aliases = spark.createDataFrame([("sd#1", "n1", "Entity"), ("sub", "subdomain::d::s", "Subdomain")], "alias string, id string, label string")
    groups = spark.createDataFrame([("g",)], "group_id string")
    shape = "unit_id string, action string, alias string, group_id string, name string, tag string, summary string"
    good = spark.createDataFrame([("a", "fuse", "sub", "g", "New", "entity", ""), ("b", "fuse", "sub", "g", "New", "entity", ""), ("c", "merge_into", "sd#1", None, None, None, None), ("d", "attach", "sub", None, "Att", "concept", "sum")], shape)
    assert build.validate_decisions(good, units, aliases, groups).count() == 0
    bad = spark.createDataFrame([("a", "fuse", "sub", "none", "New", "entity", ""), ("b", "merge_into", "sub", None, None, None, None), ("b", "attach", "sub", None, "x", None, None), ("d", "leap", None, None, None, None, None), ("z", "attach", "sub", None, "x", None, None)], shape)
    assert rows(build.validate_decisions(bad, units, aliases, groups)) == [("a", "undefined group"), ("b", "alias does not fit"), ("b", "several decisions"), ("c", "no decision"), ("d", "unknown action"), ("z", "unknown unit")]
    nodes = spark.createDataFrame([("n1",)], "id string")
    pending, sources = build.materialize_decisions(good, units, aliases, nodes)
    assert sorted((r.label, r.name, r.summary, r.confidence, ",".join(r.members)) for r in pending.collect()) == [("Concept", "Att", "sum", 0.5, "d"), ("Entity", "New", "first", 0.4, "a,b")]
    assert sources.count() == 4 and sources.where("node_uuid = 'n1'").first().member_id == "c"


def test_ingest_makes_all_levels(spark):
    tree = spark.createDataFrame([("d", "s", [("n1", "Entity", "A", "x", None, 2.0, ["sk"], ["m1", "m2"]), ("n2", "Concept", "B", "x", None, 0.5, ["sk", ""], ["m3"])], [("n1", "n2", "references", "r", 0.5), ("n1", "gone", "references", "r", 0.5), ("n1", "n1", "references", "r", 0.5)])], "domain string, subdomain string, nodes array<struct<id:string,label:string,name:string,summary:string,description:string,confidence:double,skills:array<string>,members:array<string>>>, relations array<struct<source_id:string,target_id:string,kind:string,description:string,confidence:double>>")
    out = build.ingest(tree)
    assert {r.id for r in out["nodes"].collect()} == {"n1", "n2", "domain::d", "subdomain::d::s", "skill::sk"}
    assert {(r.source_id, r.target_id, r.kind) for r in out["edges"].collect()} == {("skill::sk", "domain::d", "provides"), ("domain::d", "subdomain::d::s", "composes"), ("subdomain::d::s", "n1", "composes"), ("subdomain::d::s", "n2", "composes"), ("n1", "n2", "references")}
    assert out["sources"].count() == 3


def test_relations_patches_and_the_rest(spark):
    rel = spark.createDataFrame([("r1", "a", "b", "references", True, ["proof"]), ("r2", "a", "b", "references", True, ["only a"]), ("r3", "a", "b", "references", False, ["proof"])], "relation_id string, source_id string, target_id string, kind string, verdict boolean, quotes array<string>")
    members = spark.createDataFrame([("a", "f1"), ("b", "f2")], "id string, file_path string")
    originals = spark.createDataFrame([("f1", "has proof and only a"), ("f2", "proof too")], "file_path string, content string")
    assert [r.relation_id for r in build.accepted_relations(rel, members, originals).collect()] == ["r1"]
    asserted = spark.createDataFrame([("a", "b", "k", None, None, "t"), ("a", "b", "k", "verified", "q", "t"), ("a", "b", "k", None, None, "t")], "source_id string, target_id string, kind string, state string, quote string, text string")
    assert build.coalesce_assertions(asserted).first().assertions.count("state") == 2
    text = '```json\n{"ops": [{"op": "merge_nodes", "members": ["a", "b"]}, {"op": "merge_nodes", "members": ["a", "x"]}, {"op": "split_node", "node": "a", "parts": [{"name": "p", "members": ["m1"]}]}, {"op": "fly"}, {"op": "rename", "node": "b", "name": " "}]}\n```'
    ops = spark.createDataFrame([(text,)], "t string").select(F.posexplode(build.parse_patch(F.col("t"))).alias("pos", "o")).select("pos", "o.*")
    nodes = spark.createDataFrame([("a", "d", "s"), ("b", "d", "s"), ("c", "d", "t")], "id string, domain string, subdomain string")
    sources = spark.createDataFrame([("a", "m1"), ("a", "m2")], "node_uuid string, member_id string")
    assert rows(build.validate_patch(ops, nodes, sources)) == [(1, "unknown node"), (2, "parts are no partition"), (3, "unknown operation"), (4, "no name")]
    com = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, community string")
    assert {r.id: r.subdomain for r in build.promote(nodes, com, "a", "new").collect()} == {"a": "new", "b": "new", "c": "t"}
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")], "qid string, place int, id string")
    files = spark.createDataFrame([("a", "f"), ("b", "f")], "id string, file_path string")
    ranks = spark.createDataFrame([("q", "c2", "f", -1.0), ("q", "c1", "f", -2.0)], "qid string, chunk_id string, file_path string, rank double")
    assert [r.chunk_id for r in build.backfill_sources(hits, files, ranks).orderBy("place").collect()] == ["c1", None, None]
    masked = build.mask_ids(spark.createDataFrame([(f"x {ID.upper()} y {ID}",)], "t string"), "t").first()
    assert masked.masked == "x u1 y u1" and masked.aliases == {"u1": ID}
    dom = spark.createDataFrame([("One", "one", ["k"], ["a"]), ("one", "uno", ["l"], ["b"]), ("Two", "", ["k"], [])], "name string, slug string, skills array<string>, subdomains array<string>")
    assert [(r.slug, r.skills, r.subdomains) for r in build.merge_domains(dom).orderBy("slug").collect()] == [("one", ["k", "l"], ["a", "b"]), ("two", ["k"], [])]
    kept = build.attach_retained(spark.createDataFrame([("r#1", "N", "Entity", ["m"])], "alias string, name string, label string, members array<string>"), spark.createDataFrame([("r#1", "N", "Entity", ["m", "n"]), ("r#1", "Other", "Entity", ["z"])], "alias string, name string, label string, members array<string>"))
    assert kept.first().members == ["m", "n"]
