import random

from weftgraph.llm import mixing

DOCS = "doc_id long, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def make(spark, docs, targets):
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as h", "2 as n_tokens", "3 as repeats")
    rows = mixing.hashed(d, "doc_id", "text", "source")
    parts = mixing.plan(rows, spark.createDataFrame(targets, TARGETS))
    return rows, parts


def test_shares_are_met_and_caps_kept(spark):
    rng = random.Random(1)
    docs = [(i, "word " * rng.randint(1, 60), rng.choice(["big", " BIG ", "big", "mid", "Small", "other", None])) for i in range(3_000)] + [(9_000, None, "big"), (9_001, "", "mid")]
    rows, parts = make(spark, docs, [("big", 0.5, 1), ("mid ", 0.3, 2), ("small", 0.15, 3), ("absent", 0.05, 2)])
    report = {r.source: r for r in mixing.shares(rows, parts).collect()}
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(report[source].actual_share - share / 0.95) < 0.01
    assert report["absent"].tokens_used == 0 and report["other"].actual_share == 0 and report[""].tokens_used == 0
    assert report["big"].most_repeats == 1 and report["mid"].most_repeats <= 2 and report["small"].most_repeats <= 3
    assert max(report[s].tokens_used / (report[s].tokens_available * m) for s, m in (("big", 1), ("mid", 2), ("small", 3))) > 0.99
    used = {p.source: p.used for p in parts}
    assert all(report[s].tokens_used == n for s, n in used.items())
    longest = max(r.n_tokens for r in rows.collect())
    assert all(p.budget - p.used <= longest for p in parts if p.tokens)


def test_the_threshold_is_as_near_as_one_document_allows(spark):
    docs = [(i, "a b c", "x") for i in range(997)] + [(10_000 + i, "a b c", "y") for i in range(3)]
    _, parts = make(spark, docs, [("x", 0.9, 1), ("y", 0.1, 7)])
    p = {p.source: p for p in parts}
    assert p["y"].used == 7 * p["y"].tokens and 0 <= p["x"].budget - p["x"].used < 4


def test_null_targets_and_empty_tables(spark):
    rows, parts = make(spark, [(1, "a", "x")], [(None, 0.5, 1), ("x", None, 1), ("x", 0.5, None)])
    assert [(r.doc_id, r.repeats) for r in mixing.mixture(rows, parts).collect()] == [(1, 1)]
    rows, parts = make(spark, [], [("x", 1.0, 1)])
    assert mixing.mixture(rows, parts).count() == 0
    rows, parts = make(spark, [(1, "a", "x")], [])
    assert mixing.mixture(rows, parts).count() == 0 and mixing.shares(rows, parts).count() == 1


def test_sources_in_turn_give_the_same_plan(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} and {'more ' * (i % 17)}", f"s{i % 7}") for i in range(400)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([(f"s{k}", 1 / 7, 3) for k in range(7)], "source string, target_share double, max_repeats int")
    rows_ = mixing.hashed(docs, "doc_id", "text", "source")
    whole = mixing.plan(rows_, targets)
    monkeypatch.setattr(mixing, "SOURCES_AT_ONCE", 2)
    monkeypatch.setattr(mixing, "PARTS_SENT", 3)
    assert mixing.plan(rows_, targets) == whole and mixing.mixture(rows_, whole).count() > 0
