import math
import sqlite3

import pytest

from tests.conftest import rows
from weftgraph.functions.fulltext import compile_text, expand_abbreviations
from weftgraph.operators import search

DOCS = [
    ("1", "Queue worker", "the busy queue drains the worker", None), ("2", "foo.bar lease", "depends_on quota", "queue"), ("3", "Café économe", "订单聚合根 queue queue queue", ""),
    ("4", None, None, None), ("5", "lease", "a lease of a queue; quota depends on the lease", "worker"), ("6", "ΩΩ", "worker queue", "foo bar"), ("7", "a", "b c d e f g", "h"), ("8", "stone", "quiet", "x"), ("9", "x y z", "long text without a hit " * 5, ""),
]


@pytest.fixture(scope="module")
def index(spark):
    return search.Index(spark.createDataFrame(DOCS, "id string, name string, summary string, tags string"), "id", ["name", "summary", "tags"])


@pytest.mark.parametrize("query", ["queue", "queue worker", "foo.bar", "cafe", "depends_on", "订单聚合根", "lease quota", "zzz", '"busy" queue'])
def test_rank_equals_the_reference_engine_formula(spark, index, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, name, summary, tags)")
    db.executemany("insert into t values (?, ?, ?, ?)", DOCS)
    text = " AND ".join('"' + " ".join(atom) + '"' for atom in compile_text(query))
    expected = {i: r for i, r in db.execute("select id, bm25(t) from t where t match ?", (text,))}
    got = {r.id: r["rank"] for r in index.score(search.query_frame(spark, {"q": query})).collect()}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], abs_tol=1e-6) for k in got)


def test_boolean_queries(index):
    got = lambda q: [r.id for r in index_sorted(search.match(index, q, ["name", "summary", "tags"]))]
    index_sorted = lambda df: df.orderBy("id").collect()
    assert got("queue AND NOT worker") == ["2", "3"]
    assert got('(quo* OR stone) "depends on"') == ["2", "5"]
    assert got("tags:queue") == ["2"] and got('"busy queue"') == ["1"] and got("nothing OR stone") == ["8"]
    for bad in ("(queue", "AND queue", "nocolumn:queue"):
        with pytest.raises(ValueError):
            search.match(index, bad, ["name", "summary", "tags"])


def test_hybrid_and_budgets(spark, index):
    nodes = spark.createDataFrame([(str(i), "d") for i in range(1, 10)], "id string, domain string")
    edges = spark.createDataFrame([(1, "1", "8", "triggers", 0.9), (2, "8", "9", "references", 0.9), (3, "9", "7", "references", 0.9)], "id long, source_id string, target_id string, kind string, confidence double")
    hits = index.score(search.query_frame(spark, {"q": "busy"}))
    assert [(r.id, r.score, r.depth) for r in search.hybrid(nodes, edges, hits).orderBy("place").collect()] == [("1", 1.0, 0), ("8", 0.4, 1), ("9", 0.2, 2)]
    df = spark.createDataFrame([("g", 1, "aaaa"), ("g", 2, "bbbb"), ("g", 3, "cccc")], "g string, o int, t string")
    from pyspark.sql import functions as F

    assert [r.o for r in search.within_budget(df, ["g"], ["o"], F.length("t"), 4).collect()] == [1, 2]
    assert [r.t for r in search.pack(df, ["g"], ["o"], "t", 6).collect()] == ["aaaa", "bb"]
    assert rows(search.cap_per_group(df.withColumn("q", F.lit("q")), "q", "g", ["o"], 2, 10).select("o", "place")) == [(1, 1), (2, 2)]


def test_plain_text_queries():
    assert compile_text('a "b-c" OR') == [["a"], ["b", "c"], ["or"]]
    for bad in ("  ", "a\x00b", "\ud800"):
        with pytest.raises(ValueError):
            compile_text(bad)
    assert expand_abbreviations("kg of kgs", {"kg": "graph k", "k": "K"}) == "graph K of kgs"
