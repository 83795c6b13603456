import random

from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.functions.text import squeeze, squeeze_fast
from weftgraph.operators import snapshots
from weftgraph.operators.snapshots import consecutive_pairs, diff_snapshots, digest_rows


def test_random_snapshots_equal_brute_force(spark):
    rng = random.Random(3)
    content, snaps = {}, {}
    for v in range(5):
        content = {k: c for k, c in content.items() if rng.random() > 0.1}
        for _ in range(60):
            content[f"n{rng.randint(0, 300)}"] = (rng.choice(["a", "a  b", None, ""]), rng.choice([0.5, None, 0.75]))
        snaps[f"s{v}"] = dict(content)
    table = [(s, k, *c) for s, own in snaps.items() for k, c in own.items()]
    table += [(s, k, {"a  b": " a b\n"}.get(a, a), b) for s, k, a, b in table[:40]]
    df = spark.createDataFrame(table, "file string, id string, a string, b double").withColumns({"h1": F.lit(1), "leaf": F.lit(2)})
    log = spark.createDataFrame([(f"v{i}", f"v{i - 1}" if i else None, f"s{i}") for i in range(5)] + [("v4", "v3", "s4"), ("w", "nowhere", "s1"), ("u", "v0", "absent"), ("loop", "loop", "s1")], "v string, p string, file string")
    pairs = consecutive_pairs(log, "v", "p", F.col("file"))
    found = rows(diff_snapshots(digest_rows(df, F.col("file"), "id", ["a", "b"]), pairs))
    norm = lambda c: (" ".join((c[0] or "").split()), c[1])
    expected = []
    for i in range(1, 5):
        new, old = snaps[f"s{i}"], snaps[f"s{i - 1}"]
        expected += [(f"v{i}", k, "added" if k not in old else "removed" if k not in new else "changed") for k in {*new, *old} if k not in old or k not in new or norm(new[k]) != norm(old[k])]
    assert found == sorted(expected)
    assert diff_snapshots(digest_rows(df.limit(0), F.col("file"), "id", ["a", "b"]), pairs).count() == 0


def test_contents_swapped_between_keys_are_seen(spark):
    df = spark.createDataFrame([("o", "k1", "x"), ("o", "k2", "y"), ("n", "k1", "y"), ("n", "k2", "x")], "f string, id string, a string")
    pairs = spark.createDataFrame([("p", "n", "o")], "pair string, new string, old string")
    assert rows(diff_snapshots(digest_rows(df, F.col("f"), "id", ["a"]), pairs)) == [("p", "k1", "changed"), ("p", "k2", "changed")]


def test_deep_trees_and_versions_with_two_snapshots(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "LEAF_ROWS", 1)
    monkeypatch.setattr(snapshots, "STEP_BITS", 3)
    data = [("a", f"k{i}", str(i)) for i in range(300)] + [("b", f"k{i}", str(i + (i % 50 == 0))) for i in range(5, 310)] + [("c", f"k{i}", str(i)) for i in range(300)] + [("d", "k1", "other")]
    df = spark.createDataFrame(data, "snap string, id string, v string")
    pairs = spark.createDataFrame([("v", "b", "a"), ("v", "c", "a"), ("w", "c", "a"), ("x", "d", "a"), ("y", "none", "a")], "pair string, new string, old string")
    got = {tuple(r) for r in snapshots.diff_snapshots(snapshots.digest_rows(df, F.col("snap"), "id", ["v"]), pairs).collect()}
    v = {("v", f"k{i}", "removed") for i in range(5)} | {("v", f"k{i}", "added") for i in range(300, 310)} | {("v", f"k{i}", "changed") for i in range(50, 300, 50)}
    x = {("x", f"k{i}", "removed") for i in range(300) if i != 1} | {("x", "k1", "changed")}
    assert got == v | x


def test_squeezing_fast_equals_squeezing(spark):
    texts = ["a b", " a  b ", "a\tb", "\x1fa", "é  x", "é x", "", None, "a b ", "　a", "x\x85y", "\x0b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(squeeze_fast(F.col("t")).alias("a"), squeeze(F.col("t")).alias("b"))
    assert all(r.a == r.b for r in df.collect())
