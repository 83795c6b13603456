import random
import uuid

from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.functions import identity
from weftgraph.functions.text import slug, words
from weftgraph.operators import evaluate, resolve


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_similar_names_lose_no_pair(spark):
    rng = random.Random(2)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"café", "cafe", "naïve"}
    got = {(r.name_a, r.name_b): r.distance for r in resolve.similar_names(spark.createDataFrame([(n,) for n in [*names, "CAFE"]] + [(None,), ("",)], "name string")).collect()}
    expected = {(a, b): d for a in names for b in names if a < b and (d := levenshtein(a.encode(), b.encode())) <= 3}
    assert got == expected


def test_jaro_winkler_and_conflicts(spark):
    assert resolve.jaro_winkler("", "") == 1.0 and resolve.jaro_winkler("a", "") == 0.0
    assert abs(resolve.jaro_winkler("martha", "marhta") - 0.961111) < 1e-5
    df = spark.createDataFrame([("1", "Calvek ledger"), ("2", "calvek lodger"), ("3", "Calvek ledger"), ("4", "other thing"), ("1", "Calvek ledger")], "id string, name string")
    assert [(a, b) for a, b, *_ in rows(resolve.conflicts(df))] == [("1", "2"), ("1", "3")]


def test_ids_equal_the_standard_library(spark):
    names = ["m1,m2", "ü", "", "x" * 300]
    got = {r.n: r.u for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.uuid5(identity.NAMESPACE, F.col("n")).alias("u")).collect()}
    assert got == {n: str(uuid.uuid5(uuid.UUID(identity.NAMESPACE), n)) for n in names}
    df = spark.createDataFrame([(["b", "a", "a", "", None],), (["a,b", "c"],)], "m array<string>").select(identity.node_uuid(F.col("m")).alias("u"))
    assert df.first().u == str(uuid.uuid5(uuid.UUID(identity.NAMESPACE), "a,b")) and df.distinct().count() == 2


def test_hashes_slugs_and_words(spark):
    def fnv(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h

    df = spark.createDataFrame([("订单",), ("Hello, World_x!",), ("a" * 60,)], "n string")
    assert {r.n: r.h for r in df.select("n", identity.fnv1a32(F.col("n")).alias("h")).collect()} == {t: fnv(t) for t in ("订单", "Hello, World_x!", "a" * 60)}
    assert [r.s for r in df.select(identity.file_slug(F.col("n")).alias("s")).collect()] == [f"node-{fnv('订单'):x}", "hello-world-x", "a" * 40]
    assert [r.s for r in df.select(slug(F.col("n")).alias("s")).collect()][:2] == ["订单", "hello-world-x"]
    assert [r.w for r in df.select(words(F.col("n")).alias("w")).collect()][:2] == [["订", "单"], ["hello", "world", "x"]]
    urls = ["https://Host.org/a/b.git", "git@host.org:a/b.git", "ssh://git@host.org:22/a/b/"]
    assert {r.i for r in spark.createDataFrame([(u,) for u in urls], "u string").select(identity.repository_identity(F.col("u")).alias("i")).collect()} == {"git:host.org/a/b"}


def test_endpoints_and_fusion(spark):
    names = spark.createDataFrame([("s", "x", "1"), ("t", "x", "2"), ("t", "only", "3"), ("s", "two", "4"), ("s", "two", "5")], "scope string, alias string, id string")
    rels = spark.createDataFrame([("s", "x", "only"), ("u", "x", "t/x"), ("s", "two", "none")], "scope string, source string, target string")
    assert sorted(((r.source, r.source_id, r.target_id) for r in resolve.resolve_endpoints(rels, names).collect()), key=str) == [("two", None, None), ("x", "1", "3"), ("x", None, "2")]
    c = spark.createDataFrame([("d", "a", "Entity", "n", "s", None, ["m1", "m2"], ["x"], ["k"], 0.5), ("d", "b", "Entity", "n", "s", None, ["m2", "m1"], ["y"], ["k", "l"], 0.9), ("d", "c", "Entity", "o", "s", None, ["m3"], ["y"], ["k"], 0.9)], "scope string, alias string, label string, name string, summary string, description string, members array<string>, synonyms array<string>, skills array<string>, confidence double")
    fused = resolve.fuse(c)
    assert rows(fused.select("alias", "confidence", F.array_join("synonyms", ","), F.array_join("skills", ","))) == [("a", 0.9, "x,y", "k,l"), ("c", 0.9, "y", "k")]
    r = spark.createDataFrame([("d", "a", "c", "references", None, 0.1), ("d", "b", "c", "references", None, 0.4), ("d", "a", "b", "references", None, 0.4)], "scope string, source string, target string, kind string, description string, confidence double")
    assert rows(resolve.redirect(r, fused).select("source", "target", "confidence")) == [("a", "c", 0.4)]


def test_measures(spark):
    gold = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c")], "qid string, doc string")
    hits = spark.createDataFrame([("q1", "x", 1), ("q1", "a", 2), ("q1", "b", 6)], "qid string, doc string, rank int")
    assert rows(evaluate.recall_at(gold, hits, 5)) == [("q1", 1, 0.5, 0), ("q2", 0, 0.0, 0)]
    assert rows(evaluate.reciprocal_rank(gold, hits)) == [("q1", 0.5), ("q2", 0.0)]
    facts = spark.createDataFrame([("f1", "d", 3, 8), ("f2", "d", 9, 12)], "fact_id string, doc string, start int, end int")
    shown = spark.createDataFrame([("d", 1, 5), ("d", 6, 10)], "doc string, start int, end int")
    assert rows(evaluate.visible_facts(facts, shown)) == [("f1", 1), ("f2", 0)]


def test_shingle_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(60)) for _ in range(12)]
    texts = base + [" ".join(w if rng.random() > 0.01 else "new" for w in t.split()) for t in base] + [base[0], base[0], "too short", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        if len(w) >= 5:
            sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)), []).append(i)
    reps = [(min(v), k) for k, v in sets.items()]
    expected = sorted((a, b) for a, x in reps for b, y in reps if a < b and len(x & y) / len(x | y) >= 0.85)
    assert [(r.id_a, r.id_b) for r in evaluate.shingle_pairs(df, "id", "t").orderBy("id_a", "id_b").collect()] == expected


def test_references_within_synonyms_equal_like(spark):
    import re

    rng = random.Random(4)
    text = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    synonyms = {f"n{i:02}": text("abcAB ,_%\\", 0, 9) for i in range(40)} | {"s1": "sublease, rent", "s2": "x"}
    names = sorted({text("abcAB ,_%\\", 1, 4) for _ in range(120)} | {"lease", "_", "%", "l_ase, r", "zzzz", "sub%rent", ""})
    nodes = spark.createDataFrame([(k, "", v) for k, v in synonyms.items()] + [("none", "", None)], "id string, name string, synonyms string")
    refs = spark.createDataFrame(list(enumerate(names)), "id long, target_entity string")
    got = {r.target_entity: r.resolved_id for r in resolve.resolve_references(refs, nodes).collect()}

    def like(name):
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%{name}%".lower())
        return min((k for k, v in synonyms.items() if v and re.fullmatch(pattern, v.lower(), re.S)), default=None)

    assert got["lease"] == "s1" and got["zzzz"] is None
    assert got == {n: like(n) if n else None for n in names}
