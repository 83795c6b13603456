import random
from collections import Counter, defaultdict
from math import log

import pytest

import __spark_entry__ as entry
from tests.conftest import rows
from weftgraph.operators import recall as own
from weftgraph.operators.search import K1, B


def model(docs, asked, k, shown=None):
    """By the SQL's definition: of the rows of one id, places count once and lengths add up."""
    held, size = defaultdict(set), Counter()
    for i, *texts in set(docs):
        for col, text in enumerate(texts):
            words = (text or "").split()
            held[i] |= {(col, p, w) for p, w in enumerate(words)}
            size[i] += len(words)
    times = {i: Counter(w for _, _, w in held[i]) for i in size}
    mean, often = sum(size.values()) / len(size), Counter(w for t in times.values() for w in t)
    wanted = defaultdict(set)
    for q, text in asked:
        wanted[q] |= set((text or "").split())
    out = []
    for q, words in wanted.items():
        scores = []
        for i in size:
            parts = [max(log((len(size) - often[w] + 0.5) / (often[w] + 0.5)), 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * size[i] / mean)) for w in sorted(words) if (f := times[i][w])]
            if parts and (shown is None or i in shown):
                scores.append((round(-sum(parts), 9), i))
        out += [(q, i, place) for place, (_, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"QUERIES": 7, "ROWS": 60, "FIRST": 3, "STEP": 11, "DENSE": 2}])
def test_recall_equals_its_definition(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(own, name, value)
    rng = random.Random(5)
    word = lambda: f"w{int(rng.random() ** 3 * 40)}"
    docs = [(f"d{i:03}", " ".join(word() for _ in range(rng.randrange(9))), rng.choice([None, "", word()])) for i in range(150)]
    docs += docs[:20] + [(i, f"w1 {t}", u) for i, t, u in docs[30:40]] + [("e", None, None)]
    asked = [(q, " ".join(word() for _ in range(rng.randrange(5)))) for q in range(40)] + [(3, "w2 w9"), (41, None), (42, "none"), (43, "w0 w1 w2"), (44, "w1 w2 w0")]
    shown = {d[0] for d in docs if int(d[0][1:] or 0) % 3}
    table, queries = spark.createDataFrame(docs, "id string, a string, b string"), spark.createDataFrame(asked, "qid long, text string")
    assert rows(own.recall(table, "id", ["a", "b"], queries, 5)) == model(docs, asked, 5)
    flag = table["id"].isin(*shown)
    assert rows(own.recall(table, "id", ["a", "b"], queries, 4, flag)) == model(docs, asked, 4, shown)
    assert own.recall(table, "id", ["a"], queries.limit(0), 5).collect() == [] == own.recall(table.limit(0), "id", ["a"], queries, 5).collect()


def _shuffled(spark):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("name", ["f15_chunks", "f12_batch_recall"])
def test_a_common_word_does_not_multiply_queries_by_rows(spark, tmp_path, name):
    """Every query and every row hold one word: neither the rows of both are joined, nor is a posting written for each."""
    n, q = 1_500, 150
    spark.createDataFrame([(f"c{i}", f"the row number{i} number{i % 7}") for i in range(n)], "chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(i * 20, f"the number{i}") for i in range(q)], "result_id long, question string").write.parquet(f"{tmp_path}/results.parquet")
    fields = "name string, summary string, synonyms string, description string, tags string, related_entities string, properties string"
    spark.createDataFrame([(f"n{i:05}", "Entity", f"the node number{i}", *[None] * 6) for i in range(n)], f"id string, label string, {fields}").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(i * 20, f"the number{i}", "n00001") for i in range(q)], "id long, source_entity string, target_node_id string").write.parquet(f"{tmp_path}/cross_references.parquet")
    before = _shuffled(spark)
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == q * (10 if name == "f15_chunks" else 15)
    assert all(r.id.lstrip("cn").lstrip("0") in (str(r.qid // 20), "") for r in got if r.place == 1)
    assert sum(v for k, v in _shuffled(spark).items() if k not in before) < n * q / 3
