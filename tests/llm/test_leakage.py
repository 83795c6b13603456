import random
import re

from tests.conftest import rows
from weftgraph.llm import leakage

HAN = "\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0002ffff"
WORD = re.compile(rf"[{HAN}]|[^\W_{HAN}]+")


def brute(docs, items):
    out = set()
    for i, text in items:
        w = WORD.findall(leakage.clean(text or "").lower())
        grams, runs = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}, {tuple(w[k : k + 15]) for k in range(len(w) - 14)}
        for d, t in docs:
            x = WORD.findall(leakage.clean(t or "").lower())
            own = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
            if grams and (len(own & grams) >= 0.4 * len(grams) or runs & {tuple(x[k : k + 15]) for k in range(len(x) - 14)}):
                out.add((d, i))
    return sorted(out)


def data(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30)] + ["中", "文"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 20, 45])))) for i in range(25)]
    items += [(25, items[3][1]), (26, None), (27, ""), (28, "a a a a a a a a a a a a a a a a a a a a a"), (28, "a a a a a a a a a a a a a a a a a a a a a")]
    docs = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        w = (rng.choice(items)[1] or "").split()
        if w:
            a = rng.randrange(len(w))
            part = w[a : a + rng.choice([4, 6, 14, 15, 16, 45])]
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = "<b>" + part[0] + "</b>"
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((d, rng.choice([" ", "\n", "_", " ­"]).join(words).upper()))
    return docs + [(200, None), (201, ""), (202, "x " * 20_000 + items[4][1]), (203, "a " * 30), docs[0]], items


def test_cases_equal_brute_force(spark, monkeypatch):
    for seed, at_once in ((1, 50_000), (2, 6)):
        monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", at_once)
        docs, items = data(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as i", "3 as t")
        i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
        assert rows(leakage.contaminated(d, i, "doc_id", "text", "item_id", "text")) == brute(docs, items)
    assert leakage.contaminated(d.limit(0), i, "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.contaminated(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_search_finds_every_window():
    rng = random.Random(3)
    for _ in range(30):
        items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(5, 9)))) for i in range(6)]
        patterns = leakage.Patterns(items)
        import numpy as np

        words = np.array([rng.randint(-1, len(patterns.vocabulary) - 1) for _ in range(rng.randint(0, 400))], np.int64)
        starts, found = patterns.search(words)
        expected = sorted((s, g) for s in range(len(words) - 4) for g in range(len(patterns.grams)) if (words[s : s + 5] == patterns.grams[g]).all())
        assert sorted(zip(starts.tolist(), found.tolist())) == expected


def test_blocks_by_signs_find_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(12)], "item_id long, text string")
    docs = items.selectExpr("item_id as doc_id", "concat('before ', text, ' after') as text")
    whole = rows(leakage.contaminated(docs, items, "doc_id", "text", "item_id", "text"))
    monkeypatch.setattr(leakage, "SIGNS_AT_ONCE", 300)
    assert rows(leakage.contaminated(docs, items, "doc_id", "text", "item_id", "text")) == whole and len(whole) == 12
