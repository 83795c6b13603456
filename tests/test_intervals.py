import random

from tests.conftest import rows
from weftgraph.operators.intervals import covered_and_gaps


def brute(spans):
    out = []
    lines = {}
    for k, s, e in spans:
        if k is None or s is None or e is None or s < 1 or s > e:
            continue
        lines.setdefault(k, set()).update(range(s, e + 1))
    for k, covered in lines.items():
        last = None
        for n in sorted(covered):
            if last is None or n > last[1] + 1:
                if last is not None:
                    out += [(k, "covered", last[0], last[1]), (k, "gap", last[1] + 1, n - 1)]
                last = [n, n]
            else:
                last[1] = n
        out.append((k, "covered", last[0], last[1]))
    return sorted(out)


def test_random_spans_equal_brute_force(spark):
    rng = random.Random(5)
    spans = []
    for k in "abcdef":
        wide = 30 if k < "c" else 12_000
        spans += [(k, s := rng.randint(-2, wide), s + rng.randint(-3, rng.choice([4, 40, 900]))) for _ in range(rng.choice([3, 60, 200]))]
    spans += spans[:20] + [("long", 1, 20_000), ("long", 4096, 4096), ("long", 20_001, 20_001), ("long", 30_000, 30_001), ("touch", 4, 6), ("touch", 7, 9), ("edge", 255, 256), ("edge", 257, 4095), ("edge", 4096, 4100)]
    df = spark.createDataFrame(spans, "f string, s int, e int").repartition(7)
    assert rows(covered_and_gaps(df, ["f"], "s", "e")) == brute(spans)


def test_hot_key_clashing_columns_nulls_and_empty(spark):
    spans = [("hot", i % 500 * 3 + 1, i % 500 * 3 + 2) for i in range(5_000)] + [("hot", None, 4), ("hot", 5, None), (None, 1, 2), ("x", 2**31 - 5, 2**31 - 1)]
    df = spark.createDataFrame(spans, "kind string, start int, end int").selectExpr("kind as k0", "start as s", "end as e", "1 as block", "2 as carry", "3 as xs")
    assert rows(covered_and_gaps(df, ["k0"], "s", "e")) == brute(spans[:-1]) + [("x", "covered", 2**31 - 5, 2**31 - 1)]
    assert covered_and_gaps(df.limit(0), ["k0"], "s", "e").count() == 0
