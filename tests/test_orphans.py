from datetime import datetime

from tests.conftest import rows
from weftgraph.operators.orphans import orphan_cascade
from weftgraph.operators.skew import hot_split_join

REF = "ref_table string, ref_key string, own_key string, key string, ref_time timestamp_ntz"
KEY = "parent_table string, key string, since timestamp_ntz"
T = datetime(2025, 1, 1)


def test_direct_late_inherited_and_cycles(spark):
    refs = spark.createDataFrame(
        [("b", "1", "1", "gone", T), ("b", "2", "2", "1", T), ("b", "3", "3", "2", None), ("b", "4", "4", None, T), ("b", "5", "5", "root", datetime(2024, 1, 1)), ("b", "6", "6", "7", T), ("b", "7", "7", "6", T), ("c", "x", None, "3", T), ("c", "x", None, "3", T), ("c", "y", None, "4", T)],
        REF,
    )
    keys = spark.createDataFrame([("b", k, T) for k in ("root", "1", "2", "3", "4", "5", "6", "7")] + [("b", "root", datetime(2025, 6, 1))], KEY)
    found = rows(orphan_cascade(refs, keys, {"b": "b", "c": "b"}).select("ref_table", "ref_key", "kind", "depth"))
    assert found == [("b", "1", "direct", 0), ("b", "2", "inherited", 1), ("b", "3", "inherited", 2), ("b", "5", "direct", 0), ("c", "x", "inherited", 3)]


def test_without_children_no_round_is_run_and_hot_keys_are_split(spark):
    refs = spark.createDataFrame([("a", str(i), None, "hot" if i % 3 else f"k{i}", T) for i in range(300)], REF).selectExpr("*", "1 as since", "2 as found")
    keys = spark.createDataFrame([("n", f"k{i}", None) for i in range(0, 300, 6)], KEY)
    expected = [str(i) for i in range(300) if i % 3 or i % 6]
    for hot in (10, 10_000):
        assert sorted(r.ref_key for r in orphan_cascade(refs, keys, {"a": "n"}, hot_rows=hot).collect()) == sorted(expected)
    assert orphan_cascade(refs.limit(0), keys.limit(0), {"a": "n"}).count() == 0


def test_hot_split_join_keeps_every_row(spark):
    left = spark.createDataFrame([(None, 0), *[("h", i) for i in range(50)], ("c", 1), ("c", 1)], "k string, v int")
    right = spark.createDataFrame([("h", "H"), ("d", "D")], "k string, w string")
    for hot in (5, 500):
        assert sorted(map(tuple, hot_split_join(left, right, ["k"], hot).collect()), key=str) == sorted([(None, 0, None), *[("h", i, "H") for i in range(50)], ("c", 1, None), ("c", 1, None)], key=str)


def test_the_cascade_has_no_bound_of_rounds():
    import inspect

    # a chain of more than 999 records takes as many rounds: too long for a test
    assert "max_rounds" not in inspect.signature(orphan_cascade).parameters
