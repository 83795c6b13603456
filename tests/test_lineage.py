import random

from tests.conftest import rows
from weftgraph.operators import temporal

LINEAGE = "new_uuid string, old_uuid string, created_at timestamp_ntz"


def test_chains_are_followed_to_their_end(spark):
    ids = [f"{i:03}" for i in range(150)]
    random.Random(3).shuffle(ids)
    ring = ["t0", "t1", "r0", "r1", "r2"]
    lin = spark.createDataFrame([(b, a, None) for a, b in [*zip(ids, ids[1:]), *zip(ring, ring[1:]), ("r2", "r0")]], LINEAGE)
    found = dict(rows(temporal.latest_of(spark.createDataFrame([(x,) for x in [*ids, *ring, "alone"]], "id string"), lin)))
    assert found == {**dict.fromkeys(ids, ids[-1]), "t0": "r2", "t1": "r2", "r0": "r2", "r1": "r0", "r2": "r1", "alone": "alone"}


def test_terminals_far_away_are_reached(spark):
    lin = spark.createDataFrame([(f"{i + 1:03}", f"{i:03}", None) for i in range(70)] + [("side", "069", None), ("r0", "r1", None), ("r1", "r0", None)], LINEAGE)
    assert rows(temporal.terminals(spark.createDataFrame([("000",), ("r0",)], "id string"), lin)) == [("000", "070"), ("000", "side")]
