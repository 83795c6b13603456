from pathlib import Path

import pytest

from weftgraph import api

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def kb(spark):
    return api.KnowledgeBase(spark, str(DATA), "one")


def test_questions(kb, spark):
    found = kb.find("ledger", limit=99).collect()
    assert 0 < len(found) <= 10 and [r.place for r in found] == list(range(1, len(found) + 1))
    assert kb.find("ledger OR quota", syntax="boolean").count() > 0
    assert kb.impact("ledger", depth=9).count() >= 1
    one = found[0].id
    assert kb.show(one.upper()).count() == 1 and kb.why(one).columns[0] == "node_uuid"
    assert kb.sentinel().count() == 1 and kb.timeline().count() > 0 and kb.list_domains().count() > 0
    assert {r.what for r in kb.status().collect()} == {"label", "domain", "kind", "total"}
    whole, cut = kb.query("ledger", "entity").count(), kb.query("ledger", "entity", max_tokens=1).count()
    assert cut == 1 <= whole
    for depth in ("summary", "neighborhood", "subgraph"):
        assert kb.query("ledger", depth).count() == whole


def test_bad_requests_and_federation(kb, spark):
    for bad in (lambda: kb.find(" "), lambda: kb.find("x", syntax="sql"), lambda: kb.query("x", "deep"), lambda: kb.query("x", max_tokens=-1)):
        with pytest.raises(ValueError):
            bad()
    other = api.KnowledgeBase(spark, str(DATA), "two")
    merged, failed = api.federated([kb, other, api.KnowledgeBase(spark, "/nowhere", "lost")], lambda b: b.find("ledger"))
    assert set(failed) == {"lost"} and {r.kb for r in merged.collect()} == {"one", "two"}
    with pytest.raises(RuntimeError):
        api.federated([api.KnowledgeBase(spark, "/nowhere", "lost")], lambda b: b.find("ledger"))
    assert api.list_knowledge_bases([kb, other]).count() == 2
