import random

import pytest

from tests.conftest import rows
from weftgraph.llm import residue

POSITIVE = [
    "# {{ ticket }} trigger\nThe hub waits.", "Set ${OWNER} to 5 when the queue grows.", "Please enable JavaScript to view this page.", "- <YOUR TEAM>\n", "502 Bad Gateway\n\nupstream closed the connection",
    "Intro line.\n\nLorem ipsum condit sit porta dolor malis ruda nuntia.", "| a | TODO(summary) |", "没有（此处填写枢纽）时，等待。", "占位文字，请替换。占位文字，请替换。", "The hub stores XXXX.", "结果记为TBD: link。", "[Your version here]", "@@OWNER@@ trailer", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE.",
]
NEGATIVE = [
    "Write `${description}` in the file.", "```sh\nexport OUT=${HOME}/x\n```\nDone.", "The viewer of Estbay needs JavaScript; without scripts it offers a static list of 4 nodes.", 'The page "404 Not Found" is sent by Estbay when a node was merged away.',
    "A 502 Bad Gateway from Estbay is retried 4 times before the run counts as failed.", "Load tests of Estbay use lorem ipsum paragraphs of 743 words as neutral input.", "Entries on the TODO list of Estbay are closed after 9 days.",
    "<p>Only <b>readers</b> wait.</p>", "guarda todo lo que el filtro considera flexible.", "- [ ] item [link](references/a.md)", "Set hot_batch to 589, see [4, 8].", "~~~\n{{ unclosed code",
]


def corpus(n=700):
    rng = random.Random(6)
    good = ["The {} belongs to Estbay; only the warm hub may change busy_{} during a review.", "Unless lazy_{} says otherwise, a {} older than 9 days counts as stale.", "Das {} bleibt offen, bis {} es erlaubt.", "读者要等{}完成{}，才能看到结果。"]
    docs = []
    for i in range(n):
        text = "\n".join(rng.choice(good).format(rng.choice(["queue", "shard", "lease", "latch"]), rng.choice(["root", "node", "path"])) for _ in range(rng.randint(1, 6)))
        if i % 5 == 0:
            text += "\n" + rng.choice(POSITIVE)
        elif i % 5 == 1:
            text += "\n" + rng.choice(NEGATIVE[:11])
        docs.append((i, text, f"host{i % 23}"))
    return docs


def test_classifier_holds_on_unseen_hosts_and_rows(spark):
    docs = corpus()
    df = spark.createDataFrame([*docs, (9_000, None, "h"), (9_001, "", None), docs[0], (9_002, "fine words here. " * 20_000 + "\nPlease enable JavaScript to view this page.", None)], "doc_id long, text string, skill string").selectExpr("*", "1 as score", "2 as h", "3 as t", "4 as o")
    model = residue.train([(h, t) for _, t, h in docs])
    assert model.report["recall_unseen"] >= 0.95 and model.report["positives_unseen"] > 10
    found = {r.doc_id for r in residue.residue(df, "doc_id", "text", "skill").collect()}
    truth = {i for i, _, _ in docs if i % 5 == 0} | {9_002}
    assert len(found & truth) / len(truth) > 0.97 and len(found - truth) <= 2


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Please enable JavaScript to view this page.", None)], "doc_id long, text string, skill string")
    assert [r[0] for r in rows(residue.residue(df, "doc_id", "text", "skill"))] == [1]
    assert residue.residue(df.limit(0), "doc_id", "text", "skill").count() == 0


def test_features_of_chunks_equal_those_of_single_texts():
    texts = ["A b. C d! 中文。x", "", "# Title\n\nrow 5", "...", "\n"]
    f = residue.features(texts)
    assert f.text.tolist() == sorted(f.text.tolist()) and set(f.text.tolist()) == {0, 2, 3}
    assert [residue.segments(t) for t in texts] == [["A b.", "C d!", "中文。", "x"], [], ["# Title", "row 5"], ["..."], []]
    alone = residue.features_of_segments(["A b.", "C d!"])
    own = lambda f, k: sorted(int(x) for s, g in f.groups[:3] for x in s[g == k])
    assert own(alone, 0) == own(f, 0) and own(alone, 1) == own(f, 1)


@pytest.fixture(scope="module")
def model():
    return residue.train([(h, t) for _, t, h in corpus(2_000)])


@pytest.mark.parametrize("text", [
    *POSITIVE, "This website requires JavaScript.", "HTTP 405 Method Not Allowed", "This page could not be found.", "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.", "Page introuvable", "403 Forbidden",
    "Dear [Your name here], the hub waits.", "Set {{ " + "a very long name " * 9 + "}} now.", "TODO(" + "say what the hub does " * 4 + ")", "【待补充：" + "缓存" * 40 + "】",
])
def test_the_score_alone_finds(model, text):
    assert residue.score_texts(model, [text])[0] > model.threshold


@pytest.mark.parametrize("text", NEGATIVE)
def test_the_score_alone_spares(model, text):
    assert not residue.score_texts(model, [text])[0] > model.threshold


def test_weak_labels():
    assert residue.weak_label("404 Not Found") and residue.weak_label("Lorem ipsum dolor sit amet.") and residue.weak_label("Set {{ x }} now")
    assert residue.weak_label("A 502 Bad Gateway from the hub is retried four times before the run counts as failed.") is False
    assert residue.weak_label("The hub waits.") is None and residue.weak_label("---") is False
    assert residue.weak_label("Page introuvable", "fr") is None and residue.weak_label("Page introuvable", "missing") is None


def test_wordings_left_out_of_labels_and_examples_are_found_in_part():
    rows_ = [(h, t) for _, t, h in corpus(1_000)]
    for kind, least in (("shapes", 0.3), ("es", 0.3), ("down", 0.15)):
        held = residue.train(rows_, kind)
        found = residue.score_texts(held, residue.examples(kind)) > held.threshold
        assert found.mean() >= least, (kind, found.mean())


def test_harmless_words_do_not_hide_a_placeholder(spark):
    harmless = " ".join(f"the queue of shard {i} stays open during each review of the hub" for i in range(300))
    docs = [*corpus(), (9_500, f"{harmless} and ${{OWNER}} signs {harmless}", "h")]
    found = residue.residue(spark.createDataFrame(docs, "doc_id long, text string, skill string"), "doc_id", "text", "skill")
    assert found.where("doc_id = 9500").count() == 1
