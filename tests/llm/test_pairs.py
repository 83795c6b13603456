import random

import pytest

from tests.conftest import rows
from weftgraph.llm import pairs

Q = "Which vault does Nemshan open first when the fragment is reversible?"
CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, "​ \n", "empty"), (Q, "[raw:ab12cd34ef]", "empty"), (Q, "N/A", "empty"), (Q, "—", "empty"), (Q, "```\n```", "empty"), (Q, "null.", "empty"),
    (Q, "Yes.", None), (Q, "573", None), (Q, "`shared_lock`", None), (Q, "Nemshan", None), (Q, "Keys: `a_b`, `c_d`", None), (Q, "It opens the vault first. [raw:ab12cd34ef]", None), (Q, "Set it:\n\n```yaml\na: 1\n```", None),
    (Q, "It opens the first vault.\n\n| a | 1 |", None), (Q, "Steps:\n- one\n- two", None),
    (Q, "It opens the vault and then the wat", "truncated"), (Q, "It opens [cut]", "truncated"), (Q, "It opens the first vault (see the warm", "truncated"), (Q, "Three steps:\n1. One thing.\n2. Two things.\n3.", "truncated"), (Q, "Set it:\n```yaml\na: 1", "truncated"),
    (Q, "It opens the first vault,", "truncated"), ("请说明x。", "两个投影互相冲突时，淘汰悬空的那一个，并丢", "truncated"),
    (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "抱歉，我无法回答这个问题。", "refusal"), (Q, "The retrieved passages do not say this; they only state that x equals 3.", None), (Q, "Sorry to be brief: the evidence covers Nemshan but never mentions it.", None),
    (Q, Q, "copied"), (Q, f"> {Q}", "copied"), (Q, f"Question: {Q.lower()}\n{Q}", "copied"), (Q, f"{Q} It opens the archive, because the lease is older than the quota and the hub waits.", None),
    (Q, "Der Speicher gehört zu Nemshan und wird nicht geöffnet.", "other_language"), (f"{Q} Answer in German.", "Der Speicher gehört zu Nemshan und wird nicht geöffnet.", None), ("请说明x。请用德语回答。", "Der Speicher gehört zu Nemshan und wird nicht geöffnet.", None),
    (None, "It opens the first vault.", None), (None, None, "empty"),
]


@pytest.mark.parametrize("question,answer,defect", CASES)
def test_defects(question, answer, defect):
    assert pairs.defect_of(question, answer, pairs.refusal_automaton()) == defect


def test_automaton_covers_what_a_plain_search_covers():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 25))) for _ in range(2))
        covered = set()
        for i in range(len(b)):
            for j in range(i + 3, len(b) + 1):
                if b[i:j] in a:
                    covered.update(range(i, j))
        assert pairs.SuffixAutomaton(a).matched(b, 3) == len(covered)


def test_rows(spark):
    data = [(1, Q, None, "ok"), (1, Q, None, "ok"), (2, Q, None, "error"), (3, Q, "", " OK "), (4, Q, "", None), (5, Q, "It opens it. " * 20_000, "ok"), (6, None, "word " * 50_000, "ok"), (None, Q, "", "ok")]
    df = spark.createDataFrame(data, "result_id long, question string, answer string, status string").selectExpr("*", "1 as key", "2 as defect")
    found = pairs.broken_pairs(df, "result_id", "question", "answer", "status")
    assert sorted(map(tuple, found.withColumnRenamed("key", "id").collect()), key=str) == sorted([(1, "empty"), (3, "empty"), (6, "truncated"), (None, "empty")], key=str)
    assert pairs.broken_pairs(df.limit(0), "result_id", "question", "answer", "status").count() == 0


# none of these stands in the tables or was used to choose the parts
REFUSED = ["I'm sorry, but I can't comply with this request.",
 "Sorry, I can't do that.",
 'I must respectfully refuse.',
 'Das kann ich leider nicht sagen.',
 'I am not comfortable answering that.',
 'As an AI model, I cannot discuss this topic.',
 "Unfortunately, I won't be able to answer.",
 "I'm afraid I can't help you with that one.",
 'Dazu möchte ich mich nicht äußern.',
 'Ich kann Ihnen dabei leider nicht helfen.',
 'Je suis désolé, je ne peux pas vous aider.',
 'Je préfère ne pas répondre.',
 'Lo lamento, no puedo responder a esa pregunta.',
 'No estoy autorizado a hablar de eso.',
 '抱歉，我不能讨论这个话题。',
 '对不起，我没有权限透露这些信息。',
 'We are unable to assist with this.',
 "I'd rather not say.",
 'I have to decline.',
 'Me niego a responder.',
 '这个问题我不便评论。',
 'Ich muss diese Bitte ablehnen.',
 "Il m'est impossible de répondre."]
SOUND = ['The guide says you are not allowed to discuss quotas in public channels.',
 'The hub cannot help the relay.',
 'The policy says that staff must refuse such requests.',
 'I cannot tell from the cited lines whether the hub waits.',
 'The evidence does not say who answers.',
 'Der Knoten kann nicht antworten.',
 'Le noeud ne peut pas répondre.',
 'El nodo no puede responder.',
 '系统无法提供该字段。',
 'The reply "I can\'t help with that" is sent when the token is missing.',
 'I would set x to 5; the hub is not able to go lower.',
 "`I can't help with that`",
 "You can't answer a closed ticket.",
 'I found three sources. The hub declines late writes.']


@pytest.mark.parametrize("answer", REFUSED)
def test_refusals_of_other_wordings_are_found(answer):
    assert pairs.refuses(answer, pairs.refusal_automaton())


@pytest.mark.parametrize("answer", SOUND)
def test_statements_about_refusing_are_none(answer):
    assert not pairs.refuses(answer, pairs.refusal_automaton())


def test_a_refusal_late_in_a_long_answer_is_none():
    assert not pairs.refuses("The hub waits. The relay reads. The lease ends. I can't help with that.", pairs.refusal_automaton())


def test_copies_ruled_out_early_are_none(spark):
    rng = random.Random(4)
    for _ in range(300):
        q = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        a = "".join(rng.choice([q[i : i + rng.randint(1, 20)] for i in range(len(q))] + ["xyz"]) for _ in range(rng.randint(1, 6)))
        plain = len(a) >= max(8, 0.4 * len(q)) and pairs.SuffixAutomaton(q).matched(a, 8) >= 0.9 * len(a)
        assert pairs.is_copied(q, a) == plain
