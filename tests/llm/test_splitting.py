import random

import numpy as np

from weftgraph.llm import splitting

TEXTS = [
    "", "short", "x" * 5_000, "word " * 2_000, "Sentence one. " * 400, "行。" * 3_000, "字" * 4_000, "para\n\n" * 900, "| a | b |\n" * 700, "line\r\n" * 900, "\n" * 4_000, "é" * 2_500, "👩‍💻" * 1_500, "a\tb  c" * 1_000,
]


def check(text, limit, overlap):
    cuts = splitting.pieces(text, limit, overlap)
    if not text:
        return cuts == []
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for a, b in cuts:
        assert 0 < b - a <= limit
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert a < c <= b < d and b - c <= 2 * overlap
    return True


def test_pieces_cover_every_text():
    rng = random.Random(1)
    for text in TEXTS + ["".join(rng.choice("ab .\n。，中") for _ in range(rng.randint(0, 6_000))) for _ in range(40)]:
        for limit, overlap in ((1_800, 200), (100, 0), (100, 30)):
            assert check(text, limit, overlap)


def test_natural_places_come_first():
    text = ("First part here. " * 20 + "\n\n") * 8
    cuts = splitting.pieces(text)
    assert all(text[b - 2 : b] == "\n\n" for _, b in cuts[:-1])
    sentences = "Some words in a row. " * 300
    assert all(sentences[:b].endswith((". ", ".")) and sentences[a:].startswith("Some") for a, b in splitting.pieces(sentences)[:-1])
    assert all(len(t) <= 1_800 for t in ("x" * 5_000)[0:1_800].split())
    marks = "é" * 2_500
    assert all(not marks[a:].startswith("́") for a, _ in splitting.pieces(marks))


def test_lines_are_counted_on(spark):
    text = "".join(f"row {i}\n" for i in range(600))
    data = [("a", text, 10, 609), ("a", text, 10, 609), ("b", text, 609, 10), ("c", text, 0, 5), ("d", text, None, None), ("e", None, 1, 1), ("f", "", 1, 1), ("g", "one\ntwo", 3, None)]
    df = spark.createDataFrame(data, "chunk_id string, text string, start_line int, end_line int").selectExpr("*", "1 as piece", "2 as line", "3 as key")
    got = splitting.split_texts(df, "chunk_id", "text", "start_line", "end_line").orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in got} == {"a", "b", "c", "d", "g"}
    for r in got:
        if r.chunk_id in "ab":
            assert r.text == text[r.start_char : r.end_char] and r.start_line == 10 + text[: r.start_char].count("\n") and r.end_line == 10 + text[: r.end_char - 1].count("\n")
        if r.chunk_id in "cd":
            assert r.start_line is None and r.end_line is None
    assert [(r.start_line, r.end_line) for r in got if r.chunk_id == "g"] == [(3, 4)]
    assert splitting.split_texts(df.limit(0), "chunk_id", "text", "start_line", "end_line").count() == 0


def test_lines_of_pieces_are_counted_from_prefix_sums():
    text = "".join(f"line {i} with some words\n" * (1 + i % 3) for i in range(300))
    ends = splitting.line_ends(text)
    for a, b in splitting.pieces(text):
        assert np.searchsorted(ends, a) == text.count("\n", 0, a) and np.searchsorted(ends, b - 1) == text.count("\n", 0, b - 1)
