"""Evaluation texts that leaked into training text: Wu-Manber multi-pattern search over words.

Every case (a run of `RUN` words of an item, or a share of its five-word sequences) holds at least one five-word
sequence of the item, so the patterns are all five-word sequences of all items. A table over blocks of two words says
how far a window may be moved without missing a pattern; where it says zero, the bucket of the block at the window's
end, narrowed by the block at its start, holds the patterns that are compared word by word. Many windows are moved at
once. Matches are then counted exactly for each document and item. Texts are read once, whole; there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import vectext

WORDS, RUN, SHARE, BLOCK = 5, 15, 0.4, 2
#: Items, and signs of their texts, searched for at once: what is sent to the tasks holds about as much; further items are searched for in further passes.
ITEMS_AT_ONCE, SIGNS_AT_ONCE = 50_000, 8_000_000
_LANES = 2048
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_HIDDEN = re.compile("[\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufeff]")


def clean(text: str) -> str:
    """`text` without HTML tags, soft hyphens and zero-width characters."""
    if "<" in text:
        text = _TAG.sub("", text)
    return text if text.isascii() else _HIDDEN.sub("", text)


class Patterns:
    """The tables of the search, from (item, text) pairs."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        hashes, at = vectext.word_hashes([clean(t) for _, t in items])
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        grams, owners, places = [], [], []
        for i in range(len(items)):
            own = ids[at[i] : at[i + 1]]
            if len(own) >= WORDS:
                grams.append(np.lib.stride_tricks.sliding_window_view(own, WORDS))
                owners.append(np.full(len(own) - WORDS + 1, i))
                places.append(np.arange(len(own) - WORDS + 1))
        self.items = np.array([k for k, _ in items], np.int64)
        if not grams:
            self.grams = np.zeros((0, WORDS), np.int64)
            return
        self.grams, which = np.unique(np.concatenate(grams), axis=0, return_inverse=True)
        which = which.reshape(-1)
        owners, places = np.concatenate(owners), np.concatenate(places)
        order = np.argsort(which, kind="stable")
        self.owner, self.place = owners[order], places[order]
        self.first = np.searchsorted(which[order], np.arange(len(self.grams) + 1))
        pairs = np.unique(np.stack([owners, which]), axis=1)
        self.distinct = np.bincount(pairs[0], minlength=len(items))
        # Shift: the least distance of a block of any pattern from the pattern's end. Zero: the block ends a pattern.
        self.bits = max(12, int(4 * len(self.grams)).bit_length())
        self.shift = np.full(1 << self.bits, WORDS - BLOCK + 1, np.int8)
        for end in range(BLOCK, WORDS + 1):
            np.minimum.at(self.shift, self._slot(self.grams[:, end - 2], self.grams[:, end - 1]), WORDS - end)
        keys = self._bucket(self.grams)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = vectext.mix((a + 1).astype(np.uint64) * np.uint64(1_000_003) + (b + 1).astype(np.uint64))
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def _bucket(self, grams: np.ndarray) -> np.ndarray:
        """The block at the end in the high bits, that at the start in the low ones."""
        end, start = self._slot(grams[:, -2], grams[:, -1]), self._slot(grams[:, 0], grams[:, 1])
        return (end << np.int64(self.bits)) | start

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; -1 for a word that no item has."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each window that equals a pattern, and the pattern. Windows over -1 never match."""
        n = len(words)
        if n < WORDS or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(64, -(-n // _LANES))
        at = np.arange(WORDS - 1, n, step)  # last word of each lane's window; a lane ends where the next begins
        stop = np.minimum(at + step, n)
        hits = []
        while len(at):
            a, b = words[at - 1], words[at]
            move = np.where((a < 0) | (b < 0), WORDS - BLOCK + 1 - (b >= 0), self.shift[self._slot(a, b)])
            hits.append(at[move == 0])
            at = at + np.maximum(move, 1)
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        begin = np.concatenate(hits) - (WORDS - 1)
        windows = words[begin[:, None] + np.arange(WORDS)]
        sound = (windows >= 0).all(axis=1)
        begin, windows = begin[sound], windows[sound]
        keys = self._bucket(windows)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        starts, found = [], []
        for k in range(int((high - low).max(initial=0))):  # the bucket's members, one after the other
            open_ = np.flatnonzero(low + k < high)
            which = self.order[low[open_] + k]
            same = (windows[open_] == self.grams[which]).all(axis=1)
            starts.append(begin[open_[same]])
            found.append(which[same])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)

    def cases(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and item number of each case; `at`: the words before each text."""
        starts, found = self.search(words)
        text = np.searchsorted(at, starts, side="right") - 1
        within = starts + WORDS <= at[text + 1] if len(starts) else np.zeros(0, bool)
        starts, found, text = starts[within], found[within], text[within]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        times = self.first[found + 1] - self.first[found]
        rows = np.repeat(np.arange(len(starts)), times)
        slot = np.repeat(self.first[found], times) + np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        item, place = self.owner[slot], self.place[slot]
        pair = text[rows] * len(self.items) + item
        seen = np.unique(np.stack([pair, found[rows]]), axis=1)[0]
        pairs, count = np.unique(seen, return_counts=True)
        good = pairs[count >= SHARE * self.distinct[pairs % len(self.items)] - 1e-9]
        order = np.lexsort((starts[rows], place - starts[rows], pair))
        p, d, s = pair[order], (place - starts[rows])[order], starts[rows][order]
        new = np.ones(len(order), bool)
        new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
        length = np.diff(np.append(np.flatnonzero(new), len(order)))
        runs = p[new][length >= RUN - WORDS + 1]
        every = np.unique(np.concatenate([good, runs]))
        return every // len(self.items), every % len(self.items)


def contaminated(documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str) -> DataFrame:
    """doc_id and item_id of each document that holds a passage of an item, each pair once.

    A document is a case for an item if it holds at least 15 consecutive words of it, or at least 0.4 of its distinct
    five-word sequences. Null and empty texts, and items of fewer than five words, are no case. Texts of any length
    are searched whole. Repeated ids on either side come out once; ties and other columns do not matter, and an empty
    table gives an empty result. Items are sent to the tasks in blocks of about
    `ITEMS_AT_ONCE` items or `SIGNS_AT_ONCE` signs, whichever is less; every block meets all documents.
    """
    spark = documents.sparkSession
    held = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    size = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("signs")).first()
    blocks = 1 + max(size.n // ITEMS_AT_ONCE, size.signs // SIGNS_AT_ONCE)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where("text is not null and text <> ''")
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = None
    for k in range(blocks):
        part = [(r.i, r.t) for r in held.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()]
        shared = spark.sparkContext.broadcast(Patterns(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            for batch in batches:
                texts = [clean(t) for t in batch.column(1).to_pylist()]
                for low, high in vectext.chunks(texts):
                    hashes, at = vectext.word_hashes(texts[low:high])
                    if not len(patterns.grams):
                        continue
                    doc, item = patterns.cases(patterns.number(hashes), at)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(low + doc)), pa.array(patterns.items[item])], names=["doc_id", "item_id"])

        found = docs.mapInArrow(run, f"doc_id {kind}, item_id long")
        result = found if result is None else result.unionByName(found)
    return result.distinct()
