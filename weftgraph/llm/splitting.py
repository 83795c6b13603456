"""Splitting oversized texts at natural boundaries.

Running sums of token lengths give the offset at which each token ends. The offsets that end a paragraph, a line, a
sentence and a word are four sorted arrays; each holds the one before it. A piece ends at the last boundary under the
limit, found by binary search, of the strongest kind that leaves the piece at least half full; where there is none the
text is cut hard. The next piece starts about `overlap` characters before, at the best boundary near that place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_800, 200
#: A token is a run of blanks, a run of word characters without Han ones, one Han character, or one other sign.
_TOKEN = re.compile(r"\r?\n|[^\S\r\n]+|\r|[㐀-䶿一-鿿豈-﫿]|[^\W㐀-䶿一-鿿豈-﫿]+|[^\w\s]", re.S)
_STOPS = frozenset(".!?…。！？；;:")
_WIDE = frozenset("。！？；，、：）】》”")


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted offsets after which a paragraph, a line, a sentence or a word ends; each array holds those before it."""
    tokens = _TOKEN.findall(text)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    kinds = np.zeros(len(tokens), np.int8)
    for i, t in enumerate(tokens):
        if t[-1] == "\n":
            kinds[i] = 4 if (i and tokens[i - 1][-1] == "\n") or (i > 1 and tokens[i - 1].isspace() and tokens[i - 2][-1] == "\n") else 3
        elif t.isspace():
            kinds[i] = 2 if i and tokens[i - 1] in _STOPS else 1
        elif t in _WIDE:
            kinds[i] = 2 if t in "。！？；" else 1
        elif "㐀" <= t <= "鿿":
            kinds[i] = 1
    return [ends[kinds >= k] for k in (4, 3, 2, 1)]


def _last(bounds: list[np.ndarray], low: int, high: int) -> int | None:
    """The last boundary in (low, high] of the strongest kind that has one there."""
    for b in bounds:
        at = np.searchsorted(b, high, side="right") - 1
        if at >= 0 and b[at] > low:
            return int(b[at])
    return None


def _hard(text: str, at: int, low: int) -> int:
    """A cut at `at`, or a little before it, that parts no sign from its marks and no CR from its LF."""
    for k in range(at, max(low + 1, at - 16), -1):
        if k >= len(text) or not (unicodedata.combining(text[k]) or text[k] in "‍️" or text[k - 1] == "‍" or text[k - 1 : k + 1] == "\r\n"):
            return k
    return at


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece: at most `limit` characters, together the whole text. An empty text has none."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    bounds = boundaries(text)
    out, start = [], 0
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        end = _last(bounds, start + limit // 2, start + limit) or _hard(text, start + limit, start)
        out.append((start, end))
        aim = end - overlap
        back = _last(bounds[1:], max(start, aim - overlap // 2), aim + overlap // 4) if overlap else end
        start = max(start + 1, back if back is not None else _hard(text, aim, start))


def line_ends(text: str) -> np.ndarray:
    """Sorted offsets of the line ends: as many lie before an offset as lines were left behind there."""
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10)


def split_texts(df: DataFrame, key: str, text: str, start_line: str, end_line: str, limit: int = LIMIT, overlap: int = OVERLAP, once: bool = True) -> DataFrame:
    """Pieces of each text: key, piece (from 0), n_pieces, start_char, end_char, start_line, end_line, text.

    A text of at most `limit` characters (Unicode code points) is one piece. Lines are counted from the row's start
    line; where that is exchanged with the end line the smaller counts, and where it is null or below 1 the lines are
    null. Null and empty texts have no piece. Rows that come twice come out once; two texts of one key are both split.
    Other columns are not read. Work is by row, without a shuffle but that of the repeated rows; with `once` off they
    come out again and nothing is shuffled.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    first = F.when(F.col(end_line) >= 1, F.least(F.col(start_line), F.col(end_line))).otherwise(F.col(start_line))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.when(F.col(start_line) >= 1, first).cast("int").alias("line")).where("text is not null and text <> ''")
    rows = rows.distinct() if once else rows
    kind = rows.schema["key"].dataType
    schema = f"key {kind.simpleString()}, piece int, n_pieces int, start_char long, end_char long, start_line int, end_line int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            at = []
            for i, (t, line) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                cuts = pieces(t, limit, overlap)
                ends = None if line is None else line_ends(t)
                for k, (a, b) in enumerate(cuts):
                    at.append(i)
                    low, high = (None, None) if line is None else (line + int(np.searchsorted(ends, a)), line + int(np.searchsorted(ends, b - 1)))
                    for col, v in zip(rows[1:], (k, len(cuts), a, b, low, high, t[a:b])):
                        col.append(v)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            names = ["key", "piece", "n_pieces", "start_char", "end_char", "start_line", "end_line", "text"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(rows[1:], kinds)]], names=names)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
