"""Words of many texts at once, as arrays: code points are classified, cut and hashed without a Python loop over words.

A word is a longest run of letters and digits of the lower-cased text, each Han character alone. A word's hash is
that of its code points: a polynomial over 64-bit values of the characters, taken from running sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters of text handled at once; bounds the memory of a task whatever the length of a text.
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_END = "\x00"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point (0 separator, 1 letter or digit, 2 Han) and its 64-bit value."""
    import regex

    kind = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for m in re.finditer(r"[^\W_]+", every):
            kind[low + m.start() : low + m.end()] = 1
        for m in regex.finditer(r"\p{Han}+", every):
            span = kind[low + m.start() : low + m.end()]
            span[span == 1] = 2
    return kind, mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    up, down = np.full(n, _P, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points; equal spans have equal hashes."""
    n = len(codes)
    size = 1 << max(10, int(n).bit_length())
    up, down = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_tables()[1][codes] * up[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def cut_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    kind = _tables()[0][codes]
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    after = np.zeros_like(kind)
    after[:-1] = kind[1:]
    inside = kind > 0
    han = kind == 2
    starts = np.flatnonzero(inside & ((before == 0) | han | (before == 2)))
    ends = np.flatnonzero(inside & ((after == 0) | han | (after == 2))) + 1
    return starts, ends


def chunks(texts: list[str], chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `chunk` characters together; a longer text is a range of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chunk:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and for each text the number of words before it (one more entry than texts)."""
    lowered = [t.lower() for t in texts]
    codes = code_points(_END.join(lowered))
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts, ends = cut_words(codes)
    at = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    return span_hashes(codes, starts, ends), np.searchsorted(starts, at).astype(np.int64)
