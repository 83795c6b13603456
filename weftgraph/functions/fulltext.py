"""Tokens and queries of the full-text search."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.text import space_han

#: Latin letters with marks and the letters they are compared as, by their decomposition.
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii()]
_BARE = [unicodedata.normalize("NFD", c)[0] for c in _MARKED]
PROFILES = ("literal", "han", "trigram")
_TOKEN = re.compile(r"[^\W_]+")


def fold(c: Column) -> Column:
    """Lower case, marks taken off Latin letters."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "".join(_MARKED), "".join(_BARE))


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans("".join(_MARKED), "".join(_BARE)))


def token_array(c: Column, profile: str = "literal") -> Column:
    """Tokens of a text: runs of letters and digits; `han` has each Han character alone, `trigram` all runs of three signs."""
    if profile == "trigram":
        text = F.regexp_replace(fold(c), r"\s+", " ")
        n = F.length(text)
        return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    text = fold(space_han(c)) if profile == "han" else fold(c)
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def compile_text(query: str, profile: str = "literal") -> list[list[str]]:
    """The atoms of a plain query, each a phrase of tokens; all must occur. Operators in it are ordinary words."""
    if not query.strip() or "\x00" in query:
        raise ValueError("blank query" if not query.strip() else "query holds NUL")
    query.encode()  # lone surrogates are no valid text
    if profile == "han":
        query = re.sub(r"([㐀-䶿一-鿿])", r" \1 ", query)
    atoms = [_TOKEN.findall(fold_text(a)) for a in query.split()]
    return [a for a in atoms if a]


def expand_abbreviations(query: str, known: dict[str, str]) -> str:
    """Whole words that are abbreviations replaced, the longest first, of equal ones in order; later ones may rewrite earlier ones' text."""
    for k in sorted((k for k in known if re.fullmatch(r"[A-Za-z0-9]+", k)), key=lambda k: (-len(k), k)):
        query = re.sub(rf"(?<![A-Za-z0-9]){re.escape(k)}(?![A-Za-z0-9])", lambda _, v=known[k]: v, query)
    return query


def rewrite(query: str, known: dict[str, str] | None = None) -> str:
    return " ".join(expand_abbreviations(query, known or {}).split())


def expand_words(c: Column, known: dict[str, str]) -> Column:
    """`expand_abbreviations` on a column."""
    for k in sorted((k for k in known if re.fullmatch(r"[A-Za-z0-9]+", k)), key=lambda k: (-len(k), k)):
        c = F.regexp_replace(c, rf"(?<![A-Za-z0-9]){re.escape(k)}(?![A-Za-z0-9])", known[k].replace("\\", "\\\\").replace("$", "\\$"))
    return c
