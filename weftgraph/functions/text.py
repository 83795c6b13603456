"""Text expressions: blanks, words, tokens, slugs."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Every character that counts as a blank (tabs, line ends, separators of any kind).
BLANK = r"\x09-\x0d\x1c-\x20\x85\p{Z}"
#: One Han character, or a run of other letters and digits, after lower-casing and spacing Han characters.
WORD = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    """`c` without outer blanks; null stays null."""
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def squeeze(c: Column) -> Column:
    """Null as empty, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[{BLANK}]+", " "))


def squeeze_fast(c: Column) -> Column:
    """The same as `squeeze`; a text of plain signs with single blanks, as most are, is passed over without a pattern."""
    odd = F.contains(c, F.lit("  "))
    for sign in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f":
        odd |= F.contains(c, F.lit(sign))
    plain = (F.octet_length(c) == F.char_length(c)) & ~odd
    return F.when(plain, F.trim(c)).otherwise(squeeze(c))


def space_han(c: Column) -> Column:
    """A blank around each Han character, so that each becomes a word of its own."""
    return F.regexp_replace(c, r"(\p{IsHan})", " $1 ")


def words(c: Column) -> Column:
    """The words of `c` in order: lower-cased runs of letters and digits, each Han character alone."""
    return F.regexp_extract_all(space_han(F.lower(F.coalesce(c, F.lit("")))), F.lit(f"({WORD})"), F.lit(1))


def tokens(c: Column) -> Column:
    """Full-text tokens: runs of letters, digits and private-use characters, case-folded; a Han run is one token."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def base_name(c: Column) -> Column:
    """The last part of a path with either kind of slash."""
    return F.regexp_extract(strip(c), r"([^/\\]*)$", 1)


def source_path(c: Column) -> Column:
    """A path without outer blanks and without one leading ``./``."""
    return F.regexp_replace(strip(c), r"^\./", "")


def node_key(c: Column) -> Column:
    """A node id as it is compared: lower case, no outer blanks, blank as null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def slug(c: Column) -> Column:
    """Letters lower-cased, digits kept, any other run one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "-"), r"^-+|-+$", "")


@pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()))


def fold_compatible(c: Column) -> Column:
    """Compatibility forms composed, case folded, runs of blanks as one; plain ASCII stays in the JVM."""
    plain = F.octet_length(c) == F.char_length(c)
    return squeeze(F.when(plain, F.lower(c)).otherwise(_nfkc(c)))


@pandas_udf(T.BooleanType())
def strict_object(texts: pd.Series) -> pd.Series:
    """Whether a text is one JSON object in which no key comes twice, at any depth; null stays null."""

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key comes twice")
        return dict(pairs)

    def sound(t: str) -> bool:
        try:
            return isinstance(json.loads(t, object_pairs_hook=once), dict)
        except ValueError:
            return False

    return texts.map(lambda t: None if t is None else sound(t))
