"""Mixing sources to target shares of the tokens, by nested hash thresholds.

Every document has a 60-bit hash of its id. A source's part is its documents with a hash below a threshold, besides
whole copies where it must repeat. The threshold is found without sorting: tokens are summed by source and bucket of
1,024 (the hash's first ten bits); the cumulated sums say in which bucket the budget ends; only that bucket is split
again by the next ten bits, and so on until it holds one document. The driver holds 1,024 sums for each of at most
`SOURCES_AT_ONCE` sources, never a row of a document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import strip
from weftgraph.sources.tables import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STEP, LEVELS = 10, 6
#: Sources whose histograms are on the driver at once (1,024 sums each), and parts that are sent to every task; of more the rest follows in turn, or is joined by shuffle.
SOURCES_AT_ONCE, PARTS_SENT = 1_000, 100_000


def count_tokens(documents: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep` columns with n_tokens of the whole text; null and empty texts have 0."""
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, f"{schema}, n_tokens long")


_LOADED: dict[int, object] = {}


def _encoding(raw: bytes) -> object:
    """The tokenizer, built once in a Python worker."""
    import tiktoken

    key = hash(raw)
    if key not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _LOADED[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


@dataclass
class Part:
    """What a source gives: `copies` of everything and once more what lies below `threshold`."""

    source: str
    share: float
    max_repeats: int
    tokens: int
    budget: float = 0.0
    copies: int = 0
    threshold: int = 0
    taken: int = 0

    @property
    def used(self) -> int:
        return self.copies * self.tokens + self.taken


def _source(c: str):
    return F.coalesce(F.lower(strip(F.col(c))), F.lit(""))


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = targets.select(_source("source").alias("source"), "target_share", "max_repeats").where("source <> '' and target_share > 0").collect()
    best: dict[str, tuple[float, int]] = {}
    for r in rows:
        share, most = best.get(r.source, (0.0, 0))
        best[r.source] = (max(share, r.target_share), max(most, 1 if r.max_repeats is None else r.max_repeats))
    return [(s, share, most) for s, (share, most) in sorted(best.items())]


def plan(rows: DataFrame, targets: DataFrame) -> list[Part]:
    """The parts of the largest mixture that keeps all shares and caps; shares of sources without text go to the others in proportion."""
    wanted = _targets(targets)
    mine = rows.where("n_tokens > 0").join(_sent(rows.sparkSession, [(s,) for s, _, _ in wanted], "source string"), "source", "left_semi")
    have = {r.source: r.t for r in mine.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    parts = [Part(s, share, most, have.get(s, 0)) for s, share, most in wanted]
    open_ = [p for p in parts if p.tokens > 0 and p.max_repeats > 0]
    if not open_:
        return parts
    total_share = sum(p.share for p in open_)
    total = min(p.max_repeats * p.tokens * total_share / p.share for p in open_)
    left = {}
    for p in open_:
        p.budget = total * p.share / total_share
        p.copies = min(p.max_repeats, int(p.budget / p.tokens + 1e-9))
        rest = p.budget - p.copies * p.tokens
        if rest >= 1 and p.copies < p.max_repeats:
            left[p.source] = (p, rest)
    open_sources = sorted(left)
    for k in range(0, len(open_sources), SOURCES_AT_ONCE):
        _thresholds(mine, {s: left[s] for s in open_sources[k : k + SOURCES_AT_ONCE]})
    return parts


def _sent(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver, sent to every task if it is within the bound."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= PARTS_SENT else table


def _thresholds(mine: DataFrame, left: dict[str, tuple[Part, float]]) -> None:
    """Sets threshold and taken of each part: the last hash bound below which its tokens fit what is left of its budget."""
    prefix = dict.fromkeys(left, 0)
    for level in range(1, LEVELS + 1):
        if not left:
            break
        shift = 60 - STEP * level
        # Only the boundary bucket of each source is read on; all others are decided.
        inside = mine.select("source", "n_tokens", "h").join(_sent(mine.sparkSession, [(s, prefix[s] >> STEP) for s in left], "source string, _at long"), "source")
        if level > 1:
            inside = inside.where(F.shiftright("h", shift + STEP) == F.col("_at"))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        by: dict[str, list[tuple[int, int, int]]] = {}
        for r in sums:
            by.setdefault(r.source, []).append((r.b, r.t, r.n))
        for s in list(left):
            p, rest = left[s]
            edge = None
            for b, t, n in sorted(by.get(s, [])):
                if p.taken + t > rest:
                    edge = (b, n)
                    break
                p.taken += t
                p.threshold = (b + 1) << shift
            if edge is None or edge[1] == 1 or level == LEVELS:
                del left[s]
                if edge is not None:
                    p.threshold = edge[0] << shift
            else:
                p.threshold = edge[0] << shift
                prefix[s] = edge[0] << STEP


def hashed(documents: DataFrame, doc_id: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (lower case, no outer blanks, null as empty), n_tokens and h: written once, since every level reads it."""
    keyed = documents.select(F.col(doc_id).alias("doc_id"), _source(source).alias("source"), F.col(text).alias("text"), F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit("mixture")), 4).alias("h"))
    return materialize(count_tokens(keyed, ["doc_id", "source", "h"], "text", vocabulary))


def mixture(rows: DataFrame, parts: list[Part]) -> DataFrame:
    """doc_id, source, n_tokens, repeats of each document used; `rows` of `hashed`, `parts` of `plan`.

    Documents without tokens, and those of sources without a target, are not used. A source reaches its budget to
    within one document. Repeated ids have one hash and are used alike. With empty tables nothing comes out.
    """
    if not parts:
        return rows.select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats")).where(F.lit(False))
    table = _sent(rows.sparkSession, [(p.source, p.copies, p.threshold) for p in parts], "source string, copies int, threshold long")
    joined = rows.where("n_tokens > 0").join(table, "source")
    repeats = F.col("copies") + (F.col("h") < F.col("threshold")).cast("int")
    return joined.select("doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def shares(rows: DataFrame, parts: list[Part]) -> DataFrame:
    """What each source was to give and gave, measured on the mixture itself; sources without target or text are listed with zero."""
    spark = rows.sparkSession
    goal = spark.createDataFrame([(p.source, p.share, p.max_repeats) for p in parts], "source string, target_share double, max_repeats int")
    used = mixture(rows, parts).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    have = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens_available"))
    total = F.lit(max(1, sum(p.used for p in parts)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        have.join(goal, "source", "full").join(used, "source", "left")
        .select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("max_repeats"), zero("tokens_available"), zero("tokens_used"), zero("most_repeats"), F.round(F.coalesce(F.col("tokens_used") / total, F.lit(0.0)), 6).alias("actual_share"))
    )
