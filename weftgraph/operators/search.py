"""Full-text search with BM25 over postings, boolean queries, and hybrid ranking by text and graph."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.fulltext import compile_text, fold_text, rewrite, token_array
from weftgraph.operators.graph import bfs
from weftgraph.sources.tables import fingerprint, kept, materialize

K1, B = 1.2, 0.75
#: Columns of a node that are indexed.
FIELDS = ("name", "summary", "synonyms", "description", "tags", "related_entities", "properties")
TEXT_WEIGHT, GRAPH_WEIGHT, MAX_RESULTS = 0.6, 0.4, 10


#: Parts a term's postings are cut into when they are written: no stop word is one task's work.
SALTS = 16


class Index:
    """Postings (term, id, col, pos) and lengths of the rows of a table; written once, sorted by term."""

    def __init__(self, rows: DataFrame, key: str, fields: Sequence[str], profile: str = "literal", name: str | None = None) -> None:
        """With a `name` (which must change with the rows) the index is kept, and a later session reads what an earlier one wrote."""
        arrays = rows.select(F.col(key).alias("id"), *[token_array(F.col(c).cast("string"), profile).alias(f"t{k}") for k, c in enumerate(fields)]).where("id is not null")
        names = [f"t{k}" for k in range(len(fields))]
        write = (lambda df, part: kept(df, f"{name}-{part}")) if name else (lambda df, part: materialize(df))
        self.lengths = write(arrays.select("id", sum((F.size(c) for c in names), F.lit(0)).cast("long").alias("size")), "lengths")

        def placed(k: int) -> Column:
            return F.transform(names[k], lambda t, p: F.struct(t.alias("term"), F.lit(k).alias("col"), p.alias("pos")))

        every = F.concat(*[placed(k) for k in range(len(names))])
        postings = arrays.select("id", F.inline(every))
        self.postings = write(postings.repartition("term", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("term"), "postings")

    @classmethod
    def of_table(cls, table: DataFrame, rows: DataFrame, key: str, fields: Sequence[str], profile: str = "literal") -> Index:
        """The kept index of `rows`, which are made of the files of `table`: built when these have changed, else read."""
        made_of = hashlib.sha256(f"{fingerprint(table)} {key} {','.join(fields)} {profile} 1".encode()).hexdigest()[:24]
        return cls(rows, key, fields, profile, f"index-{made_of}")

    def score(self, queries: DataFrame, mode: str = "and") -> DataFrame:
        """qid, id and rank (lower is better) of rows that match; queries: qid, atom, tokens (a phrase).

        Count, frequency and mean length are of the whole index. A phrase's tokens stand next to each other in one
        column. `and`: every atom must occur; `or`: any.
        """
        wanted = queries.select("qid", "atom", F.size("tokens").alias("k"), F.posexplode("tokens").alias("j", "term"))
        terms = getattr(queries, "_terms", None)  # known on the driver for plain queries: the scan skips what holds none of them
        postings = self.postings if terms is None else self.postings.where(F.col("term").isin(terms))
        hits = wanted.join(postings, "term").groupBy("qid", "atom", "k", "id", "col", (F.col("pos") - F.col("j")).alias("at")).agg(F.count_distinct("j").alias("got"))
        freq = hits.where("got = k").groupBy("qid", "atom", "id").agg(F.count(F.lit(1)).alias("f"))
        found = freq.groupBy("qid", "atom").agg(F.count(F.lit(1)).alias("n"))
        stats = self.lengths.agg(F.count(F.lit(1)).alias("rows"), F.avg("size").alias("mean"))
        idf = F.log((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
        scored = freq.join(found, ["qid", "atom"]).join(self.lengths, "id").join(F.broadcast(stats), F.lit(True))
        ranked = scored.groupBy("qid", "id").agg(F.sum(part).alias("s"), F.count_distinct("atom").alias("atoms"))
        if mode == "and":
            ranked = ranked.join(queries.groupBy("qid").agg(F.count_distinct("atom").alias("need")), "qid").where("atoms = need")
        return ranked.select("qid", "id", F.round(-F.col("s"), 9).alias("rank"))


def query_frame(spark: SparkSession, queries: dict[str, str], profile: str = "literal") -> DataFrame:
    """qid, atom, tokens of plain queries."""
    rows = [(q, k, atom) for q, text in queries.items() for k, atom in enumerate(compile_text(rewrite(text), profile))]
    out = spark.createDataFrame(rows, "qid string, atom int, tokens array<string>")
    out._terms = sorted({t for _, _, atom in rows for t in atom})
    return out


def or_queries(df: DataFrame, qid: Column, text: Column) -> DataFrame:
    """Each distinct token of a text as an atom of its own: recall queries by the row."""
    return df.select(qid.alias("qid"), F.posexplode(F.array_distinct(token_array(text))).alias("atom", "t")).select("qid", "atom", F.array("t").alias("tokens"))


def top_k(scored: DataFrame, k: int, order: str = "rank") -> DataFrame:
    """The `k` first rows of each query; ties by id."""
    w = Window.partitionBy("qid").orderBy(order, "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def strengths(hits: DataFrame) -> DataFrame:
    """`hits` with text: the strength of each rank relative to the query's best; all zero means all 1. A rank that is positive or no number fails the job."""
    rank = F.col("rank")
    bad = F.isnan(rank) | (rank > 0) | (F.abs(rank) == float("inf"))
    sound = F.when(bad, F.raise_error(F.lit("a rank is positive or not finite"))).otherwise(rank)
    best = F.max(-F.col("rank")).over(Window.partitionBy("qid"))
    return hits.withColumn("rank", sound).withColumn("text", F.when(best > 0, -F.col("rank") / best).otherwise(1.0))


def hybrid(nodes: DataFrame, edges: DataFrame, hits: DataFrame, limit: int = MAX_RESULTS, depth: int = 2, reach: int = 100, min_confidence: float = 0.0, domains: Sequence[str] = ()) -> DataFrame:
    """qid, id, score, depth: nodes by 0.6 of their text strength and 0.4 over their depth (at least 1), best first."""
    hits = materialize(strengths(top_k(hits, min(limit, MAX_RESULTS))))
    found, _ = bfs(nodes, edges, hits.select("qid", "id", F.col("place").alias("pos")), depth, min_confidence, reach, domains)
    joined = found.join(hits.select("qid", "id", "text"), ["qid", "id"], "left")
    score = TEXT_WEIGHT * F.coalesce("text", F.lit(0.0)) + GRAPH_WEIGHT / F.greatest(F.col("depth"), F.lit(1))
    scored = joined.withColumn("score", F.round(score, 9))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= min(limit, MAX_RESULTS)).select("qid", "place", "id", "score", "depth")


def impact(nodes: DataFrame, edges: DataFrame, hits: DataFrame, depth: int = 2, min_confidence: float = 0.0, reach: int = 100) -> DataFrame:
    """qid, id, depth of what is reached from the three best hits; the depth is kept within 1 to 5."""
    seeds = top_k(hits, 3).select("qid", "id", F.col("place").alias("pos"))
    found, _ = bfs(nodes, edges, seeds, max(1, min(5, depth)), min_confidence, reach)
    return found


def federate(parts: dict[str, DataFrame], limit: int = MAX_RESULTS) -> DataFrame:
    """Hits of several graphs as one list: score descending, then id; kb says whose."""
    every = None
    for kb, df in parts.items():
        one = df.withColumn("kb", F.lit(kb))
        every = one if every is None else every.unionByName(one)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id", "kb")
    return every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def within_budget(rows: DataFrame, group: Sequence[str], order: Sequence[str], cost: Column, budget: int) -> DataFrame:
    """Rows in order until the budget is passed: the row that passes it is still kept; 0 means no bound."""
    if budget <= 0:
        return rows
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(cost).over(w), F.lit(0))).where(F.col("_before") <= budget).drop("_before")


def token_estimate(text: Column) -> Column:
    """Estimated model tokens: 1.5 for a Han character, 1.3 for any other word, at least 1."""
    han = F.regexp_count(text, F.lit(r"\p{IsHan}"))
    words = F.regexp_count(F.regexp_replace(text, r"\p{IsHan}", " "), F.lit(r"\S+"))
    return F.greatest(F.floor(han * 1.5 + words * 1.3), F.lit(1)).cast("int")


def pack(rows: DataFrame, group: Sequence[str], order: Sequence[str], text: str, budget: int) -> DataFrame:
    """Rows in order within a budget of characters; the last one is clipped to what is left."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return rows.withColumn("_left", left).where("_left > 0").withColumn(text, F.substring(F.col(text), F.lit(1), F.col("_left").cast("int"))).drop("_left")


def cap_per_group(rows: DataFrame, query: str, group: str, order: Sequence[str], most: int, first: int) -> DataFrame:
    """At most `most` rows of a group in a query's order, and the first `first` of what is left."""
    inner = Window.partitionBy(query, group).orderBy(*order)
    outer = Window.partitionBy(query).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= most).drop("_n")
    return kept.withColumn("place", F.row_number().over(outer)).where(F.col("place") <= first)


def lexical(rows: DataFrame, key: str, text: str, terms: Sequence[str], k: int) -> DataFrame:
    """The plain ranker: number of terms that occur, then occurrences by length, then key."""
    folded = F.lower(F.coalesce(F.col(text), F.lit("")))
    counts = [(F.length(folded) - F.length(F.replace(folded, F.lit(t.lower()), F.lit("")))) / len(t) for t in terms]
    matched = sum(((c > 0).cast("int") for c in counts), F.lit(0))
    density = F.round(sum(counts, F.lit(0.0)) / F.greatest(F.length(folded), F.lit(1)), 9)
    scored = rows.select(F.col(key).alias("id"), matched.alias("matched"), density.alias("density")).where("matched > 0")
    return scored.orderBy(F.col("matched").desc(), F.col("density").desc(), "id").limit(k)


# Boolean queries

_LEX = re.compile(r'\s*(?:(\(|\))|(AND|OR|NOT)(?=[\s()]|$)|(?:(\w+)\s*:\s*)?(?:"((?:[^"]|"")*)"|([^\s()":*]+))(\*)?)')


def match(index: Index, query: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Ids of rows that match ``AND``, ``OR``, ``NOT``, parentheses, "phrases", prefix* and column:term; set algebra over postings."""
    items, at = [], 0
    while at < len(query.rstrip()):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise ValueError(f"syntax error at {at}")
        items.append(m.groups())
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return None if pos >= len(items) else items[pos][0] or items[pos][1] or "term"

    def disjunction() -> DataFrame:
        nonlocal pos
        out = conjunction()
        while peek() == "OR":
            pos += 1
            out = out.union(conjunction()).distinct()
        return out

    def conjunction() -> DataFrame:
        nonlocal pos
        out = primary()
        while peek() in ("AND", "NOT", "term", "("):
            word = peek()
            pos += word in ("AND", "NOT")
            if word == "AND" and peek() == "NOT":
                word, pos = "NOT", pos + 1
            out = out.join(primary(), "id", "left_anti" if word == "NOT" else "left_semi")
        return out

    def primary() -> DataFrame:
        nonlocal pos
        if peek() == "(":
            pos += 1
            out = disjunction()
            if peek() != ")":
                raise ValueError("missing parenthesis")
            pos += 1
            return out
        if peek() != "term":
            raise ValueError("a term is missing")
        _, _, column, phrase, word, star = items[pos]
        pos += 1
        tokens = re.findall(r"[^\W_]+", fold_text(phrase if phrase is not None else word))
        if column is not None and column not in fields:
            raise ValueError(f"no such column: {column}")
        own = index.postings if column is None else index.postings.where(F.col("col") == list(fields).index(column))
        if not tokens:
            return own.select("id").limit(0)
        out = None
        for j, t in enumerate(tokens):
            test = F.startswith("term", F.lit(t)) if star and j == len(tokens) - 1 else F.col("term") == t
            part = own.where(test).select("id", "col", (F.col("pos") - j).alias("at")).distinct()
            out = part if out is None else out.join(part, ["id", "col", "at"], "left_semi")
        return out.select("id").distinct()

    result = disjunction()
    if pos != len(items):
        raise ValueError("syntax error")
    return result.distinct()
