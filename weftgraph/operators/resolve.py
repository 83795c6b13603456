"""Entity resolution: similar names, conflicts, fusion, and endpoints of relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from weftgraph.sources.schemas import SEMANTIC_KINDS
from weftgraph.sources.tables import materialize

PREFIX_SCALE, MOST_PREFIX = 0.1, 4
LEVENSHTEIN, SIMILARITY = 3, 0.85


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler with half transpositions kept and the prefix counted at any similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    half = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used) if u))) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:MOST_PREFIX], b[:MOST_PREFIX]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * PREFIX_SCALE * (1 - jaro)


@pandas_udf(T.DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)])


@pandas_udf(T.IntegerType())
def byte_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    def distance(x: bytes, y: bytes) -> int:
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    return pd.Series([None if x is None or y is None else distance(x.encode(), y.encode()) for x, y in zip(a, b)], dtype="Int32")


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Distance in bytes if at most `most`, else null or more; ASCII texts stay in the JVM."""
    plain = (F.octet_length(a) == F.char_length(a)) & (F.octet_length(b) == F.char_length(b))
    return F.when(plain, F.nullif(F.levenshtein(a, b, most), F.lit(-1))).otherwise(byte_levenshtein(a, b))


def similar_to(nodes: DataFrame, name: str, most: int = LEVENSHTEIN) -> DataFrame:
    """Nodes whose lower-cased name is within `most` byte edits of a name: a scan."""
    return nodes.withColumn("distance", edit_distance(F.lower("name"), F.lit(name.lower()), most)).where(F.col("distance") <= most)


def similar_names(names: DataFrame, most: int = LEVENSHTEIN) -> DataFrame:
    """name_a < name_b and distance of all pairs of distinct names within `most` byte edits, without comparing all.

    A name is cut into most + 1 segments; of two names that close one segment of the longer or shorter stands
    unchanged in the other, moved by at most `most`. Names meet on (length, segment number, segment text).
    """
    k = most + 1
    base = names.select(F.lower("name").alias("name")).where("name <> ''").distinct().withColumn("n", F.length("name"))
    cut = lambda n, i: (F.floor(n * i / k)).cast("int")
    numbers = F.sequence(F.lit(0), F.lit(k - 1))
    own = base.select("name", "n", F.explode(F.transform(numbers, lambda i: F.struct(i.alias("seg"), F.substring(F.col("name"), cut(F.col("n"), i) + 1, cut(F.col("n"), i + 1) - cut(F.col("n"), i)).alias("text")))).alias("s")).select("name", F.col("n").alias("len"), "s.seg", "s.text")
    lengths = F.sequence(F.greatest(F.col("n") - most, F.lit(1)), F.col("n"))

    def moved(l: Column, i: Column) -> Column:
        """Places where segment i of a name of length l may stand in this name, given that the first i segments hold at most i edits and the later ones the rest."""
        more = F.col("n") - l
        low, high = F.greatest(-i, more - (most - i)), F.least(i, more + (most - i))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def place(l: Column, i: Column, d: Column) -> Column:
        return F.struct(l.alias("len"), i.alias("seg"), F.substring(F.col("name"), cut(l, i) + 1 + d, cut(l, i + 1) - cut(l, i)).alias("text"), (cut(l, i) + d).alias("at"))

    every = F.flatten(F.transform(lengths, lambda l: F.flatten(F.transform(numbers, lambda i: F.transform(moved(l, i), lambda d: place(l, i, d))))))
    probes = base.select("name", F.explode(every).alias("p")).select("name", "p.len", "p.seg", "p.text", "p.at").where("at >= 0").drop("at").distinct()
    met = own.withColumnRenamed("name", "x").join(probes.withColumnRenamed("name", "y"), ["len", "seg", "text"])
    # characters differ no more than bytes: far names are dropped where they meet
    near = met.where((F.col("x") != F.col("y")) & (F.levenshtein("x", "y", most) >= 0)).select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b")).distinct()
    return near.withColumn("distance", edit_distance(F.col("name_a"), F.col("name_b"), most)).where(F.col("distance") <= most)


def conflicts(nodes: DataFrame, most: int = LEVENSHTEIN, least: float = SIMILARITY) -> DataFrame:
    """id_a < id_b of nodes whose names are close in both measures, with distance and similarity.

    Nodes of equal names (whatever their case) are one class, named by its least id: pairs of different names are given
    between these, and each other member is linked to its own with distance 0. So no class is expanded into all pairs.
    """
    named = nodes.select("id", F.lower("name").alias("name")).where("name <> ''").distinct()
    reps = named.groupBy("name").agg(F.min("id").alias("rep"))
    close = similar_names(named, most).withColumn("similarity", F.round(jaro_winkler_column("name_a", "name_b"), 9)).where(F.col("similarity") > least)
    a, b = (reps.select(F.col("rep").alias(f"id_{k}"), F.col("name").alias(f"name_{k}")) for k in "ab")
    near = close.join(a, "name_a").join(b, "name_b").where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "distance", "similarity")
    same = named.join(reps, "name").where("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"))
    return near.unionByName(same).distinct()


def resolve_references(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """`refs` with resolved_id and resolution: by exact name, else exact id, else a name within the synonyms (where ``%`` and ``_`` stay wildcards); the least id of several; else external."""
    by_name = nodes.where("name <> ''").groupBy(F.col("name").alias("target_entity")).agg(F.min("id").alias("_name"))
    ids = nodes.select(F.col("id").alias("target_entity"), F.col("id").alias("_id")).distinct()
    first = refs.join(by_name, "target_entity", "left").join(ids, "target_entity", "left")
    open_ = first.where("_name is null and _id is null").select("target_entity").distinct()
    held = _within(open_, nodes.where("synonyms <> ''").groupBy(F.lower("synonyms").alias("text")).agg(F.min("id").alias("id")))
    done = first.join(held, "target_entity", "left").withColumn("resolved_id", F.coalesce("_name", "_id", "_synonym"))
    return done.withColumn("resolution", F.when(F.col("resolved_id").isNull(), "external_kg").otherwise("resolved")).drop("_name", "_id", "_synonym")


def _within(names: DataFrame, texts: DataFrame) -> DataFrame:
    """target_entity and _synonym: the least id of the texts that are like ``%name%``, whatever stands around the name.

    Of a name the signs between wildcards are cut into runs of three (of fewer where no stretch has three, none where all
    are wildcards); a text can only match if it holds every run. Name and text meet on the rarest run, the pattern decides.
    """

    def grams(text: Column, n: Column) -> Column:
        return F.when(n == 0, F.array(F.lit(""))).when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))

    stretches = F.split(F.lower("target_entity"), "[%_]")
    size = F.least(F.lit(3), F.array_max(F.transform(stretches, F.length)))
    wanted = names.where("target_entity <> ''").select("target_entity", stretches.alias("s"), size.alias("n"))
    runs = materialize(wanted.select("target_entity", "n", F.explode(F.array_distinct(F.flatten(F.filter(F.transform("s", lambda x: grams(x, F.col("n"))), lambda g: g.isNotNull())))).alias("gram")))
    sizes = F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))
    every = texts.select("text", "id", F.explode(F.array_distinct(F.flatten(F.filter(F.transform(sizes, lambda n: grams(F.col("text"), n)), lambda g: g.isNotNull())))).alias("gram"))
    index = materialize(every.join(runs.select("gram").distinct(), "gram", "left_semi"))
    often = runs.join(index.groupBy("gram").count(), "gram", "left")
    rarest = often.groupBy("target_entity").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), F.col("gram"))).alias("m")).select("target_entity", F.col("m.gram").alias("gram"))
    pattern = F.concat(F.lit("%"), F.replace(F.lower("target_entity"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return rarest.join(index, "gram").withColumn("pattern", pattern).where("text like pattern").groupBy("target_entity").agg(F.min("id").alias("_synonym"))


def fuse(candidates: DataFrame) -> DataFrame:
    """One node for equal (scope, label, name, summary, description, members): skills and synonyms united, the highest confidence; alias is the first of the aliases."""
    key = ["scope", "label", "name", "summary", "description"]
    keyed = candidates.withColumn("members", F.array_sort(F.array_distinct("members")))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return keyed.groupBy(*key, "members").agg(F.min("alias").alias("alias"), united("synonyms"), united("skills"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("alias")).alias("aliases"))


def redirect(relations: DataFrame, fused: DataFrame) -> DataFrame:
    """Endpoints of relations replaced by the alias that survived the fusion; loops go, equal relations become one."""
    to = fused.select("scope", F.explode("aliases").alias("old"), F.col("alias").alias("new"))
    a = relations.join(to.select("scope", F.col("old").alias("source"), F.col("new").alias("_a")), ["scope", "source"], "left")
    b = a.join(to.select("scope", F.col("old").alias("target"), F.col("new").alias("_b")), ["scope", "target"], "left")
    out = b.select("scope", F.coalesce("_a", "source").alias("source"), F.coalesce("_b", "target").alias("target"), "kind", "description", "confidence")
    return out.where("source <> target").groupBy("scope", "source", "target", "kind", "description").agg(F.max("confidence").alias("confidence"))


def clean_members(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """id with its known members, each kept by the first node in order only; nodes without any are left with an empty list."""
    rows = nodes.select("id", "ord", F.posexplode_outer("members").alias("p", "unit_id"))
    known = rows.join(units.select("unit_id").distinct(), "unit_id", "left_semi")
    w = Window.partitionBy("unit_id").orderBy("ord", "p")
    first = known.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    kept = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "unit_id"))), lambda x: x["unit_id"]).alias("members"))
    return nodes.select("id").distinct().join(kept, "id", "left").select("id", F.coalesce("members", F.array().cast("array<string>")).alias("members"))


def coverage(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: units, covered ones, and the share; a unit is covered by being a member of a node."""
    used = nodes.select(F.explode("members").alias("unit_id")).distinct()
    marked = units.select("unit_id").distinct().join(used.withColumn("hit", F.lit(1)), "unit_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("units"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 9).alias("rate"))


def select_candidates(nodes: DataFrame) -> DataFrame:
    """Candidates fit to be stored: with an id, of one meaning, and a finite confidence in [0, 1]; exact repeats become one."""
    good = nodes.where((F.coalesce("id", F.lit("")) != "") & ~F.isnan("confidence") & F.col("confidence").between(0, 1))
    key = F.to_json(F.struct("label", "name", "summary", "description"))
    one = good.withColumn("_key", key).groupBy("id").agg(F.count_distinct("_key").alias("_keys")).where("_keys = 1").select("id")
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return good.join(one, "id", "left_semi").groupBy("id", "label", "name", "summary", "description").agg(united("synonyms"), united("skills"), F.max("confidence").alias("confidence"))


def resolve_endpoints(relations: DataFrame, names: DataFrame) -> DataFrame:
    """`relations` (scope, source, target) with source_id and target_id: an alias of the own scope, else ``scope/alias``, else one that is unique overall; otherwise null. names: scope, alias, id."""
    local = names.groupBy("scope", "alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"))
    framed = names.groupBy(F.concat_ws("/", "scope", "alias").alias("alias")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"))
    overall = names.groupBy("alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"))
    out = relations
    for end in ("source", "target"):
        pick = lambda df, tag: df.select(*[c for c in df.columns if c == "scope"], F.col("alias").alias(end), F.when(F.col("n") == 1, F.col("one")).alias(f"_{tag}"), (F.col("n") > 0).alias(f"_{tag}_hit"))  # noqa: B023, E731
        out = out.join(pick(local, "l"), ["scope", end], "left").join(pick(framed, "f"), end, "left").join(pick(overall, "o"), end, "left")
        chosen = F.when(F.col("_l_hit"), F.col("_l")).when(F.col("_f_hit"), F.col("_f")).otherwise(F.col("_o"))
        out = out.withColumn(f"{end}_id", chosen).drop("_l", "_f", "_o", "_l_hit", "_f_hit", "_o_hit")
    return out


def valid_relations(relations: DataFrame) -> DataFrame:
    """Relations of a semantic kind with a finite confidence in [0, 1] and two endpoints that are not blank."""
    c = F.col("confidence")
    return relations.where(F.col("kind").isin(*SEMANTIC_KINDS) & ~F.isnan(c) & c.between(0, 1) & (F.trim("source_id") != "") & (F.trim("target_id") != ""))


def lowest_confidence(members: DataFrame, key: str) -> DataFrame:
    """The least confidence of a node's members, at most 1; 0 or less counts as 0.8."""
    low = F.least(F.lit(1.0), F.min("confidence"))
    return members.groupBy(key).agg(F.when(low <= 0, 0.8).otherwise(low).alias("confidence"))


def aliases(nodes: DataFrame) -> DataFrame:
    """id and alias ``subdomain#n``, numbered in order of id within a subdomain."""
    w = Window.partitionBy("domain", "subdomain").orderBy("id")
    return nodes.select("id", F.concat("subdomain", F.lit("#"), F.row_number().over(w)).alias("alias"))


def numbered_slugs(nodes: DataFrame, slug: Column, order: list[str]) -> DataFrame:
    """id and file_slug, made unique by ``-2``, ``-3`` in order; a number that is itself a slug is passed over."""
    w = Window.partitionBy("slug").orderBy(*order)
    rows = nodes.withColumn("slug", slug).withColumn("n", F.row_number().over(w))
    named = rows.select("id", "slug", "n", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), "n")).alias("file_slug"))
    natural = rows.where("n = 1").select(F.col("slug").alias("file_slug"), F.lit(True).alias("_taken"))
    clash = named.join(natural, "file_slug", "left").withColumn("bad", F.coalesce("_taken", F.lit(False)) & (F.col("n") > 1))
    return clash.select("id", F.when(F.col("bad"), F.concat("file_slug", F.lit("-"), F.substring(F.sha1("id"), 1, 6))).otherwise(F.col("file_slug")).alias("file_slug"))


def exact_member_details(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """id and details: the details of a node's members in member order, blank and repeated ones left out."""
    rows = nodes.select("id", F.posexplode("members").alias("p", "unit_id")).dropDuplicates(["id", "unit_id"]).join(units.select("unit_id", "detail"), "unit_id").where("trim(detail) <> ''")
    return rows.groupBy("id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", "detail"))), lambda x: x["detail"])), "\n\n").alias("details"))


def unresolved_conflicts(conflicts: DataFrame) -> DataFrame:
    return conflicts.where("resolution_status = 'unresolved'")


def empty_members(nodes: DataFrame) -> DataFrame:
    """Ids of nodes without any member."""
    return nodes.where(F.coalesce(F.size("members"), F.lit(0)) <= 0).select("id")


def complete(nodes: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fused nodes that are whole (id, at least one member, all known, confidence in [0, 1], a description), and the rule each other one breaks."""
    unknown = nodes.select("id", F.explode("members").alias("unit_id")).join(units.select("unit_id").distinct(), "unit_id", "left_anti").select("id").distinct().withColumn("_unknown", F.lit(True))
    c = F.col("confidence")
    rule = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id").when(F.coalesce(F.size("members"), F.lit(0)) <= 0, "no member").when(F.col("_unknown"), "unknown member")
        .when(~F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(False)), "confidence").when(F.coalesce(F.trim("description"), F.lit("")) == "", "no description")
    )
    marked = nodes.join(unknown, "id", "left").withColumn("rule", rule)
    return marked.where("rule is null").drop("_unknown", "rule"), marked.where("rule is not null").select("id", "rule")


def relation_candidates(relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations with both ends resolved and a valid kind and confidence, and the others with the first rule they break."""
    both = resolve_endpoints(relations, names)
    c = F.col("confidence")
    rule = (
        F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "endpoint").when(F.col("source_id") == F.col("target_id"), "self")
        .when(~F.coalesce(F.col("kind").isin(*SEMANTIC_KINDS), F.lit(False)), "kind").when(~F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(False)), "confidence")
    )
    marked = both.withColumn("rule", rule)
    return marked.where("rule is null").drop("rule"), marked.where("rule is not null")


def apply_selections(relations: DataFrame, selections: DataFrame) -> DataFrame:
    """Relations (relation_id, source_id, target_id, kind, description) that were selected, given to their owner scope; equal ones of an owner become one, the least id."""
    met = relations.join(selections.select("relation_id", "owner").distinct(), "relation_id")
    return met.groupBy("owner", "source_id", "target_id", "kind", F.coalesce("description", F.lit("")).alias("description")).agg(F.min("relation_id").alias("relation_id"))


def skills_of_members(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """id and skills: of its members in member order, each once. units: unit_id, skill, pos; the last document of a unit wins."""
    last = units.groupBy("unit_id").agg(F.max_by("skill", "pos").alias("skill"))
    rows = nodes.select("id", F.posexplode("members").alias("p", "unit_id")).join(last, "unit_id").where("skill <> ''")
    return rows.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", "skill"))), lambda x: x["skill"])).alias("skills"))


def assign_uuids(nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (scope, alias, members) with the id their members give, and relations (scope, source, target) with the ids of their ends; what is ambiguous or unknown goes."""
    from weftgraph.functions.identity import node_uuid

    named = nodes.where("size(members) > 0").withColumn("id", node_uuid(F.col("members")))
    ends = resolve_endpoints(relations, named.select("scope", "alias", "id"))
    return named, ends.where("source_id is not null and target_id is not null and source_id <> target_id")
