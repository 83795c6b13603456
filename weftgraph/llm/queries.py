"""The queries of this package's problems, and the SQL that checks them where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import leakage, mixing, pairs, residue, splitting
from weftgraph.llm.neardup import NearDuplicates, groups
from weftgraph.sources.tables import table

NODE_TEXTS = ["name", "summary", "description"]


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf_dir, "nodes"), "id", NODE_TEXTS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nodes whose words are the same to 0.7."""
    return _near(spark, sf_dir).pairs()


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node with its class of equal words and the number of nodes it is linked to."""
    return _near(spark, sf_dir).per_record()


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node with the group of nearly equal nodes it belongs to."""
    return groups(table(spark, sf_dir, "nodes"), _near(spark, sf_dir).pairs())


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks as pieces of at most 1,800 characters with their lines."""
    return splitting.split_texts(table(spark, sf_dir, "chunks"), "chunk_id", "text", "start_line", "end_line").withColumnRenamed("key", "chunk_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that had to be cut."""
    pieces = splitting.split_texts(table(spark, sf_dir, "chunks"), "chunk_id", "text", "start_line", "end_line", once=False)
    return pieces.where("piece = 1").select("chunk_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken question and answer pairs with their defect."""
    return pairs.broken_pairs(table(spark, sf_dir, "results"), "result_id", "question", "answer", "status").withColumnRenamed("key", "result_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a held-out item, with the item."""
    return leakage.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"), "doc_id", "text", "item_id", "text")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out item the number of documents it leaked into."""
    items = table(spark, sf_dir, "benchmark_items").select("item_id").distinct()
    return items.join(p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs")), "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[mixing.Part]]:
    rows = mixing.hashed(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return rows, mixing.plan(rows, table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixing.mixture(*_mix(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.shares(*_mix(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler or a machine notice."""
    return residue.residue(table(spark, sf_dir, "documents"), "doc_id", "text", "skill").select("doc_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left once those are excluded."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(p9_found(spark, sf_dir), "doc_id", "left_anti")


def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the classifier does on hosts its fit has not seen, and on families and languages left out of labels and examples."""
    return residue.validation(table(spark, sf_dir, "documents"), "doc_id", "text", "skill")


_WORDS = r"regexp_extract_all(regexp_replace(lower({}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
_NODE_WORDS = _WORDS.format("concat_ws(' ', coalesce(name, ''), coalesce(summary, ''), coalesce(description, ''))")
_CLEAN = r"regexp_replace(regexp_replace(text, '</?[A-Za-z][^<>]*>', '', 'g'), '[\x{ad}\x{180e}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]', '', 'g')"

_P1_PAIRS = f"""
recs AS (SELECT DISTINCT id, {_NODE_WORDS} AS w FROM nodes WHERE id IS NOT NULL),
numbered AS (SELECT row_number() OVER () AS r, id, w, len(w) AS n FROM recs WHERE len(w) > 0),
counted AS (SELECT r, word, count(*) AS c FROM (SELECT r, unnest(w) AS word FROM numbered) GROUP BY r, word),
shared AS (SELECT a.r AS ra, b.r AS rb, sum(least(a.c, b.c)) AS common FROM counted a JOIN counted b ON a.word = b.word AND a.r < b.r GROUP BY a.r, b.r),
pairs AS (
  SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b
  FROM shared JOIN numbered x ON x.r = ra JOIN numbered y ON y.r = rb
  WHERE x.id <> y.id AND common >= 0.7 * (x.n + y.n - common) - 1e-9)"""
P1_FOUND = f"WITH {_P1_PAIRS} SELECT id_a, id_b FROM pairs"
P1_GROUPS = f"""WITH RECURSIVE {_P1_PAIRS},
both_ways AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT ids.id, coalesce(least(ids.id, min(reach.b)), ids.id) AS group_id
FROM (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL) ids LEFT JOIN reach ON reach.a = ids.id GROUP BY ids.id"""
P1_CLASSES = f"""WITH {_P1_PAIRS},
keyed AS (SELECT id, array_to_string(list_sort(w), ' ') AS k FROM numbered),
cls AS (SELECT id, min(id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS n_copies FROM keyed),
both_ways AS (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs),
linked AS (SELECT id, count(*) AS n FROM both_ways GROUP BY id)
SELECT cls.id, class_id, n_copies, coalesce(n, 0) AS n_links FROM cls LEFT JOIN linked USING (id)"""
P2_FOUND = "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1800"
P7_FOUND = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_CLEAN)} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format(_CLEAN)} AS w FROM benchmark_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, p, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
ig AS (SELECT item_id, p, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i)),
total AS (SELECT item_id, count(DISTINCT g) AS n FROM ig GROUP BY item_id),
hit AS (SELECT doc_id, item_id, dg.p AS pd, ig.p AS pi, g FROM dg JOIN ig USING (g)),
shares AS (SELECT doc_id, item_id FROM hit JOIN total USING (item_id) GROUP BY doc_id, item_id, n HAVING count(DISTINCT g) >= 0.4 * n - 1e-9),
runs AS (
  SELECT doc_id, item_id FROM (
    SELECT doc_id, item_id, pd - pi AS diag, pd - row_number() OVER (PARTITION BY doc_id, item_id, pd - pi ORDER BY pd) AS island FROM (SELECT DISTINCT doc_id, item_id, pd, pi FROM hit))
  GROUP BY doc_id, item_id, diag, island HAVING count(*) >= 11)
SELECT doc_id, item_id FROM shares UNION SELECT doc_id, item_id FROM runs"""
P7_ITEMS = f"SELECT item_id, count(doc_id) AS n_docs FROM (SELECT DISTINCT item_id FROM benchmark_items) LEFT JOIN ({P7_FOUND}) USING (item_id) GROUP BY item_id"

QUERIES = {
    "p1_found": p1_found, "p1_classes": p1_classes, "p1_groups": p1_groups, "p2_found": p2_found, "p2_pieces": p2_pieces, "p5_found": p5_found, "p7_found": p7_found, "p7_items": p7_items,
    "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_clean": p9_clean, "p9_validation": p9_validation,
}
SQL = {"p1_found": P1_FOUND, "p1_classes": P1_CLASSES, "p1_groups": P1_GROUPS, "p2_found": P2_FOUND, "p7_found": P7_FOUND, "p7_items": P7_ITEMS}
