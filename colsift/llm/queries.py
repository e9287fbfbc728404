"""The pN_ queries and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsift.llm import boilerplate, language, mixing, neighbours, sentences, setjoin, skeleton, tokens, topn
from colsift.runtime import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_blocks(table(spark, sf_dir, "table_meta"))


def p1_deciders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each presentation the tree settles, and the model where it doesn't."""
    return boilerplate.deciders(table(spark, sf_dir, "table_meta"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.nearest_matches(table(spark, sf_dir, "match_rows"), 10).drop("d")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(*(table(spark, sf_dir, t) for t in ("table_meta", "raw_tables", "lang_samples")))


def p3_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.languages(*(table(spark, sf_dir, t) for t in ("table_meta", "raw_tables", "lang_samples")))
    return found.withColumn("confidence", F.round("confidence", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, sf_dir, "cell_vectors"), k=5, max_distance=0.20)


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours behind ``p4_found`` with distance and rank."""
    near = neighbours.nearest_vectors(table(spark, sf_dir, "cell_vectors"), k=5, max_distance=0.20, recall=0.995)
    return near.select("vec_id", "near_id", F.round("distance", 6).alias("distance"), "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.column_pairs(table(spark, sf_dir, "raw_tables"), threshold=0.6, min_size=8).drop("overlap_size")


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.column_pairs(table(spark, sf_dir, "raw_tables"), threshold=0.6, min_size=8)


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join without expanding copies: each column with its class and number of links."""
    return setjoin.column_classes(table(spark, sf_dir, "raw_tables"), threshold=0.6, min_size=8)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = skeleton.look_alike_cells(table(spark, sf_dir, "raw_tables"), table(spark, sf_dir, "ref_items"))
    return found.select("table_id", "set_id", "pos", "item_id")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.with_skeleton(skeleton.table_cells(table(spark, sf_dir, "raw_tables")), "cell").drop("cell").dropDuplicates(["table_id", "set_id", "pos"])


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals grouped by equal skeleton: how many forms look alike, over all cells."""
    return skeleton.same_looking(skeleton.table_cells(table(spark, sf_dir, "raw_tables")).select("cell"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, written once: the mix reads them several times."""
    return cut(tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budgets alone, with characters for sizes, which SQL has as well."""
    docs = table(spark, sf_dir, "documents").where("source is not null and n_chars > 0").dropDuplicates(["doc_id"])
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_tokens"))
    found = mixing.source_budgets(sizes, table(spark, sf_dir, "mix_targets"))
    return found.withColumn("wanted_share", F.round("wanted_share", 9)).withColumn("budget", F.round(F.col("budget") / 100).cast("long"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_deciders, p2_found, p3_found, p3_parts, p4_found, p4_nearest, p5_found, p5_overlaps, p5_classes, p6_found, p6_forms, p6_groups, p7_ids, p8_mix, p8_shares, p8_budgets, p9_found)
}

_PAIRS = """
WITH t AS (SELECT DISTINCT table_id, relation FROM raw_tables WHERE table_id IS NOT NULL AND relation IS NOT NULL),
c AS (SELECT table_id, UNNEST(RANGE(LEN(relation))) AS set_id, relation FROM t),
x AS (SELECT DISTINCT table_id, set_id, cell FROM (SELECT table_id, set_id, UNNEST(relation[set_id + 1]) AS cell FROM c) WHERE cell <> ''),
n AS (SELECT table_id, set_id, COUNT(*) AS n FROM x GROUP BY ALL HAVING COUNT(*) >= 8),
y AS (SELECT x.*, n.n FROM x JOIN n USING (table_id, set_id)),
p AS (SELECT a.table_id AS ta, a.set_id AS sa, b.table_id AS tb, b.set_id AS sb, COUNT(*) AS o, ANY_VALUE(a.n) AS na, ANY_VALUE(b.n) AS nb
      FROM y a JOIN y b ON a.cell = b.cell AND (a.table_id, a.set_id) < (b.table_id, b.set_id) GROUP BY ALL)
SELECT ta AS table_id_a, CAST(sa AS INT) AS set_id_a, tb AS table_id_b, CAST(sb AS INT) AS set_id_b{more} FROM p WHERE o >= 0.6 * (na + nb - o)
"""
_CLASSES = _PAIRS.split("SELECT ta AS")[0] + """, l AS (SELECT table_id, set_id, LIST_SORT(LIST(cell)) AS cells FROM y GROUP BY table_id, set_id),
r AS (SELECT table_id, set_id, MIN(ROW(table_id, set_id)) OVER (PARTITION BY cells) AS rep, COUNT(*) OVER (PARTITION BY cells) AS copies FROM l),
k AS (SELECT t, s, COUNT(*) AS links FROM (SELECT ta AS t, sa AS s FROM p WHERE o >= 0.6 * (na + nb - o) UNION ALL SELECT tb, sb FROM p WHERE o >= 0.6 * (na + nb - o)) GROUP BY t, s)
SELECT table_id, CAST(set_id AS INT) AS set_id, rep[1] AS class_table_id, CAST(rep[2] AS INT) AS class_set_id, copies, COALESCE(links, 0) AS links FROM r LEFT JOIN k ON t = table_id AND s = set_id
"""

SQL: dict[str, str] = {
    "p2_found": """
WITH m AS (SELECT TRIM(tq_q) AS tq_q, ts_s, q_pos, s_pos, TRY_CAST(TRIM(d) AS DOUBLE) AS d FROM match_rows),
u AS (SELECT tq_q, ts_s, q_pos, s_pos, MIN(d) AS d FROM m
      WHERE d >= 0 AND ISFINITE(d) AND tq_q <> '' AND ts_s IS NOT NULL AND q_pos IS NOT NULL AND s_pos IS NOT NULL GROUP BY ALL)
SELECT tq_q, ts_s, q_pos, s_pos FROM u
QUALIFY ROW_NUMBER() OVER (PARTITION BY tq_q ORDER BY d, SPLIT_PART(ts_s, ':', 1)::INT, SPLIT_PART(ts_s, ':', 2)::INT, q_pos, s_pos) <= 10
""",
    "p4_found": """
WITH v AS (SELECT DISTINCT vec_id, vec_values::DOUBLE[] AS v FROM cell_vectors
           WHERE vec_id IS NOT NULL AND LEN(vec_values) = 50 AND LEN(LIST_FILTER(vec_values, lambda x: x IS NULL OR ISNAN(x))) = 0 AND LEN(LIST_FILTER(vec_values, lambda x: x <> 0)) > 0),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, LIST_DISTANCE(a.v, b.v) ** 2 AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE LIST_DISTANCE(a.v, b.v) ** 2 <= 0.2),
r AS (SELECT a, b FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY a ORDER BY d, b) <= 5)
SELECT DISTINCT LEAST(a, b) AS vec_id_a, GREATEST(a, b) AS vec_id_b FROM r
""",
    "p4_nearest": """
WITH v AS (SELECT DISTINCT vec_id, vec_values::DOUBLE[] AS v FROM cell_vectors
           WHERE vec_id IS NOT NULL AND LEN(vec_values) = 50 AND LEN(LIST_FILTER(vec_values, lambda x: x IS NULL OR ISNAN(x))) = 0 AND LEN(LIST_FILTER(vec_values, lambda x: x <> 0)) > 0),
d AS (SELECT a.vec_id, b.vec_id AS near_id, LIST_DISTANCE(a.v, b.v) ** 2 AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE LIST_DISTANCE(a.v, b.v) ** 2 <= 0.2)
SELECT vec_id, near_id, ROUND(d, 6) AS distance, CAST(ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d, near_id) AS INT) AS rank FROM d
QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d, near_id) <= 5
""",
    "p8_budgets": """
WITH s AS (SELECT source, COUNT(*) AS n_docs, SUM(n_chars) AS n_tokens FROM documents WHERE source IS NOT NULL AND n_chars > 0 GROUP BY source),
b AS (SELECT COALESCE(s.source, t.source) AS source, n_docs, n_tokens, target_share, max_repeats, n_tokens IS NOT NULL AND target_share IS NOT NULL AS usable FROM s FULL JOIN mix_targets t ON s.source = t.source),
w AS (SELECT *, CASE WHEN usable THEN target_share / SUM(target_share) FILTER (usable) OVER () END AS wanted_share FROM b),
m AS (SELECT *, MIN(n_tokens * max_repeats / wanted_share) FILTER (usable) OVER () AS total FROM w)
SELECT source, CAST(COALESCE(n_docs, 0) AS BIGINT) AS n_docs, CAST(COALESCE(n_tokens, 0) AS BIGINT) AS n_tokens, target_share, ROUND(wanted_share, 9) AS wanted_share, COALESCE(max_repeats, 0) AS max_repeats,
CAST(ROUND(COALESCE(FLOOR(CASE WHEN usable THEN total * wanted_share END + 1e-6), 0) / 100) AS BIGINT) AS budget FROM m
""",
    "p5_classes": _CLASSES,
    "p5_found": _PAIRS.format(more=""),
    "p5_overlaps": _PAIRS.format(more=", CAST(o AS INT) AS overlap_size"),
}
