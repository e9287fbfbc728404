"""Queries of the search operators: joins, ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsift.functions import distance as D
from colsift.operators import evaluate, knn, rank
from colsift.plans.data import K, LAKE, corpus, knn_sql, lake, lake_rows, pairs_sql, uploads
from colsift.runtime import cut, table

QUERIES = {}
SQL: dict[str, str] = {}
_MATCH = "q_table_id, q_set_id, q_pos, table_id, set_id, pos"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def matches(spark: SparkSession, sf_dir: str, k: int = K, exclude: str = "table") -> DataFrame:
    return knn.knn_join(uploads(spark, sf_dir), corpus(spark, sf_dir) if exclude == "table" else lake(spark, sf_dir), k, exclude)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("d", F.round("d", 6))


@query(f"WITH {LAKE}, {pairs_sql()}, {knn_sql()} SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM knn")
def j1_knn_join(spark, sf_dir):
    return rounded(matches(spark, sf_dir))


@query(f"""WITH {LAKE}, {pairs_sql("(c.table_id <> q.table_id OR c.set_id <> q.set_id)", "q.vec_id % 20 = 0")}, {knn_sql(5)}
SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM knn""")
def f2_knn_other_columns(spark, sf_dir):
    everything = lake(spark, sf_dir)
    return rounded(knn.knn_join(knn.as_queries(everything.where("vec_id % 20 = 0")), everything, 5, "column"))


@query(f"""WITH {LAKE}, {pairs_sql("TRUE", "q.vec_id % 20 = 0")}, {knn_sql(5)}
SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM knn""")
def f3_knn_no_exclusion(spark, sf_dir):
    everything = lake(spark, sf_dir)
    return rounded(knn.knn_join(knn.as_queries(everything.where("vec_id % 20 = 0")), everything, 5, "none"))


@query(f"WITH {LAKE} SELECT q.table_id AS q_table_id, q.set_id AS q_set_id, q.pos AS q_pos, c.table_id, c.set_id, c.pos, 0.0::DOUBLE AS d FROM lake q JOIN lake c ON q.v = c.v AND q.table_id <> c.table_id")
def j2_exact_join(spark, sf_dir):
    everything = lake(spark, sf_dir)
    return knn.exact_join(knn.as_queries(everything), everything, "table")


@query(f"WITH {LAKE}, {pairs_sql()} SELECT {_MATCH}, ROUND(d, 6) AS d FROM pairs WHERE d <= 0.5")
def x1_within_threshold(spark, sf_dir):
    return rounded(knn.within(uploads(spark, sf_dir), corpus(spark, sf_dir).drop("vec_id"), 0.5))


@query(f"""WITH {LAKE} SELECT vec_id, near_id, ROUND(d, 6) AS d FROM (
SELECT q.vec_id, c.vec_id AS near_id, 1 - LIST_DOT_PRODUCT(q.v, c.v) / (SQRT(LIST_DOT_PRODUCT(q.v, q.v)) * SQRT(LIST_DOT_PRODUCT(c.v, c.v))) AS d
FROM lake q JOIN lake c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) WHERE d <= 0.1""")
def x23_cosine_within(spark, sf_dir):
    everything = lake(spark, sf_dir)
    q = everything.where("vec_id % 20 = 0").select("vec_id", F.col("v").alias("q_v"))
    return rounded(knn.cosine_within(q, everything.select(F.col("vec_id").alias("near_id"), "v"), 0.1))


@query(f"""WITH {LAKE}, {pairs_sql()}, {knn_sql()} SELECT table_id, set_id, COUNT(DISTINCT pos) AS overlap, COUNT(DISTINCT q_pos) AS covered
FROM knn GROUP BY table_id, set_id ORDER BY overlap DESC, table_id, set_id LIMIT 10""")
def a1_top_columns(spark, sf_dir):
    return rank.top_columns(matches(spark, sf_dir), 10)


@query(f"""WITH {LAKE}, {pairs_sql()}, {knn_sql()}, m AS (SELECT *, MIN(d) OVER (PARTITION BY table_id) AS least FROM knn)
SELECT table_id, ROUND(MIN(d), 6) AS min_distance, COUNT(*) FILTER (d = least) AS num_closest, COUNT(*) AS total_matches
FROM m GROUP BY table_id ORDER BY num_closest DESC, MIN(d), table_id LIMIT 10""")
def a2_top_tables(spark, sf_dir):
    return rank.top_tables(matches(spark, sf_dir), 10).withColumn("min_distance", F.round("min_distance", 6))


@query(f"""WITH {LAKE}, e AS (SELECT c.table_id, c.set_id, c.pos FROM lake q JOIN lake c ON q.v = c.v AND q.table_id = 0 AND c.table_id <> 0)
SELECT table_id, set_id, COUNT(DISTINCT pos) AS overlap, set_id + 1 AS shown_column FROM e GROUP BY table_id, set_id""")
def w11_exact_column_overlap(spark, sf_dir):
    found = rank.column_overlaps(knn.exact_join(uploads(spark, sf_dir), corpus(spark, sf_dir))).where("overlap > 0")
    return found.select("table_id", "set_id", "overlap", (F.col("set_id") + 1).alias("shown_column"))


@query(f"""WITH {LAKE}, {pairs_sql()}, {knn_sql()}, ks AS (SELECT UNNEST([1, 3, 5, 10]) AS k)
SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank, CAST(k AS INT) AS k FROM knn JOIN ks ON rank <= k""")
def w3_multi_k(spark, sf_dir):
    return rounded(knn.slices(matches(spark, sf_dir), [1, 3, 5, 10]))


# A log of an earlier, incomplete search against the nearest vectors by computation.
_LOG = """log AS (SELECT DISTINCT q_vec_id, vec_id, distance FROM query_results WHERE distance IS NOT NULL AND NOT ISNAN(distance) AND distance >= 0),
truth AS (SELECT * FROM (SELECT q.vec_id AS q_vec_id, c.vec_id, LIST_DISTANCE(q.v, c.v) ** 2 AS d,
  ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY LIST_DISTANCE(q.v, c.v), c.table_id, c.set_id, c.pos) AS rank
  FROM lake q JOIN lake c ON q.table_id <> c.table_id WHERE q.vec_id IN (SELECT q_vec_id FROM log)) WHERE rank <= 5)"""


def _log(spark, sf_dir):
    df = table(spark, sf_dir, "query_results").where("distance is not null and not isnan(distance) and distance >= 0")
    return df.select("q_vec_id", "vec_id", "distance").distinct()


def _asked(spark, sf_dir):
    """The vectors in both roles: (q_vec_id, q_table_id, q_v) and (vec_id, table_id, v)."""
    v = lake(spark, sf_dir).select("vec_id", "table_id", "v")
    return v.toDF("q_vec_id", "q_table_id", "q_v"), v


def _truth(spark, sf_dir, rows, k=5):
    """The nearest ``k`` of the queries of ``rows`` (q_vec_id, q_table_id, q_v, least, limit), as far as a row can match them.

    A row matches nothing that is farther than its limit, and nothing at all if ``k`` vectors are closer than ``least``.
    """
    everything = lake_rows(spark, sf_dir)
    asked = knn.promising(rows, everything, k).groupBy("q_vec_id").agg(F.first("q_table_id").alias("q_table_id"), F.first("q_v").alias("q_v"), F.max("limit").alias("limit"))
    return knn.nearest_within(cut(asked), everything, k)


def _true_matches(spark, sf_dir):
    """The true matches among those of the log: its pairs are looked up and scored, those that ``k`` vectors surely beat are set aside."""
    asked, everything = _asked(spark, sf_dir)
    pairs = _log(spark, sf_dir).select("q_vec_id", "vec_id").distinct().join(everything, "vec_id").join(asked, "q_vec_id").where("table_id <> q_table_id")
    scored = pairs.select("q_vec_id", "q_table_id", "q_v", D.squared_euclidean(F.col("q_v"), F.col("v")).alias("d"))
    # Sums of another order may differ in the last digits.
    return _truth(spark, sf_dir, scored.select("q_vec_id", "q_table_id", "q_v", (F.col("d") * (1 - 1e-9) - 1e-12).alias("least"), (F.col("d") * (1 + 1e-9) + 1e-12).alias("limit")))


def _expected(spark, sf_dir, name, k=5):
    """One row: how many true matches the log's queries have, ``k`` each or as many as there are vectors in other tables."""
    ids = lake(spark, sf_dir).select("vec_id", "table_id")
    asked = ids.join(_log(spark, sf_dir).select(F.col("q_vec_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    tables = ids.groupBy("table_id").agg(F.count("*").alias("n")).join(asked.groupBy("table_id").agg(F.count("*").alias("queries")), "table_id")
    others = tables.crossJoin(ids.agg(F.count("*").alias("all")))
    return others.agg(F.coalesce(F.sum(F.col("queries") * F.least(F.lit(k), F.col("all") - F.col("n"))), F.lit(0)).alias(name))


@query(f"WITH {LAKE}, {_LOG} SELECT q_vec_id, vec_id, ROUND(distance, 6) AS distance FROM log WHERE (q_vec_id, vec_id) IN (SELECT (q_vec_id, vec_id) FROM truth)")
def j7_recall_hits(spark, sf_dir):
    return evaluate.hits(_log(spark, sf_dir), _true_matches(spark, sf_dir), ["q_vec_id", "vec_id"]).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {LAKE}, {_LOG}, f AS (SELECT COUNT(*) AS found FROM (SELECT DISTINCT q_vec_id, vec_id FROM log) l JOIN truth t USING (q_vec_id, vec_id)),
e AS (SELECT COUNT(*) AS expected FROM truth) SELECT found, expected, ROUND(found / expected, 6) AS recall FROM f, e""")
def a3_recall(spark, sf_dir):
    return evaluate.recall(_log(spark, sf_dir), _true_matches(spark, sf_dir), ["q_vec_id", "vec_id"], _expected(spark, sf_dir, "expected")).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {LAKE}, {_LOG}, f AS (SELECT COUNT(*) AS found FROM (SELECT DISTINCT q_vec_id, vec_id FROM log) l JOIN truth t USING (q_vec_id, vec_id)),
e AS (SELECT CAST(SUM(LEAST(n, 3)) AS BIGINT) AS possible FROM (SELECT COUNT(*) AS n FROM truth GROUP BY q_vec_id)) SELECT found, possible, ROUND(found / possible, 6) AS "precision" FROM f, e""")
def a4_precision(spark, sf_dir):
    return evaluate.precision(_log(spark, sf_dir), _true_matches(spark, sf_dir), 3, ["q_vec_id", "vec_id"], ["q_vec_id"], _expected(spark, sf_dir, "possible", 3)).withColumn("precision", F.round("precision", 6))


@query(f"""WITH {LAKE}, {_LOG}, r AS (SELECT q_vec_id, distance AS d, ROW_NUMBER() OVER (PARTITION BY q_vec_id ORDER BY distance, vec_id) AS rank FROM log),
b AS (SELECT t.d AS dt, r.d FROM truth t LEFT JOIN r USING (q_vec_id, rank))
SELECT COUNT(*) FILTER (ABS(d - dt) <= 1e-5 * GREATEST(ABS(d), ABS(dt))) AS found, COUNT(*) AS expected,
ROUND(COUNT(*) FILTER (ABS(d - dt) <= 1e-5 * GREATEST(ABS(d), ABS(dt))) / COUNT(*), 6) AS recall FROM b""")
def j8_recall_on_distance(spark, sf_dir):
    order = Window.partitionBy("q_vec_id").orderBy("distance", "vec_id")
    runs = _log(spark, sf_dir).select("q_vec_id", F.col("distance").alias("d"), F.row_number().over(order).alias("rank"))
    # A distance is close to the true one of its rank within 1e-5 of the larger.
    near = runs.where("rank <= 5").join(_asked(spark, sf_dir)[0], "q_vec_id")
    rows = near.select("q_vec_id", "q_table_id", "q_v", (F.col("d") * (1 - 2e-5) - 1e-12).alias("least"), (F.col("d") * (1 + 2e-5) + 1e-12).alias("limit"))
    return evaluate.recall_on_distance(runs, _truth(spark, sf_dir, rows), ["q_vec_id"], _expected(spark, sf_dir, "expected")).withColumn("recall", F.round("recall", 6))


# The match log: what earlier runs cost. Repeats of a match written by several runs count once.
_RUNS = """runs AS (SELECT TRIM(tq_q) AS tq_q, k, time_s, ts_s, q_pos, s_pos, TRY_CAST(TRIM(d) AS DOUBLE) AS d FROM match_rows WHERE TRIM(tq_q) <> '')"""


def _runs(spark, sf_dir):
    df = table(spark, sf_dir, "match_rows").withColumn("tq_q", F.trim("tq_q")).where("tq_q <> ''")
    return df.withColumn("d", F.when(F.trim("d").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim("d").cast("double")))


@query(f"WITH {_RUNS} SELECT k, ROUND(AVG(time_s), 6) AS time_s FROM runs GROUP BY k")
def a5_mean_time(spark, sf_dir):
    return evaluate.mean_by(_runs(spark, sf_dir), ["k"], ["time_s"])


@query(f"WITH {_RUNS} SELECT tq_q, k, ROUND(AVG(d), 10) AS d, ROUND(AVG(time_s), 10) AS time_s FROM runs WHERE d >= 0 AND ISFINITE(d) GROUP BY tq_q, k")
def a6_mean_by_query(spark, sf_dir):
    return evaluate.mean_by(_runs(spark, sf_dir).where("d >= 0"), ["tq_q", "k"], ["d", "time_s"], 10)


@query("SELECT q_vec_id, ROUND(SUM(time_s), 6) AS total_time, CAST(SUM(num_checked_vectors) AS BIGINT) AS checked FROM (SELECT DISTINCT * FROM query_results) GROUP BY q_vec_id")
def a12_query_totals(spark, sf_dir):
    df = table(spark, sf_dir, "query_results").distinct()
    return df.groupBy("q_vec_id").agg(F.round(F.sum("time_s"), 6).alias("total_time"), F.sum("num_checked_vectors").alias("checked"))


@query(f"""WITH {_RUNS}, t AS (SELECT tq_q, k, ROUND(AVG(time_s), 10) AS time_s FROM runs GROUP BY tq_q, k), n AS (SELECT tq_q, k, COUNT(*) AS rows FROM runs GROUP BY tq_q, k)
SELECT tq_q, k, time_s, rows FROM t JOIN n USING (tq_q, k)""")
def j9_merge_metrics(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return evaluate.mean_by(runs, ["tq_q", "k"], ["time_s"], 10).join(runs.groupBy("tq_q", "k").agg(F.count("*").alias("rows")), ["tq_q", "k"])


@query(f"""WITH {_RUNS}, s AS (SELECT CAST(SPLIT_PART(tq_q, ':', 1) AS INT) AS q_table_id, CAST(SPLIT_PART(tq_q, ':', 2) AS INT) AS q_set_id, k, COUNT(DISTINCT q_pos) AS size, COUNT(*) AS n FROM runs GROUP BY tq_q, k)
SELECT q_table_id, q_set_id, size, a.k AS k, b.k AS other_k, a.n AS n, b.n AS other_n FROM s a JOIN s b USING (q_table_id, q_set_id, size) WHERE a.k < b.k""")
def j10_pair_runs(spark, sf_dir):
    """Runs of one query column and size at different k: candidates beside their ground truth."""
    parts = F.split("tq_q", ":")
    runs = _runs(spark, sf_dir).groupBy(parts[0].cast("int").alias("q_table_id"), parts[1].cast("int").alias("q_set_id"), "k").agg(F.count_distinct("q_pos").alias("size"), F.count("*").alias("n"))
    return runs.join(runs.withColumnsRenamed({"k": "other_k", "n": "other_n"}), ["q_table_id", "q_set_id", "size"]).where("k < other_k")


@query("""WITH o AS (SELECT DISTINCT table_id, set_id, overlap_size FROM result_sids WHERE overlap_size IS NOT NULL)
SELECT table_id, set_id, MAX(overlap_size) AS overlap FROM o WHERE overlap_size > 0 GROUP BY table_id, set_id""")
def f7_positive_overlaps(spark, sf_dir):
    df = table(spark, sf_dir, "result_sids").where("overlap_size > 0")
    return df.groupBy("table_id", "set_id").agg(F.max("overlap_size").alias("overlap"))


@query(f"""WITH {LAKE}, s AS (SELECT table_id, set_id, COUNT(*) AS n FROM lake GROUP BY table_id, set_id HAVING COUNT(*) BETWEEN 5 AND 50)
SELECT table_id, set_id, n FROM s ORDER BY table_id, set_id LIMIT 10""")
def s2_query_sets(spark, sf_dir):
    sizes = lake(spark, sf_dir).groupBy("table_id", "set_id").agg(F.count("*").alias("n"))
    return sizes.where(F.col("n").between(5, 50)).orderBy("table_id", "set_id").limit(10)


@query(f"""WITH {LAKE}, s AS (SELECT table_id, set_id FROM lake GROUP BY table_id, set_id HAVING COUNT(*) BETWEEN 5 AND 50)
SELECT vec_id, table_id, set_id, pos FROM lake WHERE (table_id, set_id) IN (SELECT (table_id, set_id) FROM s)""")
def f1_sets_of_size(spark, sf_dir):
    everything = lake(spark, sf_dir).drop("v")
    sizes = everything.groupBy("table_id", "set_id").count().where(F.col("count").between(5, 50))
    return everything.join(sizes, ["table_id", "set_id"], "left_semi").select("vec_id", "table_id", "set_id", "pos")


@query("""SELECT q_vec_id, query_vector_pos, distance, num_checked_vectors FROM (SELECT *, LAG(distance) OVER (PARTITION BY q_vec_id ORDER BY num_checked_vectors, vec_id) AS before
FROM (SELECT DISTINCT * FROM query_results WHERE distance IS NOT NULL AND NOT ISNAN(distance))) WHERE before IS NULL OR before <> distance""")
def w4_changed_snapshots(spark, sf_dir):
    df = table(spark, sf_dir, "query_results").where("distance is not null and not isnan(distance)").distinct()
    by = Window.partitionBy("q_vec_id").orderBy("num_checked_vectors", "vec_id")
    stepped = df.withColumn("step", F.row_number().over(by))
    return evaluate.changed_snapshots(stepped, ["q_vec_id"], "step", "distance").select("q_vec_id", "query_vector_pos", "distance", "num_checked_vectors")


@query("""WITH r AS (SELECT DISTINCT q_vec_id, vec_id, distance, max_distance FROM query_results)
SELECT q_vec_id, vec_id, ABS(distance - max_distance) <= 1e-5 * GREATEST(ABS(distance), ABS(max_distance)) AS close FROM r WHERE NOT ISNAN(distance) AND NOT ISNAN(max_distance) AND distance IS NOT NULL AND max_distance IS NOT NULL""")
def x20_relatively_close(spark, sf_dir):
    df = table(spark, sf_dir, "query_results").select("q_vec_id", "vec_id", "distance", "max_distance").distinct()
    df = df.where("distance is not null and max_distance is not null and not isnan(distance) and not isnan(max_distance)")
    return df.select("q_vec_id", "vec_id", D.relatively_close(F.col("distance"), F.col("max_distance")).alias("close"))
