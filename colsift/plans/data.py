"""The driver's tables in the engine's canonical form, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsift.functions import segments as S
from colsift.functions.distance import usable
from colsift.operators.blocks import with_stats
from colsift.operators.knn import as_queries
from colsift.runtime import table

DIM = 50
ENDS = S.even_ends(DIM, 5)
K = 10


def lake_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable vectors as stored, some in several rows: vec_id, table_id, set_id, pos, v."""
    df = table(spark, sf_dir, "cell_vectors").where(usable(F.col("vec_values"), DIM))
    return df.select("vec_id", "table_id", "set_id", "pos", F.col("vec_values").alias("v"))


def lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable vectors, each once: vec_id, table_id, set_id, pos, v."""
    return lake_rows(spark, sf_dir).dropDuplicates(["vec_id"])


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake(spark, sf_dir).where("table_id <> 0")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploaded query columns: the vectors of table 0."""
    return as_queries(lake(spark, sf_dir).where("table_id = 0"))


def routed(vectors: DataFrame) -> DataFrame:
    """Vectors with ``stats`` and ``block_id``: one bit a segment, set where its mean is not negative."""
    bits = [F.when(F.col("stats")[i]["mu"] >= 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(ENDS))]
    return with_stats(vectors, ENDS).withColumn("block_id", sum(bits[1:], bits[0]).cast("long"))


LAKE = f"""lake AS (SELECT DISTINCT vec_id, table_id, set_id, pos, CAST(vec_values AS DOUBLE[]) AS v FROM cell_vectors
  WHERE LEN(vec_values) = {DIM} AND LEN(LIST_FILTER(vec_values, lambda x: x IS NULL OR ISNAN(x))) = 0 AND LEN(LIST_FILTER(vec_values, lambda x: x <> 0)) > 0)"""


def pairs_sql(where: str = "c.table_id <> 0", query: str = "q.table_id = 0") -> str:
    return f"""pairs AS (SELECT q.table_id AS q_table_id, q.set_id AS q_set_id, q.pos AS q_pos, c.table_id, c.set_id, c.pos, LIST_DISTANCE(q.v, c.v) ** 2 AS d
  FROM lake q JOIN lake c ON {query} AND {where})"""


def knn_sql(k: int = K, name: str = "knn") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY q_table_id, q_set_id, q_pos ORDER BY d, table_id, set_id, pos) AS rank FROM pairs) WHERE rank <= {k})"""


def segment_sql(i: int, v: str = "v") -> tuple[str, str]:
    """Mean and deviation of segment ``i`` of a list column."""
    a, n = S.bounds(ENDS)[i]
    part = f"LIST_SLICE({v}, {a + 1}, {a + n})"
    mu = f"(LIST_SUM({part}) / {n})"
    return mu, f"SQRT(GREATEST(LIST_SUM(LIST_TRANSFORM({part}, lambda x: x * x)) / {n} - {mu} * {mu}, 0))"


_CODE = " + ".join(f"(CASE WHEN {segment_sql(i)[0]} >= 0 THEN {1 << i} ELSE 0 END)" for i in range(len(ENDS)))
BLOCKS = f"""placed AS (SELECT *, CAST({_CODE} AS BIGINT) AS block_id, {", ".join(f"{segment_sql(i)[0]} AS mu{i}, {segment_sql(i)[1]} AS sd{i}" for i in range(len(ENDS)))} FROM lake WHERE table_id <> 0),
syn AS (SELECT block_id, COUNT(*) AS n, {", ".join(f"MAX(mu{i}) AS mx{i}, MIN(mu{i}) AS mn{i}, MAX(sd{i}) AS sx{i}, MIN(sd{i}) AS sn{i}" for i in range(len(ENDS)))} FROM placed GROUP BY block_id)"""


def bound_sql() -> tuple[str, str]:
    """Lower and upper bound of a query row q(mu_i, sd_i) against a synopsis row s."""
    low, high = [], []
    for i, (_, n) in enumerate(S.bounds(ENDS)):
        gap = lambda x, lo, hi: f"GREATEST({lo} - {x}, {x} - {hi}, 0)"
        low.append(f"{n} * (POW({gap(f'q.mu{i}', f's.mn{i}', f's.mx{i}')}, 2) + POW({gap(f'q.sd{i}', f's.sn{i}', f's.sx{i}')}, 2))")
        high.append(f"{n} * (POW(q.sd{i} + s.sx{i}, 2) + POW(GREATEST(ABS(q.mu{i} - s.mn{i}), ABS(q.mu{i} - s.mx{i})), 2))")
    return "(" + " + ".join(low) + ")", "(" + " + ".join(high) + ")"


QUERY_STATS = f"""qs AS (SELECT table_id AS q_table_id, set_id AS q_set_id, pos AS q_pos, {", ".join(f"{segment_sql(i)[0]} AS mu{i}, {segment_sql(i)[1]} AS sd{i}" for i in range(len(ENDS)))} FROM lake WHERE table_id = 0)"""
