"""Trusting answers: recall, precision, and means over experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsift.functions.distance import relatively_close

MATCH_KEY = ["q_table_id", "q_set_id", "q_pos", "table_id", "set_id", "pos"]


def hits(results: DataFrame, truth: DataFrame, keys: list[str] = MATCH_KEY) -> DataFrame:
    """Results that are in the ground truth."""
    return results.join(truth.select(*keys).distinct(), keys, "left_semi")


def _one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row counts side by side."""
    return a.unionByName(b, allowMissingColumns=True).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*a.columns, *b.columns)])


def recall(results: DataFrame, truth: DataFrame, keys: list[str] = MATCH_KEY, expected: DataFrame | None = None) -> DataFrame:
    """One row: found, expected and their ratio; the ratio is null for an empty truth.

    With ``expected``, a row of that name, ``truth`` need only hold what ``results`` can match.
    """
    found = hits(results.select(*keys).distinct(), truth, keys).agg(F.count("*").alias("found"))
    if expected is None:
        expected = truth.select(*keys).distinct().agg(F.count("*").alias("expected"))
    return _one_row(found, expected).withColumn("recall", F.expr("found / nullif(expected, 0)"))


def precision(results: DataFrame, truth: DataFrame, k: int, keys: list[str] = MATCH_KEY, query: list[str] = MATCH_KEY[:3], possible: DataFrame | None = None) -> DataFrame:
    """One row: found, possible = the sum over queries of min(expected, k), and their ratio; ``possible`` as ``expected`` of ``recall``."""
    found = hits(results.select(*keys).distinct(), truth, keys).agg(F.count("*").alias("found"))
    if possible is None:
        possible = truth.select(*keys).distinct().groupBy(*query).count().agg(F.sum(F.least("count", F.lit(k))).alias("possible"))
    return _one_row(found, possible).withColumn("precision", F.expr("found / nullif(possible, 0)"))


def recall_on_distance(results: DataFrame, truth: DataFrame, query: list[str] = MATCH_KEY[:3], expected: DataFrame | None = None) -> DataFrame:
    """Share of ranks at which both runs have relatively close distances: ids may differ under ties. ``expected`` as of ``recall``."""
    keys = [*query, "rank"]
    both = truth.select(*keys, F.col("d").alias("d_truth")).join(results.select(*keys, "d"), keys, "left")
    close = F.coalesce(relatively_close(F.col("d"), F.col("d_truth")), F.lit(False))
    counts = both.agg(F.count_if(close).alias("found"), F.count("*").alias("expected"))
    if expected is not None:
        counts = _one_row(counts.select("found"), expected)
    return counts.withColumn("recall", F.expr("found / nullif(expected, 0)"))


def effective_epsilon(approximate: DataFrame, exact: DataFrame, query: list[str] = MATCH_KEY[:3]) -> DataFrame:
    """Per query the mean of (approximate - exact) / exact over ranks; ranks at distance zero are left out."""
    keys = [*query, "rank"]
    both = approximate.select(*keys, F.col("d").alias("a")).join(exact.select(*keys, F.col("d").alias("x")), keys).where("x > 0")
    return both.groupBy(*query).agg(F.round(F.avg((F.col("a") - F.col("x")) / F.col("x")), 6).alias("effective_epsilon"), F.count("*").alias("ranks"))


def mean_by(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Means of measured values per setting."""
    return df.groupBy(*keys).agg(*[F.round(F.avg(v), digits).alias(v) for v in values])


def changed_snapshots(progress: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Snapshots whose value differs from the one before."""
    by = Window.partitionBy(*keys).orderBy(step)
    before = F.lag(value).over(by)
    return progress.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col(value))).drop("__before")
