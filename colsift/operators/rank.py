"""Ranking of columns and tables from matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_overlaps(matches: DataFrame) -> DataFrame:
    """Per column the distinct matched corpus vectors (overlap) and, besides, the distinct query vectors."""
    return matches.groupBy("table_id", "set_id").agg(F.countDistinct("pos").alias("overlap"), F.countDistinct("q_table_id", "q_set_id", "q_pos").alias("covered"))


def top_columns(matches: DataFrame, x: int) -> DataFrame:
    """The ``x`` columns of the largest overlap; ties by (table_id, set_id); no padding when there are fewer."""
    return column_overlaps(matches).where("overlap > 0").orderBy(F.desc("overlap"), "table_id", "set_id").limit(x)


def table_closeness(matches: DataFrame) -> DataFrame:
    """Per table the least distance, how many matches attain it, and all its matches."""
    # Counted by distance first, so a table of any size is a few partial sums.
    by_distance = matches.groupBy("table_id", "d").agg(F.count("*").alias("n"))
    found = by_distance.groupBy("table_id").agg(F.min(F.struct("d", "n")).alias("m"), F.sum("n").alias("total_matches"))
    return found.select("table_id", F.col("m.d").alias("min_distance"), F.col("m.n").alias("num_closest"), "total_matches")


def top_tables(matches: DataFrame, x: int) -> DataFrame:
    """The ``x`` tables with most closest matches, then the least distance, then the id."""
    return table_closeness(matches).orderBy(F.desc("num_closest"), "min_distance", "table_id").limit(x)
