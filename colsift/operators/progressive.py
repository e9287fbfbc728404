"""Progressive answers: rounds of blocks in the order of their lower bound.

After each round a rank is confirmed if no unread block can hold anything nearer. Confirmed
ranks never change, so a caller may show them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsift.operators.blocks import block_bounds, search_blocks, summarise
from colsift.operators.knn import QUERY_KEY, rank_matches
from colsift.runtime import cut


def progressive_knn(queries: DataFrame, placed: DataFrame, ends: list[int], k: int, exclude: str = "table", first: int = 1, growth: int = 2) -> Iterator[DataFrame]:
    """One DataFrame a round: (query key, table_id, set_id, pos, d, rank, step, confirmed, checked_blocks).

    Round sizes grow by ``growth``; the last round's rows are all confirmed and equal the exact answer.
    """
    bounds = block_bounds(queries, summarise(placed, ends), ends)
    order = Window.partitionBy(*QUERY_KEY).orderBy("lb", "block_id")
    ordered = cut(bounds.withColumn("r", F.row_number().over(order)))
    total = ordered.agg(F.max("r")).first()[0] or 0
    done, size, step, answer = 0, first, 0, None
    while done < total:
        upto = min(total, done + size)
        fresh = ordered.where((F.col("r") > done) & (F.col("r") <= upto))
        if answer is not None:
            # Blocks that can't improve the k-th distance so far need no reading.
            kth = answer.groupBy(*QUERY_KEY).agg(F.count("*").alias("m"), F.max("d").alias("far")).where(F.col("m") >= k)
            fresh = fresh.join(kth, QUERY_KEY, "left").where(F.col("far").isNull() | (F.col("lb") <= F.col("far") * (1 + 1e-9) + 1e-12))
        found = search_blocks(queries, fresh, placed, k, exclude).drop("rank")
        merged = found if answer is None else found.unionByName(answer.drop("rank"))
        answer = cut(rank_matches(merged, k))
        done, size, step = upto, size * growth, step + 1
        rest = ordered.where(F.col("r") > done).groupBy(*QUERY_KEY).agg(F.min("lb").alias("next_lb"))
        rows = answer.join(rest, QUERY_KEY, "left")
        sure = F.col("next_lb").isNull() | (F.col("d") < F.col("next_lb"))
        yield rows.withColumn("confirmed", sure).withColumn("step", F.lit(step)).withColumn("checked_blocks", F.lit(done)).drop("next_lb")


def progress_log(queries: DataFrame, placed: DataFrame, ends: list[int], k: int, exclude: str = "table") -> DataFrame:
    """All rounds in one DataFrame, for traces of the best answers so far."""
    out = None
    for rows in progressive_knn(queries, placed, ends, k, exclude):
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("there are no blocks to search")
    return out
