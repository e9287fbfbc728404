"""Top N within every group by statistics-guided skipping.

The rows are laid out once: range partitioning clusters them by group and cuts a huge group
over many parts, and inside a part every group's rows are dealt into layers, the best
``LAYER`` rows of each group first, then twice as many, and so on. A layer of a part is one
file, and for every group it holds the statistics tell how many rows it has there and how good
the best and the worst of them are. Layouts are kept: any later query, for any N, uses them.

A query reads no row to decide what to read. A file is skipped if of every group it holds N
better rows are known: the layers before it in its part hold that many, which settles ties as
well, or its best score of the group is strictly worse than the group's N-th score can be by
the statistics of all its layers. Spark prunes the skipped files before it opens them, and
only the rows of the others are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsift.runtime import shared_path, ship

#: Rows of a group in the first layer of a part; layer k has LAYER * 2 ** k of them.
LAYER = 16
_LAYER, _PART = "layer__", "part__"
#: More than a layout has parts.
PARTS = 1 << 32


def _layers(df: DataFrame, group: str) -> DataFrame:
    """``df``, sorted by group within its partitions, with the number of the part and of each row's layer."""
    at = df.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(at)
            new = np.r_[names[0].as_py() != last, np.asarray(pc.not_equal(names.slice(1), names.slice(0, n - 1)))]
            start = np.nonzero(new)[0]
            begun = np.zeros(n, np.int64)
            begun[start] = start
            begun = np.maximum.accumulate(begun)
            place = np.arange(n) - begun
            # Rows of the group that the last batch ended with come first here.
            place[: start[0] if len(start) else n] += seen
            last, seen = names[n - 1].as_py(), int(place[-1]) + 1
            layer = np.floor(np.log2(place // LAYER + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layer), pa.array(np.full(n, part, np.int32))], names=[*batch.schema.names, _LAYER, _PART])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(_LAYER, T.IntegerType()), T.StructField(_PART, T.IntegerType())]))


def cluster_by_group(df: DataFrame, group: str, score: str, ties: list[str], path: str) -> None:
    """Write the layout of ``df`` (columns group, score, ties) below ``path``: rows and statistics."""
    ship(df.sparkSession)
    order = [group, score, *ties]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    _layers(placed, group).sortWithinPartitions(_LAYER, _PART, *order).write.partitionBy(_LAYER, _PART).parquet(f"{path}/rows")
    zones = _rows(df.sparkSession, path, df.schema).groupBy(_LAYER, _PART, group).agg(F.count("*").alias("n"), F.min(score).alias("best"), F.max(score).alias("worst"))
    zones.write.parquet(f"{path}/zones")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(_LAYER, T.IntegerType()), T.StructField(_PART, T.IntegerType())])).parquet(f"{path}/rows")


def files_to_read(zones: DataFrame, n: int, group: str) -> DataFrame:
    """(layer, part, rows): the files that can hold one of the ``n`` best rows of a group.

    A group's first zones in the order of their worst score that hold ``n`` rows together bound
    its n-th score; a group has few zones in a part, and of its parts only ``n`` can matter here.
    """
    by_worst = Window.partitionBy(group).orderBy("worst", "best", _PART, _LAYER)
    first = zones.withColumn("r", F.row_number().over(by_worst)).where(F.col("r") <= n)
    upto = F.sum("n").over(by_worst.rowsBetween(Window.unboundedPreceding, 0))
    nth = first.withColumn("upto", upto).where(F.col("upto") >= n).groupBy(group).agg(F.min("worst").alias("nth"))
    # Layers before this one are full.
    before = LAYER * (F.pow(F.lit(2.0), _LAYER) - 1)
    needed = F.max((before < n) & (F.col("nth").isNull() | (F.col("best") <= F.col("nth"))))
    return zones.join(nth, group, "left").groupBy(_LAYER, _PART).agg(F.sum("n").alias("rows"), needed.alias("needed")).where("needed").drop("needed")


def top_n_clustered(spark: SparkSession, path: str, n: int, group: str, score: str, ties: list[str], schema: T.StructType, skip: bool = True) -> DataFrame:
    """The first ``n`` rows of every group in the order (score, ties) from a layout."""
    rows = _rows(spark, path, schema)
    if skip:
        # One row a file, which the driver lists anyway: a filter on the folders prunes them before any is opened.
        zones = spark.read.schema(T.StructType([T.StructField(_LAYER, T.IntegerType()), T.StructField(_PART, T.IntegerType()), schema[group], *(T.StructField(c, t) for c, t in (("n", T.LongType()), ("best", T.DoubleType()), ("worst", T.DoubleType())))])).parquet(f"{path}/zones")
        files = [r[_LAYER] * PARTS + r[_PART] for r in files_to_read(zones, n, group).collect()]
        rows = rows.where((F.col(_LAYER).cast("long") * PARTS + F.col(_PART)).isin(files))
    rank = Window.partitionBy(group).orderBy(score, *ties)
    return rows.select(*schema.names).withColumn("rank_", F.row_number().over(rank)).where(F.col("rank_") <= n).drop("rank_")


def top_n_per_group(df: DataFrame, n: int, group: str, score: str, ties: list[str], path: str | None = None) -> DataFrame:
    """The ``n`` rows of every group with the smallest ``score``, ties by ``ties`` ascending.

    ``group`` is a string column and ``score`` a double; rows in which one of them or of the
    tie columns is null are no candidates, NaN scores neither. Equal (group, ties) are one
    row and keep their smallest score. Groups of fewer rows come out whole. Other columns
    are not carried. An empty input gives an empty result. The layout goes to ``path``, to be
    kept and asked again by ``top_n_clustered``; without one to the shared folder.
    """
    spark = df.sparkSession
    keys = [group, *ties]
    kept = df.select(*keys, score).where(" and ".join(f"`{c}` is not null" for c in [*keys, score])).where(~F.isnan(score))
    kept = kept.groupBy(*keys).agg(F.min(score).alias(score)).select(group, score, *ties)
    path = path or shared_path(spark, "topn")
    cluster_by_group(kept, group, score, ties, path)
    return top_n_clustered(spark, path, n, group, score, ties, kept.schema)


#: What a number may look like once the blanks around it are gone.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BLANKS = r"^[\s ]+|[\s ]+$"


def read_matches(matches: DataFrame) -> DataFrame:
    """Usable rows of the match log: trimmed group, distance as a number, target split in two."""
    text = F.regexp_replace("d", BLANKS, "")
    target = F.regexp_replace("ts_s", BLANKS, "")
    out = matches.select(
        F.regexp_replace("tq_q", BLANKS, "").alias("tq_q"), "ts_s", "q_pos", "s_pos",
        F.when(text.rlike(_NUMBER), text.cast("double")).alias("d_num"),
        F.expr("try_cast(split(%s, ':')[0] as int)" % "regexp_replace(ts_s, '[ \\t]', '')").alias("s_table"),
        F.expr("try_cast(try_element_at(split(%s, ':'), 2) as int)" % "regexp_replace(ts_s, '[ \\t]', '')").alias("s_set"),
    )
    return out.where("tq_q <> '' and d_num >= 0 and d_num < double('Infinity')")


def nearest_matches(matches: DataFrame, n: int = 10) -> DataFrame:
    """(tq_q, ts_s, q_pos, s_pos, d) of the ``n`` nearest matches of every query column."""
    rows = read_matches(matches)
    top = top_n_per_group(rows, n, "tq_q", "d_num", ["s_table", "s_set", "q_pos", "s_pos", "ts_s"])
    return top.select("tq_q", "ts_s", "q_pos", "s_pos", F.col("d_num").alias("d"))
