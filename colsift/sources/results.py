"""Result files and the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = r"TQ(\d+)_Q(\d+)_qsize(\d+)_l(\d+)_dlsize(\d+)_len(\d+)_runtime([0-9.]+)_ndistcalc_dataaccess(\d+)\.csv$"
_SETTING = r"([a-z]+)_l(\d+)_(\d+)q_min(\d+)_max(\d+)$"


def as_result_rows(matches: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    """Matches in the form of a result file: joined ids, empty value columns, three decimals, and ``more`` columns as they are."""
    return matches.select(
        F.concat_ws(":", "q_table_id", "q_set_id").alias("TQ:Q"), F.concat_ws(":", "table_id", "set_id").alias("TS:S"), "q_pos", F.col("pos").alias("s_pos"),
        F.lit("[]").alias("q"), F.lit("[]").alias("s"), F.format_string("%.3f", F.col("d")).alias("d"), *more,
    )


def write_results(matches: DataFrame, path: str, by_k: bool = False, seconds: float | None = None) -> None:
    """Write a result CSV, with the run's ``seconds`` as column time; with ``by_k`` one directory for each k of a sliced run."""
    rows = as_result_rows(matches)
    if by_k:
        rows = as_result_rows(matches, ["k"])
    if seconds is not None:
        rows = rows.withColumn("time", F.lit(seconds))
    writer = rows.write.partitionBy("k") if by_k else rows.write
    writer.csv(path, header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Matches from result CSVs, whatever blanks stand around names and fields; 'qindex, sindex' are q_pos, s_pos."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {"qindex": "q_pos", "sindex": "s_pos"}
    raw = raw.toDF(*[names.get(c.strip(), c.strip()) for c in raw.columns])
    part = lambda c, i: F.split(F.col(f"`{c}`"), ":")[i].cast("int")
    more = [F.col(c).cast("int" if c == "k" else "double").alias(c) for c in ("time", "k") if c in raw.columns]
    return raw.select(
        part("TQ:Q", 0).alias("q_table_id"), part("TQ:Q", 1).alias("q_set_id"), F.col("q_pos").cast("int").alias("q_pos"),
        part("TS:S", 0).alias("table_id"), part("TS:S", 1).alias("set_id"), F.col("s_pos").cast("int").alias("pos"), F.col("d").cast("double").alias("d"), *more,
    )


def run_facts(path: DataFrame, column: str = "path") -> DataFrame:
    """Settings and costs that result files carry in their own and their directory's name."""
    name, parent = F.element_at(F.split(column, "/"), -1), F.element_at(F.split(column, "/"), -2)
    out = path.withColumn("__n", name).withColumn("__p", parent)
    own = ("q_table_id", "q_set_id", "q_size", "n_tables", "gb", "dim")
    picked = [F.regexp_extract("__n", _RUN, i + 1).cast("int").alias(c) for i, c in enumerate(own)]
    return out.where(F.col("__n").rlike(_RUN)).select(
        column, F.regexp_extract("__p", _SETTING, 1).alias("algorithm"), *picked, F.regexp_extract("__n", _RUN, 7).cast("double").alias("seconds"), F.regexp_extract("__n", _RUN, 8).cast("long").alias("data_access")
    )


def walk_runs(spark: SparkSession, path: str) -> DataFrame:
    """Settings and costs of all result files below a directory, from their names: contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path)
    return run_facts(files.select("path"))


def run_log(runs: DataFrame, **facts) -> DataFrame:
    """Rows of runs with their settings as columns: the table that takes the place of facts in names."""
    return runs.select("*", *[F.lit(v).cast("long" if isinstance(v, int) and c != "dim" else "int" if isinstance(v, int) else "string").alias(c) for c, v in facts.items()])


def write_index(placed: DataFrame, summaries: DataFrame, path: str) -> None:
    """Store vectors clustered by block and the synopses; an existing index is not overwritten."""
    placed.repartitionByRange("block_id").sortWithinPartitions("block_id").write.mode("errorifexists").parquet(f"{path}/vectors")
    summaries.write.mode("errorifexists").parquet(f"{path}/blocks")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, synopses) of a stored index; a filter on block_id skips row groups by their statistics."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/blocks")


def append_metrics(rows: DataFrame, path: str) -> None:
    """Add rows to a metrics CSV."""
    rows.write.mode("append").csv(path, header=True)
