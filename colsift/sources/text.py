"""Text inputs: uploaded columns, keywords, raw tables, word vectors, statistics files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsift.functions.text import has_header_row, upload_table_id

_RAW = """relation array<array<string>>, hasHeader boolean, headerPosition string, pageTitle string, title string, url string,
textBeforeTable string, textAfterTable string, lastModified string"""


def upload_column(spark: SparkSession, path: str, column: int) -> DataFrame:
    """(q_table_id, cell): one column of a CSV by its 1-based number; the first line is a header."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if not 1 <= column <= len(df.columns):
        raise ValueError(f"column {column} of a file with {len(df.columns)} columns")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.select(upload_table_id(name).alias("q_table_id"), F.col(f"`{df.columns[column - 1]}`").alias("cell"))


def keyword_cells(spark: SparkSession, keywords: str, q_table_id: int = 0) -> DataFrame:
    """(q_table_id, cell): tokens of a keyword query, split at single blanks."""
    one = spark.range(1).select(F.lit(q_table_id).alias("q_table_id"), F.lit(keywords).alias("kw"))
    return one.select("q_table_id", F.explode(F.split("kw", " ")).alias("cell"))


def read_raw_tables(spark: SparkSession, path: str) -> DataFrame:
    """Raw web tables, one JSON document a file, with snake-case columns and the file's name."""
    df = spark.read.schema(_RAW).json(path, multiLine=True)
    names = {"hasHeader": "has_header", "headerPosition": "header_position", "pageTitle": "page_title", "textBeforeTable": "text_before_table", "textAfterTable": "text_after_table", "lastModified": "last_modified"}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns], F.element_at(F.split(F.input_file_name(), "/"), -1).alias("raw_data_file"))


def table_shapes(raw: DataFrame) -> DataFrame:
    """(table_id, n_cols, n_rows, header): columns, longest column and the header row if there is one."""
    header = F.when(has_header_row(F.col("has_header"), F.col("header_position")), F.transform("relation", lambda c: F.try_element_at(c, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    longest = F.array_max(F.transform("relation", lambda c: F.coalesce(F.size(c), F.lit(0))))
    return raw.select("table_id", F.size("relation").alias("n_cols"), F.coalesce(longest, F.lit(0)).alias("n_rows"), header.alias("header"))


def table_rows(raw: DataFrame) -> DataFrame:
    """(table_id, row_no, cells): the row-wise view of column-wise tables, without the header row.

    Ragged columns are null beyond their end.
    """
    skip = F.when(has_header_row(F.col("has_header"), F.col("header_position")), F.lit(1)).otherwise(F.lit(0))
    longest = F.array_max(F.transform("relation", lambda c: F.coalesce(F.size(c), F.lit(0))))
    base = raw.where(F.size("relation") > 0).withColumn("skip", skip).withColumn("longest", longest).where("longest > skip")
    rows = base.withColumn("i", F.explode(F.sequence(F.col("skip"), F.col("longest") - 1)))
    return rows.select("table_id", (F.col("i") - F.col("skip")).alias("row_no"), F.transform("relation", lambda c: F.try_element_at(c, F.col("i") + 1)).alias("cells"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec): word vectors of a text file, 'word f1 ... fd' a line; vectors with NaN are dropped."""
    parts = F.split("value", r"\s+", 2)
    df = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("word"), F.transform(F.split(F.trim(parts[1]), r"\s+"), lambda x: x.cast("float")).alias("vec"))
    return df.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))


def read_column_counts(spark: SparkSession, path: str) -> DataFrame:
    """(n_cols, n_tables) of a statistics file with lines 'Key : k Value : v'."""
    form = r"Key\s*:\s*(\d+)\s+Value\s*:\s*(\d+)"
    df = spark.read.text(path).where(F.col("value").rlike(form))
    return df.select(F.regexp_extract("value", form, 1).cast("int").alias("n_cols"), F.regexp_extract("value", form, 2).cast("long").alias("n_tables"))


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(x, y) of a cumulative distance histogram: a count, then that many pairs, blank-separated."""
    values = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), r"\s+").alias("t"))
    pairs = F.transform(F.sequence(F.lit(0), F.element_at("t", 1).cast("int") - 1), lambda i: F.struct(F.element_at("t", i * 2 + 2).cast("double").alias("x"), F.element_at("t", i * 2 + 3).cast("double").alias("y")))
    return values.select(F.inline(pairs))


def radius_at(histogram: DataFrame, delta: float) -> float | None:
    """The distance below which a share ``delta`` lies, by linear interpolation; None below the first bin."""
    low = histogram.where(F.col("y") < delta).orderBy(F.desc("y"), F.desc("x")).first()
    high = histogram.where(F.col("y") >= delta).orderBy("y", "x").first()
    if low is None or high is None:
        return None
    return low["x"] + (high["x"] - low["x"]) * (delta - low["y"]) / (high["y"] - low["y"])
