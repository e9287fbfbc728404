"""Binary vector files of a lake: reading, checking and writing.

A column file is a run of columns, each a little-endian uint32 count and that many vectors of
float32 values; the file's name carries vectors, table id, columns and dimension. Flat files
hold vectors alone, labelled ones have a twin with one byte for each vector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsift.functions.text import file_name, parse_file_name
from colsift.runtime import ship

VECTORS = "table_id int, set_id int, pos int, v array<float>, raw_data_file string"


def decode_columns(content: bytes, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """(set_id, matrix) of each column of a file; an empty column has no rows."""
    at, set_id = 0, 0
    while at < len(content):
        n = int(np.frombuffer(content, "<u4", 1, at)[0])
        at += 4
        if at + 4 * n * dim > len(content):
            raise ValueError(f"column {set_id} ends beyond the file: {n} vectors of {dim}")
        yield set_id, np.frombuffer(content, "<f4", n * dim, at).reshape(n, dim)
        at += 4 * n * dim
        set_id += 1


def encode_columns(columns: list[np.ndarray]) -> bytes:
    return b"".join(np.uint32(len(c)).astype("<u4").tobytes() + np.asarray(c, dtype="<f4").tobytes() for c in columns)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, the Hadoop spellings of object stores included."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri) if "://" in uri else re.sub(r"^(file:)?/+", "file:///", uri))


def lake_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, raw_data_file, n_vectors, table_id, n_cols, dim) from listing and names, contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length", name.alias("raw_data_file"), *parse_file_name(name))


def first_tables(files: DataFrame, n: int) -> DataFrame:
    """Files of the ``n`` smallest table ids: a fixed order in place of the directory's."""
    return files.join(files.where("table_id is not null").select("table_id").distinct().orderBy("table_id").limit(n), "table_id", "left_semi")


def lake_cardinality(files: DataFrame) -> DataFrame:
    """Vectors, columns, tables and bytes of a lake from its file names and sizes alone."""
    return files.agg(F.sum("n_vectors").alias("vectors"), F.sum("n_cols").alias("columns"), F.countDistinct("table_id").alias("tables"), F.sum("length").alias("bytes"), F.round(F.sum("length") / 1073741824).cast("long").alias("gb"))


def read_vectors(spark: SparkSession, path: str, dim: int, n_tables: int | None = None) -> DataFrame:
    """All vectors of a lake directory; files whose name declares another dimension raise."""
    ship(spark)
    files = lake_files(spark, path)
    wrong = files.where(F.col("dim").isNull() | (F.col("dim") != dim)).select("raw_data_file").first()
    if wrong:
        raise ValueError(f"{wrong[0]} does not declare vectors of dimension {dim}")
    chosen = (first_tables(files, n_tables) if n_tables else files).select("path", "table_id", "raw_data_file")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for table_id, name, raw in zip(pdf["table_id"], pdf["raw_data_file"], pdf["content"]):
                for set_id, m in decode_columns(raw, dim):
                    if len(m):
                        yield pd.DataFrame({"table_id": table_id, "set_id": set_id, "pos": range(len(m)), "v": list(m), "raw_data_file": name})

    return content.join(chosen, "path").select("table_id", "raw_data_file", "content").mapInPandas(run, VECTORS)


def write_vectors(vectors: DataFrame, path: str, dim: int) -> DataFrame:
    """Write one file a table, columns in the order of set_id and vectors in that of pos; returns (raw_data_file, bytes).

    A table is one file, so it is one task's work, as the format demands; tables are spread.
    """
    ship(vectors.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = int(pdf["table_id"].iloc[0])
        sets = [np.stack(g.sort_values("pos")["v"].to_numpy()) for _, g in pdf.groupby("set_id", sort=True)]
        name = file_name(len(pdf), table, len(sets), dim)
        fs, inside = open_folder(path)
        fs.create_dir(inside, recursive=True)
        raw = encode_columns(sets)
        with fs.open_output_stream(f"{inside}/{name}") as out:
            out.write(raw)
        return pd.DataFrame({"raw_data_file": [name], "bytes": [len(raw)]})

    return vectors.select("table_id", "set_id", "pos", "v").groupBy("table_id").applyInPandas(run, "raw_data_file string, bytes long")


def read_flat(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(raw_data_file, pos, v) of files that hold vectors alone."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("raw_data_file"), "content")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, raw in zip(pdf["raw_data_file"], pdf["content"]):
                m = np.frombuffer(raw, "<f4").reshape(-1, dim)
                if len(m):
                    yield pd.DataFrame({"raw_data_file": name, "pos": range(len(m)), "v": list(m)})

    return files.mapInPandas(run, "raw_data_file string, pos int, v array<float>")


def read_labelled(spark: SparkSession, vectors_path: str, labels_path: str, dim: int) -> DataFrame:
    """(raw_data_file, pos, v, label): flat vectors with the label byte at the same position of the twin file.

    Twins have the same name up to the last dot. A file without a twin, and twins of different
    lengths, raise.
    """
    ship(spark)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    files = lambda path, name: spark.read.format("binaryFile").load(path).select(stem.alias("stem"), F.element_at(F.split("path", "/"), -1).alias(f"{name}_file"), F.col("content").alias(name))
    both = files(vectors_path, "vectors").join(files(labels_path, "labels"), "stem", "full_outer")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, other, raw, codes in zip(pdf["vectors_file"], pdf["labels_file"], pdf["vectors"], pdf["labels"]):
                if raw is None or codes is None:
                    raise ValueError(f"{name or other} has no twin")
                m, labels = np.frombuffer(raw, "<f4").reshape(-1, dim), np.frombuffer(codes, "u1")
                if len(m) != len(labels):
                    raise ValueError(f"{name} has {len(m)} vectors and {len(labels)} labels")
                if len(m):
                    yield pd.DataFrame({"raw_data_file": name, "pos": range(len(m)), "v": list(m), "label": labels.astype(np.int32)})

    return both.select("vectors_file", "labels_file", "vectors", "labels").mapInPandas(run, "raw_data_file string, pos int, v array<float>, label int")


def read_ascii(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """(v): one vector a line, values separated by the delimiter."""
    parts = F.filter(F.split(F.trim("value"), delimiter, -1), lambda x: x != "")
    return spark.read.text(path).where(F.trim("value") != "").select(F.transform(parts, lambda x: x.cast("float")).alias("v"))
