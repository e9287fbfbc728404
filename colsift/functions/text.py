"""Cleaning of table cells and parsing of the lake's file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of any script, and superscript ones, make a cell a number.
_ALL_DIGITS = r"^-?[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"
_FILE = r"data_size(\d+)_t(\d+)c(\d+)_len(\d+)_noznorm\.bin$"


def keeps_cell(cell: Column) -> Column:
    """Whether a cell is text: not null, empty, 'nan' or a whole number. Decimals are text."""
    return cell.isNotNull() & (F.length(cell) > 0) & (cell != "nan") & ~cell.rlike(_ALL_DIGITS)


def normalise(cell: Column) -> Column:
    """Small letters, every run of other characters one blank; blanks at the ends stay."""
    return F.regexp_replace(F.lower(cell), r"(?U)\W+", " ")


def file_name(n_vectors: int, table_id: int, n_cols: int, dim: int) -> str:
    return f"data_size{n_vectors}_t{table_id}c{n_cols}_len{dim}_noznorm.bin"


def parse_file_name(name: Column) -> list[Column]:
    """n_vectors, table_id, n_cols and dim of a lake file; null where the name has another form."""
    part = lambda i: F.when(name.rlike(_FILE), F.regexp_extract(name, _FILE, i).cast("int"))
    return [part(i).alias(alias) for i, alias in enumerate(("n_vectors", "table_id", "n_cols", "dim"), 1)]


def upload_table_id(name: Column) -> Column:
    """Table id of an upload named t<id>.csv, else 0."""
    return F.when(name.rlike(r"t\d+\.csv"), F.regexp_extract(name, r"t(\d+)\.csv", 1).cast("int")).otherwise(F.lit(0))


def keywords(text: Column) -> Column:
    """Tokens of a keyword query, split at single blanks."""
    return F.split(text, " ")


def has_header_row(has_header: Column, position: Column) -> Column:
    return F.coalesce(has_header & (position == "FIRST_ROW"), F.lit(False))
