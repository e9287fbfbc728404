"""One consistent form for texts that look the same.

The skeleton of a text: compatibility-decompose it (width, ligatures, kinds of blanks), drop
what is not visible, replace every character by the prototype of its look-alikes, decompose
again, and take off blanks at the ends. Look-alikes that a decomposition would take apart are
replaced before it as well. Texts of equal skeleton look equal; case, accents and other
letters stay different, but for those that many typefaces draw alike: I, l, 1 and |, O and 0,
m and rn. A skeleton is for comparing, not for reading.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsift.runtime import ship

# Characters that are drawn like a Latin letter, a digit or a sign, by prototype,
# after the public Unicode list of confusable characters (its most used scripts).
LOOK_ALIKES = {
    "A": "ΑАᎪꓮᗅ𐊠", "B": "ΒВᏴꓐᗷ𐊂", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓᗞ", "E": "ΕЕᎬꓰ𐊆", "F": "Ϝꓝ𐊇", "G": "ԌᏀꓖ", "H": "ΗНᎻꓧᕼⲎ", "J": "ЈᎫꓙᒍ",
    "K": "ΚКᏦꓗⲔ", "L": "Ꮮꓡᒪ", "M": "ΜМᎷꓟᗰⲘ", "N": "ΝꓠⲚ", "O": "0ΟОՕꓳⲞ𐊒𐊫", "P": "ΡРᏢꓑᑭⲢ", "Q": "Ԛ", "R": "ꓣᖇ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔⲦ𐊗", "U": "ꓴᑌ",
    "V": "Ꮩꓦᐯ", "W": "ԜᎳꓪ", "X": "ΧХꓫ᙭Ⲭ", "Y": "ΥҮꓬⲨ", "Z": "ΖᏃꓜⲌ",
    "a": "аɑ", "b": "Ь", "c": "сϲᴄⲥ", "d": "ԁ", "e": "е", "f": "ƒ", "g": "ɡց", "h": "һհ", "i": "іιıɩɪ", "j": "јϳ",
    "l": "I1|ΙІӀӏꓲⲒǀ∣", "rn": "m", "n": "ո",
    "o": "оοօᴏⲟ०೦൦໐๐", "p": "рρⲣ", "q": "ԛգ", "s": "ѕꜱ", "u": "υսᴜʋ", "v": "νѵᴠ", "w": "ԝѡᴡ", "x": "х", "y": "уγү", "z": "ᴢ",
    "'": "’‘ʼʹ′`´＇ꞌ", '"': "“”″", "-": "‐‑‒–−﹣", ".": "․", ",": "‚", ":": "ː∶", "/": "⁄∕", "~": "˜∼", "!": "ǃ",
}
_TABLE = {ord(x): proto for proto, alike in LOOK_ALIKES.items() for x in alike}
_ASCII = [(chr(x), proto) for x, proto in _TABLE.items() if x < 128]
#: Invisible characters besides those of category Cf: fillers and selectors.
_HIDDEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
#: Letters that compatibility decomposition would take apart visibly are none here; signs such as ½ are kept as they stand.
_BLANK = "Zs"


def _decompose(text: str) -> str:
    out = []
    for ch in unicodedata.normalize("NFKD", text):
        kind = unicodedata.category(ch)
        if kind == "Cf" or ord(ch) in _HIDDEN:
            continue
        out.append(" " if kind == _BLANK or ch in "\t" else ch)
    return "".join(out)


def skeleton(text: str | None) -> str | None:
    """The consistent form of ``text``; null stays null, a text of blanks becomes empty."""
    if text is None:
        return None
    if text.isascii():
        for x, proto in _ASCII:
            if x in text:
                text = text.replace(x, proto)
        return text.replace("\t", " ").strip(" ")
    bare = _decompose(text.translate(_TABLE)).translate(_TABLE)
    # Marks in canonical order again: hidden characters may have kept them apart.
    return unicodedata.normalize("NFD", _decompose(bare)).strip(" ")


def with_skeleton(df: DataFrame, text_col: str, out_col: str = "skeleton") -> DataFrame:
    """``df`` with the skeleton of a string column: one pass, no shuffle, repeats computed once a batch.

    A column that is already named ``out_col`` is replaced.
    """
    ship(df.sparkSession)
    df = df.drop(out_col) if text_col != out_col else df
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, str | None] = {}
            forms = []
            for x in batch.column(at).to_pylist():
                if x not in known:
                    known[x] = skeleton(x)
                forms.append(known[x])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def table_cells(raw_tables: DataFrame) -> DataFrame:
    """(table_id, set_id, pos, cell) of every non-null cell, once for each time its table is there."""
    cols = raw_tables.where("table_id is not null and relation is not null").select("table_id", F.posexplode("relation").alias("set_id", "cells"))
    return cols.select("table_id", "set_id", F.posexplode("cells").alias("pos", "cell")).where("cell is not null")


def look_alike_cells(raw_tables: DataFrame, ref_items: DataFrame) -> DataFrame:
    """(table_id, set_id, pos, item_id, cell, skeleton): cells that look like a label but differ from it.

    Labels of equal skeleton all match. Null and blank labels match nothing.
    """
    labels = with_skeleton(ref_items.where("item_id is not null and label is not null").select("item_id", "label").distinct(), "label").where("skeleton <> ''")
    cells = with_skeleton(table_cells(raw_tables), "cell")
    return cells.join(labels, "skeleton").where("cell <> label").select("table_id", "set_id", "pos", "item_id", "cell", "skeleton").distinct()


def same_looking(cells: DataFrame) -> DataFrame:
    """(skeleton, n_forms, n_cells): the groups of originals that share a form, counted, not collected.

    A group of any size is partial sums; null cells share the null form.
    """
    forms = with_skeleton(cells.groupBy("cell").agg(F.count("*").alias("n")), "cell")
    return forms.groupBy("skeleton").agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_cells"))
