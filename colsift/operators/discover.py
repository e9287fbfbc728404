"""From a column of cells or keywords to ranked columns and tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsift.functions.distance import l2_normalise, let
from colsift.functions.text import has_header_row, keeps_cell, normalise
from colsift.operators.knn import exact_join, knn_join
from colsift.operators.rank import top_columns, top_tables
from colsift.runtime import ship, written

Embedder = Callable[[DataFrame], DataFrame]
#: Words of asked columns, and of columns, of one tile of ``token_overlaps``; pairs of columns that it counts at once.
TILE_ASKED, TILE_WORDS, TILE_PAIRS = 1_048_576, 524_288, 4_194_304


def clean_cells(cells: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """(keys, pos, token): distinct normalised text cells of each column, numbered in their order.

    Null, empty, 'nan' and whole-number cells are dropped. A column without text has no rows.
    """
    tokens = cells.where(keeps_cell(F.col(cell))).select(*keys, normalise(F.col(cell)).alias("token")).distinct()
    return tokens.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("token")) - 1)


def _by_column(t: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables and sets of the columns of the rows (t, s, w), and the column's number and the word of each distinct row, in their order."""
    order = np.lexsort((w, s, t))
    t, s, w = t[order], s[order], w[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
    column = np.cumsum(new) - 1
    once = new.copy()
    once[1:] |= w[1:] != w[:-1]
    return t[new], s[new], column[once], w[once]


def _tile_overlaps(asked: tuple, columns: tuple) -> Iterator[tuple]:
    """(q_table_id, q_set_id, table_id, set_id, overlap) as arrays, part by part, of the rows (table_id, set_id, word) of either side."""
    (qt, qs, qc, qw), (t, s, c, w) = _by_column(*asked), _by_column(*columns)
    # The columns of each word, one list after the other.
    words, at = np.unique(w, return_inverse=True)
    lists = c[np.argsort(at, kind="stable")]
    begins = np.r_[0, np.cumsum(np.bincount(at, minlength=len(words)))]
    place = np.minimum(np.searchsorted(words, qw), len(words) - 1)
    met = words[place] == qw
    qc, place = qc[met], place[met]
    sizes = begins[place + 1] - begins[place]
    # A part is some asked columns whole; a column alone may have more than TILE_PAIRS.
    least = np.r_[0, np.cumsum(np.bincount(qc, weights=sizes, minlength=len(qt)).astype(np.int64))]
    a = 0
    while a < len(qt):
        b = max(a + 1, min(a + TILE_PAIRS // len(t), int(np.searchsorted(least, least[a] + TILE_PAIRS, "right")) - 1))
        rows = slice(*np.searchsorted(qc, (a, b)))
        n = sizes[rows]
        shift = begins[place[rows]] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n
        pairs = lists[np.arange(n.sum()) + np.repeat(shift, n)] + np.repeat((qc[rows] - a) * len(t), n)
        counts = np.bincount(pairs, minlength=(b - a) * len(t)).reshape(b - a, len(t))
        i, j = np.nonzero(counts)
        other = qt[a + i] != t[j]
        i, j = i[other], j[other]
        yield qt[a + i], qs[a + i], t[j], s[j], counts[i, j]
        a = b


def token_overlaps(tokens: DataFrame, asked: str) -> DataFrame:
    """(q_table_id, q_set_id, table_id, set_id, overlap): how many tokens each asked column shares with each column of another table.

    ``tokens`` is (table_id, set_id, token), where a row may repeat; ``asked`` is a predicate on it. Tokens of asked
    columns are numbered and the others left out. Blocks of asked columns and of columns meet in tiles that count
    all their pairs, so no pair is exchanged, and a tile's rows leave it part by part.
    """
    spark = tokens.sparkSession
    ship(spark)
    words = written(tokens.where(asked).select("token").distinct().select("token", F.monotonically_increasing_id().alias("word")), "words")
    held = written(tokens.join(words.hint("shuffle_hash"), "token").select("table_id", "set_id", "word"), "held")
    rows = max(1, -(-held.where(asked).count() // TILE_ASKED))
    cols = max(1, -(-held.count() // TILE_WORDS), -(-2 * spark.sparkContext.defaultParallelism // rows))
    block = lambda n: F.pmod(F.xxhash64("table_id", "set_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.where(asked).select("*", F.lit(True).alias("asked"), block(rows).alias("row"), each(cols).alias("col"))
    right = held.select("*", F.lit(False).alias("asked"), each(rows).alias("row"), block(cols).alias("col"))
    # A tile is a partition: by their bytes alone, Spark would join tiles into few tasks.
    tiles = left.unionByName(right).select("table_id", "set_id", "word", "asked", (F.col("row") * cols + F.col("col")).alias("tile")).repartitionById(rows * cols, "tile")
    names = ["q_table_id", "q_set_id", "table_id", "set_id"]
    schema = pa.schema([*((c, pa.int32()) for c in names), ("overlap", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        is_asked = rows.column("asked").to_numpy()
        both = [tuple(rows.column(c).to_numpy()[kept] for c in ("table_id", "set_id", "word")) for kept in (is_asked, ~is_asked)]
        if all(len(x[0]) for x in both):
            for found in _tile_overlaps(*both):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, schema.types)], schema=schema)

    return tiles.groupBy("tile").applyInArrow(run, ", ".join(f"{c} int" for c in names) + ", overlap long")


def require_text(tokens: DataFrame) -> DataFrame:
    """The cleaned query, or an error if nothing of it is text."""
    if tokens.isEmpty():
        raise ValueError("the query column has no text: it is numerical or empty")
    return tokens


def hash_component(word: Column, i: Column) -> Column:
    """A value in [-1, 1) from the hex digits of md5(word:i), the same in every engine."""
    digits = F.substring(F.md5(F.concat(word, F.lit(":"), i.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(4294967296.0) * 2 - 1


def hash_lexicon(words: DataFrame, dim: int) -> DataFrame:
    """(word, vec): word vectors made from the word alone, where no trained ones are at hand."""
    index = F.sequence(F.lit(0), F.lit(dim - 1))
    return words.select("word", F.transform(index, lambda i: hash_component(F.col("word"), i)).alias("vec"))


def embed_cells(tokens: DataFrame, lexicon: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """(keys, pos, v): the mean of each cell's normalised word vectors, not normalised again.

    Unknown words and vectors with NaN are left out; cells without known words, and cells
    whose mean is zero, have no vector.
    """
    words = tokens.select(*keys, "pos", F.explode(F.split("token", " ")).alias("word")).where("word <> ''")
    # Computed once for each word: a filter on it would compute it again. Bad vectors become null, which avg skips.
    bad = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x)) | ~F.exists(v, lambda x: x != 0)
    unit = lexicon.select("word", let(F.col("vec"), lambda v: F.when(~bad(v), l2_normalise(v))).alias("u"))
    means = F.array(*[F.avg(F.col("u")[i]) for i in range(dim)])
    return words.join(unit, "word").groupBy(*keys, "pos").agg(means.alias("v")).where(F.exists("v", lambda x: x != 0))


def hash_embedder(keys: list[str], dim: int) -> Embedder:
    """Embeds cleaned cells by the hash lexicon."""

    def run(tokens: DataFrame) -> DataFrame:
        words = tokens.select(F.explode(F.split("token", " ")).alias("word")).where("word <> ''").distinct()
        return embed_cells(tokens, hash_lexicon(words, dim), keys, dim)

    return run


def token_grams(tokens: DataFrame, n: int = 3) -> DataFrame:
    """The columns of ``tokens`` and ``word``: the n-grams of each whole token between its end marks."""
    marked = F.concat(F.lit("<"), "token", F.lit(">"))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - n + 1))
    return tokens.select("*", F.explode(F.transform(at, lambda i: F.substring(marked, i, F.lit(n)))).alias("word"))


def subword_embedder(keys: list[str], dim: int) -> Embedder:
    """One vector for each whole token: the mean of its n-grams' hash vectors, neither split into words nor normalised; no token is unknown."""

    def run(tokens: DataFrame) -> DataFrame:
        grams = token_grams(tokens.select(*keys, "pos", "token"))
        lexicon = hash_lexicon(grams.select("word").distinct(), dim)
        means = F.array(*[F.avg(F.col("vec")[i]) for i in range(dim)])
        return grams.join(lexicon, "word").groupBy(*keys, "pos").agg(means.alias("v")).where(F.exists("v", lambda x: x != 0))

    return run


def discover_by_column(query: DataFrame, corpus: DataFrame, embed: Embedder, k: int, x: int, exact: bool = False) -> DataFrame:
    """Columns joinable with an uploaded one: clean, embed, search, rank. ``query`` has q_table_id and cell."""
    tokens = require_text(clean_cells(query.withColumn("q_set_id", F.lit(0)), ["q_table_id", "q_set_id"]))
    q = embed(tokens.withColumnsRenamed({"q_table_id": "table_id", "q_set_id": "set_id"})).select(
        F.col("table_id").alias("q_table_id"), F.col("set_id").alias("q_set_id"), F.col("pos").alias("q_pos"), F.col("v").alias("q_v")
    )
    return top_columns(exact_join(q, corpus) if exact else knn_join(q, corpus, k), x)


def discover_by_keywords(query: DataFrame, corpus: DataFrame, embed: Embedder, k: int, x: int) -> DataFrame:
    """Tables about keywords: as ``discover_by_column``, ranked by closest matches."""
    tokens = require_text(clean_cells(query.withColumn("q_set_id", F.lit(0)), ["q_table_id", "q_set_id"]))
    q = embed(tokens.withColumnsRenamed({"q_table_id": "table_id", "q_set_id": "set_id"})).select(
        F.col("table_id").alias("q_table_id"), F.col("set_id").alias("q_set_id"), F.col("pos").alias("q_pos"), F.col("v").alias("q_v")
    )
    return top_tables(knn_join(q, corpus, k), x)


def with_metadata(ranked: DataFrame, pages: DataFrame, raw: DataFrame) -> DataFrame:
    """Ranked rows with the page around the table and its header row; missing pages leave nulls."""
    header = F.when(has_header_row(F.col("has_header"), F.col("header_position")), F.transform("relation", lambda c: F.try_element_at(c, F.lit(1))))
    facts = pages.select("table_id", "page_title", "title", "url").dropDuplicates(["table_id"])
    heads = raw.select("table_id", header.alias("header")).dropDuplicates(["table_id"])
    return ranked.join(facts, "table_id", "left").join(heads, "table_id", "left")
