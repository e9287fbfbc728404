"""Corpus encoding with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; every piece is encoded by byte-pair merges.
The merges of a piece run on a segment tree: leaf ``i`` holds the rank of the pair that
starts at the live part ``i``, inner nodes the smallest key below them, where a key is the
rank followed by the position, so the root is the leftmost pair of minimum rank. A merge
changes the pairs of two live neighbours and removes one leaf: three point updates of
logarithmic cost, so a piece of n bytes takes O(n log n) and no piece is cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from colsift.runtime import ship

TOKENIZER_DIR = "/opt/tokenizers"
RANK_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's own splitting pattern, published with the rank file.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps; the cache is emptied when full, so memory is bounded.
CACHE_PIECES = 100_000
CACHED_PIECE_BYTES = 256
_POS_BITS = 40
_NONE = (1 << 63) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a rank file (one base64 token and its rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by byte-pair merges on a segment tree of pair ranks."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    width = 1
    while width < n - 1:
        width <<= 1
    tree = [_NONE] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = (rank << _POS_BITS) | i
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    # Live part i spans piece[i:after[i]]; before[i] is the start of the live part on its left.
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        node = width + i
        tree[node] = key
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            low = left if left < right else right
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    mask = (1 << _POS_BITS) - 1
    while (root := tree[1]) != _NONE:
        i = root & mask
        gone = after[i]
        end = after[gone]
        after[i] = end
        if end < n:
            before[end] = i
        if gone < n - 1:
            put(gone, _NONE)
        rank = get(piece[i : after[end]]) if end < n else None
        put(i, _NONE if rank is None else (rank << _POS_BITS) | i)
        left = before[i]
        if left >= 0:
            rank = get(piece[left:end])
            put(left, _NONE if rank is None else (rank << _POS_BITS) | left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class PieceEncoder:
    """Encodes texts with one vocabulary; repeated pieces are served from a bounded cache."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.split, self.cache = ranks, regex.compile(SPLIT_PATTERN), {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        cache, ranks = self.cache, self.ranks
        for m in self.split.finditer(text):
            piece = m.group()
            known = cache.get(piece)
            if known is None:
                raw = piece.encode("utf-8", "replace")
                whole = ranks.get(raw)
                known = [whole] if whole is not None else merge_piece(raw, ranks)
                if len(raw) <= CACHED_PIECE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = known
            ids += known
        return ids


def broadcast_ranks(spark: SparkSession, tokenizer_dir: str = TOKENIZER_DIR, rank_file: str = RANK_FILE):
    """The vocabulary as a broadcast value: a fixed 50,256 entries, whatever the corpus."""
    return spark.sparkContext.broadcast(load_ranks(f"{tokenizer_dir}/{rank_file}"))


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_dir: str = TOKENIZER_DIR,
    rank_file: str = RANK_FILE,
) -> DataFrame:
    """(``id_col``, ids ARRAY<INT>) for every row of ``docs``, without special tokens.

    A null or an empty text gives an empty list, a null id stays null, repeated rows stay
    repeated, other columns are not read. No shuffle: one pass over two columns.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = broadcast_ranks(spark, tokenizer_dir, rank_file)
    src = docs.select(docs[id_col].alias("id_"), docs[text_col].cast("string").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder(ranks.value)
        for batch in batches:
            ends, flat = np.zeros(batch.num_rows + 1, dtype=np.int32), []
            for i, text in enumerate(batch.column(1)):
                flat.append(np.array(enc.encode(text.as_py()), dtype=np.int32))
                ends[i + 1] = ends[i] + len(flat[-1])
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id_", "ids"])

    schema = T.StructType([T.StructField("id_", src.schema["id_"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema).withColumnRenamed("id_", id_col)


def count_tokens(
    docs: DataFrame,
    text_col: str = "text",
    out_col: str = "n_tokens",
    tokenizer_dir: str = TOKENIZER_DIR,
    rank_file: str = RANK_FILE,
) -> DataFrame:
    """``docs`` without the text and with its length in tokens (0 for null and empty).

    A column that is already named ``out_col`` is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = broadcast_ranks(spark, tokenizer_dir, rank_file)
    keep = [f for f in docs.schema.fields if f.name not in (text_col, out_col)]
    src = docs.select(*[docs[f.name] for f in keep], docs[text_col].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder(ranks.value)
        for batch in batches:
            sizes = [len(enc.encode(x.as_py())) for x in batch.column(batch.num_columns - 1)]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64())], names=[*(f.name for f in keep), out_col])

    return src.mapInArrow(run, T.StructType([*keep, T.StructField(out_col, T.LongType())]))
