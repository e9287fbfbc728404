"""All pairs of similar sets by a size-aware overlap join.

Tokens are ordered by rarity: those in many sets come last, and how many sets hold them is
counted over all sets. Two sets whose Jaccard similarity is at least t share at least
t x n tokens, n being either size, hence their C rarest common tokens lie among the first
n - ceil(t x n) + C tokens of both. A small set therefore lists all C-token subsets of that
prefix, and two small sets meet in an equal subset. For a large set the subsets would be too
many; it scans the inverted lists of its prefix for C = 1, to which all sets within reach of
a large size contribute. The pairs of both ways are united and filtered by the similarity.
Equal sets are one set with members and meet as such.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.runtime import ship, written

#: Tokens of an enumerated subset, and the largest set that enumerates subsets.
SUBSET = 2
SMALL_SIZE = 16
#: A token in at least this share of the sets counts as frequent. With sets of s tokens on
#: average there are at most s / FREQUENT_SHARE of them, whatever the number of sets.
FREQUENT_SHARE = 1 / 2000
FREQUENT_LEAST = 16


def reach(n: int, threshold: float) -> int:
    """The least overlap that a set of ``n`` tokens has with a similar one."""
    return max(1, math.ceil(threshold * n - 1e-9))


def _mix(a: int, b: int) -> int:
    """One signed 64-bit key of two tokens in order."""
    h = hashlib.blake2b(a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True), digest_size=8)
    return int.from_bytes(h.digest(), "little", signed=True)


def subset_keys(tokens: list[int], frequent: dict[int, int], threshold: float) -> tuple[list[int], list[int]]:
    """Keys of a set for both ways: of its token subsets, and of its inverted lists."""
    n = len(tokens)
    least = reach(n, threshold)
    ordered = sorted(tokens, key=lambda t: (frequent.get(t, 0), t))
    subsets = []
    if n <= SMALL_SIZE and least >= SUBSET:
        subsets = [_mix(a, b) for a, b in combinations(ordered[: n - least + SUBSET], 2)]
    elif n <= SMALL_SIZE:
        subsets = ordered[: n - least + 1]
    lists = ordered[: n - least + 1] if n >= reach(SMALL_SIZE + 1, threshold) else []
    return subsets, lists


def similar_sets(sets: DataFrame, threshold: float, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct sets and the members of each: (rep_a, rep_b, overlap), (id, rep, n).

    ``sets`` has id LONG and tokens ARRAY<LONG> (64-bit hashes of the values). Null ids, null
    tokens and sets smaller than ``min_size`` take no part; repeated tokens count once. Equal
    sets share the smallest id as ``rep``; pairs have rep_a < rep_b. Two values whose hashes
    collide inside one pair would count as one: 2**-64 for each two values of the pair; sets
    are told apart by 128 bits.
    """
    spark = sets.sparkSession
    ship(spark)
    clean = sets.where("id is not null and tokens is not null").select("id", F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull()))).alias("tokens"))
    # Sets are told by two hashes of their tokens, so copies of one set are partial sums and never one task's rows.
    sized = written(clean.where(F.size("tokens") >= min_size).withColumns({"k1": F.xxhash64("tokens"), "k2": F.xxhash64(F.reverse("tokens"), F.lit(1))}), "sets")
    placed = sized.select("id", "k1", "k2", F.size("tokens").alias("n")).distinct()
    grouped = placed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = written(placed.join(grouped, ["k1", "k2"]).select("id", "rep", "copies", "n"), "members")
    alone = grouped.select(F.col("rep").alias("id"), "k1", "k2")
    classes = written(sized.join(alone, ["id", "k1", "k2"]).groupBy("id", "k1", "k2").agg(F.first("tokens").alias("tokens")).select(F.col("id").alias("rep"), "tokens"), "classes")
    # The frequent tokens are few by FREQUENT_SHARE, so they may go to the driver and to all tasks.
    n_sets = classes.count()
    floor = max(FREQUENT_LEAST, math.ceil(FREQUENT_SHARE * n_sets))
    counts = classes.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= floor)
    frequent = spark.sparkContext.broadcast({r["token"]: r["count"] for r in counts.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = frequent.value
        for batch in batches:
            reps, arrays = batch.column(0).to_pylist(), batch.column(1)
            out: dict[str, list] = {"key": [], "rep": [], "n": [], "by_list": []}
            for rep, tokens in zip(reps, arrays.to_pylist()):
                subsets, lists = subset_keys(tokens, seen, threshold)
                for keys, by_list in ((subsets, False), (lists, True)):
                    out["key"] += keys
                    out["rep"] += [rep] * len(keys)
                    out["n"] += [len(tokens)] * len(keys)
                    out["by_list"] += [by_list] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["rep"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["by_list"], pa.bool_())], names=list(out))

    keys = classes.select("rep", "tokens").mapInArrow(run, "key long, rep long, n int, by_list boolean")
    a, b = (keys.select("key", "by_list", F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = (F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9)
    large = (F.col("n_a") > SMALL_SIZE) | (F.col("n_b") > SMALL_SIZE)
    met = a.join(b, ["key", "by_list"]).where((F.col("rep_a") < F.col("rep_b")) & near & (~F.col("by_list") | large))
    met = met.select("rep_a", "rep_b").distinct()
    held = classes.select("rep", "tokens")
    both = met.join(held.select(F.col("rep").alias("rep_a"), F.col("tokens").alias("ta")), "rep_a").join(held.select(F.col("rep").alias("rep_b"), F.col("tokens").alias("tb")), "rep_b")
    both = both.withColumn("overlap", F.size(F.array_intersect("ta", "tb")))
    union = F.size("ta") + F.size("tb") - F.col("overlap")
    pairs = both.where(F.col("overlap") >= union * threshold - 1e-9).select("rep_a", "rep_b", "overlap")
    return pairs, members


def column_sets(raw_tables: DataFrame) -> DataFrame:
    """(id, tokens): the distinct cells of every column, ids made of table and set number."""
    # Hashed before anything is exchanged: repeated rows of a table give equal (id, tokens).
    cols = raw_tables.where("table_id is not null and relation is not null").select("table_id", F.posexplode("relation").alias("set_id", "cells")).where("cells is not null")
    values = F.array_distinct(F.filter("cells", lambda c: c.isNotNull() & (c != "")))
    return cols.select(column_id("table_id", "set_id").alias("id"), F.transform(values, lambda c: F.xxhash64(c)).alias("tokens"))


def column_id(table_id: str, set_id: str):
    return F.col(table_id).cast("long") * F.lit(1 << 20) + F.col(set_id).cast("long")


def id_parts(c: str):
    """Table and set number of an id, negative table numbers included."""
    return F.shiftright(c, 20).cast("int"), F.pmod(F.col(c), F.lit(1 << 20)).cast("int")


def column_classes(raw_tables: DataFrame, threshold: float = 0.6, min_size: int = 8) -> DataFrame:
    """(table_id, set_id, class_table_id, class_set_id, copies, links): every column of ``min_size`` values or more
    with its class of equal columns, their number, and the number of other columns it is similar to.

    The whole join at the size of its input: copies are counted, not paired.
    """
    pairs, members = similar_sets(column_sets(raw_tables), threshold, min_size)
    sizes = members.where("id = rep").select("rep", "copies")
    both = pairs.select(F.explode(F.array(F.struct(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")), F.struct(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))).alias("x")).select("x.*")
    linked = both.join(sizes.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("linked"))
    out = members.join(linked, "rep", "left")
    (t, s), (ct, cs) = id_parts("id"), id_parts("rep")
    return out.select(t.alias("table_id"), s.alias("set_id"), ct.alias("class_table_id"), cs.alias("class_set_id"), "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))


def column_pairs(raw_tables: DataFrame, threshold: float = 0.6, min_size: int = 8) -> DataFrame:
    """(table_id_a, set_id_a, table_id_b, set_id_b, overlap_size) of all similar column pairs.

    Columns are compared by their distinct cells as they stand, without null and empty ones;
    the smaller (table_id, set_id) comes first. Repeated rows of a table are one table.
    Pairs of equal columns are listed too, by (id, id) within their group.
    """
    pairs, members = similar_sets(column_sets(raw_tables), threshold, min_size)
    one, two = (members.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    between = pairs.join(one, "rep_a").join(two, "rep_b").select("id_a", "id_b", "overlap")
    copied = members.where("copies > 1")
    left = copied.select(F.col("id").alias("id_a"), "rep", F.col("n").alias("overlap"))
    within = left.join(copied.select(F.col("id").alias("id_b"), "rep"), "rep").where("id_a < id_b").select("id_a", "id_b", "overlap")
    both = between.unionByName(within).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "overlap")
    (ta, sa), (tb, sb) = id_parts("a"), id_parts("b")
    return both.select(ta.alias("table_id_a"), sa.alias("set_id_a"), tb.alias("table_id_b"), sb.alias("set_id_b"), F.col("overlap").cast("int").alias("overlap_size"))
