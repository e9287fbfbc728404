"""Blocks of vectors with synopses, and nearest-neighbour search that skips blocks.

A flat set of blocks takes the place of a tree: the corpus is split level by level at the
midrange of the segment statistic that gains most, every block keeps its synopsis, and the
synopses are far fewer than the vectors. A query first searches its best block, which bounds
its k-th distance; blocks whose lower bound exceeds that are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsift.functions import segments as S
from colsift.functions.distance import envelope
from colsift.operators.knn import QUERY_KEY, best_rows, matrix, nearest_rows, rank_matches, tiled
from colsift.runtime import cut, remove, shared_path, ship

#: Vectors of one tile of a block.
TILE_ROWS = 20_000
#: Vectors up to which a block is split to its end in one task.
LOCAL_ROWS = 20_000


def with_stats(vectors: DataFrame, ends: list[int], v: str = "v", out: str = "stats") -> DataFrame:
    return vectors.withColumn(out, S.stats(F.col(v), ends))


def summarise(blocks: DataFrame, ends: list[int]) -> DataFrame:
    """(block_id, n, syn) of vectors with ``block_id`` and ``stats``: one partial and one final aggregate."""
    return blocks.groupBy("block_id").agg(F.count("*").alias("n"), S.synopsis("stats", ends).alias("syn"))


def _gains(blocks: DataFrame, ends: list[int], stats: str) -> DataFrame:
    """(block_id, n, segment, stat, split_at, gain) of the split candidates over ``ends``.

    Rows meet the ranges of their block, and all candidates are one wide aggregate: a block of
    any size is partial sums.
    """
    both = blocks.join(blocks.groupBy("block_id").agg(S.synopsis(stats, ends).alias("__syn")), "block_id")
    columns, candidates = [], []
    for i, (_, length) in enumerate(S.bounds(ends)):
        mu, sd = F.col(stats)[i]["mu"], F.col(stats)[i]["sd"]
        for stat in ("mu", "sd"):
            at = (F.col("__syn")[i][f"{stat}_max"] + F.col("__syn")[i][f"{stat}_min"]) / 2
            left = (mu if stat == "mu" else sd) < at
            name = f"{stat}{i}"
            columns.append(F.first(at).alias(f"{name}_at"))
            for side, of in (("l", left), ("r", ~left)):
                columns += [F.count_if(of).alias(f"{name}_{side}n"), F.max(F.when(of, mu)).alias(f"{name}_{side}x"), F.min(F.when(of, mu)).alias(f"{name}_{side}m"), F.max(F.when(of, sd)).alias(f"{name}_{side}s")]
            c = lambda x, name=name: F.col(f"{name}_{x}")
            spread = lambda high, low, dev, n=length: n * (F.pow(high - low, 2) + F.pow(dev, 2))
            whole = spread(F.greatest(c("lx"), c("rx")), F.least(c("lm"), c("rm")), F.greatest(c("ls"), c("rs")))
            gain = whole - (spread(c("lx"), c("lm"), c("ls")) + spread(c("rx"), c("rm"), c("rs"))) / 2
            candidates.append(F.struct((c("ln") + c("rn")).alias("n"), F.lit(i).alias("segment"), F.lit(stat).alias("stat"), c("at").alias("split_at"), F.when((c("ln") > 0) & (c("rn") > 0), gain).alias("gain")))
    wide = both.groupBy("block_id").agg(*columns)
    return wide.select("block_id", F.explode(F.array(*candidates)).alias("x")).select("block_id", "x.*").where("gain is not null")


def _with_doubled(gains: DataFrame) -> DataFrame:
    return gains.withColumn("doubled", F.max("gain").over(Window.partitionBy("block_id")) * 2)


def split_gains(blocks: DataFrame, ends: list[int]) -> DataFrame:
    """(block_id, n, segment, stat, split_at, gain, doubled): every split candidate of every block.

    The gain is the block's spread in the segment minus the mean spread of the halves on both
    sides of the midrange; the best one of a block counts double against refined segments.
    """
    return _with_doubled(_gains(blocks, ends, "stats"))


def refined_gains(blocks: DataFrame, ends: list[int]) -> DataFrame:
    """(block_id, n, segment, stat, split_at, gain, doubled) of candidates over the halved segments that beat twice the best whole one.

    ``blocks`` has the statistics of the halved segments as ``halves``.
    """
    best = _gains(blocks, ends, "stats").groupBy("block_id").agg((2 * F.max("gain")).alias("doubled"))
    return _gains(blocks, S.halve(ends), "halves").join(best, "block_id", "left").where(F.col("doubled").isNull() | (F.col("gain") > F.col("doubled")))


def _best_split(mu: np.ndarray, sd: np.ndarray, lengths: list[int], least: float | None = None) -> tuple[tuple, float, np.ndarray] | None:
    """(order, gain, right side) of the best split candidate of the rows' statistics, as in ``_gains``; with ``least`` only of those that gain more."""
    spread = lambda of, i, n: n * ((mu[of, i].max() - mu[of, i].min()) ** 2 + sd[of, i].max() ** 2)
    best = None
    for i, n in enumerate(lengths):
        for stat, x in (("mu", mu[:, i]), ("sd", sd[:, i])):
            right = x >= (x.max() + x.min()) / 2
            if right.all() or not right.any():
                continue
            gain = spread(slice(None), i, n) - (spread(~right, i, n) + spread(right, i, n)) / 2
            if (least is None or gain > least) and (best is None or (gain, -i, stat) > best[0]):
                best = (gain, -i, stat), gain, right
    return best


def _half_id(block: int, right: bool) -> int:
    return int.from_bytes(hashlib.blake2b(f"{block}:{right}".encode(), digest_size=8).digest(), "little", signed=True)


def _split_whole(block: int, stats: tuple, halves: tuple, lengths: tuple, capacity: int) -> np.ndarray:
    """Block ids of the rows of one block, split by the rules of ``build_blocks`` until no part exceeds ``capacity``."""
    out, todo = np.full(len(stats[0]), block, np.int64), [(block, np.arange(len(stats[0])))]
    while todo:
        name, at = todo.pop()
        best = None
        if len(at) > capacity:
            whole = _best_split(*(x[at] for x in stats), lengths[0])
            half = _best_split(*(x[at] for x in halves), lengths[1], whole and 2 * whole[1])
            best = half or whole
        if best is None:
            out[at] = name
        else:
            todo += [(_half_id(name, False), at[~best[2]]), (_half_id(name, True), at[best[2]])]
    return out


def build_blocks(vectors: DataFrame, ends: list[int], capacity: int = 1000) -> DataFrame:
    """``vectors`` with ``stats`` and ``block_id``: blocks split until none exceeds ``capacity``.

    Each level splits every block of more than ``LOCAL_ROWS`` vectors at its best candidate, all blocks in one job: of
    whole segments, or of a half segment that gains more than twice as much. Blocks of equal
    statistics can't be split and stay as they are. A half's id is a hash of its block's and
    its side, so levels have no limit. A level is written once and its predecessor removed.
    Smaller blocks are split by the same rules, each to its end in one task.
    """
    spark = vectors.sparkSession
    placed, path = with_stats(with_stats(vectors, ends), S.halve(ends), out="halves").withColumn("block_id", F.lit(1).cast("long")), None

    def stored(df: DataFrame, before: str | None) -> tuple[DataFrame, str]:
        at = shared_path(spark, "blocks")
        df.write.option("compression", "zstd").parquet(at)
        if before:
            remove(spark, before)
        return spark.read.schema(df.schema).parquet(at), at

    while True:
        placed, path = stored(placed, path)
        large = placed.groupBy("block_id").count().where(F.col("count") > max(capacity, LOCAL_ROWS)).select("block_id")
        todo = cut(placed.join(large, "block_id", "left_semi").select("block_id", "stats", "halves"))
        whole, half = (g.select("block_id", "segment", "stat", "split_at", "gain", F.lit(x).alias("refined")) for g, x in ((_gains(todo, ends, "stats"), False), (refined_gains(todo, ends), True)))
        best = F.max_by(F.struct("segment", "stat", "split_at", "refined"), F.struct("gain", -F.col("segment"), "stat", "refined"))
        plan = cut(whole.unionByName(half).groupBy("block_id").agg(best.alias("x")).select("block_id", "x.*")) if not todo.isEmpty() else None
        if plan is None or plan.isEmpty():
            break
        s = F.when(F.col("refined"), F.element_at("halves", F.col("segment") + 1)).otherwise(F.get("stats", F.col("segment")))
        right = F.when(F.col("stat") == "mu", s["mu"]).otherwise(s["sd"]) >= F.col("split_at")
        # One plan row a too large block, fewer than vectors / capacity; Spark sends it to all tasks only where it is small.
        moved = placed.join(plan, "block_id", "left")
        code = F.when(F.col("segment").isNull(), F.col("block_id")).otherwise(F.xxhash64("block_id", right))
        placed = moved.withColumn("block_id", code).drop("segment", "stat", "split_at", "refined").select(*placed.columns)

    lengths = tuple([n for _, n in S.bounds(e)] for e in (ends, S.halve(ends)))
    at = placed.columns.index("block_id")

    def values(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        flat = rows.column(name).combine_chunks().flatten()
        return tuple(flat.field(f).to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) for f in ("mu", "sd"))

    def split(rows: pa.Table) -> pa.Table:
        found = _split_whole(rows.column("block_id")[0].as_py(), values(rows, "stats"), values(rows, "halves"), lengths, capacity)
        return rows.set_column(at, "block_id", pa.array(found)).drop_columns(["halves"])

    small = placed.groupBy("block_id").count().where(F.col("count") <= LOCAL_ROWS).select("block_id")
    ship(spark)
    local = placed.join(small, "block_id", "left_semi").select(*placed.columns).groupBy("block_id").applyInArrow(split, placed.drop("halves").schema)
    # Blocks that are larger still can't be split.
    rest = placed.join(small, "block_id", "left_anti").select(*placed.columns).drop("halves")
    return stored(local.unionByName(rest), path)[0]


def _ranges(summaries: DataFrame) -> DataFrame:
    part = lambda f: F.transform("syn", lambda x: x[f]).alias(f)
    return summaries.select("block_id", "n", *map(part, ("mu_max", "mu_min", "sd_max", "sd_min")))


#: Queries and blocks of one tile of bounds, whose rows are all their pairs.
TILE_BOUNDS = (512, 4_096)


def block_bounds(queries: DataFrame, summaries: DataFrame, ends: list[int], best: str | None = None) -> DataFrame:
    """(query key, block_id, n, lb, ub): a stated query set against all synopses, in tiles.

    With ``best``, 'lb' or 'ub', each tile gives only the block of the least such bound of each query.
    """
    lengths = [n for _, n in S.bounds(ends)]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mu, sd = matrix(a["mu"]), matrix(a["sd"])
        mx, mn, sx, sn = (matrix(b[c]) for c in ("mu_max", "mu_min", "sd_max", "sd_min"))
        low, high = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
        gap = lambda x, lo, hi: np.maximum(0, np.maximum(lo[None] - x[:, None], x[:, None] - hi[None]))
        for i, n in enumerate(lengths):
            low += n * (gap(mu[:, i], mn[:, i], mx[:, i]) ** 2 + gap(sd[:, i], sn[:, i], sx[:, i]) ** 2)
            far = np.maximum(np.abs(mu[:, i, None] - mn[None, :, i]), np.abs(mu[:, i, None] - mx[None, :, i]))
            high += n * ((sd[:, i, None] + sx[None, :, i]) ** 2 + far**2)
        i, j = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        if best:
            by_id = np.argsort(b["block_id"].to_numpy())
            i, j = np.arange(len(a)), by_id[(low if best == "lb" else high)[:, by_id].argmin(1)]
            low, high = low[i, j], high[i, j]
        return pd.DataFrame({c: a[c].to_numpy()[i] for c in QUERY_KEY} | {c: b[c].to_numpy()[j] for c in ("block_id", "n")} | {"lb": low.ravel(), "ub": high.ravel()})

    q = with_stats(queries, ends, "q_v", "q_stats")
    asked = q.select(*(F.col(c).cast("int").alias(c) for c in QUERY_KEY), F.transform("q_stats", lambda x: x["mu"]).alias("mu"), F.transform("q_stats", lambda x: x["sd"]).alias("sd"))
    schema = "q_table_id int, q_set_id int, q_pos int, block_id long, n long, lb double, ub double"
    return tiled(asked, cut(_ranges(summaries)), run, schema, QUERY_KEY, ["block_id"], TILE_BOUNDS)


def dtw_block_bounds(queries: DataFrame, summaries: DataFrame, ends: list[int], radius: int) -> DataFrame:
    """(query key, block_id, lb): least squared DTW distance of each query to each block, in tiles."""
    spans = S.bounds(ends)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        low, high = matrix(a["low"]), matrix(a["high"])
        mx, mn = matrix(b["mu_max"]), matrix(b["mu_min"])
        out = np.zeros((len(a), len(b)))
        for i, (s, n) in enumerate(spans):
            top, bottom = high[:, s : s + n].max(1)[:, None], low[:, s : s + n].min(1)[:, None]
            out += n * np.maximum(0, np.maximum(mn[None, :, i] - top, bottom - mx[None, :, i])) ** 2
        i, j = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        return pd.DataFrame({c: a[c].to_numpy()[i] for c in QUERY_KEY} | {"block_id": b["block_id"].to_numpy()[j], "lb": out.ravel()})

    env = queries.withColumn("env", envelope(F.col("q_v"), radius))
    asked = env.select(*(F.col(c).cast("int").alias(c) for c in QUERY_KEY), F.transform("env", lambda x: x["low"]).alias("low"), F.transform("env", lambda x: x["high"]).alias("high"))
    return tiled(asked, cut(_ranges(summaries)), run, "q_table_id int, q_set_id int, q_pos int, block_id long, lb double", QUERY_KEY, ["block_id"], TILE_BOUNDS)


def search_blocks(queries: DataFrame, chosen: DataFrame, placed: DataFrame, k: int, exclude: str) -> DataFrame:
    """k nearest within the chosen (query, block) pairs only; ``chosen`` has the blocks' sizes ``n``.

    Every block is one tile of a matrix product against the queries that chose it; blocks of
    more than ``TILE_ROWS`` vectors are cut into as many tiles, so no task holds a whole hot block.
    """
    ship(queries.sparkSession)
    tiles = F.greatest(F.lit(1), F.ceil(F.col("n") / TILE_ROWS)).cast("int")
    asked = chosen.select(*QUERY_KEY, F.col("block_id").alias("in_block"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("in_tile")).join(queries, QUERY_KEY)
    sizes = chosen.groupBy("block_id").agg(F.first(tiles).alias("tiles"))
    rows = placed.select("block_id", "table_id", "set_id", "pos", "v").join(sizes, "block_id")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("table_id", "set_id", "pos"), F.col("tiles")).cast("int")).drop("tiles")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series([], dtype="float64" if c == "d" else "int32") for c in [*QUERY_KEY, "table_id", "set_id", "pos", "d"]})
        q_ids, ids = tuple(left[c].to_numpy() for c in QUERY_KEY), tuple(right[c].to_numpy() for c in ("table_id", "set_id", "pos"))
        q, x = (np.stack(v.to_numpy()).astype(np.float64) for v in (left["q_v"], right["v"]))
        best = best_rows(nearest_rows(q, q_ids, x, ids, k, exclude), k)
        at = best["q"].to_numpy().astype(int)
        return pd.DataFrame({c: v[at] for c, v in zip(QUERY_KEY, q_ids)} | {c: best[c].to_numpy() for c in ("table_id", "set_id", "pos", "d")})

    found = asked.groupBy("in_block", "in_tile").cogroup(rows.groupBy("block_id", "tile")).applyInPandas(run, "q_table_id int, q_set_id int, q_pos int, table_id int, set_id int, pos int, d double")
    return rank_matches(found, k)


def seed_bounds(bounds: DataFrame, queries: DataFrame, placed: DataFrame, k: int, exclude: str, by: str = "lb") -> DataFrame:
    """(query key, tau): the k-th distance within each query's best block; infinite where it has fewer rows."""
    best = Window.partitionBy(*QUERY_KEY).orderBy(by, "block_id")
    first = bounds.withColumn("r", F.row_number().over(best)).where("r = 1")
    found = search_blocks(queries, first, placed, k, exclude).groupBy(*QUERY_KEY).agg(F.count("*").alias("m"), F.max("d").alias("far"))
    tau = F.when(F.col("m") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    return queries.select(*QUERY_KEY).join(found, QUERY_KEY, "left").select(*QUERY_KEY, F.coalesce(tau, F.lit(float("inf"))).alias("tau"))


def surviving(bounds: DataFrame, taus: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(query, block) pairs that must be read, with ``kept`` false for the pruned ones.

    The slack keeps a block whose bound equals the k-th distance up to rounding.
    """
    limit = F.col("tau") / (1 + epsilon) * (1 + 1e-9) + 1e-12
    return bounds.join(taus, QUERY_KEY).withColumn("kept", F.col("lb") <= limit)


def _search_within(asked: DataFrame, placed: DataFrame, ends: list[int], k: int, exclude: str) -> DataFrame:
    """k nearest of queries with a bound ``tau`` of their k-th distance.

    Queries and blocks meet in tiles, which tell themselves which blocks a query must read, so
    no row is made of a (query, block) pair. A tile of which most must be read is read whole.
    """
    sizes = placed.groupBy("block_id").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("parts"))
    rows = placed.select("block_id", *(F.col(c).cast("int").alias(c) for c in ("table_id", "set_id", "pos")), "v").join(sizes, "block_id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("table_id", "set_id", "pos"), F.col("parts")).cast("int")).drop("parts")

    def stats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [x[:, a : a + n] for a, n in S.bounds(ends)]
        return np.column_stack([p.mean(1) for p in parts]), np.column_stack([p.std(1) for p in parts])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("block_id")
        start = np.unique(b["block_id"].to_numpy(), return_index=True)[1]
        stop = [*start[1:], len(b)]
        q, x = matrix(a["q_v"]), matrix(b["v"])
        bound = np.zeros((len(a), len(start)))
        for y, of in zip(stats(q), stats(x)):
            low, high = np.minimum.reduceat(of, start), np.maximum.reduceat(of, start)
            for i, (_, n) in enumerate(S.bounds(ends)):
                bound += n * np.maximum(0, np.maximum(low[None, :, i] - y[:, i, None], y[:, i, None] - high[None, :, i])) ** 2
        kept = bound <= a["tau"].to_numpy()[:, None] * (1 + 1e-6) + 1e-9
        q_ids, ids = tuple(a[c].to_numpy() for c in QUERY_KEY), tuple(b[c].to_numpy() for c in ("table_id", "set_id", "pos"))
        found = []
        if kept.mean() > 0.3:
            found.append(nearest_rows(q, q_ids, x, ids, k, exclude))
        else:
            for j, (s, e) in enumerate(zip(start, stop)):
                at = np.flatnonzero(kept[:, j])
                if len(at):
                    near = nearest_rows(q[at], tuple(c[at] for c in q_ids), x[s:e], tuple(c[s:e] for c in ids), k, exclude)
                    found.append(near.assign(q=at[near["q"].to_numpy().astype(int)]))
        best = best_rows(pd.concat(found), k) if found else pd.DataFrame({c: [] for c in ("q", "d", "table_id", "set_id", "pos")})
        at = best["q"].to_numpy().astype(int)
        return pd.DataFrame({c: v[at] for c, v in zip(QUERY_KEY, q_ids)} | {c: best[c].to_numpy() for c in ("table_id", "set_id", "pos", "d")})

    queries = cut(asked.select(*(F.col(c).cast("int").alias(c) for c in QUERY_KEY), "q_v", "tau"))
    schema = "q_table_id int, q_set_id int, q_pos int, table_id int, set_id int, pos int, d double"
    return rank_matches(tiled(queries, rows, run, schema, QUERY_KEY, ["block_id", "part"]), k)


def pruned_knn(queries: DataFrame, placed: DataFrame, ends: list[int], k: int, exclude: str = "table", epsilon: float = 0.0, nprobes: int | None = None, policy: str = "lb") -> DataFrame:
    """k nearest through blocks.

    With ``epsilon`` 0 the answer equals the exhaustive one; else every distance is at most
    (1 + epsilon) times the true one of its rank, both squared. ``nprobes`` reads that many
    blocks a query, best first, and promises nothing. ``policy`` orders blocks by their lower
    ('lb') or upper ('ub') bound for the seed; the exact answer doesn't depend on it.
    """
    if nprobes is None and not epsilon:
        first = block_bounds(queries, summarise(placed, ends), ends, policy)
        return _search_within(queries.join(seed_bounds(first, queries, placed, k, exclude, policy), QUERY_KEY), placed, ends, k, exclude)
    bounds = cut(block_bounds(queries, summarise(placed, ends), ends))
    if nprobes is not None:
        order = Window.partitionBy(*QUERY_KEY).orderBy(policy, "block_id")
        chosen = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= nprobes)
    else:
        chosen = surviving(bounds, seed_bounds(bounds, queries, placed, k, exclude, policy), epsilon).where("kept")
    return search_blocks(queries, chosen, placed, k, exclude)


def index_stats(summaries: DataFrame, capacity: int) -> DataFrame:
    """One row: blocks, vectors, and the fill factor's least, greatest, mean and deviation in percent."""
    fill = 100 * F.col("n") / capacity
    return summaries.agg(
        F.count("*").alias("blocks"), F.sum("n").alias("vectors"), F.min(fill).alias("min_fill"), F.max(fill).alias("max_fill"),
        F.round(F.avg(fill), 6).alias("avg_fill"), F.round(F.stddev_pop(fill), 6).alias("sd_fill"),
    )


def query_cost(pairs: DataFrame) -> DataFrame:
    """Per query: blocks and vectors read and in all, and the share that was pruned."""
    return pairs.groupBy(*QUERY_KEY).agg(
        F.count_if("kept").alias("checked_blocks"), F.count("*").alias("all_blocks"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).alias("checked_vectors"), F.sum("n").alias("all_vectors")
    ).withColumn("pruning", F.round(1 - F.col("checked_vectors") / F.col("all_vectors"), 6))


def tightness(bounds: DataFrame, least: DataFrame) -> DataFrame:
    """Per query the mean of sqrt(lower bound / least distance) over blocks; a zero distance is left out."""
    both = bounds.join(least, [*QUERY_KEY, "block_id"]).where("d > 0")
    return both.groupBy(*QUERY_KEY).agg(F.round(F.avg(F.sqrt(F.col("lb") / F.col("d"))), 6).alias("tightness"), F.count("*").alias("blocks"))


