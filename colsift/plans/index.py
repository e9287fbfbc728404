"""Queries of the block index: synopses, bounds, pruned and progressive search."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsift.functions import distance, segments
from colsift.operators import blocks, evaluate, knn, progressive, warping
from colsift.plans.data import BLOCKS, ENDS, K, LAKE, QUERY_STATS, bound_sql, corpus, knn_sql, pairs_sql, routed, segment_sql, uploads
from colsift.plans.search import query
from colsift.runtime import cut

_N = len(ENDS)
_LB, _UB = bound_sql()
_BOUNDS = f"bounds AS (SELECT q_table_id, q_set_id, q_pos, block_id, n, {_LB} AS lb, {_UB} AS ub FROM qs q, syn s)"
_MATCH = "q_table_id, q_set_id, q_pos, table_id, set_id, pos"
_PLACED_PAIRS = """pairs AS (SELECT q.table_id AS q_table_id, q.set_id AS q_set_id, q.pos AS q_pos, c.table_id, c.set_id, c.pos, c.block_id, LIST_DISTANCE(q.v, c.v) ** 2 AS d
  FROM lake q JOIN placed c ON q.table_id = 0)"""
_KEY = "q_table_id, q_set_id, q_pos"
_SEED = f"""first AS (SELECT {_KEY}, block_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY lb, block_id) AS r FROM bounds) WHERE r = 1),
seeded AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY d) AS r FROM pairs JOIN first USING ({_KEY}, block_id)),
tau AS (SELECT {_KEY}, CASE WHEN COUNT(*) >= {K} THEN MAX(d) ELSE 'Infinity'::DOUBLE END AS tau FROM seeded WHERE r <= {K} GROUP BY {_KEY})"""


def placed(spark, sf_dir):
    return routed(corpus(spark, sf_dir))


def _rounded(df):
    return df.withColumn("d", F.round("d", 6))


@query(f"WITH {LAKE} SELECT vec_id, {', '.join(f'ROUND({segment_sql(i)[0]}, 6) AS mu{i}, ROUND({segment_sql(i)[1]}, 5) AS sd{i}' for i in range(_N))} FROM lake WHERE table_id <> 0")
def x6_segment_stats(spark, sf_dir):
    v = blocks.with_stats(corpus(spark, sf_dir), ENDS)
    return v.select("vec_id", *[c for i in range(_N) for c in (F.round(F.col("stats")[i]["mu"], 6).alias(f"mu{i}"), F.round(F.col("stats")[i]["sd"], 5).alias(f"sd{i}"))])


@query(f"WITH {LAKE}, {BLOCKS} SELECT block_id, n, {', '.join(f'ROUND(mx{i}, 6) AS mx{i}, ROUND(mn{i}, 6) AS mn{i}, ROUND(sx{i}, 5) AS sx{i}, ROUND(sn{i}, 5) AS sn{i}' for i in range(_N))} FROM syn")
def a8_synopses(spark, sf_dir):
    s = blocks.summarise(placed(spark, sf_dir), ENDS)
    names = (("mx", "mu_max", 6), ("mn", "mu_min", 6), ("sx", "sd_max", 5), ("sn", "sd_min", 5))
    return s.select("block_id", "n", *[F.round(F.col("syn")[i][f], r).alias(f"{a}{i}") for i in range(_N) for a, f, r in names])


@query(f"WITH {LAKE}, {BLOCKS} SELECT block_id, vec_id FROM placed")
def i2_routing(spark, sf_dir):
    return placed(spark, sf_dir).select("block_id", "vec_id")


@query(f"WITH {LAKE}, {BLOCKS} SELECT block_id, ROUND({' + '.join(f'{n} * (POW(mx{i} - mn{i}, 2) + POW(sx{i}, 2))' for i, (_, n) in enumerate(segments.bounds(ENDS)))}, 5) AS quality FROM syn")
def x12_quality(spark, sf_dir):
    s = blocks.summarise(placed(spark, sf_dir), ENDS)
    return s.select("block_id", F.round(segments.quality(F.col("syn"), ENDS), 5).alias("quality"))


@query(f"WITH {LAKE}, {BLOCKS}, {QUERY_STATS}, {_BOUNDS} SELECT {_KEY}, block_id, ROUND(lb, 5) AS lb, ROUND(ub, 5) AS ub FROM bounds")
def x7_bounds(spark, sf_dir):
    b = blocks.block_bounds(uploads(spark, sf_dir), blocks.summarise(placed(spark, sf_dir), ENDS), ENDS)
    return b.select(*knn.QUERY_KEY, "block_id", F.round("lb", 5).alias("lb"), F.round("ub", 5).alias("ub"))


@query(f"WITH {LAKE}, {BLOCKS} SELECT COUNT(*) AS blocks, CAST(SUM(n) AS BIGINT) AS vectors, MIN(100 * n / 200) AS min_fill, MAX(100 * n / 200) AS max_fill, ROUND(AVG(100 * n / 200), 6) AS avg_fill, ROUND(STDDEV_POP(100 * n / 200), 6) AS sd_fill FROM syn")
def a10_index_stats(spark, sf_dir):
    return blocks.index_stats(blocks.summarise(placed(spark, sf_dir), ENDS), 200)


@query(f"WITH {LAKE}, {pairs_sql()}, {knn_sql()} SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM knn")
def j3_pruned_knn(spark, sf_dir):
    return _rounded(blocks.pruned_knn(uploads(spark, sf_dir), placed(spark, sf_dir), ENDS, K))


@query(f"WITH {LAKE}, {pairs_sql()}, {knn_sql()} SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM knn")
def t7_upper_bound_policy(spark, sf_dir):
    return _rounded(blocks.pruned_knn(uploads(spark, sf_dir), placed(spark, sf_dir), ENDS, K, policy="ub"))


@query(f"""WITH {LAKE}, {BLOCKS}, {QUERY_STATS}, {_BOUNDS}, {_PLACED_PAIRS}, {_SEED},
kept AS (SELECT {_KEY}, block_id FROM bounds JOIN tau USING ({_KEY}) WHERE lb <= tau / 1.5 * (1 + 1e-9) + 1e-12),
e AS (SELECT pairs.*, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY d, table_id, set_id, pos) AS rank FROM pairs JOIN kept USING ({_KEY}, block_id))
SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM e WHERE rank <= {K}""")
def j4_epsilon_knn(spark, sf_dir):
    return _rounded(blocks.pruned_knn(uploads(spark, sf_dir), placed(spark, sf_dir), ENDS, K, epsilon=0.5))


@query(f"""WITH {LAKE}, {BLOCKS}, {QUERY_STATS}, {_BOUNDS}, {_PLACED_PAIRS},
kept AS (SELECT {_KEY}, block_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY lb, block_id) AS r FROM bounds) WHERE r <= 4),
e AS (SELECT pairs.*, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY d, table_id, set_id, pos) AS rank FROM pairs JOIN kept USING ({_KEY}, block_id))
SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM e WHERE rank <= {K}""")
def t6_nprobes(spark, sf_dir):
    return _rounded(blocks.pruned_knn(uploads(spark, sf_dir), placed(spark, sf_dir), ENDS, K, nprobes=4))


@query(f"""WITH {LAKE}, {BLOCKS}, {QUERY_STATS}, {_BOUNDS}, {_PLACED_PAIRS}, first AS (SELECT {_KEY}, block_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY lb, block_id) AS r FROM bounds) WHERE r = 1),
e AS (SELECT pairs.*, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY d, table_id, set_id, pos) AS rank FROM pairs JOIN first USING ({_KEY}, block_id))
SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM e WHERE rank <= {K}""")
def t2_best_block(spark, sf_dir):
    return _rounded(blocks.pruned_knn(uploads(spark, sf_dir), placed(spark, sf_dir), ENDS, K, nprobes=1))


@query(f"WITH {LAKE}, {pairs_sql()}, {knn_sql(1)} SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM knn")
def t3_exact_nearest(spark, sf_dir):
    return _rounded(blocks.pruned_knn(uploads(spark, sf_dir), placed(spark, sf_dir), ENDS, 1))


def _traced(spark, sf_dir, epsilon=0.0):
    """Every (query, block) pair with its bounds and whether it must be read."""
    q, at = uploads(spark, sf_dir), placed(spark, sf_dir)
    bounds = cut(blocks.block_bounds(q, blocks.summarise(at, ENDS), ENDS))
    return blocks.surviving(bounds, blocks.seed_bounds(bounds, q, at, K, "table"), epsilon)


@query(f"""WITH {LAKE}, {BLOCKS}, {QUERY_STATS}, {_BOUNDS}, {_PLACED_PAIRS}, {_SEED}
SELECT {_KEY}, block_id, ROUND(lb, 5) AS lb, ROUND(tau, 5) AS tau FROM bounds JOIN tau USING ({_KEY}) WHERE NOT lb <= tau * (1 + 1e-9) + 1e-12""")
def t8_pruning_trace(spark, sf_dir):
    gone = _traced(spark, sf_dir).where("not kept")
    return gone.select(*knn.QUERY_KEY, "block_id", F.round("lb", 5).alias("lb"), F.round("tau", 5).alias("tau"))


@query(f"""WITH {LAKE}, {BLOCKS}, {QUERY_STATS}, {_BOUNDS}, {_PLACED_PAIRS}, {_SEED}, k AS (SELECT {_KEY}, n, lb <= tau * (1 + 1e-9) + 1e-12 AS kept FROM bounds JOIN tau USING ({_KEY}))
SELECT {_KEY}, COUNT(*) FILTER (kept) AS checked_blocks, COUNT(*) AS all_blocks, CAST(COALESCE(SUM(n) FILTER (kept), 0) AS BIGINT) AS checked_vectors, CAST(SUM(n) AS BIGINT) AS all_vectors,
ROUND(1 - COALESCE(SUM(n) FILTER (kept), 0) / SUM(n), 6) AS pruning FROM k GROUP BY {_KEY}""")
def a11_query_cost(spark, sf_dir):
    return blocks.query_cost(_traced(spark, sf_dir))


@query(f"""WITH {LAKE}, {BLOCKS}, {QUERY_STATS}, {_BOUNDS}, {_PLACED_PAIRS}, least AS (SELECT {_KEY}, block_id, MIN(d) AS d FROM pairs GROUP BY {_KEY}, block_id)
SELECT {_KEY}, ROUND(AVG(SQRT(lb / d)), 6) AS tightness, COUNT(*) AS blocks FROM bounds JOIN least USING ({_KEY}, block_id) WHERE d > 0 GROUP BY {_KEY}""")
def a14_tightness(spark, sf_dir):
    q, at = uploads(spark, sf_dir), placed(spark, sf_dir)
    bounds = blocks.block_bounds(q, blocks.summarise(at, ENDS), ENDS)
    return blocks.tightness(bounds, knn.block_distances(q, at))


@query(f"""WITH {LAKE}, {BLOCKS}, {_PLACED_PAIRS} SELECT {_KEY}, block_id, ROUND(MIN(d), 6) AS d FROM pairs GROUP BY {_KEY}, block_id""")
def l3_block_nearest(spark, sf_dir):
    return _rounded(knn.block_distances(uploads(spark, sf_dir), placed(spark, sf_dir)))


_GAIN = " UNION ALL ".join(
    f"SELECT block_id, {i} AS segment, '{s}' AS stat, mu{i} AS mu, sd{i} AS sd, {s}{i} AS x, {n} AS len FROM placed" for i, (_, n) in enumerate(segments.bounds(ENDS)) for s in ("mu", "sd")
)


@query(f"""WITH {LAKE}, {BLOCKS}, f AS ({_GAIN}), m AS (SELECT *, (MAX(x) OVER w + MIN(x) OVER w) / 2 AS split_at FROM f WINDOW w AS (PARTITION BY block_id, segment, stat)),
h AS (SELECT block_id, segment, stat, split_at, len, x < split_at AS side, COUNT(*) AS n, ANY_VALUE(len) * (POW(MAX(mu) - MIN(mu), 2) + POW(MAX(sd), 2)) AS s, MAX(mu) AS mx, MIN(mu) AS mn, MAX(sd) AS sx FROM m GROUP BY block_id, segment, stat, split_at, len, x < split_at),
g AS (SELECT block_id, segment, stat, split_at, CAST(SUM(n) AS BIGINT) AS n, ANY_VALUE(len) * (POW(MAX(mx) - MIN(mn), 2) + POW(MAX(sx), 2)) - SUM(s) / 2 AS gain FROM h GROUP BY block_id, segment, stat, split_at HAVING COUNT(*) = 2)
SELECT block_id, n, segment, stat, ROUND(split_at, 5) AS split_at, ROUND(gain, 5) AS gain, ROUND(2 * MAX(gain) OVER (PARTITION BY block_id), 5) AS doubled FROM g""")
def i4_split_gains(spark, sf_dir):
    g = blocks.split_gains(placed(spark, sf_dir), ENDS)
    return g.select("block_id", "n", "segment", "stat", *[F.round(c, 5).alias(c) for c in ("split_at", "gain", "doubled")])


@query()
def i3_built_blocks(spark, sf_dir):
    """Blocks of the level-wise splitter, with their fill."""
    built = blocks.build_blocks(corpus(spark, sf_dir), ENDS, 200)
    return blocks.summarise(built, ENDS).select("block_id", "n")


@query(f"WITH {LAKE} SELECT COUNT(*) AS vectors, COUNT(DISTINCT v) AS kinds, TRUE AS fits, TRUE AS ranges_hold FROM lake WHERE table_id <> 0")
def i3_block_invariants(spark, sf_dir):
    """What must hold of built blocks: no vector lost, none too large, every synopsis covers its vectors."""
    built = blocks.build_blocks(corpus(spark, sf_dir), ENDS, 200)
    sized = built.join(blocks.summarise(built, ENDS), "block_id")
    holds = F.forall(F.zip_with("stats", "syn", lambda x, y: x["mu"].between(y["mu_min"], y["mu_max"]) & x["sd"].between(y["sd_min"], y["sd_max"])), lambda b: b)
    return sized.agg(F.count("*").alias("vectors"), F.count_distinct("v").alias("kinds"), (F.max("n") <= 200).alias("fits"), F.min(holds).alias("ranges_hold"))


@query(f"""WITH {LAKE}, {BLOCKS}, {QUERY_STATS}, {_BOUNDS}, {_PLACED_PAIRS}, {_SEED}, {pairs_sql().replace("pairs AS", "all_pairs AS")},
exact AS (SELECT {_KEY}, d, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY d, table_id, set_id, pos) AS rank FROM all_pairs),
kept AS (SELECT {_KEY}, block_id FROM bounds JOIN tau USING ({_KEY}) WHERE lb <= tau / 1.5 * (1 + 1e-9) + 1e-12),
e AS (SELECT pairs.*, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY d, table_id, set_id, pos) AS rank FROM pairs JOIN kept USING ({_KEY}, block_id))
SELECT {_KEY}, ROUND(AVG((e.d - exact.d) / exact.d), 6) AS effective_epsilon, COUNT(*) AS ranks FROM e JOIN exact USING ({_KEY}, rank) WHERE rank <= {K} AND exact.d > 0 GROUP BY {_KEY}""")
def a11_effective_epsilon(spark, sf_dir):
    """How far the answers of the relaxed search are from the true ones of their ranks."""
    q, at = uploads(spark, sf_dir), placed(spark, sf_dir)
    return evaluate.effective_epsilon(blocks.pruned_knn(q, at, ENDS, K, epsilon=0.5), knn.knn_join(q, corpus(spark, sf_dir), K))


@query(f"WITH {LAKE}, {pairs_sql()}, {knn_sql()} SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM knn")
def j5_knn_on_built_blocks(spark, sf_dir):
    built = blocks.build_blocks(corpus(spark, sf_dir), ENDS, 200)
    return _rounded(blocks.pruned_knn(uploads(spark, sf_dir), built, ENDS, K))


@query(f"WITH {LAKE}, {pairs_sql()}, {knn_sql()} SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM knn")
def t11_progressive_answer(spark, sf_dir):
    """The last round of the progressive search: all ranks confirmed."""
    last = None
    for rows in progressive.progressive_knn(uploads(spark, sf_dir), placed(spark, sf_dir), ENDS, K):
        last = rows
    return _rounded(last.where("confirmed")).select(*knn.QUERY_KEY, "table_id", "set_id", "pos", "d", "rank")


@query()
def t9_progress_log(spark, sf_dir):
    """Snapshots of every rank after each round in which its distance changed."""
    log = progressive.progress_log(uploads(spark, sf_dir), placed(spark, sf_dir), ENDS, K)
    return evaluate.changed_snapshots(log, [*knn.QUERY_KEY, "rank"], "step", "d").select(*knn.QUERY_KEY, "rank", "step", F.round("d", 6).alias("d"), "confirmed", "checked_blocks")


@query(f"WITH {LAKE}, {pairs_sql()}, {knn_sql()} SELECT {_KEY}, CAST(rank AS INT) AS rank, ROUND(d, 6) AS d, TRUE AS confirmed FROM knn")
def t9_last_snapshots(spark, sf_dir):
    """Where the progress of every rank ends: confirmed, at its true distance."""
    log = progressive.progress_log(uploads(spark, sf_dir), placed(spark, sf_dir), ENDS, K)
    last = log.groupBy(*knn.QUERY_KEY, "rank").agg(F.max_by(F.struct("d", "confirmed"), "step").alias("x"))
    return last.select(*knn.QUERY_KEY, "rank", F.round("x.d", 6).alias("d"), "x.confirmed")


@query(f"WITH {LAKE} SELECT vec_id, ROUND(LIST_MAX(LIST_SLICE(v, 1, 6)), 6) AS high, ROUND(LIST_MIN(LIST_SLICE(v, 1, 6)), 6) AS low, ROUND(LIST_MAX(LIST_SLICE(v, 20, 30)), 6) AS high_mid FROM lake")
def x10_envelope(spark, sf_dir):
    from colsift.plans.data import lake

    env = lake(spark, sf_dir).select("vec_id", distance.envelope(F.col("v"), 5).alias("e"))
    return env.select("vec_id", F.round(F.col("e")[0]["high"], 6).alias("high"), F.round(F.col("e")[0]["low"], 6).alias("low"), F.round(F.col("e")[24]["high"], 6).alias("high_mid"))


@query(f"WITH {LAKE} SELECT vec_id, {', '.join(f'ROUND(LIST_MAX(LIST_SLICE(v, {a + 1}, {a + n})), 6) AS mx{i}, ROUND(LIST_MIN(LIST_SLICE(v, {a + 1}, {a + n})), 6) AS mn{i}' for i, (a, n) in enumerate(segments.bounds(ENDS)))} FROM lake")
def x11_segment_extremes(spark, sf_dir):
    from colsift.plans.data import lake

    v = F.col("v")
    cols = [c for i, (a, n) in enumerate(segments.bounds(ENDS)) for c in (F.round(F.array_max(F.slice(v, a + 1, n)).cast("double"), 6).alias(f"mx{i}"), F.round(F.array_min(F.slice(v, a + 1, n)).cast("double"), 6).alias(f"mn{i}"))]
    return lake(spark, sf_dir).select("vec_id", *cols)


@query()
def x3_dtw_nearest(spark, sf_dir):
    """Nearest vector under dynamic time warping among all vectors for the stated queries (ids divisible by 20)."""
    from colsift.plans.data import lake

    everything = lake(spark, sf_dir)
    q = everything.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_vec_id"), F.col("v").alias("q_v"))
    return warping.dtw_nearest(q, everything, 0.1).select("q_vec_id", "vec_id", F.round("d", 6).alias("d"))


def _dtw_bound_sql() -> str:
    """Least DTW distance of a query row q(v) to a synopsis row s: the envelope's range of each segment against the block's means."""
    parts = []
    for i, (a, n) in enumerate(segments.bounds(ENDS)):
        reach = f"LIST_SLICE(q.v, {max(1, a + 1 - 5)}, {min(ENDS[-1], a + n + 5)})"
        parts.append(f"{n} * POW(GREATEST(s.mn{i} - LIST_MAX({reach}), LIST_MIN({reach}) - s.mx{i}, 0), 2)")
    return " + ".join(parts)


@query(f"WITH {LAKE}, {BLOCKS} SELECT q.table_id AS q_table_id, q.set_id AS q_set_id, q.pos AS q_pos, block_id, ROUND({_dtw_bound_sql()}, 6) AS lb FROM lake q, syn s WHERE q.table_id = 0")
def x9_dtw_bounds(spark, sf_dir):
    """DTW lower bounds of all (query, block) pairs."""
    s = blocks.summarise(placed(spark, sf_dir), ENDS)
    return blocks.dtw_block_bounds(uploads(spark, sf_dir), s, ENDS, 5).withColumn("lb", F.round("lb", 6))


@query(f"""WITH {LAKE}, {BLOCKS}, {QUERY_STATS}, {_BOUNDS}, q AS (SELECT block_id, {' + '.join(f'{n} * (POW(mx{i} - mn{i}, 2) + POW(sx{i}, 2))' for i, (_, n) in enumerate(segments.bounds(ENDS)))} AS quality FROM syn)
SELECT {_KEY}, block_id, ROUND(lb, 5) AS lb, ROUND(quality, 5) AS quality FROM bounds JOIN q USING (block_id)""")
def t13_block_dump(spark, sf_dir):
    s = blocks.summarise(placed(spark, sf_dir), ENDS)
    b = blocks.block_bounds(uploads(spark, sf_dir), s, ENDS)
    q = s.select("block_id", segments.quality(F.col("syn"), ENDS).alias("quality"))
    return b.join(q, "block_id").select(*knn.QUERY_KEY, "block_id", F.round("lb", 5).alias("lb"), F.round("quality", 5).alias("quality"))


@query(f"""WITH {LAKE}, {BLOCKS}, {QUERY_STATS}, {_BOUNDS}, {_PLACED_PAIRS}, first AS (SELECT {_KEY}, block_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY lb, block_id) AS r FROM bounds) WHERE r = 1),
e AS (SELECT pairs.*, ROW_NUMBER() OVER (PARTITION BY {_KEY} ORDER BY d, table_id, set_id, pos) AS rank FROM pairs JOIN first USING ({_KEY}, block_id))
SELECT {_MATCH}, ROUND(d, 6) AS d, CAST(rank AS INT) AS rank FROM e WHERE rank = 1""")
def t1_nearest_in_best_block(spark, sf_dir):
    return _rounded(blocks.pruned_knn(uploads(spark, sf_dir), placed(spark, sf_dir), ENDS, 1, nprobes=1))
