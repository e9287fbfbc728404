import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colsift.llm import neighbours, setjoin, topn
from colsift.runtime import shared_path

# ---- top N


def _top(rows, n):
    best = {}
    for g, d, *ties in rows:
        if g is None or d is None or d != d or any(t is None for t in ties):
            continue
        key = (g, *ties)
        best[key] = min(d, best.get(key, d))
    groups = {}
    for (g, *ties), d in best.items():
        groups.setdefault(g, []).append((d, *ties))
    return {(g, *x) for g, xs in groups.items() for x in sorted(xs)[:n]}


@pytest.mark.parametrize("layer", [16, 1])
def test_top_n_against_brute_force(spark, layer, monkeypatch):
    monkeypatch.setattr(topn, "LAYER", layer)
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randint(0, 40)}", rng.choice([0.5, 1.0, rng.random()]), rng.randint(0, 300), rng.randint(0, 3)) for _ in range(4000)]
    rows += rows[:50] + [(None, 1.0, 1, 1), ("g1", None, 1, 1), ("g1", float("nan"), 1, 1), ("g1", 0.1, None, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, d double, a int, b int, rank_ string")
    path = shared_path(spark, "test-topn")
    got = {(r.g, r.d, r.a, r.b) for r in topn.top_n_per_group(df, 7, "g", "d", ["a", "b"], path).collect()}
    assert got == _top(rows, 7)
    # The layout that was kept answers other N as well.
    schema = df.select("g", "d", "a", "b").schema
    for n in (1, 30, 5000):
        assert {tuple(r) for r in topn.top_n_clustered(spark, path, n, "g", "d", ["a", "b"], schema).collect()} == _top(rows, n)


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "g string, d double, a int")
    assert topn.top_n_per_group(df, 3, "g", "d", ["a"]).count() == 0


def test_skipping_reads_less_and_finds_the_same(spark):
    """600 groups of 1 to 200 rows with many ties and a hot one of a third of all rows: a third of the rows are read at most."""
    many = spark.range(60_000).select(F.concat(F.lit("g"), F.floor(F.sqrt(F.col("id") * 6)).cast("string")).alias("g"), (F.xxhash64("id") % 50).cast("double").alias("d"), F.col("id").alias("a"))
    df = many.unionByName(spark.range(30_000).select(F.lit("hot").alias("g"), (F.col("id") % 977).cast("double").alias("d"), F.col("id").alias("a")))
    path = shared_path(spark, "test-topn")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        topn.cluster_by_group(df, "g", "d", ["a"], path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = topn.files_to_read(spark.read.parquet(f"{path}/zones"), 10, "g").agg(F.sum("rows")).first()[0]
    assert read <= df.count() / 3
    run = lambda skip: {tuple(r) for r in topn.top_n_clustered(spark, path, 10, "g", "d", ["a"], df.schema, skip).collect()}
    assert run(True) == run(False) and len(run(True)) > 5000
    files = [f for f in spark.read.parquet(f"{path}/rows").where("g = 'hot'").select("part__").distinct().collect()]
    assert len(files) > 1, "a hot group is cut over parts"


def test_matches_are_parsed(spark):
    rows = [(" 1:0 ", "2:0", 0, 0, " 1.5"), ("1:0", "10:0", 0, 0, "1.50"), ("1:0", "3:0", 0, 0, "-nan"), ("1:0", "3:1", 0, 0, "-1"), ("1:0", "3:2", 0, 0, "inf"), ("1:0", "3:3", 0, 0, "2e-3"), ("", "3:3", 0, 0, "1"), (None, "3:3", 0, 0, "1"), ("1:0", None, 0, 0, "1")]
    df = spark.createDataFrame(rows, "tq_q string, ts_s string, q_pos int, s_pos int, d string")
    got = sorted((r.d, r.ts_s) for r in topn.nearest_matches(df, 10).collect())
    assert got == [(0.002, "3:3"), (1.5, "10:0"), (1.5, "2:0")]


# ---- nearest vectors


def _pairs(x, ids, k, most):
    out = set()
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        near = sorted((d[j], ids[j]) for j in range(len(x)) if j != i and d[j] <= most)[:k]
        out |= {(min(ids[i], j), max(ids[i], j)) for _, j in near}
    return out


def _vectors(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r], "x") for i, r in zip(ids, x)], "vec_id long, vec_values array<float>, cell string")


def _clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 4, dim))
    x = np.repeat(centre, 4, axis=0) + rng.normal(scale=0.05, size=(n // 4 * 4, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x.astype(np.float32)


def test_close_pairs_are_exact_with_all_cells_probed(spark):
    x = _clustered(400, 8, 1)
    x[10:40] = x[10]  # a group of copies
    ids = list(range(1000, 1000 + len(x)))
    random.Random(1).shuffle(ids)
    got = {tuple(r) for r in neighbours.close_pairs(_vectors(spark, ids, x), 3, 0.2, 8, n_cells=4, margin=float("inf")).collect()}
    assert got == _pairs(x.astype(float), ids, 3, 0.2)


def test_close_pairs_recall_with_few_probes(spark):
    x = _clustered(2000, 16, 2)
    ids = list(range(len(x)))
    got = {tuple(r) for r in neighbours.close_pairs(_vectors(spark, ids, x), 5, 0.2, 16, n_cells=20).collect()}
    want = _pairs(x.astype(float), ids, 5, 0.2)
    assert len(got & want) / len(want) >= 0.95 and got <= want


@pytest.mark.parametrize("n_cells", [8, 60])
def test_recall_without_a_radius(spark, n_cells):
    """Vectors without any structure: as many cells are probed as the recall needs."""
    x = np.random.default_rng(5).normal(size=(1500, 12)).astype(np.float32)
    df = _vectors(spark, range(len(x)), x)
    got = {(r.vec_id, r.near_id) for r in neighbours.nearest_vectors(df, 5, dim=12, n_cells=n_cells).collect()}
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:5]}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.94


def test_tiles_of_a_large_cell_find_the_same(spark, monkeypatch):
    x = _clustered(600, 8, 3)
    ids = list(range(len(x)))
    monkeypatch.setattr(neighbours, "TILE_HOME", 40)
    monkeypatch.setattr(neighbours, "TILE_PROBE", 70)
    got = {tuple(r) for r in neighbours.close_pairs(_vectors(spark, ids, x), 3, 0.3, 8, n_cells=7, margin=float("inf")).collect()}
    assert got == _pairs(x.astype(float), ids, 3, 0.3)


def test_unusable_and_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None), (7, [1.0, None]), (None, [1.0, 0.0]), (8, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, vec_values array<float>")
    assert {tuple(r) for r in neighbours.close_pairs(df, 5, 0.2, 2).collect()} == {(1, 2)}
    assert neighbours.close_pairs(df.limit(0), 5, 0.2, 2).count() == 0
    ranked = neighbours.nearest_vectors(df, 2, dim=2).orderBy("vec_id", "rank").collect()
    assert [(r.vec_id, r.near_id, round(r.distance, 6)) for r in ranked] == [(1, 2, 0.0), (1, 8, 41.0), (2, 1, 0.0), (2, 8, 41.0), (8, 1, 41.0), (8, 2, 41.0)]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_quantisation_bound_holds(seed):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(60, 12)) * rng.uniform(0.01, 10)).astype(np.float32)
    codes, meta = neighbours.encode_int8(x)
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(-1)
    radius = float(np.quantile(d, 0.2))
    i, j, *_ = neighbours.tile_survivors(codes, meta, codes, meta, radius, 60)
    assert {(a, b) for a, b in zip(*np.nonzero(d <= radius))} <= set(zip(i, j))


# ---- set join


def _similar(sets, t, least):
    return {(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= least and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def _found(spark, sets, t, least):
    rows = [([[*v]], i) for i, v in sets.items()]
    df = spark.createDataFrame(rows, "relation array<array<string>>, table_id int")
    return {(r.table_id_a, r.table_id_b, r.overlap_size) for r in setjoin.column_pairs(df, t, least).collect()}


@pytest.mark.parametrize("t", [0.5, 0.6, 0.8])
def test_pairs_against_brute_force(spark, t):
    rng = random.Random(4)
    sets = {}
    for i in range(260):
        if i % 3 and sets:
            base = list(sets[rng.choice(list(sets))])
            keep = [v for v in base if rng.random() < 0.9] + [f"n{rng.randint(0, 80)}" for _ in range(rng.randint(0, 4))]
        else:
            keep = [f"v{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 9, 12, 16, 17, 20, 45]))] + rng.sample(["-", "x", "?", "n/a"], 2)
        sets[i] = set(keep)
    assert _found(spark, sets, t, 4) == _similar(sets, t, 4)


def test_copies_small_sets_and_hot_tokens(spark):
    base = {f"c{i}" for i in range(9)}
    sets = {i: base for i in range(6)} | {10 + i: {f"f{j}" for j in range(8)} | {f"own{i}-{j}" for j in range(8)} for i in range(40)} | {90: {"a"}, 91: {"a"}}
    assert _found(spark, sets, 0.6, 8) == _similar(sets, 0.6, 8)


def test_columns_with_nulls_and_repeats(spark):
    cells = [f"v{i}" for i in range(8)]
    rows = [(1, [cells, [*cells, None, "", "v0"], None, []]), (1, [cells, [*cells, None, "", "v0"], None, []]), (2, None), (None, [cells]), (3, [cells[:7]])]
    df = spark.createDataFrame(rows, "table_id int, relation array<array<string>>")
    assert [tuple(r) for r in setjoin.column_pairs(df).collect()] == [(1, 0, 1, 1, 8)]
    assert setjoin.column_pairs(df.limit(0)).count() == 0
