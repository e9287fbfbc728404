import numpy as np
import pytest
from pyspark.sql import functions as F

from colsift.functions import distance
from colsift.operators import blocks, discover, evaluate, knn, progressive, rank, warping

DIM, ENDS = 6, [2, 4, 6]


@pytest.fixture(scope="module")
def lake(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t in range(1, 9):
        for s in range(2):
            centre = rng.normal(size=DIM) * 3
            for p in range(12):
                v = centre + rng.normal(size=DIM) * 0.3 if p else np.ones(DIM)
                rows.append((t, s, p, [float(np.float32(x)) for x in v]))
    return spark.createDataFrame(rows, "table_id int, set_id int, pos int, v array<float>").cache()


def _brute(rows, k, exclude):
    out = set()
    x = np.array([r.v for r in rows])
    for q in rows:
        d = ((x - np.array(q.v)) ** 2).sum(1)
        near = [(d[i], r.table_id, r.set_id, r.pos) for i, r in enumerate(rows) if exclude == "none" or r.table_id != q.table_id or (exclude == "column" and r.set_id != q.set_id)]
        out |= {(q.table_id, q.set_id, q.pos, *m[1:], i + 1) for i, m in enumerate(sorted(near)[:k])}
    return out


def _keys(df):
    return {(r.q_table_id, r.q_set_id, r.q_pos, r.table_id, r.set_id, r.pos, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("exclude", ["table", "column", "none"])
def test_knn_with_ties_against_brute_force(spark, lake, exclude):
    rows = lake.collect()
    assert _keys(knn.knn_join(knn.as_queries(lake), lake, 4, exclude)) == _brute(rows, 4, exclude)


def test_knn_in_several_query_blocks(lake, monkeypatch):
    monkeypatch.setattr(knn, "TILE_QUERIES", 50)
    monkeypatch.setattr(knn, "TILE_VECTORS", 70)
    assert _keys(knn.knn_join(knn.as_queries(lake), lake, 3)) == _brute(lake.collect(), 3, "table")


def test_knn_edges(lake):
    q = knn.as_queries(lake)
    assert knn.knn_join(q.limit(0), lake, 3).count() == 0
    assert knn.knn_join(q, lake.limit(0), 3).count() == 0
    few = lake.where("table_id = 1 or (table_id = 2 and pos < 2)")
    assert knn.knn_join(knn.as_queries(few.where("table_id = 1")), few, 10).groupBy("q_set_id", "q_pos").count().where("count <> 4").count() == 0
    with pytest.raises(ValueError):
        knn.not_own("row")


def test_exact_join_and_ranking(lake):
    found = knn.exact_join(knn.as_queries(lake.where("table_id = 1")), lake)
    assert found.count() == 2 * 7 * 2, "the vector of ones in every column of the other tables"
    top = rank.top_columns(found, 3).collect()
    assert [(r.table_id, r.set_id, r.overlap, r.covered) for r in top] == [(2, 0, 1, 2), (2, 1, 1, 2), (3, 0, 1, 2)]
    tables = rank.top_tables(found, 100).collect()
    assert [(r.table_id, r.num_closest, r.total_matches) for r in tables] == [(t, 4, 4) for t in range(2, 9)]


def test_slices_nest(lake):
    runs = knn.slices(knn.knn_join(knn.as_queries(lake.where("table_id = 1")), lake, 5), [1, 3, 5])
    assert {r.k: r["count"] for r in runs.groupBy("k").count().collect()} == {1: 24, 3: 72, 5: 120}


@pytest.fixture(scope="module")
def placed(lake):
    return blocks.build_blocks(lake, ENDS, capacity=20).cache()


def test_blocks_are_bounded_and_whole(lake, placed):
    sizes = {r.block_id: r.n for r in blocks.summarise(placed, ENDS).collect()}
    assert sum(sizes.values()) == lake.count() and max(sizes.values()) <= 20 and len(sizes) > 5


def test_equal_vectors_cannot_be_split(spark):
    same = spark.createDataFrame([(1, 0, p, [1.0] * 6) for p in range(30)], "table_id int, set_id int, pos int, v array<float>")
    assert blocks.build_blocks(same, ENDS, capacity=5).select("block_id").distinct().count() == 1


@pytest.mark.parametrize("policy", ["lb", "ub"])
def test_pruned_equals_exhaustive(lake, placed, policy):
    q = knn.as_queries(lake.where("table_id <= 3"))
    assert _keys(blocks.pruned_knn(q, placed, ENDS, 4, policy=policy)) == _keys(knn.knn_join(q, lake, 4))


def test_blocks_are_skipped(lake, placed):
    q = knn.as_queries(lake.where("table_id = 1 and pos > 0"))
    bounds = blocks.block_bounds(q, blocks.summarise(placed, ENDS), ENDS)
    cost = blocks.query_cost(blocks.surviving(bounds, blocks.seed_bounds(bounds, q, placed, 4, "none")))
    assert cost.agg(F.avg("pruning")).first()[0] > 0.5


def test_epsilon_and_probes(lake, placed):
    q = knn.as_queries(lake.where("table_id = 2"))
    true = {(r.q_set_id, r.q_pos, r["rank"]): r.d for r in knn.knn_join(q, lake, 4).collect()}
    near = blocks.pruned_knn(q, placed, ENDS, 4, epsilon=0.5).collect()
    assert len(near) == len(true) and all(r.d <= 1.5 * true[r.q_set_id, r.q_pos, r["rank"]] + 1e-9 for r in near)
    found = [len(_keys(blocks.pruned_knn(q, placed, ENDS, 4, nprobes=n)) & _keys(knn.knn_join(q, lake, 4))) for n in (1, 4, 100)]
    assert found == sorted(found) and found[-1] == len(true)


def test_progress_is_monotone_and_ends_exact(lake, placed):
    q = knn.as_queries(lake.where("table_id = 1"))
    sure, last = {}, None
    for rows in progressive.progressive_knn(q, placed, ENDS, 3):
        last = rows.collect()
        for r in last:
            key = (r.q_set_id, r.q_pos, r["rank"])
            assert sure.get(key, (r.table_id, r.set_id, r.pos)) == (r.table_id, r.set_id, r.pos), "a confirmed rank changed"
            if r.confirmed:
                sure[key] = (r.table_id, r.set_id, r.pos)
    assert all(r.confirmed for r in last)
    assert {(r.q_table_id, r.q_set_id, r.q_pos, r.table_id, r.set_id, r.pos, r["rank"]) for r in last} == _keys(knn.knn_join(q, lake, 3))


def test_evaluation(spark):
    cols = "q_table_id int, q_set_id int, q_pos int, table_id int, set_id int, pos int, rank int, d double"
    truth = spark.createDataFrame([(0, 0, 0, 1, 0, i, i + 1, float(i)) for i in range(4)], cols)
    runs = spark.createDataFrame([(0, 0, 0, 1, 0, 0, 1, 0.0), (0, 0, 0, 1, 0, 9, 2, 1.0), (0, 0, 0, 1, 0, 0, 1, 0.0)], cols)
    assert tuple(evaluate.recall(runs, truth).first()) == (1, 4, 0.25)
    assert tuple(evaluate.precision(runs, truth, 2).first()) == (1, 2, 0.5)
    assert tuple(evaluate.recall_on_distance(runs.distinct(), truth).first()) == (2, 4, 0.5)
    assert evaluate.recall(runs, truth.limit(0)).first().recall is None


def test_discovery_end_to_end(spark):
    cells = [(1, 0, p, c) for p, c in enumerate(["red lion", "Blue Bird", "12", None, "green fox"])] + [(2, 0, p, c) for p, c in enumerate(["blue-bird", "red lion", "black cat"])] + [(3, 0, 0, "42")]
    df = spark.createDataFrame(cells, "table_id int, set_id int, pos int, cell string")
    tokens = discover.clean_cells(df, ["table_id", "set_id"])
    assert {(r.table_id, r.token) for r in tokens.collect()} == {(1, "red lion"), (1, "blue bird"), (1, "green fox"), (2, "blue bird"), (2, "red lion"), (2, "black cat")}
    embed = discover.hash_embedder(["table_id", "set_id"], 8)
    corpus = embed(tokens)
    asked = spark.createDataFrame([(0, "Red Lion"), (0, "blue bird"), (0, "7")], "q_table_id int, cell string")
    best = discover.discover_by_column(asked, corpus, embed, 2, 2, exact=True).collect()
    assert [(r.table_id, r.overlap) for r in best] == [(1, 2), (2, 2)]
    near = discover.discover_by_keywords(spark.createDataFrame([(0, "Black-Cat")], "q_table_id int, cell string"), corpus, embed, 1, 1).first()
    assert near.table_id == 2
    with pytest.raises(ValueError):
        discover.discover_by_column(spark.createDataFrame([(0, "7")], "q_table_id int, cell string"), corpus, embed, 2, 2)


def test_unknown_words_are_left_out(spark):
    tokens = spark.createDataFrame([(1, 0, 0, "known odd"), (1, 0, 1, "odd")], "table_id int, set_id int, pos int, token string")
    lex = spark.createDataFrame([("known", [3.0, 4.0]), ("broken", [float("nan"), 1.0])], "word string, vec array<double>")
    got = discover.embed_cells(tokens, lex, ["table_id", "set_id"], 2).collect()
    assert [(r.pos, r.v) for r in got] == [(0, [0.6, 0.8])]


@pytest.mark.parametrize("block", [7, 1_000])
def test_dtw_nearest_over_all_tables(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "TILE_QUERIES", block)
    monkeypatch.setattr(knn, "TILE_VECTORS", block * 4)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 20)).astype(np.float32)
    x[40], x[90] = x[10], x[10]
    x[20:30] += np.roll(x[30:40], 1, axis=1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, v array<float>").repartition(3)
    q = df.where("vec_id % 5 = 0").select(F.col("vec_id").alias("q_vec_id"), F.col("v").alias("q_v"))
    want = {}
    for i in range(0, 150, 5):
        d = distance.dtw_matrix(np.repeat(x[i : i + 1], 150, 0).astype(float), x.astype(float), 2)
        d[i] = np.inf
        want[i] = (int(np.argmin(d)), pytest.approx(d.min()))
    assert {r.q_vec_id: (r.vec_id, r.d) for r in warping.dtw_nearest(q, df, 0.1).collect()} == want
    assert warping.dtw_nearest(q.limit(0), df).count() == 0


def test_x3_answers_a_query_alone_in_its_table(spark, tmp_path):
    from colsift.plans import index

    rows = [(0, 1, 0, 0, [1.0] * 49 + [0.5]), (1, 2, 0, 0, [1.0] * 50), (2, 2, 0, 1, [3.0] * 50), (20, 2, 0, 2, [3.0] * 49 + [3.5])]
    spark.createDataFrame(rows, "vec_id long, table_id int, set_id int, pos int, vec_values array<float>").write.parquet(f"{tmp_path}/cell_vectors.parquet")
    assert {(r.q_vec_id, r.vec_id) for r in index.x3_dtw_nearest(spark, str(tmp_path)).collect()} == {(0, 1), (20, 2)}


def test_blocks_split_until_none_is_too_large(spark):
    """Outliers that double take one level each; vectors that are equal stay together."""
    rows = [(1, 0, i, [2.0**i] * DIM) for i in range(16)] + [(2, 0, i, [0.5] * DIM) for i in range(5)]
    built = blocks.build_blocks(spark.createDataFrame(rows, "table_id int, set_id int, pos int, v array<double>"), ENDS, 3)
    sizes = built.groupBy("block_id").agg(F.count("*").alias("n"), F.count_distinct("v").alias("kinds")).collect()
    assert sum(r.n for r in sizes) == 21
    assert all(r.n <= 3 or r.kinds == 1 for r in sizes)


@pytest.mark.parametrize("tile", [40, 1_000])
def test_nearest_within_limits_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(knn, "TILE_LIMITED", tile)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, DIM)).astype(np.float32)
    x[60:90] = x[:30] + rng.normal(size=(30, DIM)).astype(np.float32) * 0.01
    x[90:110] = x[5]
    rows = [(i, i % 7, 0, i, [float(y) for y in v]) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows + rows[::3], "vec_id long, table_id int, set_id int, pos int, v array<float>")
    limits = {i: [0.0, 0.01, 4.0, 1e300, float("inf")][i % 5] for i in range(0, 120, 2)}
    queries = spark.createDataFrame([(i, i % 7, rows[i][4], y) for i, y in limits.items()], "q_vec_id long, q_table_id int, q_v array<float>, limit double")
    want = set()
    for i, y in limits.items():
        d = ((x[i].astype(float) - x.astype(float)) ** 2).sum(1)
        near = sorted((d[j], j % 7, 0, j) for j in range(120) if j % 7 != i % 7 and d[j] <= y)[:4]
        want |= {(i, m[3], r + 1) for r, m in enumerate(near)}
    assert {(r.q_vec_id, r.vec_id, r["rank"]) for r in knn.nearest_within(queries, vectors, 4).collect()} == want
    assert knn.nearest_within(queries.limit(0), vectors, 4).count() == knn.nearest_within(queries, vectors.limit(0), 4).count() == 0


@pytest.fixture(scope="module")
def logged(spark, tmp_path_factory):
    """A log of far vectors with three near ones, one at the distance of another vector, and a query that is no vector."""
    at = tmp_path_factory.mktemp("logged")
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 50)).astype(np.float32)
    x[100:103] = x[:3] + np.float32(0.01)
    rows = [(i, i % 9, 0, i, [float(y) for y in v]) for i, v in enumerate(x)]
    spark.createDataFrame(rows + rows[:20], "vec_id long, table_id int, set_id int, pos int, vec_values array<float>").write.parquet(f"{at}/cell_vectors.parquet")
    d = lambda i, j: float(((x[i].astype(float) - x[j].astype(float)) ** 2).sum())
    far = [(i, int(np.argsort([d(i, j) for j in range(300)])[200]), 250.0) for i in range(20, 80)]
    log = [(i, 100 + i, d(i, 100 + i)) for i in range(3)] + [(3, 4, d(3, 4)), (999, 5, 0.5), (5, 888, 0.1)] + far
    spark.createDataFrame(log + log[:2], "q_vec_id long, vec_id long, distance double").write.parquet(f"{at}/query_results.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["a4_precision", "j7_recall_hits", "a3_recall", "j8_recall_on_distance"])
def test_log_is_held_against_what_it_can_match(spark, monkeypatch, logged, name):
    """The answer is the SQL's, and queries whose logged vectors are surely beaten are not searched."""
    duckdb = pytest.importorskip("duckdb")
    from colsift.plans import search

    asked, run = [], knn.nearest_within
    monkeypatch.setattr(knn, "nearest_within", lambda queries, *rest: asked.append(queries.count()) or run(queries, *rest))
    found = search.QUERIES[name](spark, logged)
    con = duckdb.connect()
    for t in ("cell_vectors", "query_results"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{logged}/{t}.parquet/*.parquet'")
    want = con.sql(search.SQL[name])
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())
    assert len(asked) == 1 and 3 <= asked[0] <= 6


def test_blocks_split_in_one_task_as_by_levels(lake, monkeypatch):
    """Blocks that fit a task take no levels, and are the same sets of vectors."""
    found, written, save = [], [], blocks.shared_path
    monkeypatch.setattr(blocks, "shared_path", lambda *of: written.append(of) or save(*of))
    for rows in (5, 20_000):
        monkeypatch.setattr(blocks, "LOCAL_ROWS", rows)
        written.clear()
        members = blocks.build_blocks(lake, ENDS, capacity=5).groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("table_id", "set_id", "pos"))).alias("m"))
        found.append({tuple(map(tuple, r.m)) for r in members.collect()})
    assert found[0] == found[1] and len(written) == 2


def test_pruned_search_makes_no_row_of_a_query_and_block(lake, placed, monkeypatch):
    q = knn.as_queries(lake.where("table_id <= 3"))
    sizes, search = [], blocks.search_blocks
    monkeypatch.setattr(blocks, "search_blocks", lambda queries, chosen, *rest: sizes.append(chosen.count()) or search(queries, chosen, *rest))
    assert _keys(blocks.pruned_knn(q, placed, ENDS, 4)) == _keys(knn.knn_join(q, lake, 4))
    assert sizes == [q.count()]


@pytest.mark.parametrize("tile", [None, 5])
def test_overlaps_without_a_row_of_a_pair(spark, monkeypatch, tmp_path, tile):
    """Shared tokens are counted in tiles of any size; no join lists the pairs."""
    from colsift.plans import text

    if tile:
        for name in ("TILE_ASKED", "TILE_WORDS", "TILE_PAIRS"):
            monkeypatch.setattr(discover, name, tile)
    rng = np.random.default_rng(4)
    lake = [(t, [[f"w{w}" + "-X" * (w % 2) for w in rng.integers(0, 40, 9)] + [None, "", "12"] for _ in range(1 + t % 3)] + [None]) for t in range(0, 90, 2)]
    spark.createDataFrame([*lake, *lake[:5], (100, None), (None, [["a y"]])], "table_id int, relation array<array<string>>").write.parquet(f"{tmp_path}/raw_tables.parquet")
    found = text.w5_token_overlaps(spark, str(tmp_path))
    held = {(t, s): set() for t, relation in lake for s, c in enumerate(relation) if c}
    for r in text.tokens(spark, str(tmp_path)).collect():
        held[r.table_id, r.set_id].add(r.token)
    want = {(*q, *c, len(a & b)) for q, a in held.items() for c, b in held.items() if q[0] % 20 == 0 and q[0] != c[0] and a & b}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) > 500
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_of_no_asked_column(spark):
    tokens = spark.createDataFrame([(1, 0, "a"), (2, 0, "a")], "table_id int, set_id int, token string")
    assert discover.token_overlaps(tokens, "table_id % 20 = 0").count() == 0
