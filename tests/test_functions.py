import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colsift.functions import distance, segments, text


def _one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("x")).first().x


def test_distances(spark):
    a, b = [1.0, 2.0, 2.0], [0.0, 2.0, 4.0]
    c = {"a": a, "b": b}
    assert _one(spark, distance.squared_euclidean(F.col("a"), F.col("b")), **c) == 5.0
    assert _one(spark, distance.norm(F.col("a")), **c) == 3.0
    assert _one(spark, distance.cosine_distance(F.col("a"), F.col("b")), **c) == pytest.approx(1 - 12 / (3 * 20**0.5))
    assert _one(spark, distance.l2_normalise(F.col("a")), **c) == pytest.approx([1 / 3, 2 / 3, 2 / 3])
    assert _one(spark, distance.l2_normalise(F.col("z")), z=[0.0, 0.0]) == [0.0, 0.0]
    assert _one(spark, distance.cosine_distance(F.col("z"), F.col("a")), z=[0.0, 0.0, 0.0], a=a) is None


def test_usable(spark):
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,), ([1.0, float("nan")],), ([1.0, None],)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert [r.x for r in df.select(distance.usable(F.col("v"), 2).alias("x")).collect()] == [True, False, False, False, False, False]


def _dtw(a, b, w):
    n = len(a)
    m = np.full((n + 1, n + 1), np.inf)
    m[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(n, i + w) + 1):
            m[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(m[i - 1, j], m[i, j - 1], m[i - 1, j - 1])
    return m[n, n]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 9999), st.integers(0, 6))
def test_dtw_recurrence(seed, w):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, 3, 8))
    assert distance.dtw_matrix(a, b, w) == pytest.approx([_dtw(x, y, w) for x, y in zip(a, b)])
    if w == 0:
        assert distance.dtw_matrix(a, b, 0) == pytest.approx(((a - b) ** 2).sum(1))


def test_bounds_hold(spark):
    rng = np.random.default_rng(1)
    ends = segments.even_ends(10, 3)
    assert ends == [3, 6, 10] and segments.halve([2, 3]) == [1, 2, 3]
    v = [(i % 4, [float(x) for x in rng.normal(size=10)]) for i in range(60)]
    df = spark.createDataFrame(v, "block_id int, v array<double>").withColumn("stats", segments.stats(F.col("v"), ends))
    syn = df.groupBy("block_id").agg(segments.synopsis("stats", ends).alias("syn"))
    both = df.select(F.col("v").alias("q"), F.col("stats").alias("qs")).limit(20).crossJoin(df.join(syn, "block_id"))
    env = distance.envelope(F.col("q"), 2)
    rows = both.select(
        distance.squared_euclidean(F.col("q"), F.col("v")).alias("d"), segments.lower_bound(F.col("qs"), F.col("syn"), ends).alias("lb"), segments.upper_bound(F.col("qs"), F.col("syn"), ends).alias("ub"),
        distance.dtw(0.2)(F.col("q"), F.col("v")).alias("w"), segments.dtw_lower_bound(env, F.col("syn"), ends).alias("wlb"),
    ).collect()
    assert all(r.lb <= r.d + 1e-9 and r.d <= r.ub + 1e-9 and r.wlb <= r.w + 1e-9 and r.w <= r.d + 1e-9 for r in rows)
    halves = syn.groupBy().agg(segments.merge_synopses("syn", ends).alias("m")).first().m
    whole = df.groupBy().agg(segments.synopsis("stats", ends).alias("m")).first().m
    assert halves == whole


def test_envelope(spark):
    env = _one(spark, distance.envelope(F.col("a"), 1), a=[3.0, 1.0, 2.0, 5.0])
    assert [(e.low, e.high) for e in env] == [(1.0, 3.0), (1.0, 3.0), (1.0, 5.0), (2.0, 5.0)]


def test_cells(spark):
    cells = ["abc", "", None, "nan", "12", "-12", "1.5", "²", "-x", "Öl & Gas", "٣٤", " "]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r.c for r in df.where(text.keeps_cell(F.col("c"))).collect()}
    assert got == {"abc", "1.5", "-x", "Öl & Gas", " "}
    assert [r.x for r in df.where("c in ('1.5', 'Öl & Gas')").select(text.normalise(F.col("c")).alias("x")).collect()] == ["1 5", "öl gas"]


def test_names(spark):
    name = text.file_name(7, 3, 2, 50)
    df = spark.createDataFrame([(name,), ("other.bin",), (None,)], "n string")
    assert [tuple(r) for r in df.select(*text.parse_file_name(F.col("n"))).collect()] == [(7, 3, 2, 50), (None,) * 4, (None,) * 4]
    ups = spark.createDataFrame([("t12.csv",), ("x.csv",)], "n string").select(text.upload_table_id(F.col("n")).alias("i")).collect()
    assert [r.i for r in ups] == [12, 0]


@pytest.mark.parametrize("window", [0, 1, 5, 20])
@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_sifted_warping_pairs_are_whole(n, window):
    """All pairs within the limit, and none that is clearly beyond."""
    x = np.random.default_rng(1).normal(size=(300, n)).astype(np.float32).astype(float)
    d = distance.dtw_matrix(np.repeat(x[7:8], 300, 0), x, window)
    for limit in (0.0, np.percentile(d, 5), np.median(d), np.inf):
        got = set(distance.dtw_close(x[7], np.ascontiguousarray(x.T, np.float32), window, limit))
        assert set(np.flatnonzero(d <= limit)) <= got <= set(np.flatnonzero(d <= limit * 1.001 + 1e-4))
