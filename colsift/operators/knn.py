"""Nearest corpus vectors for every query vector, and exact matches.

Canonical columns: corpus (table_id, set_id, pos, v), queries (q_table_id, q_set_id, q_pos,
q_v), matches (q_table_id, q_set_id, q_pos, table_id, set_id, pos, d, rank). Distances are
squared Euclidean; ties are settled by (table_id, set_id, pos).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsift.runtime import ship

QUERY_KEY = ["q_table_id", "q_set_id", "q_pos"]
ORDER = ["d", "table_id", "set_id", "pos"]
#: Queries and vectors of one tile: 8 bytes x dim x as many are held at once.
TILE_QUERIES, TILE_VECTORS = 2_048, 16_384
#: Queries, and vectors, of one tile of a search within limits, which holds them as stored.
TILE_LIMITED = 131_072
#: Vectors that tell which limits can't hold a nearest neighbour.
PROBES = 2_048


def as_queries(vectors: DataFrame) -> DataFrame:
    """Corpus rows in the role of queries."""
    return vectors.select(F.col("table_id").alias("q_table_id"), F.col("set_id").alias("q_set_id"), F.col("pos").alias("q_pos"), F.col("v").alias("q_v"))


def not_own(exclude: str) -> Column:
    """Join predicate of an exclusion policy: own 'table', own 'column' or 'none'."""
    if exclude == "table":
        return F.col("table_id") != F.col("q_table_id")
    if exclude == "column":
        return (F.col("table_id") != F.col("q_table_id")) | (F.col("set_id") != F.col("q_set_id"))
    if exclude == "none":
        return F.lit(True)
    raise ValueError(f"unknown exclusion policy {exclude!r}")


def rank_matches(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query vector with their rank."""
    by_query = Window.partitionBy(*QUERY_KEY).orderBy(*ORDER)
    return pairs.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def nearest_rows(q: np.ndarray, q_ids: tuple, x: np.ndarray, ids: tuple, k: int, exclude: str) -> pd.DataFrame:
    """(q, d, table_id, set_id, pos): at least the ``k`` nearest rows of ``x`` for every row of ``q``.

    One matrix product a slice of queries picks the candidates; the product loses digits to
    cancellation, so whatever may tie is kept and scored exactly in float64. ``q_ids`` and
    ``ids`` are (table, set, pos) arrays.
    """
    (qt, qs, _), (t, s, p) = q_ids, ids
    xn = (x * x).sum(1)
    found = []
    for a in range(0, len(q), 512):
        part = slice(a, a + 512)
        d = (q[part] * q[part]).sum(1)[:, None] + xn[None] - 2 * q[part] @ x.T
        if exclude != "none":
            own = qt[part, None] == t[None]
            if exclude == "column":
                own &= qs[part, None] == s[None]
            d[own] = np.inf
        n = min(k, d.shape[1])
        limit = np.partition(d, n - 1, axis=1)[:, n - 1]
        i, j = np.nonzero((d <= limit[:, None] + 1e-6) & np.isfinite(d))
        found.append(pd.DataFrame({"q": i + a, "d": ((q[i + a] - x[j]) ** 2).sum(1), "table_id": t[j], "set_id": s[j], "pos": p[j]}))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in ("q", *ORDER)})


def best_rows(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["q", *ORDER], kind="stable").groupby("q", sort=False).head(k)


def tiled(queries: DataFrame, vectors: DataFrame, run, schema: str, query_key: list[str] = QUERY_KEY, vector_key: list[str] | None = None, most: tuple[int, int] | None = None) -> DataFrame:
    """``run(queries, vectors)`` of every tile: a stated query set against all vectors, in blocks.

    Both sides are dealt by hash into blocks of bounded size, and every pair of blocks meets in
    one task: no side is collected or sent to all tasks, and no task holds more than a tile.
    """
    spark = queries.sparkSession
    ship(spark)
    vector_key = vector_key or ["table_id", "set_id", "pos"]
    most_queries, most_vectors = most or (TILE_QUERIES, TILE_VECTORS)
    rows = max(1, -(-queries.count() // most_queries))
    cols = max(1, -(-vectors.count() // most_vectors), -(-spark.sparkContext.defaultParallelism // rows))
    block = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", block(query_key, rows).alias("__row"), each(cols).alias("__col"))
    right = vectors.select("*", block(vector_key, cols).alias("__in_col"), each(rows).alias("__in_row"))

    def checked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = run(a, b) if len(a) and len(b) else None
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame({c: [] for c in names}) if found is None else found[names]

    return left.groupBy("__row", "__col").cogroup(right.groupBy("__in_row", "__in_col")).applyInPandas(checked, schema)


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows in float64."""
    return np.stack(vectors.to_numpy()).astype(np.float64)


_PAIR = "q_table_id int, q_set_id int, q_pos int, table_id int, set_id int, pos int, d double"


def _ids(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    return df.select(*(F.col(c).cast("int").alias(c) for c in keys), v)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, exclude: str = "table") -> DataFrame:
    """Exhaustive k nearest neighbours of every query vector.

    Each tile answers with its own top k of every query, and only those are exchanged and
    ranked. A query with fewer than ``k`` candidates after exclusion has fewer rows; without
    queries there are none.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        q_ids, ids = tuple(a[c].to_numpy() for c in QUERY_KEY), tuple(b[c].to_numpy() for c in ("table_id", "set_id", "pos"))
        best = best_rows(nearest_rows(matrix(a["q_v"]), q_ids, matrix(b["v"]), ids, k, exclude), k)
        at = best["q"].to_numpy().astype(int)
        return pd.DataFrame({c: v[at] for c, v in zip(QUERY_KEY, q_ids)} | {c: best[c].to_numpy() for c in ("table_id", "set_id", "pos", "d")})

    return rank_matches(tiled(_ids(queries, QUERY_KEY, "q_v"), _ids(corpus, ["table_id", "set_id", "pos"], "v"), run, _PAIR), k)


def _own(a: pd.DataFrame, b: pd.DataFrame, exclude: str) -> np.ndarray:
    """Which pairs of a tile the exclusion policy leaves out."""
    own = np.zeros((len(a), len(b)), bool)
    if exclude != "none":
        own = a["q_table_id"].to_numpy()[:, None] == b["table_id"].to_numpy()[None]
        if exclude == "column":
            own &= a["q_set_id"].to_numpy()[:, None] == b["set_id"].to_numpy()[None]
    return own


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows, up to the digits a product loses."""
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)


def block_distances(queries: DataFrame, placed: DataFrame, exclude: str = "table") -> DataFrame:
    """(query key, block_id, d): the least distance of every query to every block of vectors."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("block_id")
        names, start = np.unique(b["block_id"].to_numpy(), return_index=True)
        q, x = matrix(a["q_v"]), matrix(b["v"])
        d = _distances(q, x)
        d[_own(a, b, exclude)] = np.inf
        out = []
        for name, s, e in zip(names, start, [*start[1:], len(b)]):
            at = d[:, s:e].argmin(1) + s
            kept = np.isfinite(d[np.arange(len(q)), at])
            rows = a.loc[kept, QUERY_KEY].copy()
            rows["block_id"], rows["d"] = name, ((q[kept] - x[at[kept]]) ** 2).sum(1)
            out.append(rows)
        return pd.concat(out)

    vectors = placed.select("block_id", *(F.col(c).cast("int").alias(c) for c in ("table_id", "set_id", "pos")), "v")
    found = tiled(_ids(queries, QUERY_KEY, "q_v"), vectors, run, "q_table_id int, q_set_id int, q_pos int, block_id long, d double")
    return found.groupBy(*QUERY_KEY, "block_id").agg(F.min("d").alias("d"))


def cosine_within(queries: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, near_id, d): pairs of a query (vec_id, q_v) and another vector (near_id, v) within a cosine distance."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        q, x = matrix(a["q_v"]), matrix(b["v"])
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1 - (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None])
        i, j = np.nonzero((d <= threshold) & (a["vec_id"].to_numpy()[:, None] != b["near_id"].to_numpy()[None]))
        return pd.DataFrame({"vec_id": a["vec_id"].to_numpy()[i], "near_id": b["near_id"].to_numpy()[j], "d": d[i, j]})

    return tiled(queries, vectors, run, "vec_id long, near_id long, d double", ["vec_id"], ["near_id"])


def exact_join(queries: DataFrame, corpus: DataFrame, exclude: str = "table") -> DataFrame:
    """All vectors equal to a query vector: a hash equi-join on the array, NaN excluded on both sides."""
    clean = lambda df, c: df.where(~F.exists(c, lambda x: x.isNull() | F.isnan(x)))
    joined = clean(corpus, "v").join(clean(queries, "q_v"), F.col("v") == F.col("q_v")).where(not_own(exclude))
    return joined.select(*QUERY_KEY, "table_id", "set_id", "pos", F.lit(0.0).alias("d"))


def slices(matches: DataFrame, ks: list[int]) -> DataFrame:
    """One run cut at several k: each row once for every k it is within."""
    return matches.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))


def within(queries: DataFrame, corpus: DataFrame, threshold: float, exclude: str = "table") -> DataFrame:
    """All pairs within a squared distance."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        q, x, own = matrix(a["q_v"]), matrix(b["v"]), _own(a, b, exclude)
        out = []
        for s in range(0, len(q), 512):
            i, j = np.nonzero((_distances(q[s : s + 512], x) <= threshold + 1e-6) & ~own[s : s + 512])
            d = ((q[s + i] - x[j]) ** 2).sum(1)
            kept = d <= threshold
            i, j = s + i[kept], j[kept]
            out.append(pd.DataFrame({c: a[c].to_numpy()[i] for c in QUERY_KEY} | {c: b[c].to_numpy()[j] for c in ("table_id", "set_id", "pos")} | {"d": d[kept]}))
        return pd.concat(out)

    return tiled(_ids(queries, QUERY_KEY, "q_v"), _ids(corpus, ["table_id", "set_id", "pos"], "v"), run, _PAIR)


def _values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def promising(rows: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``rows`` (q_table_id, q_v, least, ...) without those for which ``k`` vectors of other tables are closer than ``least``.

    Only some vectors are tried, so a row that stays may have as many; a row that goes surely has.
    """
    ship(rows.sparkSession)
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).select("vec_id", "table_id", "v").toPandas().drop_duplicates("vec_id")
    if len(some) < k:
        return rows
    shared = rows.sparkSession.sparkContext.broadcast((some["table_id"].to_numpy(), matrix(some["v"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, x = shared.value
        xn = (x * x).sum(1)
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            if batch.num_rows:
                tables, least = batch.column("q_table_id").to_numpy(), batch.column("least").to_numpy()
                every = _values(batch.column("q_v"))
                for s in range(0, len(kept), 512):
                    part = slice(s, s + 512)
                    q = every[part].astype(np.float64)
                    qn = (q * q).sum(1)
                    # The product loses digits to cancellation.
                    slack = 1e-12 * (np.sqrt(qn)[:, None] + np.sqrt(xn)[None]) ** 2
                    closer = (qn[:, None] + xn[None] - 2 * q @ x.T + slack < least[part, None]) & (tables[part, None] != t[None])
                    kept[part] = closer.sum(1) < k
            yield batch.filter(pa.array(kept))

    return rows.mapInArrow(run, rows.schema)


def _limited_tile(q: np.ndarray, q_table: np.ndarray, limit: np.ndarray, x: np.ndarray, ids: tuple, k: int) -> pd.DataFrame:
    """(q, d, table_id, set_id, pos, at): the at most ``k`` nearest rows of ``x`` of other tables within each query's limit.

    A float32 product over half of the values, or all where that leaves many, bounds each
    distance from below, with a slack for its rounding; what may be within the limit is scored
    exactly in float64. Limits shrink as a query's nearest rows are found.
    """
    t, s, p = ids
    found, bound = [], limit.astype(np.float64)
    big = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
    kind = np.float32 if big < 1e15 else np.float64
    sides = {}
    for h in (x.shape[1] // 2, x.shape[1]):
        qh, xh = q[:, :h].astype(kind), x[:, :h].astype(kind)
        qn, xn = (qh.astype(np.float64) ** 2).sum(1), (xh.astype(np.float64) ** 2).sum(1)
        sides[h] = np.column_stack([qh, np.ones(len(q), kind)]), np.column_stack([xh, (-xn / 2).astype(kind)]), qn, xn
    by_limit = np.argsort(bound, kind="stable")
    for a in range(0, len(q), 256):
        at, h, held = by_limit[a : a + 256], x.shape[1] // 2, []
        for b in range(0, len(x), 2048):
            while True:
                qa, xa, qn, xn = sides[h]
                slack = (h + 8) * 2.4e-7 * (np.sqrt(qn[at].max()) + np.sqrt(xn[b : b + 2048].max())) ** 2
                floor = ((qn[at] - bound[at] - slack) / 2)[:, None]
                near = np.flatnonzero(qa[at] @ xa[b : b + 2048].T >= np.nextafter(floor.astype(kind), kind(-np.inf)))
                if h == x.shape[1] or len(near) < 2048:
                    break
                h = x.shape[1]
            width = min(2048, len(x) - b)
            for c in range(0, len(near), 65_536):
                i, j = at[near[c : c + 65_536] // width], b + near[c : c + 65_536] % width
                d = ((q[i].astype(np.float64) - x[j]) ** 2).sum(1)
                kept = (d <= bound[i]) & np.isfinite(d) & (q_table[i] != t[j])
                if not kept.any():
                    continue
                i, j = i[kept], j[kept]
                held.append(pd.DataFrame({"q": i, "d": d[kept], "table_id": t[j], "set_id": s[j], "pos": p[j], "at": j}))
                if sum(map(len, held)) > 20_000:
                    held = [best_rows(pd.concat(held), k)]
                    full = held[0].groupby("q")["d"].agg(["size", "max"])
                    full = full[full["size"] >= k]
                    bound[full.index] = np.minimum(bound[full.index], full["max"])
        found += held and [best_rows(pd.concat(held), k)]
    return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("q", *ORDER, "at")})


def nearest_within(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(q_vec_id, vec_id, d, rank): the nearest vectors of other tables, at most ``k`` and none beyond the query's limit.

    ``queries`` has (q_vec_id, q_table_id, q_v, limit), each once, and ``vectors`` (vec_id, table_id, set_id, pos, v),
    where rows of an id may repeat. Both are counted, so they should be stored, not computed.
    """
    spark = queries.sparkSession
    ship(spark)
    rows = max(1, -(-queries.count() // TILE_LIMITED))
    cols = max(1, -(-vectors.count() // TILE_LIMITED), -(-spark.sparkContext.defaultParallelism // rows))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("q_vec_id", "q_table_id", "q_v", "limit", block("q_vec_id", rows).alias("__row"), each(cols).alias("__col"))
    right = vectors.select("vec_id", "table_id", "set_id", "pos", "v", block("vec_id", cols).alias("__in_col"), each(rows).alias("__in_row"))
    schema = "q_vec_id long, vec_id long, table_id int, set_id int, pos int, d double"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = pd.DataFrame({c: [] for c in ("q", *ORDER, "at")})
        if a.num_rows and b.num_rows:
            _, once = np.unique(b.column("vec_id").to_numpy(), return_index=True)
            b = b.take(pa.array(once))
            ids = tuple(b.column(c).to_numpy() for c in ("table_id", "set_id", "pos"))
            found = _limited_tile(_values(a.column("q_v")), a.column("q_table_id").to_numpy(), a.column("limit").to_numpy(), _values(b.column("v")), ids, k)
        of, at = (pa.array(found[c].to_numpy().astype(np.int64)) for c in ("q", "at"))
        kinds = {"table_id": pa.int32(), "set_id": pa.int32(), "pos": pa.int32(), "d": pa.float64()}
        return pa.table({"q_vec_id": a.column("q_vec_id").take(of), "vec_id": b.column("vec_id").take(at)} | {c: pa.array(found[c].to_numpy(), kind) for c, kind in kinds.items()})

    met = left.groupBy("__row", "__col").cogroup(right.groupBy("__in_row", "__in_col")).applyInArrow(run, schema)
    by_query = Window.partitionBy("q_vec_id").orderBy(*ORDER)
    return met.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("q_vec_id", "vec_id", "d", "rank")
