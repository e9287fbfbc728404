"""Distances between vectors, as column expressions and as Arrow kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a column used twice is else computed twice, or once for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squared_euclidean(a: Column, b: Column) -> Column:
    """Sum of squared differences in float64; no square root is taken anywhere in the engine."""
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda s, t: s + t * t)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, t: s + t.cast("double") * t.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size)


def l2_normalise(v: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    scaled = lambda w, n: F.transform(w, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))
    return let(v, lambda w: let(norm(w), lambda n: scaled(w, n)))


def relatively_close(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    """|a - b| within ``tolerance`` of the larger magnitude."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def usable(v: Column, dim: int) -> Column:
    """``dim`` values, none null or NaN, not all zero."""
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def dtw_matrix(a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Squared dynamic time warping distances of paired rows within a Sakoe-Chiba band.

    The recurrence runs over the band's cells; all row pairs advance together.
    """
    rows, n = a.shape
    before = np.full((rows, n + 1), np.inf)
    before[:, 0] = 0.0
    for i in range(1, n + 1):
        now = np.full((rows, n + 1), np.inf)
        for j in range(max(1, i - window), min(n, i + window) + 1):
            step = np.minimum(np.minimum(before[:, j], now[:, j - 1]), before[:, j - 1])
            now[:, j] = (a[:, i - 1] - b[:, j - 1]) ** 2 + step
        before = now
    return before[:, n]


def dtw_within(a: np.ndarray, b: np.ndarray, window: int, limit: np.ndarray) -> np.ndarray:
    """``dtw_matrix`` of pairs up to their ``limit``; infinite beyond it. A pair ends once all cells of a row exceed the limit."""
    n = a.shape[1]
    out, left = np.full(len(a), np.inf), np.arange(len(a))
    a, b, limit = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), np.asarray(limit, dtype=float)
    before = np.full((n + 1, len(left)), np.inf)
    before[0] = 0.0
    for i in range(1, n + 1):
        now = np.full((n + 1, len(left)), np.inf)
        first, last = max(1, i - window), min(n, i + window)
        cost = (a[i - 1] - b[first - 1 : last]) ** 2
        near = np.minimum(before[first : last + 1], before[first - 1 : last])
        for k, j in enumerate(range(first, last + 1)):
            np.minimum(near[k], now[j - 1], out=now[j])
            now[j] += cost[k]
        before = now
        if i % 5 == 0 and i < n:
            kept = now[first : last + 1].min(axis=0) <= limit
            if kept.mean() < 0.9:
                left, limit, a, b, before = left[kept], limit[kept], a[:, kept], b[:, kept], now[:, kept]
                if not len(left):
                    return out
    out[left] = np.where(before[n] <= limit, before[n], np.inf)
    return out


def dtw_close(q: np.ndarray, xt: np.ndarray, window: int, limit: float) -> np.ndarray:
    """Columns of ``xt`` (values x vectors, float32) that may be within ``limit`` of ``q`` under DTW: all that are, and few others.

    In float32, with a slack for its rounding. The cells of an anti-diagonal don't depend on each
    other, so each is one step for all vectors; a vector ends once no cell of two neighbouring
    diagonals is within the limit.
    """
    n, at = len(xt), np.arange(xt.shape[1])
    e = 2.4e-7 * max(np.abs(q).max(initial=0), np.abs(xt).max(initial=0))
    limit = np.nextafter(np.float32(limit * (1 + 4 * n * 1.2e-7 + 1e-6) + 4 * np.sqrt(2 * n * min(limit, 1e300)) * e + 4 * n * e * e), np.float32(np.inf))
    q = q.astype(xt.dtype)[:, None]
    before, last, now = (np.full((n + 2, len(at)), np.inf, xt.dtype) for _ in range(3))
    before[0] = 0
    for s in range(2, 2 * n + 1):
        lo, hi = max(1, s - n, -((window - s) // 2)), min(n, s - 1, (s + window) // 2)
        if lo > hi:  # a diagonal without cells in a band of one
            now[:] = np.inf
        else:
            out = now[lo : hi + 1]
            np.subtract(xt[lo - 1 : hi], q[s - hi - 1 : s - lo][::-1], out=out)
            np.multiply(out, out, out=out)
            least = np.minimum(last[lo : hi + 1], last[lo - 1 : hi])
            np.minimum(least, before[lo - 1 : hi], out=least)
            out += least
            now[lo - 1] = now[hi + 1] = np.inf
        before, last, now = last, now, before
        if s >= n // 2 and s % 8 == 0 and lo <= hi:
            kept = np.flatnonzero(np.minimum(last[lo : hi + 1].min(0), before[max(0, lo - 1) : hi + 2].min(0)) <= limit)
            if len(kept) < 0.7 * len(at):
                at, xt = at[kept], np.take(xt, kept, axis=1)
                if not len(at):
                    return at
                # Only what the band still reads is copied.
                held = slice(max(0, lo - 2), hi + 3)
                before, last, now = (_columns(x, held, kept) for x in (before, last, now))
    return at[last[n] <= limit]


def _columns(x: np.ndarray, rows: slice, kept: np.ndarray) -> np.ndarray:
    out = np.full((len(x), len(kept)), np.inf, x.dtype)
    np.take(x[rows], kept, axis=1, out=out[rows])
    return out


def dtw(warping: float):
    """Column function (a, b) -> squared DTW distance; band radius int(warping * length)."""

    @pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)
        return pd.Series(dtw_matrix(x, y, int(warping * x.shape[1])))

    return run


def envelope(v: Column, radius: int) -> Column:
    """Sliding (low, high) of a vector within ``radius`` positions."""
    at = F.sequence(F.lit(1), F.size(v))
    window = lambda i: F.slice(v, F.greatest(F.lit(1), i - radius), radius + 1 + F.least(i - 1, F.lit(radius)))
    return F.transform(at, lambda i: F.struct(F.array_min(window(i)).cast("double").alias("low"), F.array_max(window(i)).cast("double").alias("high")))
