"""Segment statistics of vectors and the bounds they give on squared distances.

A vector is cut into even segments. Per segment its mean and population standard deviation
are kept; a block of vectors keeps the ranges of both (its synopsis). For any vector v of a
block and any query q the squared distance is at least the lower and at most the upper bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even_ends(dim: int, n_segments: int) -> list[int]:
    """Exclusive ends of even segments; the last one takes the rest."""
    size = max(1, dim // n_segments)
    return [min(dim, size * (i + 1)) for i in range(n_segments - 1)] + [dim]


def halve(ends: list[int]) -> list[int]:
    """Ends with every segment of two values or more cut in half."""
    out, start = [], 0
    for end in ends:
        if end - start >= 2:
            out.append(start + (end - start) // 2)
        out.append(end)
        start = end
    return out


def bounds(ends: list[int]) -> list[tuple[int, int]]:
    """(start, length) of each segment."""
    return [(a, b - a) for a, b in zip([0, *ends[:-1]], ends)]


def mean(v: Column, start: int, length: int) -> Column:
    return F.aggregate(F.slice(v, start + 1, length), F.lit(0.0), lambda s, x: s + x.cast("double")) / length


def stdev(v: Column, start: int, length: int) -> Column:
    squares = F.aggregate(F.slice(v, start + 1, length), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / length
    mu = mean(v, start, length)
    return F.sqrt(F.greatest(squares - mu * mu, F.lit(0.0)))


def stats(v: Column, ends: list[int]) -> Column:
    """ARRAY<STRUCT<mu, sd>> of a vector."""
    return F.array(*[F.struct(mean(v, a, n).alias("mu"), stdev(v, a, n).alias("sd")) for a, n in bounds(ends)])


def synopsis(stats_col: str, ends: list[int]) -> Column:
    """Aggregate: ARRAY<STRUCT<mu_max, mu_min, sd_max, sd_min>> of a group of vectors; mergeable."""
    one = lambda i, f: F.col(stats_col)[i][f]
    return F.array(*[
        F.struct(F.max(one(i, "mu")).alias("mu_max"), F.min(one(i, "mu")).alias("mu_min"), F.max(one(i, "sd")).alias("sd_max"), F.min(one(i, "sd")).alias("sd_min"))
        for i in range(len(ends))
    ])


def merge_synopses(syn_col: str, ends: list[int]) -> Column:
    """Aggregate: synopsis of the union of groups from their synopses."""
    one = lambda i, f: F.col(syn_col)[i][f]
    return F.array(*[
        F.struct(F.max(one(i, "mu_max")).alias("mu_max"), F.min(one(i, "mu_min")).alias("mu_min"), F.max(one(i, "sd_max")).alias("sd_max"), F.min(one(i, "sd_min")).alias("sd_min"))
        for i in range(len(ends))
    ])


def _gap(x: Column, low: Column, high: Column) -> Column:
    return F.when(x < low, low - x).when(x > high, x - high).otherwise(F.lit(0.0))


def lower_bound(q: Column, syn: Column, ends: list[int]) -> Column:
    """Least squared distance of a query (its stats) to any vector of a block."""
    parts = []
    for i, (_, n) in enumerate(bounds(ends)):
        mu, sd = _gap(q[i]["mu"], syn[i]["mu_min"], syn[i]["mu_max"]), _gap(q[i]["sd"], syn[i]["sd_min"], syn[i]["sd_max"])
        parts.append(n * (mu * mu + sd * sd))
    return sum(parts[1:], parts[0])


def upper_bound(q: Column, syn: Column, ends: list[int]) -> Column:
    """Greatest squared distance of a query (its stats) to any vector of a block."""
    parts = []
    for i, (_, n) in enumerate(bounds(ends)):
        far = F.greatest(F.abs(q[i]["mu"] - syn[i]["mu_min"]), F.abs(q[i]["mu"] - syn[i]["mu_max"]))
        parts.append(n * ((q[i]["sd"] + syn[i]["sd_max"]) * (q[i]["sd"] + syn[i]["sd_max"]) + far * far))
    return sum(parts[1:], parts[0])


def dtw_lower_bound(env: Column, syn: Column, ends: list[int]) -> Column:
    """Least squared DTW distance: per segment the query envelope's range against the block's means."""
    parts = []
    for i, (a, n) in enumerate(bounds(ends)):
        part = F.slice(env, a + 1, n)
        high = F.array_max(F.transform(part, lambda e: e["high"]))
        low = F.array_min(F.transform(part, lambda e: e["low"]))
        d = F.when(syn[i]["mu_min"] > high, syn[i]["mu_min"] - high).when(syn[i]["mu_max"] < low, low - syn[i]["mu_max"]).otherwise(F.lit(0.0))
        parts.append(n * d * d)
    return sum(parts[1:], parts[0])


def quality(syn: Column, ends: list[int]) -> Column:
    """Spread of a block: per segment length x (mean range squared + largest deviation squared)."""
    parts = [n * ((syn[i]["mu_max"] - syn[i]["mu_min"]) * (syn[i]["mu_max"] - syn[i]["mu_min"]) + syn[i]["sd_max"] * syn[i]["sd_max"]) for i, (_, n) in enumerate(bounds(ends))]
    return sum(parts[1:], parts[0])
