"""Statistics as column expressions."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def exact_mean(x: Column, places: int = 2) -> Column:
    """The mean of numbers of so many decimals, the same in whatever order they are added: whole units are summed,
    and the sum divided once, so equal means are equal. Numbers of more decimals have the mean of a sum of doubles."""
    unit = 10**places
    whole = F.round(x * unit).try_cast("long")
    exact = F.when(F.count_if(whole / unit == x) == F.count(x), F.try_sum(whole) / F.count(x) / unit)
    return F.coalesce(exact, F.avg(x))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson score interval of k of n, within 0 and 1; (0, 0) for n = 0."""
    n = n.cast("double")
    p = F.try_divide(k.cast("double"), n)
    den = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / den
    margin = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / den
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + margin)).otherwise(0.0)


def ratio(top: Column, bottom: Column) -> tuple[Column, Column]:
    """A ratio and its status: over zero it is null, its status by the sign of the top."""
    status = F.when(bottom != 0, "finite").when(top > 0, "positive_infinity").when(top < 0, "negative_infinity").otherwise("undefined")
    return F.try_divide(top.cast("double"), bottom.cast("double")), status


def average_rank(x: Column, by: list[str], descending: bool = True) -> Column:
    """The rank of x among its non-null fellows, ties at their mean."""
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    place = F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2
    return F.when(x.isNotNull(), place)


def rank_percentile(rank: Column, n: Column) -> Column:
    """100 for the first of n ranks, 0 for the last; 100 for a single one."""
    return F.when(n == 1, F.when(rank.isNotNull(), 100.0)).otherwise(F.try_divide(n - rank, n - 1) * 100)


def pearson(x: str, y: str) -> Column:
    """Null for fewer than two pairs or a constant side."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(pair, F.col(x)), F.when(pair, F.col(y))
    spread = (F.count(a) >= 2) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(spread, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Null for a zero vector, unless `eps` is added below."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + eps)


def likert(x: Column) -> Column:
    """A score from 0 to 100 on a scale to 5."""
    return x / 20


def axis_reach(x: Column, centre: float = 3.0) -> Column:
    """How far an axis must reach on either side of its centre (an aggregate)."""
    return F.max(F.abs(x - centre))


def kendall(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    """Kendall's tau-b in n log n, pairs out of order being counted by a merge, and its two-sided p-value: exact
    without ties for 33 pairs of values or fewer, or if one pair at most is out of order or in order; else by the
    normal approximation with its correction for ties. Nulls where a side is constant."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n = len(x)

    def tied(*columns: np.ndarray) -> np.ndarray:
        return np.unique(np.stack(columns, 1), axis=0, return_counts=True)[1].astype(float)

    swaps, width, rank = 0, 1, np.unique(y, return_inverse=True)[1]
    while width < n:
        merged = rank.copy()
        for a in range(0, n - width, 2 * width):
            left, right = rank[a : a + width], rank[a + width : a + 2 * width]
            swaps += int((len(left) - np.searchsorted(left, right, "right")).sum())
            merged[a : a + 2 * width] = np.sort(rank[a : a + 2 * width], kind="stable")
        rank, width = merged, 2 * width
    if n < 2:
        return None, None
    total, (cx, cy, both) = n * (n - 1) / 2, (tied(x), tied(y), tied(x, y))
    tx, ty, txy = (float((c * (c - 1) / 2).sum()) for c in (cx, cy, both))
    if tx == total or ty == total:
        return None, None
    score = total - tx - ty + txy - 2 * swaps
    tau = max(-1.0, min(1.0, score / math.sqrt(total - tx) / math.sqrt(total - ty)))
    if not tx and not ty and (n <= 33 or min(swaps, total - swaps) <= 1):
        few = int(min(swaps, total - swaps))
        ways = [1] + [0] * few  # orders of k values by their number of inversions, up to `few`
        for k in range(2, n + 1):
            sums = list(accumulate(ways))
            ways = [sums[i] - (sums[i - k] if i >= k else 0) for i in range(few + 1)]
        return tau, min(1.0, 2 * sum(ways) / math.factorial(n)) if 2 * few < total else 1.0
    spread = n * (n - 1.0) * (2 * n + 5)
    vx, vy = (float((c * (c - 1) * (2 * c + 5)).sum()) for c in (cx, cy))
    ux, uy = (float((c * (c - 1) * (c - 2)).sum()) for c in (cx, cy))
    var = (spread - vx - vy) / 18 + 2 * tx * ty / (n * (n - 1.0)) + (ux * uy / (9 * n * (n - 1.0) * (n - 2)) if n > 2 else 0)
    return tau, math.erfc(abs(score) / math.sqrt(var) / math.sqrt(2)) if var > 0 else None
