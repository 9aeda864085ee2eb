"""Connected components of a link table, by contraction in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Links that a task contracts at once, on average.
LINKS = 1 << 19


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of links a-b, ascending, and the smallest id that each reaches."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, top = ends[: len(a)], ends[len(a) :], np.arange(len(ids))
    while True:
        lo, hi = np.minimum(top[x], top[y]), np.maximum(top[x], top[y])
        apart = lo < hi
        if not apart.any():
            return ids, ids[top]
        x, y = x[apart], y[apart]
        np.minimum.at(top, hi[apart], lo[apart])
        while (top[top] != top).any():
            top = top[top]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(2)] for b in batches]
    if sides:
        ids, tops = smallest(*(np.concatenate(x).astype(np.int64) for x in zip(*sides, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tops)], ["id", "top"])


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) for every id of links(a, b); comp is the smallest id reachable.

    Links are dealt evenly to tasks of about LINKS; each finds, among its own, the smallest id that every id
    reaches. An id that several tasks have joins its smallest ids there, so what is left is a graph of such
    smallest ids, with fewer ids and fewer links, which is solved alike. An id is in no more rows than there
    are tasks, so a hub of any size is no hot key. Links of an id with itself and nulls are ignored.
    """
    links = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    parts = max(1, -(-links.count() // LINKS))
    tops = scratch.table(links.repartition(parts).mapInArrow(_contracted, "id long, top long"), "tops")
    if parts == 1:
        return tops.withColumnRenamed("top", "comp")
    heads = scratch.table(tops.groupBy("id").agg(F.min("top").alias("head")), "heads")
    joined = tops.join(heads, "id").where("top <> head").select(F.col("top").alias("a"), F.col("head").alias("b"))
    upper = connected_components(scratch.table(joined.distinct(), "contracted"), scratch).toDF("head", "comp")
    out = scratch.table(heads.join(upper, "head", "left").select("id", F.coalesce("comp", "head").alias("comp")), "comps")
    scratch.drop(tops, heads)
    return out
