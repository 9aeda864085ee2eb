"""Benchmark passages in documents, by spaced seeds that tolerate substitutions.

A passage is found where W = min(10, words of the item) consecutive words of an item stand in a document, in
place, with at most W // 5 of them substituted. Fixed masks pick word positions and ignore the others; for
each (W, substitutions) masks are chosen so that every placement of the substitutions leaves one mask
unharmed, so no such window is missed. Hashes of the masked words of benchmark and documents are joined, and
the aligned words around each hit are then compared.

The benchmark is read in blocks of a bounded size, each of which is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .scratch import documents

WINDOW, SUBSTITUTED = 10, 5
#: Bytes of benchmark text that are broadcast at once, on average.
BLOCK_BYTES = 8 << 20
BLOCK = 1 << 20
FILTER_BITS = 22


@lru_cache
def masks(window: int, substituted: int) -> tuple[tuple[int, ...], ...]:
    """Few masks (offsets, the first 0) such that, however many positions up to `substituted` of a window
    are wrong, one of them fits on right ones; the heaviest for which at most four are needed."""
    wrong = np.array([sum(1 << k for k in c) for c in combinations(range(window), substituted)], np.int64)
    for weight in range(window - substituted, 0, -1):
        forms = [(0, *c) for span in range(weight, window + 1) for c in combinations(range(1, span), weight - 1) if c == () or c[-1] == span - 1]
        hits = {}
        for form in forms:
            own = sum(1 << k for k in form)
            hits[form] = np.any([wrong & (own << s) == 0 for s in range(window - form[-1])], axis=0)
        chosen, left = [], np.ones(len(wrong), bool)
        while left.any() and len(chosen) < 4:
            best = max(forms, key=lambda f: (hits[f] & left).sum())
            chosen.append(best)
            left &= ~hits[best]
        if not left.any():
            return tuple(chosen)
    raise AssertionError("one position is always right")


def masked(value: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash at each position at which the mask fits."""
    n = max(0, len(value) - mask[-1])
    out = np.full(n, sum(1 << k for k in mask), B.U64)
    for k, at in enumerate(mask):
        out += value[at : at + n] * B.U64(0x9E3779B97F4A7C15 + 2 * k * 0x51ED270B)
    return B.mix(out)


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and where each row's begin."""
    low = B.LOWER[data]
    starts, ends, row = B.words(low, offsets)
    return B.span_hashes(low, starts, ends), np.searchsorted(row, np.arange(len(offsets)))


class Seeds:
    """The masked hashes of some benchmark items, by mask, with a bit table before the search."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        data, at = B.buffers(pa.array([t for _, t in items], pa.string()))
        self.value, self.first = word_values(data, at)
        found: dict[tuple[int, ...], list] = {}
        for k in range(len(items)):
            own = self.value[self.first[k] : self.first[k + 1]]
            window = min(WINDOW, len(own))
            for mask in masks(window, window // SUBSTITUTED) if window else ():
                h = masked(own, mask)
                found.setdefault(mask, []).append((h, np.full(len(h), k), np.arange(len(h))))
        self.seeds = {}
        for mask, parts in found.items():
            h, item, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << FILTER_BITS, bool)
            table[h >> B.U64(64 - FILTER_BITS)] = True
            self.seeds[mask] = (h[order], item[order], pos[order], table)

    def hits(self, value: np.ndarray) -> np.ndarray:
        """Distinct (document word, item, diagonal) of masked words that are equal; diagonal = document
        position - item position."""
        out = [np.zeros((0, 3), np.int64)]
        for mask, (h, item, pos, table) in self.seeds.items():
            own = masked(value, mask)
            at = np.flatnonzero(table[own >> B.U64(64 - FILTER_BITS)])
            lo, hi = np.searchsorted(h, own[at], "left"), np.searchsorted(h, own[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if len(at):
                k = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                p = np.repeat(at, n)
                out.append(np.stack([p, item[k], p - pos[k]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of the verified passages, distinct; rows' words begin at `first`."""
        hits = self.hits(value)
        rel = np.arange(1 - WINDOW, 2 * WINDOW)
        found = [np.zeros((0, 2), np.int64)]
        for k in range(0, len(hits), 1 << 15):
            p, item, diagonal = hits[k : k + (1 << 15)].T
            row = np.searchsorted(first, p, "right") - 1
            d = p[:, None] + rel
            q = d - diagonal[:, None]
            size = self.first[item + 1] - self.first[item]
            inside = (d >= first[row][:, None]) & (d < first[row + 1][:, None]) & (q >= 0) & (q < size[:, None])
            same = inside & (value[np.where(inside, d, 0)] == self.value[np.where(inside, self.first[item][:, None] + q, 0)])
            window = np.minimum(WINDOW, size)
            good = np.zeros(len(p), bool)
            for w in np.unique(window):
                own = window == w
                total = np.concatenate([np.zeros((own.sum(), 1), int), np.cumsum(same[own], 1)], 1)
                whole = np.concatenate([np.zeros((own.sum(), 1), int), np.cumsum(inside[own], 1)], 1)
                good[own] = ((total[:, w:] - total[:, :-w] >= w - w // SUBSTITUTED) & (whole[:, w:] - whole[:, :-w] == w)).any(1)
            found.append(np.stack([row[good], item[good]], 1))
        out = np.unique(np.concatenate(found), axis=0)
        return out[:, 0], out[:, 1]


def _matched(seeds):
    """Rows (doc_id, text, items) with the ids of this block's items added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = B.buffers(batch.column(1))
            for i, j in B.blocks(at, BLOCK):
                value, first = word_values(data[at[i] : at[j]], at[i : j + 1] - at[i])
                row, item = seeds.value.matches(value, first)
                lists = batch.column(2).slice(i, j - i).to_pylist()
                for r, k in zip(row.tolist(), item.tolist(), strict=True):
                    lists[r].append(seeds.value.ids[k])
                items = pa.array([sorted(set(x)) for x in lists], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(2)), items], ["doc_id", "text", "items"])

    return run


def _cleaned(seeds, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, where = B.buffers(batch.column(at))
            keep = np.ones(batch.num_rows, bool)
            for i, j in B.blocks(where, BLOCK):
                value, first = word_values(data[where[i] : where[j]], where[i : j + 1] - where[i])
                keep[i + seeds.value.matches(value, first)[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def _seed_blocks(benchmark: DataFrame):
    """Broadcast seeds of the items with text, a block at a time."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // BLOCK_BYTES))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield sc.broadcast(Seeds([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()]))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in whose text no passage of the benchmark stands; nothing is
    shuffled. Null and empty texts are clean; items count with or without an id."""
    for seeds in _seed_blocks(benchmark):
        docs = docs.mapInArrow(_cleaned(seeds, docs.columns.index("text")), docs.schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, items) for every row of docs(doc_id, text) against
    benchmark(item_id, text).

    items are the distinct ids, ascending, of the items of which a passage stands in the text. Null and
    empty texts and items hold no passage; items without an id are left out. Every row is returned, those
    that repeat a doc_id or have none too. Documents are read once, and blocks of a benchmark of more than
    one pass them on in a chain without a shuffle. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.array().cast("array<long>").alias("items"))
    for seeds in _seed_blocks(benchmark.where("item_id is not null")):
        rows = rows.mapInArrow(_matched(seeds), "doc_id long, text string, items array<long>")
    return rows.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", "n_items", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS g, generate_subscripts(w, 1) AS p FROM d),
bw AS (SELECT item_id, len(w) AS l, least(10, len(w)) AS k, unnest(w) AS g, generate_subscripts(w, 1) AS q FROM b),
m AS (SELECT doc_id, item_id, p - q AS diagonal, q, n, l, k FROM dw JOIN bw USING (g)),
e AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diagonal) >= k - k // 5),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead,
  count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS behind,
  count(*) OVER (PARTITION BY doc_id, item_id, diagonal) AS whole FROM e),
f AS (SELECT DISTINCT doc_id, item_id FROM s WHERE CASE WHEN k < 10 THEN whole >= k - k // 5 AND diagonal >= 0 AND diagonal + k <= n
  ELSE (ahead >= 8 AND q + 9 <= l AND q + 9 + diagonal <= n) OR (behind >= 8 AND q >= 10 AND q - 9 + diagonal >= 1) END),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM f GROUP BY 1)
SELECT d.doc_id, g.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, '') AS items FROM d LEFT JOIN g USING (doc_id)
"""
