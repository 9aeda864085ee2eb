"""Length buckets that minimise padding, and token-budget batches inside each.

A dynamic program over the histogram of all lengths chooses at most `buckets` upper edges for which the
padding, the sum of edge - length, is least over all choices. The histogram has a row for each length that
occurs, so at most as many as the longest text has tokens, and each round of the program passes over it once.
Inside a bucket, rows in the order of doc_id fill batches of budget // edge rows, numbered by prefix sums
over range partitions, so a bucket that holds most rows is not one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import token_files
from .scratch import Scratch, documents, shuffle_partitions


#: Words whose ids a worker keeps for counting; the stages before and after share its memory.
KEPT_WORDS = 400_000


def best_edges(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper edges, ascending, of at most `buckets` buckets with the least padding; lengths ascend.

    A round allows one bucket more. What ends at length j costs min over i of cost(i) + j * (rows from i to
    j) - (their sum); as i grows so does the row count before it, so the choices are lines whose slopes fall,
    and their lower hull is walked as j grows. Ties go to the last bucket that begins lowest.
    """
    m = len(lengths)
    if not m:
        return []
    c, s = [0] * (m + 1), [0] * (m + 1)
    for k in range(m):
        c[k + 1], s[k + 1] = c[k] + counts[k], s[k] + counts[k] * lengths[k]
    cost = [lengths[j] * c[j + 1] - s[j + 1] for j in range(m)]
    backs = []
    for _ in range(1, min(buckets, m)):
        new, back = cost[:], [-1] * m
        hull: list[tuple[int, int, int]] = []  # of the lines y = slope * length + base: slope, base, i
        head = 0
        for j in range(1, m):
            slope, base = -c[j], cost[j - 1] + s[j]
            while len(hull) - head >= 2:
                (p, q, _), (u, v, _) = hull[-2], hull[-1]
                if (base - q) * (p - u) < (v - q) * (p - slope):
                    hull.pop()
                else:
                    break
            hull.append((slope, base, j - 1))
            x = lengths[j]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                head += 1
            through = hull[head][0] * x + hull[head][1] + x * c[j + 1] - s[j + 1]
            if through < new[j]:
                new[j], back[j] = through, hull[head][2]
        backs.append(back)
        cost = new
    out, j = [], m - 1
    for back in reversed(backs):
        out.append(lengths[j])
        if back[j] < 0:
            return out[::-1]
        j = back[j]
    return [*out, lengths[j]][::-1]


def pack(rows: DataFrame, *, buckets: int = 8, budget: int = 16384) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch) for every row of rows(doc_id, n_tokens).

    bucket counts from 0 by length, bucket_length is the largest length in it, to which its rows are padded,
    and batch counts from 0 inside the bucket. A row longer than the budget is a batch of its own. A null
    length counts as 0; a null doc_id comes first; rows that repeat a doc_id all get places, in the order of
    their lengths. Other columns are ignored.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    rows = rows.select(F.col("doc_id").cast("long"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens"))
    first = F.col("doc_id").asc_nulls_first()
    # Written before it is dealt out, as finding the ranges reads it too.
    rows = scratch.table(rows, "lengths").repartitionByRange(shuffle_partitions(spark), first, "n_tokens")
    placed = scratch.table(rows.withColumn("part", F.spark_partition_id()), "placed")
    lengths = placed.groupBy("n_tokens").count().orderBy("n_tokens").collect()
    edges = best_edges([r.n_tokens for r in lengths], [r["count"] for r in lengths], buckets)
    if not edges:
        return placed.selectExpr("doc_id", "n_tokens", "0 as bucket", "n_tokens as bucket_length", "n_tokens as batch")
    bucket = F.lit(len(edges) - 1)
    for k in range(len(edges) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= edges[k], k).otherwise(bucket)
    placed = placed.withColumn("bucket", bucket)
    number = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(first, "n_tokens")) - 1
    counts = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("bucket", "part", before.alias("base"))
    length = F.element_at(F.array(*(F.lit(e).cast("long") for e in edges)), F.col("bucket") + 1)
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))).cast("long"))
    out = placed.withColumn("rank", number).join(bases, ["bucket", "part"]).withColumn("bucket_length", length)
    return out.select("doc_id", "n_tokens", "bucket", "bucket_length", F.floor((F.col("base") + F.col("rank")) / fit).cast("long").alias("batch"))


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words, runs of bytes other than space and 0x09-0x0D; 0 for null."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", words.cast("long").alias("n_tokens"))


def token_lengths(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens): ids that the tokenizer file at `path` gives, as in op8, without an end; 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_files.WordEncoder.of(path, KEPT_WORDS)
        for batch in batches:
            for ids, texts in token_files._slices(batch):
                sizes = [len(x) // encoder.dtype.itemsize for x in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(word_lengths(documents(spark, sf_dir)))


def oracle_sql(buckets: int = 8, budget: int = 16384) -> str:
    """The same dynamic program, a round a common table, over all pairs of lengths."""
    rounds = "d1 AS (SELECT j, edge * c - s AS v, [edge] AS path FROM h),\n"
    for k in range(2, buckets + 1):
        rounds += f"""x{k} AS (SELECT b.j, min({{'v': d.v + b.edge * (b.c - a.c) - (b.s - a.s), 'i': a.j}}) AS best FROM h a JOIN d{k - 1} d ON d.j = a.j JOIN h b ON a.j < b.j GROUP BY b.j),
d{k} AS (SELECT h.j, CASE WHEN x.best.v < d.v THEN x.best.v ELSE d.v END AS v, CASE WHEN x.best.v < d.v THEN list_append(p.path, h.edge) ELSE d.path END AS path
  FROM h JOIN d{k - 1} d ON d.j = h.j LEFT JOIN x{k} x ON x.j = h.j LEFT JOIN d{k - 1} p ON p.j = x.best.i),
"""
    return rf"""
WITH l AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
h0 AS (SELECT n AS edge, count(*)::BIGINT AS c0, sum(n)::BIGINT AS s0 FROM l GROUP BY n),
h AS (SELECT row_number() OVER (ORDER BY edge) AS j, edge, sum(c0) OVER (ORDER BY edge)::BIGINT AS c, sum(s0) OVER (ORDER BY edge)::BIGINT AS s FROM h0),
{rounds}e1 AS (SELECT unnest(path) AS bucket_length, generate_subscripts(path, 1) - 1 AS bucket FROM (SELECT path FROM d{buckets} ORDER BY j DESC LIMIT 1)),
p AS (SELECT l.doc_id, l.n, min(e1.bucket) AS bucket, min(e1.bucket_length) AS bucket_length FROM l JOIN e1 ON l.n <= e1.bucket_length GROUP BY l.doc_id, l.n)
SELECT doc_id, n AS n_tokens, bucket::INT AS bucket, bucket_length, ((row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1) // greatest(1, {budget} // greatest(bucket_length, 1)))::BIGINT AS batch FROM p
"""


ORACLE_SQL = oracle_sql()
