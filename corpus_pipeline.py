"""The corpus pipeline: five stages from documents to packed batches.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
documents, but for the last. Its result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import decontaminate, exact_dedup, near_dedup, packing, quality, token_files
from granary.llm.scratch import Scratch, bounded_batches, documents


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among dropped(doc_id); rows without one stay."""
    return docs.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labelled rows of its input."""
    bounded_batches(spark)
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, but for the case of A-Z, one row with the largest doc_id; doc_ids may repeat or be null.
    Rows equal in both are ordered by their text, and those equal in that too by a hash of all columns."""
    found = exact_dedup.exact_duplicates(docs).select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha"), "kept")
    text = exact_dedup.ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.withColumn("_sha", F.unhex(F.sha2(text, 256)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("_sha") == F.col("sha"))
    # Kept rows that repeat both are few; only they are ordered.
    repeated = found.where("kept").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "sha")
    dropped = found.where("not kept").select("id", "sha").distinct().union(repeated)
    first = Window.partitionBy(F.col("doc_id").cast("long"), "_sha").orderBy("text", F.xxhash64(*docs.columns))
    one = rows.join(repeated, same, "left_semi").withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    return rows.join(dropped, same, "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the row with the smallest doc_id.

    Where a doc_id repeats or is null, all rows are numbered in order of doc_id, nulls last, and of a hash of the
    text, and compared by that number, so that each row is a document of its own.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if shared.isEmpty():
        return without(docs, near_dedup.near_duplicates(docs, width=5).where("not kept"))
    number = "_" + max(docs.columns, key=len)  # no column has this name
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id())
    rows = Scratch(spark).table(rows, "rows")
    found = near_dedup.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), width=5).where("not kept")
    return rows.join(found.select(F.col("doc_id").alias(number)), number, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length in tokens of op8's vocabulary, bucket and batch."""
    bounded_batches(spark)
    return packing.pack(packing.token_lengths(docs, token_files.vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A classifier cannot be put in SQL; the tests hold every stage and run()'s rows to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents, each written and read again."""
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
