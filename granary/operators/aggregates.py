"""Aggregates over groups of documents, methods, runs and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_weights(topics: DataFrame, by: str, words: str, scores: str) -> DataFrame:
    """(by, word, weight): a word's highest score over topics(by, words, scores), 1/(place from 1) where its
    topic has no score for it."""
    rows = topics.select(by, F.posexplode(F.arrays_zip(F.col(words).alias("word"), F.col(scores).alias("score"))).alias("i", "x"))
    return rows.groupBy(by, F.col("x.word").alias("word")).agg(F.max(F.coalesce(F.col("x.score").cast("double"), 1.0 / (F.col("i") + 1))).alias("weight"))


def cluster_sizes(rows: DataFrame, cluster: str, noise: int = -1) -> DataFrame:
    """(cluster, n, is_noise), noise being a cluster apart."""
    return rows.groupBy(F.coalesce(F.col(cluster), F.lit(noise)).alias(cluster)).agg(F.count(F.lit(1)).alias("n")).withColumn("is_noise", F.col(cluster) == noise)


def method_pairs(rows: DataFrame, by: list[str], ordinal: str, values: list[str]) -> DataFrame:
    """All pairs of methods of a page, the one defined first as `a`. A page has some ten methods at most, so its
    rows are gathered in order and paired inside the row; nothing but pages is shuffled."""
    listed = F.array_sort(F.collect_list(F.struct(ordinal, *values)))
    pages = rows.groupBy(*by).agg(listed.alias("_m"))
    later = F.transform("_m", lambda x, i: F.transform(F.slice("_m", i + 2, F.size("_m")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    out = pages.select(*by, F.inline(F.flatten(later)))
    return out.select(*by, *(F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in (ordinal, *values)))


def top_per_group(rows: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, numbered as `place`."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def at_least(rows: DataFrame, by: list[str], least: int, counted: str | None = None) -> DataFrame:
    """The rows of groups that have so many rows, or so many distinct values of `counted`."""
    n = F.count_distinct(counted) if counted else F.count(F.lit(1))
    return rows.join(rows.groupBy(*by).agg(n.alias("_n")).where(F.col("_n") >= least).drop("_n"), by, "left_semi")


def group_names(rows: DataFrame, by: str, name: str) -> DataFrame:
    """(by, names): the distinct names that are not blank, sorted."""
    return rows.where(F.trim(name) != "").groupBy(by).agg(F.array_sort(F.collect_set(F.trim(name))).alias("names"))


def pages_index(rows: DataFrame, clause: str, doc: str, page: str) -> DataFrame:
    """(clause, documents): a map from each document to its sorted distinct pages."""
    own = rows.groupBy(clause, doc).agg(F.array_sort(F.collect_set(page)).alias("pages"))
    return own.groupBy(clause).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(doc, "pages")))).alias("documents"))


def runs_summary(runs: DataFrame, by: str, ok: Column, order: str, value: str, error: str, errors: int = 5) -> DataFrame:
    """(by, runs, ok, failed, mean, ok_sum, errors): the mean is over all runs, the sum over those that are ok,
    and errors are the last ones that are not, in order."""
    last = F.row_number().over(Window.partitionBy(by, ok).orderBy(F.desc(order)))
    said = F.when(~ok & (F.col("_last") <= errors), F.struct(order, error))
    return runs.withColumn("_last", last).groupBy(by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.avg(value).alias("mean"),
        F.sum(F.when(ok, F.col(value))).alias("ok_sum"), F.transform(F.array_sort(F.collect_list(said)), lambda s: s[error]).alias("errors"),
    )
