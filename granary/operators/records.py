"""Rows by requested lists, metadata, first matches, and names that must differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import document_key

#: Bytes of items that are broadcast at most.
MOST_BROADCAST = 8 << 20


def requested(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The rows of the documents of a list that a user gave, with their `place` in it, the first of repeated
    names counting; an error names those that no row has."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([*enumerate(names)], "place int, _name string").select("place", document_key(F.col("_name")).alias(key)).where(f"{key} <> ''")
    listed = listed.groupBy(key).agg(F.min("place").alias("place"))
    missing = [r[0] for r in listed.join(rows.select(key), key, "left_anti").orderBy("place").collect()]
    if missing:
        raise ValueError(f"not found: {', '.join(missing)}")
    return rows.join(F.broadcast(listed), key)


def status_ok(status: Column, key: Column, score: Column) -> Column:
    """Rows that ended well: status `ok` in any case, a key that is not blank, and a score that is a number."""
    return (F.lower(F.trim(status)) == "ok") & (F.coalesce(F.trim(key), F.lit("")) != "") & number(score).isNotNull()


def number(x: Column) -> Column:
    """The value as a number; null for what is none, and for NaN."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def year_range(year: Column, first: int | None, last: int | None) -> Column:
    """Years within bounds, which count themselves; null years go only if there is a bound."""
    inside = F.lit(True)
    if first is not None:
        inside = inside & F.coalesce(year >= first, F.lit(False))
    return inside if last is None else inside & F.coalesce(year <= last, F.lit(False))


def with_metadata(rows: DataFrame, metadata: DataFrame, key: str, default: str = "UNKNOWN") -> DataFrame:
    """The rows with the columns of metadata(key, ...), the default where there are none, and whether they are
    missing."""
    columns = [c for c in metadata.columns if c != key]
    out = rows.join(metadata.withColumn("_has", F.lit(True)), key, "left")
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c) for c in columns]
    return out.select(*rows.columns, *filled, F.col("_has").isNull().alias("missing"))


def first_existing(rows: DataFrame, key: str, candidates: list[DataFrame], value: str) -> DataFrame:
    """The rows with the value of the first of the candidates(key, value) that has their key."""
    named = [c.select(key, F.col(value).alias(f"_{k}")) for k, c in enumerate(candidates)]
    out = reduce(lambda x, y: x.join(y, key, "left"), named, rows)
    return out.select(*rows.columns, F.coalesce(*(F.col(f"_{k}") for k in range(len(named)))).alias(value))


def distinct_names(rows: DataFrame, name: str, key: str) -> DataFrame:
    """The rows with `shown`: the name, followed by the key in brackets where several rows have it."""
    alike = F.count(F.lit(1)).over(Window.partitionBy(name))
    return rows.withColumn("shown", F.when(alike > 1, F.concat(name, F.lit(" ("), F.col(key).cast("string"), F.lit(")"))).otherwise(F.col(name)))


def label_order(label: Column, last: str = "OTHER") -> list[Column]:
    """The order of label lists: by name in any case, one label behind all others, nulls at the end."""
    return [label.isNull().asc(), (label == last).asc(), F.lower(label).asc(), label.asc()]


def span_issue(start: Column, end: Column, length: Column, end_before: Column) -> Column:
    """What is wrong with a span, all that is, in a fixed order."""
    found = [F.when(start > end, "inverted"), F.when(end - start != length, "length"), F.when(start < end_before, "overlap")]
    return F.array_compact(F.array(*found))


def against_all(rows: DataFrame, items: DataFrame, row: str, item: str, text: str, on: Column, most: int = MOST_BROADCAST) -> DataFrame:
    """The pairs of rows and items for which `on` holds, `row` and `item` being columns to deal them by and `text`
    what makes items large. Their size is counted first: up to `most` bytes of items are broadcast, more are cut
    into blocks of about that size, each of which meets each part of the rows in a task."""
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16), F.lit(0))).first()[0]
    if size <= most:
        return rows.join(F.broadcast(items), on)
    blocks, parts = -(-size // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(x: DataFrame, own: str, n: int, by: str, other: str, m: int) -> DataFrame:
        return x.withColumn(own, F.pmod(F.xxhash64(by), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

    left = dealt(rows, "_part", parts, row, "_block", blocks)
    right = dealt(items, "_block", blocks, item, "_part", parts).withColumnsRenamed({"_block": "_block_b", "_part": "_part_b"})
    met = (F.col("_part") == F.col("_part_b")) & (F.col("_block") == F.col("_block_b"))
    return left.join(right, met & on).drop("_part", "_block", "_part_b", "_block_b")
