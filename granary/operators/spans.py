"""Pages, segments and intervals by character offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_start(by: list[str], order: str, size: Column) -> Column:
    """Where each of consecutive things begins, by the sizes of those before it."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")


def lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no, line, start, end) of all lines of each text, from 0; linear in its length."""
    rows = docs.select(doc, text, F.monotonically_increasing_id().alias("_row"))
    rows = rows.select(doc, "_row", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    start = running_start(["_row"], "line_no", F.length("line") + 1)
    return rows.select(doc, "line_no", "line", start.alias("start")).withColumn("end", F.col("start") + F.length("line"))


def deduped(spans: DataFrame, by: list[str], order: str, start: str = "start", end: str = "end", names: tuple[str, ...] = ("parent", "title", "text")) -> DataFrame:
    """The first, by `order`, of spans alike: in place where both ends are known, else in their names."""
    placed = F.col(start).isNotNull() & F.col(end).isNotNull()
    key = [F.when(placed, F.col(start)), F.when(placed, F.col(end))]
    key += [F.when(~placed, F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(n), F.lit("")), r"(?U)\s+", " ")))) for n in names]
    w = Window.partitionBy(*by, *key).orderBy(order)
    return spans.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def coverage(spans: DataFrame, by: list[str], start: str, end: str, size: str) -> DataFrame:
    """The share of each text that its spans cover, overlaps counted once; null for an empty text."""
    own = merged(spans.where(F.col(end) > F.col(start)), by, start, end).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))
    sizes = spans.groupBy(*by).agg(F.max(size).alias(size))
    out = sizes.join(own, by, "left").na.fill(0, ["covered"])
    return out.withColumn("coverage", F.try_divide(F.col("covered").cast("double"), F.col(size)))


def page_offsets(pages: DataFrame, doc: str, order: str, text: str, separator: int = 2) -> DataFrame:
    """Each page's span in its document's joined text, whose pages stand `separator` characters apart."""
    start = running_start([doc], order, F.length(text) + separator)
    return pages.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def join_pages(pages: DataFrame, doc: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda p: p[text]), separator)
    return pages.groupBy(doc).agg(joined.alias("full_text"))


def segments(starts: DataFrame, doc: str, start: str, size: str) -> DataFrame:
    """Spans from distinct boundaries to the next one or the end, numbered from 1; empty ones go. A
    document's text before its first boundary is its first segment."""
    first = starts.groupBy(doc, size).agg(F.lit(0).cast("long").alias(start))
    cuts = starts.select(doc, size, F.col(start).cast("long").alias(start)).unionByName(first).where(f"{start} between 0 and {size}").distinct()
    w = Window.partitionBy(doc).orderBy(start)
    spans = cuts.withColumn("end", F.coalesce(F.lead(start).over(w), F.col(size).cast("long"))).where(F.col("end") > F.col(start))
    return spans.withColumn("segment_number", F.row_number().over(w).cast("long"))


def merged(spans: DataFrame, by: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Unions of intervals that touch or lie at most `gap` apart."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("_new", (reach.isNull() | (F.col(start) > reach + gap)).cast("int"))
    island = fresh.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def interval_iou(a: DataFrame, b: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Intersection, union and their ratio of two interval sets; 1 if both are empty, 0 if one is."""
    a, b = merged(a, by, start, end), merged(b, by, start, end)
    size_a = a.groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("len_a"))
    size_b = b.groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("len_b"))
    left, right = a.toDF(*by, "s1", "e1"), b.toDF(*by, "s2", "e2")
    hits = left.join(right, by).where(overlaps(*map(F.col, ("s1", "e1", "s2", "e2"))))
    common = hits.groupBy(*by).agg(F.sum(overlap_length(*map(F.col, ("s1", "e1", "s2", "e2")))).alias("inter"))
    out = size_a.join(size_b, by, "full_outer").join(common, by, "left").na.fill(0, ["len_a", "len_b", "inter"])
    union = F.col("len_a") + F.col("len_b") - F.col("inter")
    return out.withColumn("union", union).withColumn("iou", F.when(union == 0, 1.0).otherwise(F.try_divide(F.col("inter").cast("double"), union.cast("double"))))


def without_overlaps(spans: Column, keep: str = "earlier") -> Column:
    """Of an array of (start, end) structs those a greedy pass in order keeps: on an overlap the earlier,
    or the longer, which takes the place of the one before."""
    first = F.slice(spans, 1, 0)

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        free = last.isNull() | (s["start"] >= last["end"])
        added = F.concat(kept, F.array(s))
        if keep == "earlier":
            return F.when(free, added).otherwise(kept)
        longer = (s["end"] - s["start"]) > (last["end"] - last["start"])
        swapped = F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(s))
        return F.when(free, added).when(longer, swapped).otherwise(kept)

    return F.aggregate(F.array_sort(spans), first, step)
