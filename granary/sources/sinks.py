"""Writers: small CSV, JSON lines by document, and an upsert by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.spans import join_pages


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a header: for results of a report's size."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, by: str | None = None, append: bool = False) -> None:
    writer = rows.write.mode("append" if append else "overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows but for those whose keys are new, and the new rows; columns of one side are null in the other."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments as Parquet, a folder a document hash bucket, so that millions of documents make few folders."""
    segments.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(64))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """A text file a page, below folders of its document and number."""
    pages.select("document_id", "page_number", "text").write.mode("overwrite").partitionBy("document_id", "page_number").text(path)


def full_texts(pages: DataFrame) -> DataFrame:
    """(document_id, full_text): pages(document_id, file, text) in the order of their file names, a line feed between two."""
    return join_pages(pages, "document_id", "file", "text", "\n")


def write_summary(rows: DataFrame, path: str) -> None:
    """The one row of a run's totals, as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)
