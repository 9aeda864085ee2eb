"""Readers of page trees, tolerant JSON and CSV, and taxonomies."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import strip


def texts(spark: SparkSession, root: str, names: str) -> DataFrame:
    """(path, value) of the text files below a folder, to the last byte; what is not UTF-8 is replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("value"))


#: The page number of a file whose name has none, behind all others.
NO_PAGE = 10**9


def page_tree(spark: SparkSession, root: str, all_names: bool = False) -> DataFrame:
    """(document_id, page_number, text) of root/document_*/page_*.txt, text as it stands; files whose names have
    no number are left out, or with `all_names` come last."""
    files, path = texts(spark, root, "page_*.txt"), F.col("path")
    number = F.regexp_extract(path, r"page_(\d+)\.txt$", 1).try_cast("int")
    rows = files.select(F.regexp_extract(path, r"([^/]+)/page_[^/]*\.txt$", 1).alias("document_id"), (F.coalesce(number, F.lit(NO_PAGE)) if all_names else number).alias("page_number"), F.col("value").alias("text"))
    return rows.where("document_id <> '' and page_number is not null")


def stripped_pages(pages: DataFrame) -> DataFrame:
    """Pages without white space at their ends; empty ones go."""
    return pages.withColumn("text", strip(F.col("text"))).where("text <> ''")


def document_folders(pages: DataFrame) -> DataFrame:
    """(document_id, number) of the documents of a tree whose folders are named document_n, to be sorted by number."""
    number = F.regexp_extract("document_id", r"^document_(\d+)$", 1).try_cast("long")
    return pages.select("document_id", number.alias("number")).where("number is not null").distinct()


def segment_tree(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, segment_number, text) of segment_*.txt beside or one folder below a document."""
    files, path = texts(spark, root, "segment_*.txt"), F.col("path")
    rows = files.select(F.regexp_extract(path, r"([^/]+)/(?:segments/)?segment_\d+\.txt$", 1).alias("document_id"), F.regexp_extract(path, r"segment_(\d+)\.txt$", 1).try_cast("int").alias("segment_number"), F.col("value").alias("text"))
    return rows.where("document_id <> ''")


def json_rows(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON lines, or one JSON text a file; what does not parse is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", not lines).json(path)


def json_objects(spark: SparkSession, root: str, names: str, schema: str) -> DataFrame:
    """(path, and the fields of schema) of files below a folder that hold one JSON object each; others are left out."""
    files = texts(spark, root, names).withColumn("_v", F.try_parse_json("value"))
    whole = files.where(F.coalesce(F.schema_of_variant("_v").startswith("OBJECT<"), F.lit(False)))
    return whole.select("path", F.from_json("value", schema).alias("_row")).select("path", "_row.*")


def with_legacy(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """The rows with each new name, filled from its older names where it is null or not there."""
    for new, older in names.items():
        have = [F.col(f"`{c}`") for c in (new, *older) if c in rows.columns]
        rows = rows.withColumn(new, F.coalesce(*have) if have else F.lit(None).cast("string")).drop(*(c for c in older if c != new))
    return rows


def csv_rows(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV with a header, quotes doubled and line feeds in quotes; columns are cast, to null where they cannot be."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = [F.col(f"`{c}`").try_cast(kind).alias(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()]
    return rows.select(*have)


def stata_rows(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """The first that is there of a folder's Stata files, or the file `root` itself. It is parsed on the driver:
    these are metadata tables of some thousand rows."""
    import pandas as pd

    files = spark.read.format("binaryFile")
    for name in names or (None,):
        found = (files.option("pathGlobFilter", name) if name else files).load(root).select("content").take(1)
        if found:
            return spark.createDataFrame(pd.read_stata(io.BytesIO(found[0][0]), convert_categoricals=False))
    raise FileNotFoundError(f"none of {', '.join(names)} in {root}")


def taxonomy(text: str) -> list[dict[str, str]]:
    """Entries (name, tldr, description) of a markdown list: `### 1. Name`, a `TL;DR:` line, then prose. OTHER
    comes last."""
    out: list[dict[str, str]] = []
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("### "):
            name = line[4:].strip()
            head, dot, rest = name.partition(".")
            out.append({"name": rest.strip() if dot and head.strip().isdigit() else name, "tldr": "", "description": ""})
        elif out and line and not line.startswith("--"):
            label, colon, rest = line.replace("*", "").partition(":")
            key = "tldr" if colon and label.strip().lower() in ("tldr", "tl;dr") else "description"
            out[-1][key] = f"{out[-1][key]} {rest if key == 'tldr' else line}".strip()
    return [*out, {"name": "OTHER", "tldr": "", "description": ""}]


def taxonomy_details(text: str) -> list[dict]:
    """Entries (name, tldr, description, details) of the same list; details are the lines that begin with a dash,
    and so also a heading that is struck out by dashes, below the entry before it."""
    out, name = [], None
    details: dict[int, list[str]] = {}
    for line in map(str.strip, text.splitlines()):
        if line.startswith("### "):
            name = len(details)
            details[name] = []
        elif name is not None and line.startswith("-"):
            details[name].append(line.lstrip("-").strip())
    plain = "\n".join(x for x in text.splitlines() if not x.strip().startswith("-"))
    for k, entry in enumerate(taxonomy(plain)[:-1]):
        out.append({**entry, "details": details[k]})
    return out


def feature_names(text: str) -> list[str]:
    """The names of the list's entries, without their numbers."""
    return [e["name"] for e in taxonomy(text)[:-1]]


def feature_rows(listed: DataFrame, paged: DataFrame) -> DataFrame:
    """Distinct (document_id, document_page, feature_name) of two forms: rows with those columns, and rows
    (id, features) whose id reads document_n_page_m; rows without a feature or page go."""
    where = F.regexp_extract("id", r"^(document_\d+)_page_(\d+)$", 1)
    page = F.regexp_extract("id", r"^(document_\d+)_page_(\d+)$", 2).try_cast("int")
    other = paged.select(where.alias("document_id"), page.alias("document_page"), F.explode("features").alias("feature_name"))
    rows = listed.select("document_id", F.col("document_page").try_cast("int").alias("document_page"), "feature_name").unionByName(other)
    return rows.where("document_id <> '' and document_page is not null and trim(feature_name) <> ''").distinct()


def clustered(rows: DataFrame) -> DataFrame:
    """Rows whose cluster_id is a whole number."""
    return rows.withColumn("cluster_id", F.col("cluster_id").cast("string").try_cast("int")).where("cluster_id is not null")
