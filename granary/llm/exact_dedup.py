"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions only.

A text is cut where its content says so, chunks become identifiers, and texts are compared as ordered lists
of identifiers. A chunk's identifier is its SHA-256, verified: every distinct (identifier, chunk) is moved
once, folded before the shuffle, and an identifier found with two different chunks is a collision. Texts
with such a chunk are compared by the chunks themselves instead. After this only identifiers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, documents, join_groups

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A cut falls after a word of odd last letter and the first two letters of the next, 256 characters after
#: the cut before at the earliest and 8192 at the latest.
CUT = r"(?<=[acegikmoqsuwy][ \n][bdfhjlnprtvxz][aceg])"
CHUNK = rf"(?s).{{256,8192}}?{CUT}|.{{1,8192}}"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; the quick form is used where a text has no other letters."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, which joined give the text; none for an empty one."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs(doc_id, text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts equal each
    other. keep_id is the largest doc_id of the group and kept marks its row; rows that repeat this doc_id
    in the group are all marked. Null ids never win against others; a group of null ids keeps its rows.
    group_size counts rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    norm = docs.select(F.col("doc_id").cast("long"), ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    cut = norm.select("doc_id", "text", chunks(F.col("text")).alias("chunks"))
    pieces = norm.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    stored = pieces.groupBy(identifier(F.col("chunk")).alias("id"), "chunk").agg(F.count(F.lit(1)).alias("uses"))
    collided = scratch.table(stored.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "collided")
    recipes = cut.select("doc_id", F.transform("chunks", identifier).alias("recipe"), F.sha2("text", 256).alias("text_sha256"))
    if collided.limit(1).count():
        recipes = resolved(cut, collided)
    recipes = scratch.table(recipes, "recipes")
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Empty texts, or a text that a third of all rows have, are one recipe: its rows are dealt to many tasks.
    found = join_groups(recipes, scratch.table(groups, "groups"), "recipe", "group_size", "doc_id")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def resolved(cut: DataFrame, collided: DataFrame) -> DataFrame:
    """Recipes in which a text that uses a collided identifier stands with its chunks instead, each behind
    33 zero bytes, so that it is longer than any identifier."""
    uses = cut.select("doc_id", F.explode(F.transform("chunks", identifier)).alias("id"))
    marked = uses.join(collided, "id", "left_semi").select(F.col("doc_id").alias("marked")).distinct()
    raw = F.transform("chunks", lambda c: F.concat(F.lit(bytearray(33)), F.encode(c, "UTF-8")))
    recipe = F.when(F.col("marked").isNull(), F.transform("chunks", identifier)).otherwise(raw)
    return cut.join(marked, cut.doc_id.eqNullSafe(marked.marked), "left").select("doc_id", recipe.alias("recipe"), F.sha2("text", 256).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256 FROM t JOIN g USING (text)
"""
