"""Joins, set operations, samples, keeps and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import jaccard
from granary.operators import aggregates, ranks
from granary.sources import sinks

from .registry import Tables, query
from .scores import r6


@query("""
WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels)
SELECT 'intersect' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
""")
def q_set_ops(t: Tables) -> DataFrame:
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    ops = {"intersect": a.intersect(b), "except": a.exceptAll(b).distinct(), "union": a.union(b).distinct(), "union_all": a.union(b)}
    out = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, x in ops.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'cached' ELSE 'todo' END AS state FROM documents")
def q_semi_anti_resume(t: Tables) -> DataFrame:
    docs, done = t.documents.select("doc_id"), t.labels.select("doc_id")
    return docs.join(done, "doc_id", "left_semi").withColumn("state", F.lit("cached")).unionByName(docs.join(done, "doc_id", "left_anti").withColumn("state", F.lit("todo")))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def q_dedupe_first(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'old' ELSE 'new' END AS version, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def q_upsert(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", F.lit("old").alias("version"), F.lit(0).cast("long").alias("n"))
    new = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit("new").alias("version"), F.count(F.lit(1)).alias("n"))
    return sinks.upsert(old, new, ["c_custkey"])


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '-7'), doc_id LIMIT 25")
def q_sample_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id").limit(25)


@query("SELECT doc_id FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS seen FROM labels) ON seen = doc_id ORDER BY CASE WHEN seen IS NULL THEN 1 ELSE 0 END, md5(doc_id::VARCHAR || '-7'), doc_id LIMIT 25")
def q_sample_priority(t: Tables) -> DataFrame:
    seen = t.labels.select("doc_id").distinct().withColumn("late", F.lit(0))
    rows = t.documents.select("doc_id").join(seen, "doc_id", "left")
    return rows.orderBy(F.coalesce("late", F.lit(1)), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id").limit(25).select("doc_id")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def q_first_n(t: Tables) -> DataFrame:
    return t.conversations.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("rn <= 3").select("conv_id", "turn", "role")


@query("""
WITH m AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY 1),
c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2), l AS (SELECT o_custkey, p FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, lower(p)) = 1)
SELECT c_custkey, coalesce(priorities, 'UNKNOWN') AS priorities, coalesce(first_status, 'UNKNOWN') AS first_status, coalesce(p, 'UNKNOWN') AS modal FROM customer LEFT JOIN m ON m.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey
""")
def q_meta_merge(t: Tables) -> DataFrame:
    meta = t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status"))
    counts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("n"), F.lower("o_orderpriority").alias("k"), "o_orderpriority")).alias("m")).select("o_custkey", F.col("m.o_orderpriority").alias("modal"))
    rows = t.customer.select("c_custkey").join(meta.join(modal, "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", *(F.coalesce(c, F.lit("UNKNOWN")).alias(c) for c in ("priorities", "first_status", "modal")))


@query("""
WITH f AS (SELECT doc_id, lang, unnest(['the', 'de', 'der']) AS feature, unnest([regexp_matches(lower(text), '\\bthe\\b'), regexp_matches(lower(text), '\\bde\\b'), regexp_matches(lower(text), '\\bder\\b')]) AS hit FROM documents), h AS (SELECT * FROM f WHERE hit),
n AS (SELECT lang, count(DISTINCT doc_id) AS n FROM h GROUP BY 1) SELECT h.lang, feature, round(count(DISTINCT doc_id) / any_value(n)::DOUBLE * 100, 2) AS pct FROM h JOIN n ON n.lang = h.lang GROUP BY 1, 2
""")
def q_provision_heatmap(t: Tables) -> DataFrame:
    words = ("the", "de", "der")
    hits = F.array_compact(F.array(*(F.when(F.lower("text").rlike(rf"\b{w}\b"), w) for w in words)))
    rows = t.documents.select("doc_id", "lang", hits.alias("hits")).where("size(hits) > 0")
    n = rows.groupBy("lang").agg(F.count_distinct("doc_id").alias("n"))
    out = rows.select("doc_id", "lang", F.explode("hits").alias("feature")).groupBy("lang", "feature").agg(F.count_distinct("doc_id").alias("c"))
    return out.join(n, "lang").select("lang", "feature", F.round(F.col("c") / F.col("n") * 100, 2).alias("pct"))


@query("SELECT event_type, count(*) AS page_rows, count(DISTINCT user_id) AS doc_count, array_to_string(list_sort(list(DISTINCT hour(ts)))::VARCHAR[], ',') AS pages FROM events GROUP BY 1")
def q_page_doc_freq(t: Tables) -> DataFrame:
    pages = F.array_join(F.array_sort(F.collect_set(F.hour("ts"))).cast("array<string>"), ",")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("page_rows"), F.count_distinct("user_id").alias("doc_count"), pages.alias("pages"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, -1) AS a_n, coalesce(b.n, -1) AS b_n, row_number() OVER (ORDER BY coalesce(a.n, 0) DESC, coalesce(a.doc_id, b.doc_id))::INT AS place FROM (SELECT doc_id, n_chars AS n FROM documents) a FULL JOIN (SELECT user_id::BIGINT AS doc_id, count(*) AS n FROM events GROUP BY 1) b ON a.doc_id = b.doc_id")
def q_doc_union(t: Tables) -> DataFrame:
    a = t.documents.select("doc_id", F.col("n_chars").alias("a_n"))
    b = t.events.groupBy(F.col("user_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("b_n"))
    both = a.join(b, "doc_id", "full_outer").withColumn("shown", F.coalesce("a_n", F.lit(0)))
    return ranks.placed(both, "place", F.desc("shown"), F.asc("doc_id")).drop("shown").na.fill(-1, ["a_n", "b_n"])


@query("""
WITH x AS (SELECT source, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), y AS (SELECT source, unnest(w) AS word FROM x), n AS (SELECT source, word, count(*) AS uses FROM y GROUP BY 1, 2),
r AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY uses DESC, word) AS i FROM n), t AS (SELECT source, i, word, CASE WHEN i % 3 = 0 THEN NULL ELSE i / 40.0 END::DOUBLE AS score FROM r WHERE i <= 30)
SELECT source, word, round(max(coalesce(score, 1.0 / i)), 6) AS weight FROM t GROUP BY 1, 2
""")
def q_cluster_words(t: Tables) -> DataFrame:
    """The weight of each word of a topic: its highest score, 1/place where the topic gives none."""
    words = t.documents.select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    counts = words.groupBy("source", "word").agg(F.count(F.lit(1)).alias("uses"))
    top = counts.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("uses"), "word"))).where("i <= 30")
    topics = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("i", "word", F.when(F.col("i") % 3 != 0, F.col("i") / 40).alias("score")))).alias("topic"))
    return aggregates.word_weights(topics.select("source", "topic.word", "topic.score"), "source", "word", "score").select("source", "word", r6("weight").alias("weight"))


@query("SELECT sector, state, sum(n)::BIGINT AS customers FROM (SELECT CASE WHEN n_regionkey <= 1 THEN 'A' ELSE 'B' END AS sector, n_name AS state, 1 AS n FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1, 2")
def q_doc_metadata(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy(F.when(F.col("n_regionkey") <= 1, "A").otherwise("B").alias("sector"), F.col("n_name").alias("state")).agg(F.count(F.lit(1)).alias("customers"))


@query("""
WITH m AS (SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS x FROM conversations GROUP BY 1, 2), s AS (SELECT conv_id, role, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')) AS w FROM m),
a AS (SELECT * FROM s WHERE role = 'user'), b AS (SELECT * FROM s WHERE role = 'assistant')
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.conv_id IS NOT NULL AS in_a, b.conv_id IS NOT NULL AS in_b,
 round(CASE WHEN len(list_distinct(coalesce(a.w, []) || coalesce(b.w, []))) = 0 THEN 1 ELSE len(list_intersect(coalesce(a.w, []), coalesce(b.w, []))) / len(list_distinct(coalesce(a.w, []) || coalesce(b.w, [])))::DOUBLE END, 6) AS jaccard FROM a FULL JOIN b ON a.conv_id = b.conv_id
""")
def q_label_overlap(t: Tables) -> DataFrame:
    words = t.conversations.select("conv_id", "role", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    sets = words.groupBy("conv_id", "role").agg(F.collect_set("w").alias("w"))
    a = sets.where("role = 'user'").select("conv_id", F.col("w").alias("a"), F.lit(True).alias("in_a"))
    b = sets.where("role = 'assistant'").select("conv_id", F.col("w").alias("b"), F.lit(True).alias("in_b"))
    none = F.array().cast("array<string>")
    out = a.join(b, "conv_id", "full_outer")
    return out.select("conv_id", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"), r6(jaccard(F.coalesce("a", none), F.coalesce("b", none))).alias("jaccard"))
