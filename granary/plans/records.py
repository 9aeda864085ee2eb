"""Requested rows, filters, metadata, names, pairs of methods, topics, runs and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import codes, stats
from granary.functions import text as tx
from granary.operators import aggregates, ranks, records, spans

from .registry import Tables, query
from .scores import r6

WANTED = ["5", "document_17", " 3 ", "document_5", "190"]


@query("""
WITH w AS (SELECT unnest(['document_5', 'document_17', 'document_3', 'document_190']) AS document_id, unnest([0, 1, 2, 4]) AS place)
SELECT document_id, place, length(text)::INT AS size FROM w JOIN documents ON document_id = 'document_' || doc_id
""")
def q_doc_list(t: Tables) -> DataFrame:
    rows = t.documents.select(F.concat(F.lit("document_"), "doc_id").alias("document_id"), F.length("text").alias("size"))
    return records.requested(rows, "document_id", WANTED).select("document_id", "place", "size")


def loose_scores(t: Tables) -> DataFrame:
    """Events as a table of scores read from CSV would be: status, document and score as text."""
    kind = F.col("event_id") % 5
    score = F.when(kind == 0, F.lit("n/a")).when(kind == 1, F.lit("NaN")).otherwise(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise(" Ok ").alias("status"), F.when(kind == 2, F.lit(" ")).otherwise(F.col("user_id").cast("string")).alias("document"), score.alias("score"))


@query("""
SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS score, event_type <> 'error' AND event_id % 5 <> 2 AS ok FROM events WHERE event_id % 5 >= 2 AND json_extract_string(props, '$.k') IS NOT NULL
""")
def q_score_rows(t: Tables) -> DataFrame:
    rows = loose_scores(t).where(records.number(F.col("score")).isNotNull())
    return rows.select("event_id", records.number(F.col("score")).alias("score"), records.status_ok(F.col("status"), F.col("document"), F.col("score")).alias("ok"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE o_orderkey % 9 > 0 AND year(o_orderdate) BETWEEN 1994 AND 1996")
def q_year_range(t: Tables) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 9 > 0, F.year("o_orderdate"))
    return t.orders.select("o_orderkey", year.alias("year")).where(records.year_range(F.col("year"), 1994, 1996))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 6)")
def q_min_group(t: Tables) -> DataFrame:
    return aggregates.at_least(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], 6)


@query("SELECT p_brand, count(*) AS segments FROM part WHERE p_type <> 'STANDARD' GROUP BY 1 ORDER BY 2 DESC, p_brand LIMIT 10")
def q_top_types_by_rows(t: Tables) -> DataFrame:
    """Types by the number of their segments, none left out but the default label."""
    label = F.when(F.col("p_type") == "STANDARD", "OTHER").otherwise(F.col("p_type"))
    rows = t.part.where(label != "OTHER").groupBy("p_brand").agg(F.count(F.lit(1)).alias("segments"))
    return rows.orderBy(F.desc("segments"), "p_brand").limit(10)


@query("SELECT conv_id || '::segment_' || turn AS segment_id, role FROM conversations")
def q_segment_ids(t: Tables) -> DataFrame:
    return t.conversations.select(tx.segment_id(F.col("conv_id").cast("string"), F.col("turn")).alias("segment_id"), "role")


def classified(t: Tables) -> DataFrame:
    """Parts as classified segments: labels, the first extraction, and candidates by several names."""
    form = F.col("p_size") % 4
    labels = F.when(form == 0, F.array().cast("array<string>")).when(form == 1, F.array(F.lit(" "), F.lit("x"))).otherwise(F.array(F.concat(F.lit(" "), "p_type"), F.lit("y")))
    named = F.struct(F.when(F.col("p_size") % 3 == 0, F.lit("")).alias("label"), F.when(F.col("p_size") % 3 == 1, F.col("p_name")).alias("feature_name"), F.col("p_brand").alias("raw_label"))

    def candidate(name: Column, label: Column, similarity: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(name.alias("feature_name"), label.alias("label"), none.alias("raw_label"), similarity.alias("similarity"), F.lit(" t ").alias("tldr"), none.alias("description"))

    listed = F.array(candidate(F.col("p_name"), F.lit(None).cast("string"), F.lit("0.5")), candidate(F.lit(""), F.lit(" "), F.lit("1")), candidate(F.lit(""), F.col("p_type"), F.lit("high")))
    return t.part.select("p_partkey", labels.alias("labels"), F.when(F.col("p_size") % 5 > 0, F.array(named)).otherwise(F.array().cast("array<struct<label:string,feature_name:string,raw_label:string>>")).alias("extractions"), listed.alias("candidates"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 >= 2 THEN trim(p_type) WHEN p_size % 5 = 0 THEN 'OTHER' WHEN p_size % 3 = 1 THEN p_name ELSE p_brand END AS label, trim(p_name) || ':0.5:t,' || trim(p_type) || ':-:t' AS candidates FROM part
""")
def q_shown_labels(t: Tables) -> DataFrame:
    flat = F.transform(tx.flat_candidates(F.col("candidates")), lambda c: F.concat_ws(":", c["feature_name"], F.coalesce(c["similarity"].cast("string"), F.lit("-")), c["tldr"]))
    return classified(t).select("p_partkey", tx.shown_label(F.col("labels"), F.col("extractions")).alias("label"), F.array_join(flat, ",").alias("candidates"))


@query("""
SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, abs(length(a.text) - length(b.text))::INT AS gap FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn
""")
def q_method_pairs(t: Tables) -> DataFrame:
    """All pairs of the methods that read a page, in the order of their definition."""
    pairs = aggregates.method_pairs(t.conversations, ["conv_id"], "turn", ["text"])
    return pairs.select("conv_id", "turn_a", "turn_b", F.abs(F.length("text_a") - F.length("text_b")).alias("gap"))


@query("""
WITH p AS (SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, abs(length(a.text) - length(b.text))::INT AS gap FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn)
SELECT turn_a, turn_b, conv_id, gap, row_number() OVER (PARTITION BY turn_a, turn_b ORDER BY gap DESC, conv_id)::INT AS place FROM p QUALIFY row_number() OVER (PARTITION BY turn_a, turn_b ORDER BY gap DESC, conv_id) <= 5
""")
def q_top_disagreements(t: Tables) -> DataFrame:
    return aggregates.top_per_group(q_method_pairs(t), ["turn_a", "turn_b"], 5, F.desc("gap"), F.asc("conv_id")).select("turn_a", "turn_b", "conv_id", "gap", "place")


@query(r"""
WITH w AS (SELECT conv_id, turn, length(text)::BIGINT AS n, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, role FROM conversations),
p AS (SELECT a.turn AS turn_a, b.turn AS turn_b, least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE AS iou, CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE END AS jaccard, a.role = b.role AS same FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn)
SELECT turn_a, turn_b, count(*) AS pages, round(avg(iou), 6) AS char_iou, round(avg(jaccard), 6) AS jaccard, round(100.0 * count(*) FILTER (same) / count(*), 6) AS label_agreement FROM p GROUP BY 1, 2
""")
def q_pair_agreement(t: Tables) -> DataFrame:
    """By pair of methods: how far their spans, words and labels agree. A method's span runs from 0 as far as
    its text, so two spans share the shorter one."""
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("n"), tx.token_set(F.col("text")).alias("w"), "role")
    pairs = aggregates.method_pairs(rows, ["conv_id"], "turn", ["n", "w", "role"])
    zero = F.lit(0).cast("long")
    iou = F.try_divide(spans.overlap_length(zero, F.col("n_a"), zero, F.col("n_b")).cast("double"), F.greatest("n_a", "n_b"))
    same = F.count_if(F.col("role_a") == F.col("role_b"))
    return pairs.groupBy("turn_a", "turn_b").agg(F.count(F.lit(1)).alias("pages"), r6(F.avg(iou)).alias("char_iou"), r6(F.avg(tx.jaccard(F.col("w_a"), F.col("w_b")))).alias("jaccard"), r6(100.0 * same / F.count(F.lit(1))).alias("label_agreement"))


@query("""
SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS n_name, coalesce(n_regionkey::VARCHAR, 'UNKNOWN') AS n_regionkey, n_name IS NULL AS missing FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <= 2) ON n_nationkey = c_nationkey
""")
def q_metadata_left(t: Tables) -> DataFrame:
    meta = t.nation.where("n_regionkey <= 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return records.with_metadata(t.customer.select("c_custkey", "c_nationkey"), meta, "c_nationkey").drop("c_nationkey")


@query("SELECT c_custkey, coalesce(a.o_orderkey, b.o_orderkey, -1) AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) b ON b.o_custkey = c_custkey")
def q_first_existing(t: Tables) -> DataFrame:
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"))
    pending = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"))
    out = records.first_existing(t.customer.select("c_custkey"), "c_custkey", [pending, first.agg(F.min("o_orderkey").alias("first_order"))], "first_order")
    return out.na.fill(-1, ["first_order"])


@query("SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def q_group_names(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return aggregates.group_names(rows, "n_regionkey", "n_name").select("n_regionkey", F.array_join("names", ",").alias("names"))


@query("""
WITH p AS (SELECT event_type, user_id, array_to_string(list_sort(list(DISTINCT hour(ts))), '-') AS pages FROM events GROUP BY 1, 2) SELECT event_type, string_agg(user_id || ':' || pages, ' ' ORDER BY user_id) AS documents FROM p GROUP BY 1
""")
def q_pages_index(t: Tables) -> DataFrame:
    index = aggregates.pages_index(t.events.select("event_type", "user_id", F.hour("ts").alias("page")), "event_type", "user_id", "page")
    said = F.transform(F.map_entries("documents"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.array_join(e["value"].cast("array<string>"), "-")))
    return index.select("event_type", F.array_join(said, " ").alias("documents"))


@query("SELECT CASE WHEN label % 4 = 0 THEN -1 ELSE label END::INT AS cluster, count(*) AS n, CASE WHEN label % 4 = 0 THEN -1 ELSE label END = -1 AS is_noise FROM embeddings GROUP BY 1, 3")
def q_cluster_sizes(t: Tables) -> DataFrame:
    return aggregates.cluster_sizes(t.embeddings.select(F.when(F.col("label") % 4 != 0, F.col("label")).alias("cluster")), "cluster")


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY event_id DESC) AS last FROM events)
SELECT user_id, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 9) AS mean, round(sum(value) FILTER (event_type <> 'error'), 4) AS ok_sum,
 coalesce(string_agg(props, ';' ORDER BY event_id) FILTER (event_type = 'error' AND last <= 5), '') AS errors FROM e GROUP BY 1
""")
def q_runs_errors(t: Tables) -> DataFrame:
    out = aggregates.runs_summary(t.events, "user_id", F.col("event_type") != "error", "event_id", "value", "props")
    return out.select("user_id", "runs", "ok", "failed", F.round("mean", 9).alias("mean"), F.round("ok_sum", 4).alias("ok_sum"), F.array_join("errors", ";").alias("errors"))


@query("SELECT count(DISTINCT user_id) AS documents, count(*) AS segments, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value >= 100) AS ranked FROM events")
def q_run_totals(t: Tables) -> DataFrame:
    return t.events.agg(F.count_distinct("user_id").alias("documents"), F.count(F.lit(1)).alias("segments"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") >= 100).alias("ranked"))


ALIASES = ["the", "of the", "and"]


@query(r"""
WITH d AS (SELECT year(o_orderdate)::INT AS year, coalesce(text, '') AS x FROM orders LEFT JOIN documents ON doc_id = o_orderkey),
c AS (SELECT year, len(regexp_extract_all(x, '(?i)\bthe\b')) AS the, len(regexp_extract_all(x, '(?i)\bof the\b')) AS of_the, len(regexp_extract_all(x, '(?i)\band\b')) AS and_, len(regexp_extract_all(x, '(?i)\b(?:of the|the|and)\b')) AS every FROM d)
SELECT year, count(*) AS docs, count(*) FILTER (every > 0) AS mentioned, sum(the)::BIGINT AS the, sum(of_the)::BIGINT AS of_the, sum(and_)::BIGINT AS and_, sum(every)::BIGINT AS every, round(100.0 * sum(every) / count(*), 6) AS per_100 FROM c GROUP BY 1 HAVING count(*) >= 10
""")
def q_alias_counts(t: Tables) -> DataFrame:
    """Mentions by year, of each alias and of any."""
    each, every = tx.keyword_counts(F.col("text"), ALIASES)
    hits = t.documents.select("doc_id", each.alias("each"), every.alias("every"))
    rows = t.orders.select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("doc_id")).join(hits, "doc_id", "left")
    sums = [F.coalesce(F.sum(F.col("each")[k]), F.lit(0)).alias(n) for k, n in enumerate(("the", "of_the", "and_"))]
    total = F.coalesce(F.sum("every"), F.lit(0))
    out = rows.groupBy("year").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("every") > 0).alias("mentioned"), *sums, total.alias("every"), r6(100.0 * total / F.count(F.lit(1))).alias("per_100"))
    return out.where("docs >= 10")


def loose_spans(t: Tables) -> DataFrame:
    """Events as spans, some without a place, many alike."""
    start = (F.hour("ts") * 100 + F.minute("ts") % 3 * 10).cast("long")
    known = F.col("event_id") % 6 > 0
    return t.events.select("event_id", "user_id", F.when(known, start).alias("start"), F.when(known, start + 250).alias("end"), F.concat(F.lit(" "), F.upper("event_type")).alias("title"), F.lit("p").alias("parent"), F.lit(None).cast("string").alias("text"), F.lit(2600).cast("long").alias("size"))


_SPANS = """SELECT event_id, user_id, CASE WHEN event_id % 6 > 0 THEN hour(ts) * 100 + minute(ts) % 3 * 10 END AS s, CASE WHEN event_id % 6 = 0 THEN event_type END AS title FROM events"""


@query(f"SELECT event_id, user_id FROM ({_SPANS}) QUALIFY row_number() OVER (PARTITION BY user_id, s, title ORDER BY event_id) = 1")
def q_dedupe_spans(t: Tables) -> DataFrame:
    return spans.deduped(loose_spans(t), ["user_id"], "event_id").select("event_id", "user_id")


@query(f"""
WITH c AS (SELECT DISTINCT user_id, unnest(range(s, s + 250)) AS c FROM ({_SPANS}) WHERE s IS NOT NULL), n AS (SELECT user_id, count(*) AS covered FROM c GROUP BY 1)
SELECT u.user_id, coalesce(covered, 0)::BIGINT AS covered, round(coalesce(covered, 0) / 2600.0::DOUBLE, 6) AS coverage FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN n ON n.user_id = u.user_id
""")
def q_coverage(t: Tables) -> DataFrame:
    """Covered characters by interval algebra; the SQL counts a set of single ones."""
    out = spans.coverage(loose_spans(t), ["user_id"], "start", "end", "size")
    return out.select("user_id", "covered", r6("coverage").alias("coverage"))


@query("""
WITH s AS (SELECT event_id, user_id, hour(ts) AS s, hour(ts) + event_id % 4 - 1 AS e, event_id % 3 AS l FROM events), b AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS before FROM s)
SELECT event_id, array_to_string(list_filter([CASE WHEN s > e THEN 'inverted' END, CASE WHEN e - s <> l THEN 'length' END, CASE WHEN s < before THEN 'overlap' END], lambda x: x IS NOT NULL), ',') AS issues FROM b
""")
def q_span_issue_kinds(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.hour("ts").alias("s"), (F.hour("ts") + F.col("event_id") % 4 - 1).alias("e"), (F.col("event_id") % 3).alias("l"))
    rows = rows.withColumn("before", F.lag("e").over(Window.partitionBy("user_id").orderBy("s", "event_id")))
    return rows.select("event_id", F.array_join(records.span_issue(*map(F.col, ("s", "e", "l", "before"))), ",").alias("issues"))


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name || p_size) > 1 THEN p_name || p_size || ' (' || p_partkey || ')' ELSE p_name || p_size END AS shown FROM part")
def q_distinct_names(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.concat("p_name", F.col("p_size").cast("string")).alias("name"))
    return records.distinct_names(rows, "name", "p_partkey").select("p_partkey", "shown")


@query("""
WITH s AS (SELECT l_suppkey AS k, round(sum(l_quantity)) AS a, round(avg(l_extendedprice)) AS b, round(avg(l_discount), 3) AS c, count(*) AS d FROM lineitem GROUP BY 1),
r AS (SELECT k, rank() OVER (ORDER BY a DESC) AS a, rank() OVER (ORDER BY b DESC) AS b, rank() OVER (ORDER BY c DESC) AS c, rank() OVER (ORDER BY d DESC) AS d FROM s), m AS (SELECT k, (a + b + c + d) / 4.0::DOUBLE AS mean_rank FROM r)
SELECT k, mean_rank, rank() OVER (ORDER BY mean_rank)::INT AS place FROM m
""")
def q_mean_of_ranks(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.sum("l_quantity")).alias("a"), F.round(F.avg("l_extendedprice")).alias("b"), F.round(F.avg("l_discount"), 3).alias("c"), F.count(F.lit(1)).alias("d"))
    for name in "abcd":
        rows = ranks.placed(rows, f"r{name}", F.desc(name), ties=True)
    rows = rows.select("k", ((F.col("ra") + F.col("rb") + F.col("rc") + F.col("rd")) / 4.0).alias("mean_rank"))
    return ranks.placed(rows, "place", F.asc("mean_rank"), ties=True)


@query("""
WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'OTHER' ELSE c_mktsegment END AS label FROM customer)
SELECT c_custkey, label, row_number() OVER (ORDER BY label IS NULL, label = 'OTHER', lower(label), c_custkey)::INT AS place FROM l
""")
def q_label_order(t: Tables) -> DataFrame:
    label = F.when(F.col("c_custkey") % 7 != 0, F.when(F.col("c_mktsegment") == "MACHINERY", "OTHER").otherwise(F.col("c_mktsegment")))
    rows = t.customer.select("c_custkey", label.alias("label"))
    return ranks.placed(rows, "place", *records.label_order(F.col("label")), F.asc("c_custkey"))


@query("""
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN round(c_acctbal) END AS a, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS b, 'document_' || c_custkey AS d FROM customer) SELECT c_custkey, row_number() OVER (ORDER BY b NULLS LAST, a DESC NULLS LAST, c_custkey)::INT AS place FROM s
""")
def q_nulls_last(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.round("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("b"), F.concat(F.lit("document_"), "c_custkey").alias("d"))
    number = tx.trailing_number(F.col("d"), 10**12)
    return ranks.placed(rows, "place", F.asc_nulls_last("b"), F.desc_nulls_last("a"), number.asc()).select("c_custkey", "place")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 'document_' || o_custkey END AS document, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice)::BIGINT END, -1) AS whole FROM orders
""")
def q_file_ids(t: Tables) -> DataFrame:
    form, key = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    file = F.when(form == 0, F.concat(key, F.lit(".0"))).when(form == 1, F.concat(F.lit("CBA "), key, F.lit("_2.pdf"))).when(form == 2, F.concat(F.lit(" "), key)).otherwise("none")
    loose = F.when(F.col("o_orderkey") % 3 == 0, F.format_string(" %.2f", F.col("o_totalprice"))).otherwise("?")
    return t.orders.select("o_orderkey", tx.document_of_file(file).alias("document"), tx.number_or(loose, "long", -1).alias("whole"))


_NAMES = ", ".join(f"({n}, '{codes.STATE_NAMES[a]}')" for n, a in codes.STATES.items() if a in codes.STATE_NAMES)


@query(f"""
WITH s(n, name) AS (VALUES {_NAMES}) SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE coalesce(name, c_nationkey::VARCHAR) END AS state, CASE WHEN c_nationkey >= 10 THEN c_nationkey::VARCHAR END AS sector,
 CASE WHEN c_custkey % 4 = 0 THEN 'Employer' ELSE c_name END || ' v ' || c_mktsegment AS title FROM customer LEFT JOIN s ON n = c_nationkey
""")
def q_names(t: Tables) -> DataFrame:
    code = F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).otherwise(F.col("c_nationkey").cast("string"))
    sector = F.when(F.col("c_nationkey") >= 10, F.concat(F.lit("#"), "c_nationkey", F.lit("-456"))).otherwise(F.col("c_nationkey").cast("string"))
    title = tx.document_title(F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).otherwise(F.col("c_name")), F.col("c_mktsegment"))
    return t.customer.select("c_custkey", codes.state_name(code).alias("state"), codes.sector_code(sector).alias("sector"), title.alias("title"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || ':' || coalesce((json_extract_string(props, '$.k')::DOUBLE)::VARCHAR, 'null') || ':' END AS scores FROM events
""")
def q_json_scores(t: Tables) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("null"))
    listed = F.concat(F.lit('[{"name": " "}, {"score": 2}, {"name": " '), "event_type", F.lit('", "score": '), k, F.lit("}]"))
    found = tx.json_scores(F.when(F.col("event_id") % 4 == 0, F.lit("no list")).otherwise(listed))
    said = F.transform(found, lambda s: F.concat(s["name"], F.lit(":"), F.coalesce(s["score"].cast("string"), F.lit("null")), F.lit(":"), s["reason"]))
    return t.events.select("event_id", F.array_join(said, ",").alias("scores"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity * 0.125, 2) AS amount FROM lineitem")
def q_half_even(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", tx.half_even(F.col("l_quantity") * 0.125, 2).alias("amount"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || chr(10) || p_type ELSE p_name || chr(10) || p_brand || chr(10) || p_type END AS prototype FROM part")
def q_prototype_text(t: Tables) -> DataFrame:
    middle = F.when(F.col("p_size") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "p_brand"))
    return t.part.select("p_partkey", tx.prototype_text(F.col("p_name"), middle, F.col("p_type")).alias("prototype"))


@query("""
WITH z AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END AS v FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8), 6) AS sim FROM z a JOIN z b ON b.vec_id = a.vec_id + 1
""")
def q_cosine_eps(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")).alias("v"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return rows.join(after, "vec_id").select("vec_id", r6(stats.cosine(F.col("v"), F.col("w"), 1e-8)).alias("sim"))


@query("SELECT event_type, round(max(abs(value / 20 - 3)), 6) AS reach, round(avg(value / 20), 6) AS mean FROM events GROUP BY 1")
def q_axis(t: Tables) -> DataFrame:
    score = stats.likert(F.col("value"))
    return t.events.groupBy("event_type").agg(r6(stats.axis_reach(score)).alias("reach"), r6(F.avg(score)).alias("mean"))


@query("SELECT s_suppkey, round(coalesce(score, -1), 6) AS score, rnk FROM (SELECT s_suppkey, score, rank() OVER (PARTITION BY s_nationkey ORDER BY score DESC NULLS LAST)::INT AS rnk FROM supplier LEFT JOIN (SELECT l_suppkey, avg(l_quantity) AS score FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 4 GROUP BY 1) ON l_suppkey = s_suppkey)")
def q_left_rank(t: Tables) -> DataFrame:
    """Segments with the rank scores that they have; those without come last."""
    scores = t.lineitem.where("l_returnflag = 'R' and l_linenumber = 4").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_quantity").alias("score"))
    rows = t.supplier.join(scores, "s_suppkey", "left")
    place = F.rank().over(Window.partitionBy("s_nationkey").orderBy(F.desc_nulls_last("score")))
    return rows.select("s_suppkey", r6(F.coalesce("score", F.lit(-1.0))).alias("score"), place.alias("rnk"))
