"""Codes, labels, typed fields, headings, passages under a budget, and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import codes, rubric
from granary.functions import text as tx
from granary.operators import chunks, graphs, headings, ranks, spans

from .registry import Tables, query
from .scores import r6


def _values(table: dict) -> str:
    return ", ".join(f"({k}, '{v}')" for k, v in table.items())


@query(f"""
WITH s(n, a) AS (VALUES {_values(codes.STATES)}) SELECT c_custkey, CASE WHEN c_nationkey * 3 > 0 THEN coalesce(s.a, 'FIPS_' || (c_nationkey * 3)) END AS state,
 CASE WHEN c_nationkey * 3 > 0 THEN coalesce(s.a, 'FIPS_' || (c_nationkey * 3)) WHEN c_mktsegment = 'BUILDING' THEN 'VARIES' ELSE 'UNKNOWN' END AS states FROM customer LEFT JOIN s ON s.n = c_nationkey * 3
""")
def q_states(t: Tables) -> DataFrame:
    code, place = F.col("c_nationkey") * 3, F.when(F.col("c_mktsegment") == "BUILDING", "Varies").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", codes.state_of(code).alias("state"), F.array_join(codes.states([code, F.lit("0")], place), ",").alias("states"))


@query(f"""
WITH s(n, a) AS (VALUES {_values(codes.SECTORS)}) SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size || ' - ' || coalesce(s.a, 'Other/Unknown NAICS Sector') WHEN p_size = 5 THEN upper(p_type) ELSE p_size::VARCHAR END AS industry FROM part LEFT JOIN s ON s.n = p_size
""")
def q_industry(t: Tables) -> DataFrame:
    code = F.when(F.col("p_size") >= 10, F.concat(F.lit("code "), "p_size", F.lit("4100"))).when(F.col("p_size") != 5, F.col("p_size").cast("string"))
    return t.part.select("p_partkey", codes.industry(code, F.col("p_type")).alias("industry"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN year(o_orderdate)::INT ELSE -1 END AS year FROM orders")
def q_years(t: Tables) -> DataFrame:
    day, form = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    value = F.when(form == 0, day.cast("string")).when(form == 1, F.date_format(day, "M/d/yyyy")).when(form == 2, F.datediff(day, F.lit("1960-01-01")).cast("string")).when(form == 3, F.year(day).cast("string")).otherwise("n.d.")
    return t.orders.select("o_orderkey", F.coalesce(codes.year_of(value), F.lit(-1)).alias("year"))


LABELS = ["Large Plated", "Burnished", "Economy", "Steel"]


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_type), 'large plated') THEN 'Large Plated' WHEN contains(lower(p_type), 'burnished') THEN 'Burnished' WHEN contains(lower(p_type), 'economy') THEN 'Economy' WHEN contains(lower(p_type), 'steel') THEN 'Steel' ELSE 'OTHER' END AS label,
 left(p_type, 10) AS shown FROM part
""")
def q_canonical_labels(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.canonical_label(F.col("p_type"), LABELS).alias("label"), tx.display_label(F.concat("p_type", F.lit(" Clause")), 10).alias("shown"))


@query("""
WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, [0.1, 0.25, 0.5, 0.75, 0.9]) AS p FROM part GROUP BY 1)
SELECT p_brand, round(p[1], 3) AS low, round(p[5], 3) AS high FROM q
""")
def q_anchors(t: Tables) -> DataFrame:
    p = t.part.groupBy("p_brand").agg(F.percentile("p_retailprice", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("p"))
    turned = rubric.directed(F.reverse(rubric.percentile_anchors(*(F.col("p")[k] for k in range(5)))), F.lit("more is better"))
    return p.select("p_brand", turned[0].cast("double").alias("low"), turned[4].cast("double").alias("high"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice END AS num, CASE o_orderkey % 3 WHEN 1 THEN o_orderpriority END AS str, CASE o_orderkey % 3 WHEN 2 THEN o_orderstatus = 'F' END AS bool FROM orders
""")
def q_typed_fields(t: Tables) -> DataFrame:
    form = F.col("o_orderkey") % 3
    kind = rubric.field_type(F.when(form == 0, " Float").when(form == 1, "remark").otherwise("bool"))
    value = F.when(form == 0, F.concat(F.format_string("%.2f", F.round("o_totalprice", 2)), F.lit(" USD"))).when(form == 1, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no"))
    return t.orders.select("o_orderkey", rubric.typed(value, kind).alias("x")).select("o_orderkey", "x.num", "x.str", "x.bool")


@query("""
WITH m AS (SELECT min(value) AS low, max(value) AS high FROM events) SELECT event_id, round(6 + 12 * (value - low) / (high - low), 6) AS size,
 printf('%02d:%02d:%02d', user_id * 37 // 3600, user_id * 37 % 3600 // 60, user_id * 37 % 60) AS took FROM events CROSS JOIN m
""")
def q_marker_scale(t: Tables) -> DataFrame:
    ends = t.events.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    rows = t.events.join(F.broadcast(ends))
    return rows.select("event_id", r6(rubric.marker_scale(F.col("value"), F.col("low"), F.col("high"))).alias("size"), rubric.elapsed(F.col("user_id") * 37).alias("took"))


STOP = ["the", "and", "of", "to", "in", "de", "la", "der", "die", "und"]


@query(f"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]+')) AS term FROM documents) SELECT term, count(*) AS n FROM w WHERE term NOT IN ({", ".join(f"'{s}'" for s in STOP)}) GROUP BY 1
""")
def q_term_freq(t: Tables) -> DataFrame:
    terms = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z'-]+"), F.lit(0))).alias("term"))
    return terms.where(~F.col("term").isin(STOP)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, row_number() OVER (ORDER BY sum(n) DESC, event_type)::INT AS place FROM c GROUP BY 1) SELECT user_id, c.event_type, n, place FROM c JOIN s ON s.event_type = c.event_type
""")
def q_heatmap(t: Tables) -> DataFrame:
    cells = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    totals = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
    places = totals.select("event_type", F.row_number().over(Window.orderBy(F.desc("total"), "event_type")).alias("place"))
    return cells.join(places, "event_type").select("user_id", "event_type", "n", "place")


@query("""
WITH a AS (SELECT l_partkey AS page, round(1 - sum(round(l_discount * 100)::BIGINT + round(l_tax * 100)::BIGINT) / (200.0::DOUBLE * count(*)), 12) AS score FROM lineitem GROUP BY 1) SELECT page, score, rank() OVER (ORDER BY score DESC)::INT AS place, score > 0.95 AS agreed FROM a
""")
def q_agreement(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_partkey").alias("page")).agg(F.round(1 - F.sum(F.round(F.col("l_discount") * 100).cast("long") + F.round(F.col("l_tax") * 100).cast("long")) / (200.0 * F.count(F.lit(1))), 12).alias("score"))
    return ranks.placed(rows, "place", F.desc("score"), ties=True).withColumn("agreed", F.col("score") > 0.95)


@query("""
WITH s AS (SELECT conv_id, turn // 2 AS section, turn % 2 AS method, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations),
p AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.w, []) AS x, coalesce(b.w, []) AS y FROM (SELECT * FROM s WHERE method = 0) a FULL JOIN (SELECT * FROM s WHERE method = 1) b ON a.conv_id = b.conv_id AND a.section = b.section)
SELECT conv_id, round(avg(CASE WHEN len(list_distinct(x || y)) = 0 THEN 1 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y))::DOUBLE END), 6) AS overlap, count(*) AS sections FROM p GROUP BY 1
""")
def q_section_overlap(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.expr("turn div 2").alias("section"), (F.col("turn") % 2).alias("method"), tx.token_set(F.col("text")).alias("w"))
    one, two = (rows.where(F.col("method") == k).select("conv_id", "section", F.col("w").alias(name)) for k, name in ((0, "x"), (1, "y")))
    none = F.array().cast("array<string>")
    both = one.join(two, ["conv_id", "section"], "full_outer")
    return both.groupBy("conv_id").agg(r6(F.avg(tx.jaccard(F.coalesce("x", none), F.coalesce("y", none)))).alias("overlap"), F.count(F.lit(1)).alias("sections"))


_STRIP = "trim({}, ' ' || chr(10) || chr(9) || chr(13) || chr(12) || chr(11))"


@query(f"""
WITH b AS (SELECT doc_id, unnest(string_split_regex(text, '\\n{{2,}}')) AS part FROM documents), s AS (SELECT doc_id, {_STRIP.format('part')} AS block FROM b)
SELECT doc_id, count(*) AS blocks, sum(length(block))::BIGINT AS size, true AS placed FROM s WHERE block <> '' GROUP BY 1
""")
def q_blocks(t: Tables) -> DataFrame:
    rows = headings.blocks(t.documents, "doc_id", "text").join(t.documents.select("doc_id", "text"), "doc_id")
    placed = F.substring("text", F.col("start") + 1, F.length("block")) == F.col("block")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("block")).alias("size"), F.bool_and(placed).alias("placed"))


_WORDS = "len(string_split_regex(s, '\\s+'))"
_SUB = " OR ".join(f"regexp_matches(s, '{p}')" for p in headings.SUB_PATTERNS)


@query(f"""
WITH l AS (SELECT doc_id, {_STRIP.format('line')} AS s, {_STRIP.format("regexp_replace(line, '\\s+', ' ', 'g')")} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
m AS (SELECT *, regexp_matches(s, '{headings.CAPITALS}') AND {_WORDS} <= 16 AND regexp_matches(s, '[A-Z]') AND length(s) <= 120 AND NOT ends_with(s, '.') AS all_caps, regexp_extract_all(s, '[A-Za-z][A-Za-z''/-]*') AS names FROM l),
f AS (SELECT *, len(names) BETWEEN 1 AND 14 AND len(list_filter(names, lambda w: regexp_matches(w, '^[A-Z]') AND w <> upper(w))) >= 0.65 * len(names) AND length(s) <= 120 AND NOT ends_with(s, '.') AS title_case,
 regexp_matches(s, '{headings.NUMBERED}') AS number, ends_with(s, ':') AND {_WORDS} <= 18 AS colon, ends_with(s, '.') AND {_WORDS} <= 10 AS short, regexp_matches(s, '(?i){"|".join(headings.TOP_PATTERNS)}') AS top_pattern, {_SUB} AS sub_pattern,
 regexp_matches(lower(t), '^(?:{"|".join(headings.TOP_TITLES)})(?: |$)') AS top_title FROM m),
g AS (SELECT *, length(s) BETWEEN 3 AND 120 AND {_WORDS} <= CASE WHEN contains(s, ',') THEN 18 ELSE 24 END AND NOT ends_with(s, ';') AND (all_caps OR title_case OR number OR colon OR short OR top_pattern OR sub_pattern OR top_title) AS heading FROM f)
SELECT doc_id, count(*) AS lines, {", ".join(f"count(*) FILTER ({m}) AS {m}" for m in ("all_caps", "title_case", "number", "colon", "short", "top_pattern", "sub_pattern", "top_title", "heading"))} FROM g GROUP BY 1
""")
def q_heading_marks(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    marks = headings.heading_marks(F.col("line")) | {"heading": headings.heading_like(F.col("line"))}
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), *(F.count_if(c).alias(k) for k, c in marks.items()))


@query("""
WITH b AS (SELECT user_id, hour(ts)::INT AS start, CASE WHEN event_type = 'click' THEN 'top' ELSE 'sub' END AS level, round(value / 100, 4) AS confidence, event_id::VARCHAR AS title FROM events)
SELECT * FROM b WHERE confidence >= 0.25 QUALIFY row_number() OVER (PARTITION BY user_id, start ORDER BY CASE level WHEN 'top' THEN 0 ELSE 1 END, confidence DESC, title) = 1
""")
def q_verified_boundaries(t: Tables) -> DataFrame:
    level = F.when(F.col("event_type") == "click", "top").otherwise("sub")
    rows = t.events.select("user_id", F.hour("ts").alias("start"), level.alias("level"), F.round(F.col("value") / 100, 4).alias("confidence"), F.col("event_id").cast("string").alias("title"))
    return headings.verified(rows, "user_id")


@query()
def q_assembled_segments(t: Tables) -> DataFrame:
    found = headings.blocks(t.documents, "doc_id", "text")
    level = F.when(F.length("heading") <= 40, "top").otherwise("sub")
    return headings.assembled(found.select("doc_id", "start", level.alias("level"), F.col("heading").alias("title")), t.documents, "doc_id", "text")


@query(f"""
WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n\\s*\\n')) AS x FROM documents) SELECT doc_id, count(*) AS sentences, sum(length({_STRIP.format('x')}))::BIGINT AS size FROM s WHERE {_STRIP.format('x')} <> '' GROUP BY 1
""")
def q_sentence_blank(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(tx.split_sentences(F.col("text"))).alias("x"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("x")).alias("size"))


@query("SELECT item_id, left(text, floor(length(text) * 0.1)::INT) AS plan, substr(text, 11, least(length(text), 40) - 10) AS around FROM benchmark")
def q_context(t: Tables) -> DataFrame:
    at = F.least(F.lit(20), F.length("text"))
    return t.benchmark.select("item_id", tx.prefix_share(F.col("text")).alias("plan"), tx.around(F.col("text"), at, at + 10, 10).alias("around"))


_PAGES = "SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM conversations"


@query(f"""
WITH p AS (SELECT conv_id, turn, s, s + length(text) AS e FROM ({_PAGES})), x AS (SELECT DISTINCT conv_id, 50 AS a, 450 AS b FROM p), f AS (SELECT conv_id, min(turn) AS first FROM p GROUP BY 1),
h AS (SELECT p.conv_id, turn, (greatest(s, a) - s)::BIGINT AS local_start, (least(e, b) - s)::BIGINT AS local_end FROM p JOIN x ON p.conv_id = x.conv_id AND s < b AND e > a)
SELECT f.conv_id, coalesce(turn, first) AS turn, coalesce(local_start, -1) AS local_start, coalesce(local_end, -1) AS local_end FROM f LEFT JOIN h ON h.conv_id = f.conv_id
""")
def q_extraction_pages(t: Tables) -> DataFrame:
    pages = spans.page_offsets(t.conversations, "conv_id", "turn", "text").select("conv_id", "turn", "start", "end")
    wanted = pages.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumns({"a": F.lit(50).cast("long"), "b": F.lit(450).cast("long")})
    hits = wanted.join(pages.withColumnRenamed("conv_id", "c"), (F.col("conv_id") == F.col("c")) & spans.overlaps(F.col("start"), F.col("end"), F.col("a"), F.col("b")), "left")
    return hits.select("conv_id", F.coalesce("turn", "first").alias("turn"), F.coalesce(F.greatest("start", "a") - F.col("start"), F.lit(-1)).alias("local_start"), F.coalesce(F.least("end", "b") - F.col("start"), F.lit(-1)).alias("local_end"))


@query("SELECT source, count(*) AS entries, sum(least(length(text), 1800))::BIGINT AS chars, count(*) FILTER (length(text) > 1800) AS truncated FROM documents GROUP BY 1")
def q_entry_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.length(F.left("text", F.lit(1800)))).alias("chars"), F.count_if(F.length("text") > 1800).alias("truncated"))


@query("SELECT source, doc_id, left(text, 1800) AS excerpt FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '-7'), doc_id) <= 10")
def q_sample_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id")
    return t.documents.withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("source", "doc_id", F.left("text", F.lit(1800)).alias("excerpt"))


@query()
def q_corpus_budget(t: Tables) -> DataFrame:
    own = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda s: s["n"]).alias("sizes"))
    return own.select("conv_id", headings.within_budget(F.col("sizes"), 600).alias("b")).select("conv_id", "b.used", F.size(F.filter("b.taken", lambda x: x)).alias("included"))


@query()
def q_refined_chunks(t: Tables) -> DataFrame:
    seeds = t.documents.select("doc_id", F.length("text").alias("size"), F.explode(chunks.match_spans([r"\b(?:the|der|el)\b"])(F.col("text"))).alias("m"))
    near = seeds.select("doc_id", F.greatest(F.lit(0), F.col("m.start") - 150).alias("start"), F.least("size", F.col("m.end") + 150).alias("end"))
    rows = spans.merged(near, ["doc_id"], "start", "end", gap=50).join(t.documents.select("doc_id", "text"), "doc_id")
    part = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    cut = rows.select("doc_id", "start", F.explode(chunks.chunks(1000, 0.1)(part)).alias("c"))
    return cut.select("doc_id", (F.col("start") + F.col("c.start")).alias("start"), (F.col("start") + F.col("c.end")).alias("end"))


@query()
def q_dbscan(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = graphs.density_clusters(rows, 0.35, 3)
    return found.select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "core")
