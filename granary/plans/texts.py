"""Texts, spans, sentences and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import authority, chunks, neighbours, records, spans

from .registry import Tables, query
from .scores import r6


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY 1")
def q_join_pages(t: Tables) -> DataFrame:
    return spans.join_pages(t.conversations, "conv_id", "turn", "text")


_SPANS = "SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM conversations"


@query(f'SELECT conv_id, turn, s AS start, (s + length(text))::BIGINT AS "end" FROM ({_SPANS})')
def q_page_offsets(t: Tables) -> DataFrame:
    return spans.page_offsets(t.conversations, "conv_id", "turn", "text").select("conv_id", "turn", "start", F.col("end").cast("long").alias("end"))


@query(f"""
WITH p AS ({_SPANS}), d AS (SELECT conv_id, max(s + length(text)) AS size FROM p GROUP BY 1), c AS (SELECT conv_id, s, size FROM p JOIN d USING (conv_id) WHERE role = 'user' UNION SELECT conv_id, 0, size FROM d),
e AS (SELECT conv_id, s, lead(s, 1, size) OVER (PARTITION BY conv_id ORDER BY s) AS e FROM c) SELECT conv_id, s::BIGINT AS start, e::BIGINT AS "end", row_number() OVER (PARTITION BY conv_id ORDER BY s) AS segment_number FROM e WHERE e > s
""")
def q_segments_from_boundaries(t: Tables) -> DataFrame:
    pages = spans.page_offsets(t.conversations, "conv_id", "turn", "text")
    sized = pages.join(pages.groupBy("conv_id").agg(F.max("end").alias("size")), "conv_id")
    bounded = sized.withColumn("start", F.when(F.col("role") == "user", F.col("start")).otherwise(0))
    return spans.segments(bounded.select("conv_id", "start", "size"), "conv_id", "start", "size").select("conv_id", "start", "end", "segment_number")


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS heading FROM conversations")
def q_carry_forward(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w), F.lit(-1)).alias("heading"))


@query(f"""
WITH p AS (SELECT conv_id, turn, s, s + length(text) AS e FROM ({_SPANS})), z AS (SELECT conv_id, max(e) AS size FROM p GROUP BY 1),
w AS (SELECT conv_id, unnest(range(0, size, 500)) AS ws, size FROM z)
SELECT p.conv_id, turn, (ws // 500)::BIGINT AS part, (greatest(s, ws) - s)::BIGINT AS local_start, (least(e, ws + 500) - s)::BIGINT AS local_end FROM p JOIN w ON p.conv_id = w.conv_id AND s < ws + 500 AND e > ws
""")
def q_segment_page_overlap(t: Tables) -> DataFrame:
    pages = spans.page_offsets(t.conversations, "conv_id", "turn", "text").select("conv_id", "turn", "start", "end")
    windows = pages.groupBy("conv_id").agg(F.max("end").alias("size")).where("size > 0").select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(size - 1) div 500"))).alias("part"))
    windows = windows.withColumn("ws", F.col("part") * 500)
    hits = pages.join(windows, "conv_id").where(spans.overlaps(F.col("start"), F.col("end"), F.col("ws"), F.col("ws") + 500))
    return hits.select("conv_id", "turn", "part", (F.greatest("start", "ws") - F.col("start")).alias("local_start"), (F.least(F.col("end"), F.col("ws") + 500) - F.col("start")).alias("local_end"))


_EVENTS = "SELECT user_id, event_type, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + {} AS e FROM events"


def event_spans(t: Tables, seconds: int) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t.events.select("user_id", "event_type", at.alias("s"), (at + seconds).alias("e"))


def _merge_sql(source: str, by: str, gap: int = 0) -> str:
    return f"""(SELECT {by}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} OR row_number() OVER (PARTITION BY {by} ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS f FROM ({source}))) GROUP BY {by}, g)"""


@query(f"SELECT user_id, s::BIGINT AS s, e::BIGINT AS e FROM {_merge_sql(_EVENTS.format(14400), 'user_id', 600)}")
def q_interval_merge(t: Tables) -> DataFrame:
    return spans.merged(event_spans(t, 14400), ["user_id"], "s", "e", gap=600)


@query(f"""
WITH a AS (SELECT * FROM {_merge_sql(_EVENTS.format(14400) + " WHERE event_type = 'click'", 'user_id')}), b AS (SELECT * FROM {_merge_sql(_EVENTS.format(14400) + " WHERE event_type = 'view'", 'user_id')}),
la AS (SELECT user_id, sum(e - s)::BIGINT AS len_a FROM a GROUP BY 1), lb AS (SELECT user_id, sum(e - s)::BIGINT AS len_b FROM b GROUP BY 1),
i AS (SELECT a.user_id, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS inter FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND a.e > b.s GROUP BY 1)
SELECT user_id, coalesce(len_a, 0) AS len_a, coalesce(len_b, 0) AS len_b, coalesce(inter, 0) AS inter, coalesce(len_a, 0) + coalesce(len_b, 0) - coalesce(inter, 0) AS "union", round(coalesce(inter, 0) / (coalesce(len_a, 0) + coalesce(len_b, 0) - coalesce(inter, 0))::DOUBLE, 6) AS iou
FROM la FULL JOIN lb USING (user_id) LEFT JOIN i USING (user_id)
""")
def q_interval_iou(t: Tables) -> DataFrame:
    rows = event_spans(t, 14400)
    a, b = (rows.where(F.col("event_type") == k).select("user_id", "s", "e") for k in ("click", "view"))
    return spans.interval_iou(a, b, ["user_id"], "s", "e").withColumn("iou", r6("iou"))


@query(f"""
WITH r AS (SELECT *, event_id FROM (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 14400 AS e FROM events))
SELECT event_id, CASE WHEN lag(e) OVER w IS NULL THEN 'first' WHEN s < lag(e) OVER w THEN 'overlap' WHEN s = lag(e) OVER w THEN 'touch' ELSE 'gap' END AS issue FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)
""")
def q_span_issues(t: Tables) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    before = F.lag(at + 14400).over(Window.partitionBy("user_id").orderBy(at, "event_id"))
    return t.events.select("event_id", F.when(before.isNull(), "first").when(at < before, "overlap").when(at == before, "touch").otherwise("gap").alias("issue"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
SELECT doc_id, (k - 1)::INT AS line_no, s::BIGINT AS start, (s + length(line))::BIGINT AS "end" FROM o WHERE trim(line) <> ''
""")
def q_lines(t: Tables) -> DataFrame:
    return spans.lines(t.documents, "doc_id", "text").where(F.trim("line") != "").select("doc_id", "line_no", "start", "end")


_STRIPPED = "list_filter(list_transform({}, lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13) || chr(12) || chr(11))), lambda x: x <> '')"
_MARKED = _STRIPPED.format(r"regexp_extract_all(text, '[^.!?\n]+[.!?]+(?:\s+|$)|[^.!?\n]+(?:\n|$)')")


@query(f"""
WITH s AS (SELECT doc_id, {_MARKED} AS m, {_STRIPPED.format("string_split(coalesce(text, ''), chr(10))")} AS l FROM documents), c AS (SELECT doc_id, CASE WHEN len(m) > 1 THEN m ELSE l END AS m FROM s)
SELECT doc_id, len(m)::INT AS n_sentences, coalesce(m[1], '') AS first_one FROM c
""")
def q_sentence_split(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", tx.sentences(F.coalesce("text", F.lit(""))).alias("m"))
    return rows.select("doc_id", F.size("m").alias("n_sentences"), F.coalesce(F.get("m", F.lit(0)), F.lit("")).alias("first_one"))


@query(f"""
WITH s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
SELECT a.doc_id, len(list_intersect(a.w, b.w))::INT AS shared, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE, 6) AS jaccard FROM s a JOIN s b ON b.doc_id = a.doc_id + 1
""")
def q_token_jaccard(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", tx.token_set(F.col("text")).alias("w"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return rows.join(after, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).alias("shared"), r6(tx.jaccard(F.col("w"), F.col("v"))).alias("jaccard"))


#: DuckDB's levenshtein counts bytes, so its SQL first puts one unused ASCII character for each other letter.
_WIDE = "éèêçäöüßáíóúñÉÈÊÇÄÖÜÁÍÓÚÑàâîôùûëïœÀÂÎÔ"
_NARROW = "".join(chr(c) for c in (*range(1, 9), *range(14, 28), *map(ord, "@#^~{}[]<>$%&*+=_|")))[: len(_WIDE)]
_WORDS = "SELECT item_id, translate(trim(regexp_replace(text, '\\s+', ' ', 'g')), '" + _WIDE + "', '" + _NARROW + "') AS x FROM benchmark"


def _pairs(t: Tables) -> DataFrame:
    a = t.benchmark.select("item_id", tx.norm_space(F.col("text")).alias("a"))
    return a.join(a.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")


@query(f"""
WITH n AS ({_WORDS})
SELECT a.item_id, round(levenshtein(a.x, b.x) / length(a.x)::DOUBLE, 6) AS cer FROM n a JOIN n b ON b.item_id = a.item_id + 1
""")
def q_cer(t: Tables) -> DataFrame:
    return _pairs(t).select("item_id", r6(tx.error_rate(F.col("a"), F.col("b"))).alias("cer"))


@query()
def q_wer(t: Tables) -> DataFrame:
    return _pairs(t).select("item_id", r6(chunks.word_error_rate(F.col("a"), F.col("b"))).alias("wer"))


@query(f"""
WITH n AS (SELECT *, item_id % 4 AS grp FROM ({_WORDS})),
p AS (SELECT a.grp, levenshtein(a.x, b.x) / length(a.x)::DOUBLE AS cer FROM n a JOIN n b ON b.item_id = a.item_id + 1)
SELECT grp::BIGINT AS grp, count(*) AS n, round(avg(cer), 6) AS mean, round(list_sort(list(cer))[count(*) // 2 + 1], 6) AS upper_median, round(1 - avg(cer), 6) AS agreement FROM p GROUP BY 1
""")
def q_upper_median_pairs(t: Tables) -> DataFrame:
    rows = _pairs(t).select((F.col("item_id") % 4).alias("grp"), tx.error_rate(F.col("a"), F.col("b")).alias("cer"))
    upper = F.element_at(F.array_sort(F.collect_list("cer")), (F.count("cer") / 2).cast("int") + 1)
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cer")).alias("mean"), r6(upper).alias("upper_median"), r6(1 - F.avg("cer")).alias("agreement"))


LEXICON = {"worker": ["the", "and"], "firm": ["in", "for"], "union": ["that"], "manager": ["with", "was"]}
_AGENTS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(?:^|[^\\pL\\pN_])(?:{'|'.join(w)})(?:$|[^\\pL\\pN_])') THEN '{a}' END" for a, w in LEXICON.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_AGENTS}, ',') AS agents FROM documents")
def q_agent_match(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(authority.agents(F.col("text"), LEXICON), ",").alias("agents"))


@query(f"WITH a AS (SELECT doc_id, CASE WHEN len({_AGENTS}) > 0 THEN {_AGENTS} ELSE ['other'] END AS l FROM documents) SELECT doc_id, unnest(l) AS agent, (generate_subscripts(l, 1) - 1)::INT AS ordinal FROM a")
def q_statement_explode(t: Tables) -> DataFrame:
    found = authority.statements(authority.agents(F.col("text"), LEXICON))
    return t.documents.select("doc_id", F.posexplode(found).alias("ordinal", "agent"))


_BITS = {"neg": 1, "strict": 2, "permissive": 3, "modal": 4, "active": 5, "passive": 6, "obliges": 7, "constrains": 8, "permits": 9, "entitles": 10}


@query(
    "WITH b AS (SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"(l_partkey * 7 + l_suppkey * {k} + l_linenumber) % {k + 2} < {k + 2} / 2.0 AS {n}" for n, k in _BITS.items())
    + """ FROM lineitem), f AS (SELECT l_orderkey, l_linenumber, NOT neg AND ((strict AND active) OR (strict AND obliges) OR (NOT modal AND obliges)) AS obligation,
 (neg AND modal AND active) OR (NOT neg AND strict AND constrains) OR (neg AND passive AND (entitles OR permits)) AS "constraint", (NOT neg AND ((permissive AND active) OR permits)) OR (neg AND constrains) AS permission,
 (NOT neg AND entitles) OR (neg AND obliges) AS entitlement FROM b)
SELECT CASE WHEN "constraint" THEN 'prohibitions' WHEN entitlement THEN 'rights' WHEN permission THEN 'permissions' WHEN obligation THEN 'obligations' ELSE 'other' END AS kind, obligation, "constraint", permission, entitlement, count(*) AS n FROM f GROUP BY ALL
"""
)
def q_auth_flags(t: Tables) -> DataFrame:
    bits = [(F.expr(f"(l_partkey * 7 + l_suppkey * {k} + l_linenumber) % {k + 2}") < (k + 2) / 2.0) for k in _BITS.values()]
    found = authority.flags(*bits)
    rows = t.lineitem.select(authority.sentence_type(found).alias("kind"), *(c.alias(n) for n, c in found.items()))
    return rows.groupBy("kind", *found).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT label AS proto_id, embedding AS proto FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT vec_id AS id, proto_id, list_cosine_similarity(embedding::DOUBLE[], proto::DOUBLE[]) AS c FROM embeddings CROSS JOIN p)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY c DESC, proto_id)::INT AS rank, proto_id, round(c, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, proto_id) <= 5
""")
def q_knn_topk(t: Tables) -> DataFrame:
    first = t.embeddings.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("rn = 1")
    protos = first.select(F.col("label").alias("proto_id"), F.col("embedding").alias("proto"))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.cosine_topk(rows, protos, 5).withColumn("similarity", r6("similarity"))


@query("""
WITH s AS (SELECT label, vec_id, list_cosine_similarity(lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[], embedding::DOUBLE[]) AS sim FROM embeddings),
b AS (SELECT *, CASE WHEN abs(sim - lag(sim) OVER (PARTITION BY label ORDER BY vec_id)) > 0.15 THEN 1 ELSE 0 END AS brk FROM s)
SELECT label, vec_id, round(sim, 6) AS sim, sum(brk) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS grp FROM b
""")
def q_shift_breaks(t: Tables) -> DataFrame:
    return neighbours.shift_breaks(t.embeddings, "label", "vec_id", "embedding").select("label", "vec_id", r6("sim").alias("sim"), "grp")


@query(r"""
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS norm_key, trim(regexp_replace(p_type || '/' || p_brand, '[^a-zA-Z0-9._-]+', '_', 'g'), '_') AS slug,
 trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS snake, coalesce(try_cast(nullif(regexp_extract(p_brand, '(\d+)$', 1), '') AS BIGINT), 1000000000) AS brand_no FROM part
""")
def q_norm_keys(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        tx.norm_key(F.concat("p_name", F.lit(" / "), "p_brand")).alias("norm_key"),
        tx.slug(F.concat("p_type", F.lit("/"), "p_brand")).alias("slug"),
        tx.snake(F.col("p_type")).alias("snake"),
        tx.trailing_number(F.col("p_brand"), 10**9).alias("brand_no"),
    )


@query(r"""
WITH n AS (SELECT item_id, regexp_extract(trim(regexp_replace(text, '\s+', ' ', 'g')), '^.*?[.!?](?:\s|$)|^.*$') AS f FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(trim(f), '[.!?]$') OR trim(f) = '' THEN trim(f) ELSE trim(f) || '.' END AS first_sentence FROM n
""")
def q_first_sentence(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", tx.first_sentence(F.col("text")).alias("first_sentence"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IS NOT NULL AS has_k, least(5, greatest(1, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 3))) AS score FROM events")
def q_json_fields(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", k.try_cast("bigint").alias("k"), k.isNotNull().alias("has_k"), tx.clamp_score(k).alias("score"))


@query(r"""
WITH h AS (SELECT b.item_id, d.doc_id, d.text, CASE WHEN instr(d.text, b.text) > 0 THEN instr(d.text, b.text) ELSE instr(lower(d.text), lower(b.text)) END AS p FROM benchmark b JOIN documents d ON instr(lower(d.text), lower(b.text)) > 0)
SELECT item_id, doc_id, (p - 1)::INT AS start, substr(text, greatest(1, p - 30), 60) AS context FROM h
""")
def q_find_span(t: Tables) -> DataFrame:
    items = t.benchmark.select("item_id", F.col("text").alias("part"))
    hits = records.against_all(t.documents.select("doc_id", "text"), items, "doc_id", "item_id", "part", F.instr(F.lower("text"), F.lower("part")) > 0)
    start = F.col("start")
    rows = hits.select("item_id", "doc_id", "text", tx.span_of(F.col("text"), F.col("part")).alias("start"))
    return rows.select("item_id", "doc_id", "start", F.substring("text", F.greatest(F.lit(1), start - 29), F.lit(60)).alias("context"))


@query()
def q_boundary_candidates(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(chunks.match_spans([r"^[A-Z][a-z]+\.$", r"(broken", r"\bthe\b"])(F.col("text"))).alias("m")).select("doc_id", "m.start", "m.end")


@query()
def q_nonoverlap(t: Tables) -> DataFrame:
    own = event_spans(t, 14400).groupBy("user_id").agg(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end"))).alias("x"))
    return own.select("user_id", F.size(spans.without_overlaps(F.col("x"), "earlier")).alias("earlier"), F.size(spans.without_overlaps(F.col("x"), "longer")).alias("longer"))


@query()
def q_chunk(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(chunks.chunks(1000, 0.1)(F.col("text"))).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.start", "c.end")
