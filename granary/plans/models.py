"""What is asked of models, by stand-ins, and how their answers are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import model
from granary.functions import text as tx
from granary.operators import chunks, headings
from granary.sources import sinks

from .records import classified
from .registry import Tables, query
from .scores import r6


@query("SELECT p_partkey, trim(p_name) AS likeliest, CASE WHEN p_partkey % 3 = 0 THEN 'OTHER' ELSE p_type END AS valid FROM part")
def q_model_labels(t: Tables) -> DataFrame:
    rows = classified(t).join(t.part.select("p_partkey", "p_type", "p_brand"), "p_partkey")
    answer = F.when(F.col("p_partkey") % 3 == 0, "something else").otherwise(F.concat(F.lit(" "), F.lower("p_type"), F.lit("!")))
    best = model.likeliest(tx.flat_candidates(F.col("candidates")))
    return rows.select("p_partkey", best.alias("likeliest"), model.valid_label(answer, F.array("p_brand", "p_type")).alias("valid"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'OTHER' WHEN 1 THEN event_type || ',pay' WHEN 2 THEN event_type || ',pay' ELSE 'OTHER' END AS labels FROM events
""")
def q_page_labels(t: Tables) -> DataFrame:
    form, kind = F.col("event_id") % 4, F.col("event_type")
    answer = F.when(form == 0, "I cannot help with that.").when(form == 1, F.concat(F.lit('["'), kind, F.lit('", " ", "pay", "'), kind, F.lit('"]'))).when(form == 2, F.concat(F.lit("- "), kind, F.lit("\n2) pay\n\n* "), kind))
    return t.events.select("event_id", F.array_join(model.page_labels(answer), ",").alias("labels"))


@query("""
WITH p AS (SELECT doc_id, substr(text, 11, 400) AS chunk FROM documents) SELECT doc_id, CASE WHEN length(chunk) >= 40 THEN 'A title:' || (10 + instr(chunk, substr(chunk, 21, 20)) - 1) || ':' || (10 + instr(chunk, substr(chunk, 21, 20)) + 19) ELSE '' END AS spans FROM p WHERE chunk IS NOT NULL
""")
def q_located_pieces(t: Tables) -> DataFrame:
    part = F.substring("text", 11, 400)
    rows = t.documents.where("text is not null").select("doc_id", part.alias("chunk"))
    quoted = F.when(F.length("chunk") >= 40, F.substring("chunk", 21, 20)).otherwise("")
    pieces = F.array(F.struct(F.lit(" A  title").alias("title"), quoted.alias("text")), F.struct(F.lit("none").alias("title"), F.lit("\x01not there").alias("text")))
    found = model.located(F.col("chunk"), F.lit(10), pieces)
    said = F.transform(found, lambda p: F.concat_ws(":", p["title"], p["start"].cast("string"), p["end"].cast("string")))
    return rows.select("doc_id", F.array_join(said, ",").alias("spans"))


_RATE = "('0x' || left(md5(s_name || '|{a}|{k}'), 4))::INT % 101"


@query("SELECT s_suppkey, " + ", ".join("round((" + " + ".join(_RATE.format(a=a, k=k) for k in range(3)) + f") / 3.0::DOUBLE, 6) AS {a}" for a in ("cost", "breadth")) + " FROM supplier")
def q_model_rates(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", model.rated(F.col("s_name"), ["cost", "breadth"]).alias("r"))
    return rows.select("s_suppkey", r6("r.cost").alias("cost"), r6("r.breadth").alias("breadth"))


@query("SELECT c_custkey, round(c_acctbal, 2) AS amount, c_custkey % 2 = 0 AS agreed, CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'Maybe' END || ' ' || printf('%.2f', round(c_acctbal, 2)) || ' a month.' AS note FROM customer")
def q_model_fields(t: Tables) -> DataFrame:
    word = F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("Maybe")
    # Rounded as SQL does: it is the product with 100 that may reach a half, and a zero keeps its sign.
    balance = F.round(F.abs("c_acctbal") * 100) / 100
    shown = F.concat(F.when(F.col("c_acctbal").cast("string").startswith("-"), "-").otherwise(""), F.format_string("%.2f", balance))
    text = F.concat_ws(" ", word, F.when(F.col("c_acctbal").isNotNull(), shown), F.lit("a month. More"))
    found = t.customer.select("c_custkey", "c_acctbal", model.extracted(text, {"amount": "number", "agreed": "boolean", "note": "string"}).alias("x"))
    note = F.when(F.col("c_acctbal").isNotNull(), F.col("x.note.str"))
    return found.select("c_custkey", F.col("x.amount.num").alias("amount"), F.coalesce("x.agreed.bool", F.lit(False)).alias("agreed"), note.alias("note"))


@query("""
WITH r AS (SELECT c_mktsegment, c_custkey, round(c_acctbal * 100) AS x, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '|0'), c_custkey) AS rn FROM customer),
o AS (SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after FROM r WINDOW w AS (PARTITION BY c_mktsegment ORDER BY rn)),
m AS (SELECT *, CASE rn % 2 WHEN 1 THEN after ELSE before END AS one, CASE rn % 2 WHEN 1 THEN before ELSE after END AS two FROM o),
p AS (SELECT c_mktsegment, c_custkey, coalesce((sign(x - one) + 1) / 2.0, 0.5) + coalesce((sign(x - two) + 1) / 2.0, 0.5) AS points FROM m)
SELECT c_mktsegment, c_custkey, points::DOUBLE AS points, round((points - avg(points) OVER (PARTITION BY c_mktsegment)) / nullif(stddev_pop(points) OVER (PARTITION BY c_mktsegment), 0), 6) AS score FROM p
""")
def q_tournament(t: Tables) -> DataFrame:
    """One round of two matches, in which the higher balance wins."""
    rows = t.customer.select("c_mktsegment", "c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"))
    found = model.tournament(rows, "c_mktsegment", "c_custkey", "balance", lambda a, b: (F.signum(a - b) + 1) / 2, rounds=1, matches=2)
    return found.select("c_mktsegment", "c_custkey", "points", r6("score").alias("score"))


@query()
def q_plan(t: Tables) -> DataFrame:
    """Plans of documents by their first lines, and the boundaries that their rules propose."""
    head = F.slice(F.split(tx.prefix_share(F.col("text"), 0.5), "\n"), 1, 40)
    rows = t.documents.select("doc_id", model.plan(head, headings.heading_like).alias("p"))
    return rows.select("doc_id", "p.segment_type", F.size("p.segment_header_examples").alias("examples"), F.array_join("p.segment_header_rules", " ").alias("rules"))


@query("""
WITH m AS (SELECT doc_id, len(regexp_extract_all(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n')) AS breaks FROM documents) SELECT doc_id, breaks::INT AS candidates FROM m WHERE breaks > 0
""")
def q_boundary_fallback(t: Tables) -> DataFrame:
    """Blank lines stand in where no rule is valid or none matches."""
    found = chunks.match_spans([r"(broken", r"\x01"], overlapping=True, otherwise=r"\n\n")(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return t.documents.select("doc_id", F.size(found).alias("candidates")).where("candidates > 0")


@query("SELECT conv_id::VARCHAR AS document_id, string_agg(text, chr(10) ORDER BY 'page_' || printf('%04d', turn) || '.txt') AS full_text FROM conversations GROUP BY 1")
def q_full_texts(t: Tables) -> DataFrame:
    pages = t.conversations.select(F.col("conv_id").cast("string").alias("document_id"), F.format_string("page_%04d.txt", F.col("turn")).alias("file"), "text")
    return sinks.full_texts(pages)
