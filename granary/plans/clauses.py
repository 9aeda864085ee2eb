"""Clauses from sentences to counts: modality, verb classes, agents, flags, evidence, and what is made of them.

The driver's texts have no such words, so sentences are put together from the keys of `orders`; operators read
the sentences, and the SQL says from the keys what they must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import lexicon as lx
from granary.functions import stats
from granary.operators import authority, modality

from .registry import Tables, query
from .scores import r6

SUBJECTS = ["The employee", "The employer", "The union", "The workers union", "The manager", "Overtime", "Members of the board"]
AUXILIARIES = ["shall", "must", "will", "may", "can", "should", "has to", ""]
VERBS = ["required to attend", "prohibited from smoking", "allowed to leave", "paid out weekly", "given off", "agree to the terms", "receive a bonus", "commit to the plan", "work nights"]
PASSIVE = 5  # so many of the first


def sentences(t: Tables) -> DataFrame:
    """Orders with a sentence each, such as "The union shall not be allowed to leave"."""
    subject, aux, verb = F.col("o_custkey") % len(SUBJECTS), F.col("o_orderkey") % len(AUXILIARIES), F.col("o_custkey") % len(VERBS)
    said, passive, no = aux != len(AUXILIARIES) - 1, verb < PASSIVE, F.expr("(o_orderkey div 8) % 3 = 0")

    def pick(names: list[str], at: Column) -> Column:
        return F.element_at(modality.words_of(names), (at + 1).cast("int"))

    text = F.concat_ws(" ", pick(SUBJECTS, subject), F.when(said, pick(AUXILIARIES, aux)).when(passive, "is"), F.when(no, "not"), F.when(said & passive, "be"), pick(VERBS, verb))
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", text.alias("text"))


def read(t: Tables) -> DataFrame:
    """Sentences with their clause, its features, and the agents of their subject."""
    rows = modality.with_struct(sentences(t), "clause", modality.surface_clause(F.col("text")))
    subjects = F.array(F.regexp_extract("text", r"^(.*?) (?:shall|must|will|may|can|should|has|is|not)\b", 1))
    return modality.with_struct(rows, "f", modality.auth_features(F.col("clause"))).withColumn("agents", modality.subject_agents(subjects, F.col("text")))


def flags() -> dict[str, Column]:
    names = ("neg", "strict_modal", "permissive_modal", "md", "active_verb", "passive", "obligation_verb", "constraint_verb", "permission_verb", "entitlement_verb")
    return authority.flags(*(F.col(f"f.{n}") for n in names))


def typed(t: Tables) -> DataFrame:
    """(o_orderkey, o_custkey, o_orderpriority, o_orderstatus, type, agents), `other` where there is no agent."""
    found = F.struct(authority.sentence_type(flags()).alias("type"), authority.statements(F.col("agents")).alias("agents"))
    return modality.with_struct(read(t), "x", found).select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "x.type", "x.agents")


_KEYS = "k AS (SELECT *, (o_custkey % 7)::INT AS s, (o_orderkey % 8)::INT AS a, (o_orderkey // 8) % 3 = 0 AS neg, (o_custkey % 9)::INT AS v FROM orders)"
_FEATURES = f"""{_KEYS}, f AS (SELECT *, a <= 5 AS md, a <= 2 AS strict, a IN (3, 4, 5) AS permissive, v < 5 AS passive, v IN (0, 5) AS obliges, v = 1 AS constrains, v = 2 AS permits, v IN (3, 4, 6) AS entitles, v = 7 AS promises, v = 8 AS active,
 ['require', 'prohibit', 'allow', 'pay', 'give', 'agree', 'receive', 'commit', ''][v + 1] AS root, ['require', 'prohibit', 'allow', 'pay,pay_out', 'give,give_off', 'agree', 'receive', 'commit', ''][v + 1] AS variants,
 [['worker'], ['firm'], ['union'], ['union'], ['manager'], ['other'], ['worker', 'firm']][s + 1] AS agents FROM k),
g AS (SELECT *, (NOT neg AND strict AND active) OR (NOT neg AND strict AND obliges) OR (NOT neg AND NOT md AND obliges) AS obligation,
 (neg AND md AND active) OR (NOT neg AND strict AND constrains) OR (neg AND passive AND (entitles OR permits)) AS constraint_,
 (NOT neg AND ((permissive AND active) OR permits)) OR (neg AND constrains) AS permission, (NOT neg AND entitles) OR (neg AND obliges) AS entitlement FROM f),
h AS (SELECT *, CASE WHEN constraint_ THEN 'prohibitions' WHEN entitlement THEN 'rights' WHEN permission THEN 'permissions' WHEN obligation THEN 'obligations' ELSE 'other' END AS type FROM g)"""


@query(f"""
WITH {_KEYS} SELECT o_orderkey, CASE WHEN a <= 5 THEN ['shall', 'must', 'will', 'may', 'can', 'should'][a + 1] WHEN a = 6 THEN 'have_to' ELSE '' END AS modals, CASE WHEN a IN (3, 4) THEN 'permissive' WHEN a = 7 THEN 'none' ELSE 'restrictive' END AS force,
 neg, CASE WHEN v < 5 THEN 'passive' ELSE 'active' END AS voice FROM k
""")
def q_modal_features(t: Tables) -> DataFrame:
    rows = modality.with_struct(sentences(t), "c", modality.surface_clause(F.col("text")))
    return rows.select("o_orderkey", F.array_join("c.modal_verbs", ",").alias("modals"), F.col("c.modal_force").alias("force"), F.col("c.is_negative").alias("neg"), "c.voice")


@query(f"""
WITH {_KEYS} SELECT o_orderkey, CASE WHEN v = 1 THEN 'prohibition' WHEN v = 2 THEN 'permission' WHEN v IN (3, 6) THEN 'rights' WHEN v = 0 OR a = 6 THEN 'obligation' ELSE 'none' END AS special, neg AND (v = 0 OR (v = 4 AND a = 6)) AS protected FROM k
""")
def q_special_verb(t: Tables) -> DataFrame:
    rows = modality.with_struct(sentences(t), "c", modality.surface_clause(F.col("text")))
    return rows.select("o_orderkey", modality.special_verb(F.col("c"), F.col("text")).alias("special"), modality.negated_protection(F.col("c"), F.col("text")).alias("protected"))


@query(f"""
WITH {_FEATURES} SELECT o_orderkey, root, variants, CASE WHEN a <= 4 THEN ['shall', 'must', 'will', 'may', 'can'][a + 1] WHEN a = 6 THEN 'have_to' ELSE '' END AS modal, md, strict, permissive, passive, neg, obliges, constrains, permits, entitles, promises, active FROM f
""")
def q_auth_features(t: Tables) -> DataFrame:
    names = {"strict": "strict_modal", "permissive": "permissive_modal", "obliges": "obligation_verb", "constrains": "constraint_verb", "permits": "permission_verb", "entitles": "entitlement_verb", "promises": "promise_verb", "active": "active_verb"}
    rows = read(t)
    return rows.select("o_orderkey", F.col("f.root_verb").alias("root"), F.array_join("f.root_verb_variants", ",").alias("variants"), "f.modal", "f.md", "f.passive", "f.neg", *(F.col(f"f.{c}").alias(n) for n, c in names.items()))


def _said(name: str, value: str) -> str:
    return f"'auth:{name}=' || CASE WHEN {value} THEN 'True' ELSE 'False' END"


@query(f"""
WITH {_FEATURES} SELECT o_orderkey, array_to_string(list_filter([{", ".join(_said(n, v) for n, v in (("md", "md"), ("strict_modal", "strict"), ("permissive_modal", "permissive"), ("neg", "neg"), ("passive", "passive")))},
 'auth:root=' || CASE root WHEN '' THEN 'none' ELSE root END, CASE WHEN variants <> '' THEN 'auth:root_variants=' || variants END, CASE WHEN obliges THEN 'auth:obligation_verb' END, CASE WHEN constrains THEN 'auth:constraint_verb' END,
 CASE WHEN permits THEN 'auth:permission_verb' END, CASE WHEN entitles THEN 'auth:entitlement_verb' END, CASE WHEN promises THEN 'auth:promise_verb' END,
 'auth:labels=' || coalesce(nullif(array_to_string(list_filter([CASE WHEN obligation THEN 'obligation' END, CASE WHEN constraint_ THEN 'constraint' END, CASE WHEN permission THEN 'permission' END, CASE WHEN entitlement THEN 'entitlement' END], lambda x: x IS NOT NULL), ','), ''), 'none')], lambda x: x IS NOT NULL), '; ') AS evidence, type FROM h
""")
def q_auth_evidence(t: Tables) -> DataFrame:
    return read(t).select("o_orderkey", F.array_join(modality.auth_evidence(F.col("f"), flags()), "; ").alias("evidence"), authority.sentence_type(flags()).alias("type"))


@query(f"WITH {_FEATURES} SELECT o_orderkey, array_to_string(agents, ',') AS agents FROM f")
def q_subject_agents(t: Tables) -> DataFrame:
    return read(t).select("o_orderkey", F.array_join(authority.statements(F.col("agents")), ",").alias("agents"))


@query(f"WITH {_FEATURES} SELECT o_orderkey, type FROM h WHERE type = 'rights' AND list_contains(agents, 'worker')")
def q_sentence_filter(t: Tables) -> DataFrame:
    return typed(t).where((F.col("type") == "rights") & F.array_contains("agents", "worker")).select("o_orderkey", "type")


@query(f"WITH {_FEATURES}, x AS (SELECT o_orderkey, type, unnest(agents) AS agent FROM h) SELECT agent, type, o_orderkey FROM x QUALIFY row_number() OVER (PARTITION BY agent, type ORDER BY md5(o_orderkey::VARCHAR || '-7'), o_orderkey) = 1")
def q_sample_bucket(t: Tables) -> DataFrame:
    rows = typed(t).select("o_orderkey", "type", F.explode("agents").alias("agent"))
    first = F.min(F.struct(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("-7"))), "o_orderkey"))
    return rows.groupBy("agent", "type").agg(first.alias("m")).select("agent", "type", "m.o_orderkey")


AGENT_BUCKETS = [*lx.AGENTS, "other"]
_DOMAIN = f"d AS (SELECT unnest({AGENT_BUCKETS}) AS agent), y AS (SELECT unnest({lx.SENTENCE_TYPES}) AS type)"


@query(f"""
WITH {_FEATURES}, {_DOMAIN}, x AS (SELECT o_orderpriority, o_orderstatus, type, unnest(agents) AS agent FROM h),
l AS (SELECT coalesce(o_orderpriority, 'all') AS doc, coalesce(o_orderstatus, 'all') AS segment, grouping_id(o_orderpriority, o_orderstatus)::BIGINT AS level FROM h GROUP BY ROLLUP (o_orderpriority, o_orderstatus)),
c AS (SELECT coalesce(o_orderpriority, 'all') AS doc, coalesce(o_orderstatus, 'all') AS segment, grouping_id(o_orderpriority, o_orderstatus)::BIGINT AS level, agent, type, count(*) AS n FROM x GROUP BY ROLLUP (o_orderpriority, o_orderstatus), agent, type)
SELECT l.doc, l.segment, d.agent, y.type, coalesce(c.n, 0)::BIGINT AS n FROM l CROSS JOIN d CROSS JOIN y LEFT JOIN c ON c.doc = l.doc AND c.segment = l.segment AND c.level = l.level AND c.agent = d.agent AND c.type = y.type
""")
def q_sentence_counters(t: Tables) -> DataFrame:
    """Counts of agent and type for each segment, document and all, with zeros: one pass, a count a cell."""
    cells = {f"{a} {k}": F.count_if(F.array_contains("agents", a) & (F.col("type") == k)) for a in AGENT_BUCKETS for k in lx.SENTENCE_TYPES}
    wide = typed(t).rollup("o_orderpriority", "o_orderstatus").agg(*(c.alias(n) for n, c in cells.items()))
    rows = wide.select("*", F.explode(F.create_map(*(x for n in cells for x in (F.lit(n), F.col(f"`{n}`"))))).alias("cell", "n"))
    cell = F.split("cell", " ")
    return rows.select(F.coalesce("o_orderpriority", F.lit("all")).alias("doc"), F.coalesce("o_orderstatus", F.lit("all")).alias("segment"), cell[0].alias("agent"), cell[1].alias("type"), "n")


@query(f"""
WITH {_FEATURES}, x AS (SELECT type, unnest(agents) AS agent FROM h), n AS (SELECT count(*) FILTER (type <> 'other')::DOUBLE AS named FROM x),
c AS (SELECT coalesce(agent, 'total') AS agent, coalesce(type, 'total') AS type, count(*) AS n FROM x GROUP BY CUBE (agent, type))
SELECT agent, type, c.n, round(CASE WHEN type <> 'other' AND named > 0 THEN 100 * c.n / named END, 6) AS pct, (SELECT count(*) FROM h WHERE len(agents) > 1) AS several, (SELECT count(*) FROM h WHERE agents = ['other']) AS none FROM c CROSS JOIN n
""")
def q_agent_clause_table(t: Tables) -> DataFrame:
    """The cross table of agents and types, its totals, shares of assignments that have a type, and how many
    sentences have several agents or none."""
    rows = typed(t)
    facts = rows.agg(F.sum(F.when(F.col("type") != "other", F.size("agents")).otherwise(0)).alias("named"), F.count_if(F.size("agents") > 1).alias("several"), F.count_if(F.array_contains("agents", "other")).alias("none"))
    table = rows.select("type", F.explode("agents").alias("agent")).cube("agent", "type").agg(F.count(F.lit(1)).alias("n")).na.fill("total", ["agent", "type"])
    share = F.when(F.col("type") != "other", F.try_divide(100 * F.col("n"), F.col("named")))
    return table.join(F.broadcast(facts)).select("agent", "type", "n", r6(share).alias("pct"), "several", "none")


_TOTALS = ", ".join(f"count(*) FILTER (type = '{k}' AND list_contains(agents, '{a}')) AS {a}_{k}" for a in ("worker", "firm") for k in lx.SENTENCE_TYPES[:4])
_BENEFIT = "{a}_rights + {a}_permissions - {a}_prohibitions - {a}_obligations"


@query(f"""
WITH {_FEATURES}, s AS (SELECT o_orderpriority, o_custkey % 100 AS doc, o_custkey AS segment, {_TOTALS} FROM h GROUP BY ALL),
b AS (SELECT *, {_BENEFIT.format(a="worker")} AS worker_benefit, {_BENEFIT.format(a="firm")} AS firm_benefit FROM s),
r AS (SELECT *, worker_benefit / nullif(firm_benefit, 0)::DOUBLE AS ratio, CASE WHEN firm_benefit <> 0 THEN 'finite' WHEN worker_benefit > 0 THEN 'positive_infinity' WHEN worker_benefit < 0 THEN 'negative_infinity' ELSE 'undefined' END AS status FROM b)
SELECT o_orderpriority, doc::BIGINT AS doc, count(*) AS segments, {", ".join(f"sum({a}_{k})::BIGINT AS {a}_{k}" for a in ("worker", "firm") for k in (*lx.SENTENCE_TYPES[:4], "benefit"))},
 round(sum(worker_benefit) / nullif(sum(firm_benefit), 0)::DOUBLE, 6) AS ratio, round(avg(ratio), 6) AS mean_ratio, count(ratio) AS finite, count(*) FILTER (status = 'positive_infinity') AS positive_infinity, count(*) FILTER (status = 'negative_infinity') AS negative_infinity, count(*) FILTER (status = 'undefined') AS undefined FROM r GROUP BY 1, 2
""")
def q_clause_totals(t: Tables) -> DataFrame:
    """By clause type and document the ten totals of its segments, their ratio, and the segments' own ratios."""
    kinds, sides = lx.SENTENCE_TYPES[:4], ("worker", "firm")
    counts = [F.count_if((F.col("type") == k) & F.array_contains("agents", a)).alias(f"{a}_{k}") for a in sides for k in kinds]
    rows = typed(t).groupBy("o_orderpriority", (F.col("o_custkey") % 100).cast("long").alias("doc"), F.col("o_custkey").alias("segment")).agg(*counts)
    rows = rows.withColumns({f"{a}_benefit": F.expr(_BENEFIT.format(a=a)) for a in sides})
    value, status = stats.ratio(F.col("worker_benefit"), F.col("firm_benefit"))
    rows = rows.withColumn("own", value).withColumn("status", status)
    totals = [F.sum(f"{a}_{k}").alias(f"{a}_{k}") for a in sides for k in (*kinds, "benefit")]
    marks = [F.count_if(F.col("status") == s).alias(s) for s in ("positive_infinity", "negative_infinity", "undefined")]
    out = rows.groupBy("o_orderpriority", "doc").agg(F.count(F.lit(1)).alias("segments"), *totals, r6(F.avg("own")).alias("mean_ratio"), F.count("own").alias("finite"), *marks)
    whole, _ = stats.ratio(F.col("worker_benefit"), F.col("firm_benefit"))
    return out.withColumn("ratio", r6(whole))
