"""Counts, shares, scores, ranks and statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import stats
from granary.functions import text as tx
from granary.operators import ranks

from .registry import Tables, query


def r6(x):
    return F.round(x, 6)


@query("""
WITH d AS (SELECT year(o_orderdate) AS y, text, len(regexp_extract_all(lower(coalesce(text, '')), '\\b(?:the|of)\\b')) AS hits FROM orders LEFT JOIN documents ON o_orderkey = doc_id),
g AS (SELECT y::INT AS year, count(*) AS docs, count(text) AS docs_with_text, count(*) FILTER (hits > 0) AS docs_with_mention, sum(hits)::BIGINT AS mentions FROM d GROUP BY 1 HAVING count(*) >= 10),
w AS (SELECT *, docs_with_mention / docs::DOUBLE AS p, docs::DOUBLE AS n, 1.959963984540054 AS z FROM g)
SELECT year, docs, docs_with_text, docs_with_mention, mentions, round(p, 6) AS share,
 round(greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS ci_low,
 round(least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS ci_high FROM w
""")
def q_mentions_by_year(t: Tables) -> DataFrame:
    hits = t.documents.select("doc_id", F.regexp_count(F.lower("text"), F.lit(r"\b(?:the|of)\b")).alias("hits"), F.lit(1).alias("has"))
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year")).join(hits, F.col("o_orderkey") == F.col("doc_id"), "left")
    out = rows.groupBy("year").agg(F.count(F.lit(1)).alias("docs"), F.count("has").alias("docs_with_text"), F.count_if(F.col("hits") > 0).alias("docs_with_mention"), F.coalesce(F.sum("hits"), F.lit(0)).alias("mentions")).where("docs >= 10")
    low, high = stats.wilson(F.col("docs_with_mention"), F.col("docs"))
    return out.select("*", r6(F.col("docs_with_mention") / F.col("docs")).alias("share"), r6(low).alias("ci_low"), r6(high).alias("ci_high"))


@query("""
SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n_rows, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events)::DOUBLE, 6) AS user_share,
 round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS row_share, row_number() OVER (ORDER BY count(DISTINCT user_id) DESC, count(*) DESC, lower(event_type))::INT AS place FROM events GROUP BY 1
""")
def q_group_prevalence(t: Tables) -> DataFrame:
    total = t.events.agg(F.count_distinct("user_id").alias("u"), F.count(F.lit(1)).alias("n"))
    out = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n_rows"))
    place = F.row_number().over(Window.orderBy(F.desc("users"), F.desc("n_rows"), F.lower("event_type")))
    return out.join(total).select("event_type", "users", "n_rows", r6(F.col("users") / F.col("u")).alias("user_share"), r6(F.col("n_rows") / F.col("n")).alias("row_share"), place.alias("place"))


@query("""
SELECT p_brand, count(DISTINCT l_orderkey) AS orders, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) NOT IN ('brand 11', 'brand 12') GROUP BY 1 ORDER BY 2 DESC, 3 DESC, lower(p_brand) LIMIT 10
""")
def q_top_types(t: Tables) -> DataFrame:
    parts = t.part.where(~tx.norm_key(F.col("p_brand")).isin("brand 11", "brand 12")).select("p_partkey", "p_brand")
    rows = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count_distinct("l_orderkey").alias("orders"), F.count(F.lit(1)).alias("lines"))
    return rows.orderBy(F.desc("orders"), F.desc("lines"), F.lower("p_brand")).limit(10)


@query("""
SELECT c_mktsegment, n_name, count(*) AS customers, sum(count(*)) OVER (PARTITION BY c_mktsegment)::BIGINT AS segment_total, sum(count(*)) OVER (PARTITION BY n_name)::BIGINT AS nation_total
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
""")
def q_joint_distribution_long(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("customers"))
    return rows.withColumn("segment_total", F.sum("customers").over(Window.partitionBy("c_mktsegment"))).withColumn("nation_total", F.sum("customers").over(Window.partitionBy("n_name")))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1")
def q_joint_distribution_wide(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT event_type, coalesce(hour(ts)::INT, -1) AS hour, count(*) AS n, grouping_id(event_type, hour(ts))::BIGINT AS level FROM events GROUP BY CUBE (event_type, hour(ts))")
def q_cross_tab_cube(t: Tables) -> DataFrame:
    return t.events.withColumn("hour", F.hour("ts")).cube("event_type", "hour").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).na.fill(-1, ["hour"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END)::BIGINT AS large FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q_rollup_counts(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") >= 25).alias("large"))


def benefits(t: Tables, by: str) -> DataFrame:
    """Rights and permissions less prohibitions and obligations, for workers and firms, by stand-in flags."""
    sign = F.when(F.col("l_returnflag").isin("A", "N"), 1).otherwise(-1)
    worker = F.sum(F.when(F.col("l_linestatus") == "O", sign).otherwise(0)).alias("worker")
    firm = F.sum(F.when(F.col("l_linestatus") == "F", sign).otherwise(0)).alias("firm")
    out = t.lineitem.groupBy(by).agg(worker, firm, F.count(F.lit(1)).alias("lines"))
    value, status = stats.ratio(F.col("worker"), F.col("firm"))
    return out.withColumn("ratio", value).withColumn("status", status)


_BENEFITS = """SELECT {by}, sum(CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag IN ('A', 'N') THEN 1 ELSE -1 END ELSE 0 END)::BIGINT AS worker,
 sum(CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag IN ('A', 'N') THEN 1 ELSE -1 END ELSE 0 END)::BIGINT AS firm, count(*) AS lines FROM lineitem GROUP BY 1"""
_STATUS = "CASE WHEN firm <> 0 THEN 'finite' WHEN worker > 0 THEN 'positive_infinity' WHEN worker < 0 THEN 'negative_infinity' ELSE 'undefined' END"


@query(f"SELECT l_suppkey, worker, firm, lines, round(worker / nullif(firm, 0)::DOUBLE, 6) AS ratio, {_STATUS} AS status FROM ({_BENEFITS.format(by='l_suppkey')})")
def q_benefit_ratio(t: Tables) -> DataFrame:
    return benefits(t, "l_suppkey").withColumn("ratio", r6("ratio"))


_CLASS = "CASE status WHEN 'positive_infinity' THEN 3 WHEN 'finite' THEN 2 WHEN 'undefined' THEN 1 ELSE 0 END"


@query(f"""
WITH b AS (SELECT *, worker / nullif(firm, 0)::DOUBLE AS ratio, {_STATUS} AS status FROM ({_BENEFITS.format(by="l_orderkey")}))
SELECT o_orderpriority, l_orderkey, status, round(ratio, 6) AS ratio,
 row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_CLASS} DESC, coalesce(ratio, 0) DESC, worker DESC, firm, lines DESC, l_orderkey DESC)::INT AS place FROM b JOIN orders ON o_orderkey = l_orderkey
""")
def q_ratio_rank(t: Tables) -> DataFrame:
    rows = benefits(t, "l_orderkey").join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"))
    w = Window.partitionBy("o_orderpriority").orderBy(F.expr(_CLASS).desc(), F.coalesce("ratio", F.lit(0.0)).desc(), F.desc("worker"), "firm", F.desc("lines"), F.desc("l_orderkey"))
    return rows.select("o_orderpriority", "l_orderkey", "status", r6("ratio").alias("ratio"), F.row_number().over(w).alias("place"))


@query(f"""
WITH b AS (SELECT *, worker / nullif(firm, 0)::DOUBLE AS ratio FROM ({_BENEFITS.format(by="l_orderkey")}))
SELECT o_custkey, round(avg(ratio), 6) AS composite, count(*) AS clauses FROM b JOIN orders ON o_orderkey = l_orderkey WHERE ratio IS NOT NULL GROUP BY 1
""")
def q_composite_ratio(t: Tables) -> DataFrame:
    rows = benefits(t, "l_orderkey").where("ratio is not null").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_custkey").agg(r6(F.avg("ratio")).alias("composite"), F.count(F.lit(1)).alias("clauses"))


_RANKED = """SELECT o_orderkey, o_custkey, o_orderpriority, round(o_totalprice / 1000) AS score,
 rank() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice / 1000) DESC) + (count(*) OVER (PARTITION BY o_orderpriority, round(o_totalprice / 1000)) - 1) / 2.0::DOUBLE AS avg_rank,
 count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders"""


def ranked_orders(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.round(F.col("o_totalprice") / 1000).alias("score"))
    rows = rows.withColumn("avg_rank", stats.average_rank(F.col("score"), ["o_orderpriority"])).withColumn("n", F.count("score").over(Window.partitionBy("o_orderpriority")))
    return rows.withColumn("percentile", stats.rank_percentile(F.col("avg_rank"), F.col("n")))


@query(f"SELECT o_orderkey, o_orderpriority, score, avg_rank::DOUBLE AS avg_rank, round(CASE WHEN n = 1 THEN 100 ELSE (n - avg_rank) / (n - 1) * 100 END, 6) AS percentile FROM ({_RANKED})")
def q_avg_rank_percentile(t: Tables) -> DataFrame:
    return ranked_orders(t).select("o_orderkey", "o_orderpriority", "score", "avg_rank", r6("percentile").alias("percentile"))


@query(f"""
WITH s AS ({_RANKED}), c AS (SELECT o_orderpriority, o_custkey, count(*) AS ranked, avg(score) AS mean_score, avg(avg_rank) AS mean_rank FROM s GROUP BY 1, 2),
d AS (SELECT o_custkey, count(*) AS clauses, sum(ranked)::BIGINT AS segments, sum(mean_score * ranked) / sum(ranked) AS weighted, avg(mean_rank) AS unweighted FROM c GROUP BY 1)
SELECT o_custkey, clauses, segments, round(weighted, 6) AS weighted, round(unweighted, 6) AS unweighted, rank() OVER (ORDER BY round(weighted, 6) DESC)::INT AS place FROM d
""")
def q_min_rank_weighted(t: Tables) -> DataFrame:
    clause = ranked_orders(t).groupBy("o_orderpriority", "o_custkey").agg(F.count("score").alias("ranked"), F.avg("score").alias("mean_score"), F.avg("avg_rank").alias("mean_rank"))
    out = clause.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("clauses"), F.sum("ranked").alias("segments"), r6(F.try_divide(F.sum(F.col("mean_score") * F.col("ranked")), F.sum("ranked"))).alias("weighted"), r6(F.avg("mean_rank")).alias("unweighted")
    )
    return ranks.placed(out, "place", F.desc("weighted"), ties=True)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, p_retailprice, CASE WHEN rn = 1 THEN 'high' WHEN rn = n THEN 'low' ELSE 'mid' END AS pick FROM r WHERE rn IN (1, (n - 1) // 2 + 1, n)
""")
def q_high_mid_low(t: Tables) -> DataFrame:
    rows = t.part.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("p_brand")))
    return rows.where("rn in (1, (n - 1) div 2 + 1, n)").select("p_brand", "p_partkey", "p_retailprice", F.when(F.col("rn") == 1, "high").when(F.col("rn") == F.col("n"), "low").otherwise("mid").alias("pick"))


@query("""
WITH r AS (SELECT c_custkey, c_acctbal, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS hi, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS lo,
 greatest(1, ceil(0.1 * count(*) OVER (PARTITION BY c_mktsegment))) AS k FROM customer)
SELECT c_mktsegment, c_custkey, c_acctbal, CASE WHEN hi <= k THEN 'top' ELSE 'bottom' END AS grp FROM r WHERE hi <= k OR lo <= k
""")
def q_top_bottom_pct(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_mktsegment")
    rows = t.customer.withColumn("hi", F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey"))).withColumn("lo", F.row_number().over(w.orderBy("c_acctbal", "c_custkey")))
    rows = rows.withColumn("k", F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) * 0.1)))
    return rows.where("hi <= k or lo <= k").select("c_mktsegment", "c_custkey", "c_acctbal", F.when(F.col("hi") <= F.col("k"), "top").otherwise("bottom").alias("grp"))


@query("""
(SELECT c_custkey, c_acctbal, 'top' AS grp FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
UNION ALL (SELECT c_custkey, c_acctbal, 'bottom' FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) ORDER BY c_acctbal, c_custkey LIMIT 5)
""")
def q_top_bottom_n(t: Tables) -> DataFrame:
    top = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select("c_custkey", "c_acctbal", F.lit("top").alias("grp"))
    bottom = t.customer.join(top, "c_custkey", "left_anti").orderBy("c_acctbal", "c_custkey").limit(5).select("c_custkey", "c_acctbal", F.lit("bottom").alias("grp"))
    return top.unionByName(bottom)


@query("""
SELECT source, count(n_chars) AS n, min(n_chars) AS lo, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75,
 round(quantile_cont(n_chars, 0.9), 6) AS p90, max(n_chars) AS hi, round(avg(n_chars), 6) AS mean, round(count(*) FILTER (lang = 'en') / count(lang)::DOUBLE, 6) AS true_rate FROM documents GROUP BY 1
""")
def q_field_distribution(t: Tables) -> DataFrame:
    p = F.percentile("n_chars", [0.1, 0.25, 0.5, 0.75, 0.9])
    out = t.documents.groupBy("source").agg(F.count("n_chars").alias("n"), F.min("n_chars").alias("lo"), p.alias("p"), F.max("n_chars").alias("hi"), r6(F.avg("n_chars")).alias("mean"), r6(F.try_divide(F.count_if(F.col("lang") == "en"), F.count("lang"))).alias("true_rate"))
    return out.select("source", "n", "lo", *(r6(F.col("p")[k]).alias(f"p{q}") for k, q in enumerate((10, 25, 50, 75, 90))), "hi", "mean", "true_rate")


@query("""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]+')) AS token FROM documents), c AS (SELECT lang, token, count(*) AS n FROM w WHERE token NOT IN ('the', 'of', 'de', 'la', 'der', 'die') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS place, count(*) OVER (PARTITION BY lang) AS distinct_tokens FROM c) SELECT lang, token, n, place::INT AS place, distinct_tokens FROM r WHERE place <= 15
""")
def q_topk_values(t: Tables) -> DataFrame:
    tokens = t.documents.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z'-]+"), F.lit(0))).alias("token"))
    counts = tokens.where(~F.col("token").isin("the", "of", "de", "la", "der", "die")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("distinct_tokens"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))).where("place <= 15")
    return top.join(sizes, "lang")


@query("SELECT event_type, coalesce(user_id, -1) AS user_id, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS hi, grouping_id(event_type, user_id)::BIGINT AS level FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id))")
def q_distribution_grouping_sets(t: Tables) -> DataFrame:
    out = t.events.groupingSets([("event_type",), ("event_type", "user_id")], "event_type", "user_id")
    return out.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.max("value")).alias("hi"), F.grouping_id("event_type", "user_id").alias("level")).na.fill(-1, ["user_id"])


_PAIRS = "SELECT c_nationkey, count(*)::DOUBLE AS x, avg(o_totalprice) AS y, c_custkey FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 4"


def pairs(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.count(F.lit(1)).cast("double").alias("x"), F.avg("o_totalprice").alias("y"))


_RANKS = """SELECT c_nationkey, x, y, rank() OVER (PARTITION BY c_nationkey ORDER BY x DESC) + (count(*) OVER (PARTITION BY c_nationkey, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY c_nationkey ORDER BY y DESC) + (count(*) OVER (PARTITION BY c_nationkey, y) - 1) / 2.0 AS ry FROM ({})"""


@query(f"""
SELECT c_nationkey, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS pearson, CASE WHEN count(*) >= 2 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rx, ry), 6) END AS spearman,
 CASE WHEN stddev_pop(x) > 0 THEN round(regr_slope(y, x), 4) END AS slope, CASE WHEN stddev_pop(x) > 0 THEN round(regr_intercept(y, x), 4) END AS intercept FROM ({_RANKS.format(_PAIRS)}) GROUP BY 1
""")
def q_correlations(t: Tables) -> DataFrame:
    rows = pairs(t).withColumn("rx", stats.average_rank(F.col("x"), ["c_nationkey"])).withColumn("ry", stats.average_rank(F.col("y"), ["c_nationkey"]))
    line = F.stddev_pop("x") > 0
    return rows.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        r6(stats.pearson("x", "y")).alias("pearson"),
        r6(stats.pearson("rx", "ry")).alias("spearman"),
        F.when(line, F.round(F.regr_slope("y", "x"), 4)).alias("slope"),
        F.when(line, F.round(F.regr_intercept("y", "x"), 4)).alias("intercept"),
    )


def kendalls(t: Tables) -> DataFrame:
    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        tau, p = stats.kendall(rows.x.to_numpy(), rows.y.to_numpy())
        return pd.DataFrame({"c_nationkey": [key[0]], "tau": [tau], "p": [p]}).astype({"tau": "float64", "p": "float64"})

    return pairs(t).groupBy("c_nationkey").applyInPandas(one, "c_nationkey int, tau double, p double")


@query(f"""
WITH p AS ({_PAIRS}) SELECT a.c_nationkey, round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(sum(abs(sign(a.x - b.x)))::DOUBLE * sum(abs(sign(a.y - b.y)))::DOUBLE), 0), 6) AS tau
FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey GROUP BY 1
""")
def q_corr_kendall(t: Tables) -> DataFrame:
    return kendalls(t).select("c_nationkey", F.round(F.nanvl("tau", F.lit(None)), 6).alias("tau"))


@query()
def q_kendall_p(t: Tables) -> DataFrame:
    return kendalls(t).select("c_nationkey", F.round(F.nanvl("tau", F.lit(None)), 6).alias("tau"), F.round(F.nanvl("p", F.lit(None)), 6).alias("p"))


@query("""
WITH a AS (SELECT c_custkey AS k, count(*)::DOUBLE AS s1, avg(o_totalprice) AS s2 FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
r AS (SELECT k, rank() OVER (ORDER BY s1 DESC)::INT AS r1, rank() OVER (ORDER BY s2 DESC)::INT AS r2 FROM a)
SELECT k, r1, r2, (r1 + r2) / 2.0::DOUBLE AS mean_rank, rank() OVER (ORDER BY (r1 + r2) / 2.0)::INT AS place, r1 - r2 AS displacement FROM r
""")
def q_rank_compare(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("s1"))
    means = t.orders.groupBy("o_custkey").agg(stats.exact_mean(F.col("o_totalprice")).alias("s2"))
    rows = t.customer.select(F.col("c_custkey").alias("k")).join(counts, F.col("k") == F.col("o_custkey")).drop("o_custkey").join(means, F.col("k") == F.col("o_custkey"))
    rows = ranks.placed(ranks.placed(rows, "r1", F.desc("s1"), ties=True), "r2", F.desc("s2"), ties=True)
    rows = rows.select("k", "r1", "r2", ((F.col("r1") + F.col("r2")) / 2.0).alias("mean_rank"))
    return ranks.placed(rows, "place", F.asc("mean_rank"), ties=True).withColumn("displacement", F.col("r1") - F.col("r2"))


@query("""
WITH s AS (SELECT l_orderkey, l_returnflag, avg(least(5, greatest(1, l_quantity::INT // 10))) AS c, count(l_quantity) AS fields FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, round(avg(c), 6) AS composite, count(*) AS clauses, count(*) FILTER (fields >= 2) AS supported FROM s GROUP BY 1
""")
def q_doc_composite(t: Tables) -> DataFrame:
    score = tx.clamp_score(F.expr("cast(l_quantity as int) div 10"))
    clause = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.avg(score).alias("c"), F.count("l_quantity").alias("fields"))
    return clause.groupBy("l_orderkey").agg(r6(F.avg("c")).alias("composite"), F.count(F.lit(1)).alias("clauses"), F.count_if(F.col("fields") >= 2).alias("supported"))


@query("""
WITH g AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT DISTINCT ts::DATE AS day FROM events), c AS (SELECT DISTINCT event_type FROM events),
m AS (SELECT r.day, c.event_type, coalesce(n, 0)::BIGINT AS n, dense_rank() OVER (ORDER BY r.day) AS i, dense_rank() OVER (ORDER BY c.event_type) AS j FROM r CROSS JOIN c LEFT JOIN g ON g.day = r.day AND g.event_type = c.event_type),
z AS (SELECT max(i) AS mi, max(j) AS mj FROM m), k AS (SELECT unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS di, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS dj, unnest([1, 2, 1, 2, 4, 2, 1, 2, 1]) AS w)
SELECT a.day, a.event_type, any_value(a.n) AS n, round(sum(b.n * w) / 16.0::DOUBLE, 6) AS smooth FROM m a CROSS JOIN z CROSS JOIN k JOIN m b ON b.i = least(greatest(a.i + di, 1), mi) AND b.j = least(greatest(a.j + dj, 1), mj) GROUP BY 1, 2
""")
def q_heatmap_smoothed(t: Tables) -> DataFrame:
    cells = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    types = sorted(r[0] for r in t.events.select("event_type").distinct().collect())
    wide = cells.groupBy("day").pivot("event_type", types).sum("n").na.fill(0)
    row = F.array(*(F.col(f"`{c}`") for c in types))
    w = Window.orderBy("day")
    rows = wide.select("day", row.alias("here"), F.coalesce(F.lag(row).over(w), row).alias("up"), F.coalesce(F.lead(row).over(w), row).alias("down"))
    last = len(types) - 1

    def line(name: str, k: int):
        return F.col(name)[max(k - 1, 0)] + 2 * F.col(name)[k] + F.col(name)[min(k + 1, last)]

    out = [F.struct(F.lit(c).alias("event_type"), F.col("here")[k].alias("n"), r6((line("up", k) + 2 * line("here", k) + line("down", k)) / 16.0).alias("smooth")) for k, c in enumerate(types)]
    return rows.select("day", F.inline(F.array(*out)))


@query("""
SELECT user_id, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 6) AS mean_value,
 round(sum(CASE WHEN event_type <> 'error' THEN value END), 4) AS ok_sum FROM events GROUP BY 1
""")
def q_runs_summary(t: Tables) -> DataFrame:
    ok = F.col("event_type") != "error"
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), r6(F.avg("value")).alias("mean_value"), F.round(F.sum(F.when(ok, F.col("value"))), 4).alias("ok_sum"))


@query("SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS v1, round(avg(value) FILTER (event_type = 'view'), 6) AS v2, round(avg(value) FILTER (event_type = 'view') - avg(value) FILTER (event_type = 'click'), 6) AS delta FROM events GROUP BY 1")
def q_version_delta(t: Tables) -> DataFrame:
    out = t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    return out.select("user_id", r6("click").alias("v1"), r6("view").alias("v2"), r6(F.col("view") - F.col("click")).alias("delta"))
