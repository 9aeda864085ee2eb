"""Queries against their SQL on rows that the tables of the tests do not have."""

import duckdb
from conftest import same
from pyspark.sql import functions as F

from granary import plans
from granary.functions import stats


def both(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return plans.QUERIES[name](spark, str(folder)), con.execute(plans.ORACLE_SQL[name])


def test_heading_marks(spark, tmp_path):
    """Boundaries and white space are those of ASCII."""
    lines = ["Para. Ci\u00f3n que", "1\u00e9", "A1\u00f1 x", "1.2\u2028", "\u00a0Scope", "Scope\u00a0x", "Sec. 4\u00f3", "cla\u017fse", "Clau\u017fe 4", "DEF\u0130NITIONS", "a\x0bb c d e f g h i j."]
    rows = [(1, "\n".join(lines)), *enumerate(lines, 2), (90, ""), (91, None)]
    assert same(*both(spark, tmp_path, "q_heading_marks", "documents", rows, "doc_id long, text string"))


def test_rank_compare(spark, tmp_path):
    """Customers of one mean tie, in whatever order their orders come."""
    prices = [0.1, 0.2, 0.3, 1234.56, 470000.01, 999.99, 0.07, 250000.13]
    orders = [(k, prices[(i + k) % 8] if k % 2 else prices[i]) for k in range(40) for i in (range(8) if k < 20 else reversed(range(8)))]
    spark.createDataFrame([(k,) for k in range(41)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = plans.QUERIES["q_rank_compare"](spark, str(tmp_path)).collect()
    assert sorted(r.k for r in rows) == list(range(40)) and {(r.r1, r.r2, r.mean_rank, r.place, r.displacement) for r in rows} == {(1, 1, 1.0, 1, 0)}


def test_exact_mean(spark):
    rows = [(1, 0.1), (1, 0.2), (1, 0.3), (2, 0.2), (3, 1e300), (3, 1e300), (4, None), (5, 0.125), (5, 0.25), (6, float("nan")), (6, 1.0), (7, -0.01), (7, None), (8, 9e16), (8, 9e16)]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(stats.exact_mean(F.col("x")).alias("m")).collect()}
    assert got.pop(6) != got.get(6) and got == {1: 0.2, 2: 0.2, 3: 1e300, 4: None, 5: 0.1875, 7: -0.01, 8: 9e16}


def test_model_fields(spark, tmp_path):
    """Large amounts, halves that doubles miss, zeros with a sign, and none."""
    amounts = [12345678.91, -1e7, 99999999999.99, 1e9, 9999999.99, 1.005, 2.675, 0.125, -0.125, -0.004, -0.005, 0.0, -0.0, 1e-7, None, None, 42.0]
    assert same(*both(spark, tmp_path, "q_model_fields", "customer", [*enumerate(amounts)], "c_custkey long, c_acctbal double"))
