import json
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import stats
from granary.functions import text as tx
from granary.functions.model import keyword_provider, model_udf
from granary.operators import chunks, records, spans
from granary.sources import readers, sinks
from granary.streaming.ingest import ingest


def one(spark, row, schema, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_text(spark):
    r = one(
        spark,
        (" A  b\n", "Hours of Work!", "12", ["", " "], "X", "5 cents -2.5"),
        "a string, b string, c string, d array<string>, e string, f string",
        tx.norm_space(F.col("a")), tx.slug(F.col("b")), tx.document_key(F.col("c")), tx.first_label(F.col("d"), F.col("e")), tx.first_number(F.col("f")), tx.norm_key(F.col("b")),
    )
    assert list(r) == ["A b", "Hours_of_Work", "document_12", "X", 5.0, "hours of work"]
    r = one(spark, ('```json\n{"a": 1}\n```', "9", "x"), "a string, b string, c string", F.to_json(tx.loose_json(F.col("a"))), tx.clamp_score(F.col("b")), tx.clamp_score(F.col("c")))
    assert list(r) == ['{"a":1}', 5, 3]
    r = one(spark, ("abc def", "ABC", ""), "a string, b string, c string", tx.span_of(F.col("a"), F.col("b")), tx.error_rate(F.col("c"), F.col("a")), tx.error_rate(F.col("c"), F.col("c")))
    assert list(r) == [0, 1.0, 0.0]


def test_stats(spark):
    rows = spark.createDataFrame([(0, 0), (0, 5), (5, 5)], "k int, n int")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in rows.select(low, high).collect()]
    assert got[0] == (0.0, 0.0) and got[1][0] == 0.0 and got[2][1] == 1.0
    value, status = stats.ratio(F.col("w"), F.col("f"))
    rows = spark.createDataFrame([(1, 0), (-1, 0), (0, 0), (-2, -1)], "w int, f int").select(value, status)
    assert [tuple(r) for r in rows.collect()] == [(None, "positive_infinity"), (None, "negative_infinity"), (None, "undefined"), (2.0, "finite")]
    rows = spark.createDataFrame([(x,) for x in (3.0, 2.0, 2.0, 1.0, None)], "x double").withColumn("g", F.lit(1))
    ranks = [r[0] for r in rows.select(stats.average_rank(F.col("x"), ["g"]).alias("r")).orderBy(F.asc_nulls_last("r")).collect()]
    assert ranks == [1.0, 2.5, 2.5, 4.0, None]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double").agg(stats.pearson("x", "y")).first()[0]
    assert flat is None


def test_spans(spark):
    rows = spark.createDataFrame([("d", 0, 5), ("d", 5, 9), ("d", 20, 21)], "d string, s int, e int")
    assert sorted(tuple(r) for r in spans.merged(rows, ["d"], "s", "e").collect()) == [("d", 0, 9), ("d", 20, 21)]
    cuts = spark.createDataFrame([("d", 0, 10), ("d", 4, 10), ("d", 10, 10)], "d string, s long, size long")
    got = sorted((r["s"], r["end"], r["segment_number"]) for r in spans.segments(cuts, "d", "s", "size").collect())
    assert got == [(0, 4, 1), (4, 10, 2)]
    x = spark.createDataFrame([([(0, 5), (3, 10)],)], "x array<struct<start:int,end:int>>")
    first, longer = x.select(spans.without_overlaps(F.col("x")), spans.without_overlaps(F.col("x"), "longer")).first()
    assert [tuple(v) for v in first] == [(0, 5)] and [tuple(v) for v in longer] == [(3, 10)]


def plain_chunks(text, most, overlap):
    """Every place behind a break tried one by one."""
    if len(text) <= most:
        return [(0, len(text))] if text else []
    most, share, out, start = max(1000, most), min(0.5, overlap), [], 0
    while True:
        end = min(len(text), start + most)
        if end < len(text):
            for mark in ("\n\n", "\n", ". ", "; ", ", ", " "):
                places = [k + len(mark) for k in range(start, end - len(mark) + 1) if text[k : k + len(mark)] == mark]
                if places and places[-1] - start >= int(most * 0.6):
                    end = places[-1]
                    break
        out.append((start, end))
        if end == len(text):
            return out
        start = end - int(most * share) if end - int(most * share) > start else end


def test_chunks(spark):
    rng = random.Random(3)
    for most, overlap in [(1000, 0.0), (1000, 0.1), (1500, 0.3), (200, 0.9), (3000, 0.2)]:
        for _ in range(40):
            text = "".join(rng.choice(["word", "x" * rng.randint(1, 400), "\n\n", "\n", ". ", "; ", ", ", " "]) for _ in range(rng.randint(0, 120)))
            assert chunks.chunk(text, most, overlap) == plain_chunks(text, most, overlap)
    assert chunks.chunk("a b" * 100, 400) == [(0, 300)] and chunks.chunk("", 5) == []
    r = spark.createDataFrame([("a b c", "a x c")], "a string, b string").select(chunks.word_error_rate(F.col("a"), F.col("b"))).first()[0]
    assert r == pytest.approx(1 / 3)
    r = spark.createDataFrame([("ab ab",), (None,)], "t string").select(chunks.match_spans(["ab", "(", "b a"])(F.col("t"))).collect()
    assert [tuple(x) for x in r[0][0]] == [(0, 2), (3, 5)] and r[1][0] == []


def test_sources(spark, tmp_path):
    for n in (1, 2, 10):
        p = tmp_path / "pages" / "document_1" / f"page_{n}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f" page {n}\n")
    rows = readers.page_tree(spark, str(tmp_path / "pages")).orderBy("page_number").collect()
    assert [tuple(r) for r in rows] == [("document_1", n, f" page {n}\n") for n in (1, 2, 10)]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert readers.json_rows(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny ""z"""\nq,w\n')
    assert [tuple(r) for r in readers.csv_rows(spark, str(tmp_path / "a.csv"), {"a": "int", "b": "string", "c": "int"}).collect()] == [(1, 'x\ny "z"', None), (None, "w", None)]
    names = [r["name"] for r in readers.taxonomy("### 1. Wages\nTL;DR: pay\nWhat is paid.\n--### 2. Gone\n### Hours\n")]
    assert names == ["Wages", "Hours", "OTHER"]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_ingest(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"k": n}))
        ingest(spark, source, "k int", sink, mark).awaitTermination()
        assert spark.read.parquet(sink).count() == n + 1


def test_model(spark):
    f = model_udf(keyword_provider({"wage": "Wages"}), "string")
    rows = spark.createDataFrame([("Wage rates",), (None,)], "t string").select(f(F.col("t")))
    assert [r[0] for r in rows.collect()] == ["Wages", "OTHER"]


def test_against_all(spark):
    """Items too large to broadcast meet every row in blocks, with the same pairs."""
    rows = spark.createDataFrame([(i, f"text {i % 7} of {i}") for i in range(60)] + [(None, "text 1 of"), (3, None)], "doc long, text string")
    items = spark.createDataFrame([(k, f"{k} of") for k in range(9)] + [(None, "5 of 5"), (99, None)], "item long, part string")
    on = F.instr("text", F.col("part")) > 0
    pairs = [sorted(map(tuple, records.against_all(rows, items, "doc", "item", "part", on, most=most).collect()), key=str) for most in (1 << 20, 64, 1)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) > 60
    assert records.against_all(rows, items.limit(0), "doc", "item", "part", on).count() == 0
