import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.functions import lexicon, model, stats
from granary.functions import text as tx
from granary.operators import aggregates, authority, headings, modality, ranks, records, spans
from granary.sources import readers, sinks


def clauses(spark, *texts):
    rows = modality.with_struct(spark.createDataFrame([*enumerate(texts)], "k int, text string"), "c", modality.surface_clause(F.col("text")))
    return [r.c for r in rows.orderBy("k").collect()]


def test_forms():
    assert lexicon.forms("ban")["participle"] == "banned" and lexicon.forms("supply")["third"] == "supplies" and lexicon.forms("guarantee")["ing"] == "guaranteeing"
    assert lexicon.forms("pay")["past"] == "paid" and lexicon.forms("notify")["past"] == "notified" and lexicon.forms("expect")["past"] == "expected"
    table = lexicon.lemma_table()
    assert table["forbidden"] == "forbid" and table["receives"] == "receive" and len(lexicon.verbs()) == len(set(lexicon.verbs()))


def test_surface_clause(spark):
    got = clauses(spark, "Employees shall not be required to attend", "They have to work or may go", "Nothing here", None, "Leave is paid out", "It shall or may be given up; don't agree")
    assert got[0].modal_verbs == ["shall"] and got[0].is_negative and got[0].voice == "passive" and got[0].root_verb == "require"
    assert got[1].modal_verbs == ["may"] and got[1].modal_force == "permissive"
    assert got[2].modal_force == "none" and got[2].root_verb == "" and got[2].root_verb_variants == [] and got[3].voice == "active"
    assert got[4].root_verb_variants == ["pay", "pay_out"]
    assert got[5].modal_force == "mixed" and got[5].is_negative and got[5].root_verb_variants == ["give", "give_up"]


def test_parsed_clause(spark):
    """Clauses of a parser: nulls, other case, have_to alone."""
    schema = "k int, c struct<root_verb:string,root_verb_variants:array<string>,lemmas:array<string>,modal_verbs:array<string>,modal_force:string,is_negative:boolean,voice:string>"
    rows = [(0, (" Give ", ["give_off", " "], ["give"], ["have_to"], "restrictive", None, "passive")), (1, (None, None, None, None, None, None, None)), (2, ("work", [], ["work"], ["should"], "restrictive", True, "active"))]
    got = {r.k: r.f for r in modality.with_struct(spark.createDataFrame(rows, schema), "f", modality.auth_features(F.col("c"))).collect()}
    assert got[0].modal == "have_to" and not got[0].md and got[0].entitlement_verb and got[0].root_verb_variants == ["give", "give_off"] and not got[0].neg
    assert got[1].root_verb == "" and got[1].active_verb and not got[1].special_verb and got[1].modal == ""
    assert got[2].md and got[2].permissive_modal and not got[2].strict_modal and got[2].active_verb


def test_agents(spark):
    rows = [(["the workers union"], ""), ([" "], "The Board pays members"), (["Employee", "department head"], "union"), (None, None), (["the workers union and its workers"], "")]
    got = spark.createDataFrame(rows, "s array<string>, t string").select(modality.subject_agents(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in got] == [["union"], ["worker", "firm"], ["worker", "manager"], [], ["union"]]


def test_evidence(spark):
    rows = modality.with_struct(modality.with_struct(spark.createDataFrame([("The company may not be allowed to go",)], "t string"), "c", modality.surface_clause(F.col("t"))), "f", modality.auth_features(F.col("c")))
    names = ("neg", "strict_modal", "permissive_modal", "md", "active_verb", "passive", "obligation_verb", "constraint_verb", "permission_verb", "entitlement_verb")
    flags = authority.flags(*(F.col(f"f.{n}") for n in names))
    assert rows.select(modality.auth_evidence(F.col("f"), flags)).first()[0] == [
        "auth:md=True", "auth:strict_modal=False", "auth:permissive_modal=True", "auth:neg=True", "auth:passive=True", "auth:root=allow",
        "auth:root_variants=allow", "auth:permission_verb", "auth:labels=constraint",
    ]


def test_heading_marks(spark):
    lines = ["ARTICLE IV", "1.2.3 Hours", "(a) first", "WAGES AND HOURS", "Wages and Benefits Paid", "Purpose of it", "Notes:", "It ends.", "a long line of words that says nothing of note at all;", "iv) roman"]
    rows = spark.createDataFrame([*enumerate(lines)], "k int, s string")
    marks = headings.heading_marks(F.col("s"))
    got = {r.k: {n for n in marks if r[n]} for r in rows.select("k", *(c.alias(n) for n, c in marks.items())).collect()}
    assert got[0] == {"top_pattern", "all_caps"} and got[1] == {"sub_pattern", "number", "title_case"} and got[2] == {"sub_pattern"} and got[3] == {"all_caps"}
    assert got[4] == {"title_case"} and "top_title" in got[5] and got[6] == {"title_case", "colon"} and got[7] == {"short"} and got[8] == set() and got[9] == {"sub_pattern"}
    apart = rows.withColumn("d", F.lit(1)).withColumn("x", headings.set_apart(rows, "d", "k", "s")).orderBy("k").collect()
    assert [r.x for r in apart] == [True, *[False] * 8, True]


def test_lines_and_blocks_by_row(spark):
    """Texts of one id are kept apart."""
    docs = spark.createDataFrame([(1, "a\nbc"), (1, "x\n\n\ny"), (2, None), (3, "")], "d int, t string")
    got = sorted((r.d, r.line_no, r.start, r.end) for r in spans.lines(docs, "d", "t").collect())
    assert got == [(1, 0, 0, 1), (1, 0, 0, 1), (1, 1, 2, 2), (1, 1, 2, 4), (1, 2, 3, 3), (1, 3, 4, 5), (3, 0, 0, 0)]
    assert sorted((r.d, r.start, r.block) for r in headings.blocks(docs, "d", "t").collect()) == [(1, 0, "a\nbc"), (1, 0, "x"), (1, 4, "y")]


def test_kendall():
    rng = np.random.default_rng(2)
    for n, top in ((1, 5), (2, 2), (6, 99), (7, 99), (20, 6), (60, 1000)):
        x, y = rng.integers(0, top, n).astype(float), rng.integers(0, top, n).astype(float)
        sign = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(n) for j in range(i)]
        score, a, b = sum(p * q for p, q in sign), sum(p != 0 for p, _ in sign), sum(q != 0 for _, q in sign)
        tau, p = stats.kendall(x, y)
        if not a or not b:
            assert tau is None and p is None
            continue
        assert tau == pytest.approx(score / math.sqrt(a * b)) and 0 <= p <= 1
        if n <= 7 and len(set(x)) == len(set(y)) == n:
            worse = [abs(sum((u[i] - u[j] > 0) * 2 - 1 for i in range(n) for j in range(i))) >= abs(score) for u in itertools.permutations(range(n))]
            assert p == pytest.approx(sum(worse) / len(worse))
    assert stats.kendall(np.arange(4.0), np.arange(4.0)) == (1.0, pytest.approx(2 / 24))


def test_ranks(spark):
    rows = spark.createDataFrame([(k, k % 7) for k in range(50)], "k int, v int")
    got = {r.k: (r.place, r.row) for r in ranks.placed(ranks.placed(rows, "place", F.desc("v"), ties=True), "row", F.desc("v"), F.asc("k")).collect()}
    want = sorted(range(50), key=lambda k: (-(k % 7), k))
    assert got == {k: (1 + sum(j % 7 > k % 7 for j in range(50)), want.index(k) + 1) for k in range(50)}
    assert ranks.placed(rows.limit(0), "place", F.desc("v")).count() == 0


def test_records(spark):
    rows = spark.createDataFrame([("document_1",), ("document_20",)], "d string")
    assert {r.d: r.place for r in records.requested(rows, "d", ["20", "document_1", " 20", ""]).collect()} == {"document_20": 0, "document_1": 1}
    with pytest.raises(ValueError, match="document_3"):
        records.requested(rows, "d", ["3", "1"])
    years = spark.createDataFrame([(1990,), (2000,), (None,)], "y int")
    assert years.where(records.year_range(F.col("y"), None, None)).count() == 3 and years.where(records.year_range(F.col("y"), 1990, None)).count() == 2
    many = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "g string, v int")
    assert {r.g for r in aggregates.at_least(many, ["g"], 2, "v").collect()} == {"b"}


def test_structured_model(spark):
    """A provider may fail before it answers, and answer with a struct."""
    calls = []

    def provider(texts):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("busy")
        return pd.DataFrame({"is_new_segment": texts.str.isupper(), "note": texts})

    ask = model.model_udf(lambda: provider, "is_new_segment boolean, note string")
    got = spark.createDataFrame([("AB",), ("c",)], "t string").coalesce(1).select(ask("t").alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [(True, "AB"), (False, "c")]


def test_tournament(spark):
    rows = spark.createDataFrame([("g", k, k) for k in range(9)] + [("one", 100, 5)], "g string, k int, v int")
    got = {r.k: r for r in model.tournament(rows, "g", "k", "v", lambda a, b: F.when(a > b, 1.0).when(a < b, 0.0)).collect()}
    assert got[8].points >= max(got[k].points for k in range(8)) and got[0].points <= min(got[k].points for k in range(1, 9))
    assert got[100].points == 7.5 and got[100].score is None and abs(sum(got[k].score for k in range(9))) < 1e-9


def test_plan(spark):
    lines = ["ARTICLE I", "the text of it goes on and on and on, without any sign that it were a heading;", " ARTICLE  II", "ARTICLE I"]
    p = spark.createDataFrame([(lines,), ([],)], "l array<string>").select(model.plan(F.col("l"), headings.heading_like).alias("p")).collect()
    assert p[0].p.segment_header_examples == ["ARTICLE I", "ARTICLE II"] and p[0].p.segment_header_rules == [r"^ARTICLE\b"] and p[1].p.segment_header_rules == []


def test_unicode_strip(spark):
    assert spark.createDataFrame([("   x　\n\x1c",)], "t string").select(tx.strip(F.col("t"))).first()[0] == "x"


def test_sources_and_sinks(spark, tmp_path):
    for name, text in (("page_2.txt", " b "), ("page_10.txt", "a"), ("page_x.txt", "z"), ("page_3.txt", " \n")):
        (tmp_path / "pages" / "document_7").mkdir(parents=True, exist_ok=True)
        (tmp_path / "pages" / "document_7" / name).write_text(text)
    pages = readers.page_tree(spark, str(tmp_path / "pages"), all_names=True)
    assert [r.page_number for r in pages.orderBy("page_number").collect()] == [2, 3, 10, readers.NO_PAGE]
    assert sorted(r.text for r in readers.stripped_pages(pages).collect()) == ["a", "b", "z"]
    assert [tuple(r) for r in readers.document_folders(pages).collect()] == [("document_7", 7)]
    for name, text in (("a.json", '{"x": 1}'), ("b.json", "[1]"), ("c.json", "not"), ("d.json", '{"x": 2, "y": "z"}')):
        (tmp_path / name).write_text(text)
    got = {(r.x, r.y) for r in readers.json_objects(spark, str(tmp_path), "*.json", "x int, y string").collect()}
    assert got == {(1, None), (2, "z")}
    old = spark.createDataFrame([(None, "a"), ("n", "b")], "new string, old string")
    assert [tuple(r) for r in readers.with_legacy(old, {"new": ["old", "older"], "other": []}).collect()] == [("a", None), ("n", None)]
    pd.DataFrame({"cbafile": [1.0], "location": ["x"]}).to_stata(tmp_path / "second.dta", write_index=False)
    assert readers.stata_rows(spark, str(tmp_path), "first.dta", "second.dta").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.stata_rows(spark, str(tmp_path), "none.dta")
    text = "### 1. Wages\nTL;DR: pay\nProse.\n- base\n--### 2. Gone\n### Hours\n- shift"
    assert [(e["name"], e["details"]) for e in readers.taxonomy_details(text)] == [("Wages", ["base", "### 2. Gone"]), ("Hours", ["shift"])]
    assert readers.feature_names(text) == ["Wages", "Hours"]
    sinks.write_pages(pages, str(tmp_path / "out"))
    assert (tmp_path / "out" / "document_id=document_7" / "page_number=10").is_dir()
    full = sinks.full_texts(spark.createDataFrame([("d", "page_10.txt", "x"), ("d", "page_2.txt", "y")], "document_id string, file string, text string")).first()
    assert full.full_text == "x\ny"
    sinks.write_summary(spark.createDataFrame([(1, 2)], "docs int, rows int"), str(tmp_path / "sum"))
    assert json.loads(next((tmp_path / "sum").glob("part-*")).read_text()) == {"docs": 1, "rows": 2}
    parts = spark.createDataFrame([("document_1", 1, "a"), ("document_2", 1, "b")], "document_id string, segment_number int, segment_text string")
    sinks.write_segments(parts, str(tmp_path / "segments"))
    assert spark.read.parquet(str(tmp_path / "segments")).count() == 2
    sinks.write_csv(parts, str(tmp_path / "csv"))
    assert readers.csv_rows(spark, str(tmp_path / "csv"), {"document_id": "string", "segment_number": "int"}).count() == 2
    for _ in range(2):
        sinks.write_json(parts, str(tmp_path / "json"), by="document_id", append=True)
    assert spark.read.json(str(tmp_path / "json")).count() == 4
