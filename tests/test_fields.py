import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from granary.functions import codes, rubric
from granary.functions import text as tx
from granary.operators import graphs, headings
from granary.sources import readers


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_codes(spark):
    assert values(spark, [("6",), ("6.0",), ("3",), ("0",), ("ny",), ("x",), (None,)], "a string", codes.state_of(F.col("a"))) == ["CA", "CA", "FIPS_3", None, "NY", None, None]
    place = [(None, "Albany, NY; Newark NJ"), ("36", "CA"), (None, "varies"), (None, None), (None, "Oz")]
    assert values(spark, place, "a string, b string", codes.states([F.col("a")], F.col("b"))) == [["NJ", "NY"], ["NY"], ["VARIES"], ["UNKNOWN"], ["UNKNOWN"]]
    kinds = [("naics 6221", None), ("99", None), ("retail  trade", "x"), ("nan", "public"), (None, None)]
    got = values(spark, kinds, "a string, b string", codes.industry(F.col("a"), F.col("b")))
    assert got == ["62 - Health Care and Social Assistance", "99 - Other/Unknown NAICS Sector", "RETAIL TRADE", "PUBLIC", "UNKNOWN"]
    years = [("2015",), ("2015-03-02",), ("3/2/2015",), ("20000",), ("1700-01-01",), ("soon",), (None,)]
    assert values(spark, years, "a string", codes.year_of(F.col("a"))) == [2015, 2015, 2015, 2014, None, None, None]


def test_rubric(spark):
    assert values(spark, [("List[str]",), (" INT",), ("odd",), (None,)], "a string", rubric.field_type(F.col("a"))) == ["list[string]", "number", "string", "string"]
    assert values(spark, [("Lower better",), ("up",), (None,)], "a string", rubric.score_direction(F.col("a"))) == ["lower_is_better", "higher_is_better", "higher_is_better"]
    rows = [("about 5.5 %", "number"), ("no", "boolean"), ('["a", " ", "b"]', "list[string]"), ("7", "list[number]"), ("", "string"), (None, "number")]
    got = [tuple(x) for x in values(spark, rows, "a string, b string", rubric.typed(F.col("a"), F.col("b")))]
    none = (None,) * 5
    assert got == [(5.5, None, None, None, None), (None, None, False, None, None), (None, None, None, ["a", "b"], None), (None, None, None, None, [7.0]), none, none]
    turn = [(["9", "", "", "", "1"], "higher"), (["9", "", "", "", "1"], "lower"), (["a", "", "", "", "1"], "higher")]
    assert [x[0] for x in values(spark, turn, "a array<string>, b string", rubric.directed(F.col("a"), F.col("b")))] == ["1", "9", "a"]
    pairs = [(1, 3), (1, 0), (-1, 0), (0, 0), (None, 1)]
    assert values(spark, pairs, "a int, b int", rubric.ratio_text(F.col("a"), F.col("b"))) == ["0.3333", "+inf", "-inf", "undefined", "n/a"]
    assert values(spark, [(3661.9,)], "a double", rubric.elapsed(F.col("a"))) == ["01:01:01"]
    assert values(spark, [(5.0, 0.0, 10.0), (50.0, 0.0, 10.0), (1.0, 2.0, 2.0)], "a double, b double, c double", rubric.marker_scale(F.col("a"), F.col("b"), F.col("c"))) == [12.0, 18.0, 12.0]


def test_texts(spark):
    labels = ["Wages", "Sick Leave"]
    got = values(spark, [("wages",), ("SICK-leave",), ("on sick leave now",), ("x",), (None,)], "a string", tx.canonical_label(F.col("a"), labels))
    assert got == ["Wages", "Sick Leave", "Sick Leave", "OTHER", "OTHER"]
    pages = ['{"natural_text": "hi", "is_table": true}', "---\nprimary_language: en\nis_table: True\n---\nbody --- more\n", " plain "]
    got = [(x["meta"], x["body"]) for x in values(spark, [(p,) for p in pages], "a string", tx.front_matter(F.col("a")))]
    assert got == [({"is_table": "true"}, "hi"), ({"primary_language": "en", "is_table": "True"}, "body --- more"), ({}, "plain")]
    assert values(spark, [("A b. C!\n\n D\n \nE",), ("",), (None,)], "a string", tx.split_sentences(F.col("a"))) == [["A b.", "C!", "D", "E"], [], None]
    assert values(spark, [("0123456789",)], "a string", tx.around(F.col("a"), F.lit(1), F.lit(3), 2)) == ["01234"]


def test_headings(spark):
    lines = ["ARTICLE IV", "3.1 Hours", "Management Rights", "the parties meet and agree on nothing in particular today;", "Note:", "ab", "it is what it is and no more than that would ever be said here"]
    assert values(spark, [(x,) for x in lines], "a string", headings.heading_like(F.col("a"))) == [True, True, True, False, True, False, False]
    text = "  PART I\n\n\nHours\nThe worker shall be paid for all of the hours worked.\n\nNo\n\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "d int, t string")
    found = sorted((r.d, r.start, r.heading) for r in headings.blocks(docs, "d", "t").collect())
    assert found == [(1, 2, "PART I"), (1, text.index("Hours"), "Hours"), (1, text.index("No\n"), "No")]
    cuts = spark.createDataFrame([(1, 2, "top", "PART I"), (1, text.index("Hours"), "sub", "Hours"), (1, text.index("No\n"), "sub", "No")], "d int, start int, level string, title string")
    got = [tuple(r) for r in headings.assembled(cuts, docs, "d", "t").collect()]
    assert got == [(1, text.index("Hours"), text.index("\n\nNo"), "PART I", "Hours")]
    rows = spark.createDataFrame([(1, 0, "sub", 0.9, "a"), (1, 0, "top", 0.3, "b"), (1, 5, "top", 0.1, "c")], "d int, start int, level string, confidence double, title string")
    assert [r.title for r in headings.verified(rows, "d").collect()] == ["b"]


def test_budget(spark):
    got = values(spark, [([5, 9, 2, 1],), ([],), ([11],)], "a array<int>", headings.within_budget(F.col("a"), 10))
    assert [(x["used"], x["taken"]) for x in got] == [(9, [True, False, True, False]), (0, []), (0, [False])]


def test_rows(spark):
    listed = spark.createDataFrame([("document_1", "2", "a"), ("document_1", "x", "a")], "document_id string, document_page string, feature_name string")
    paged = spark.createDataFrame([("document_1_page_2", ["a", "b"]), ("other", ["c"])], "id string, features array<string>")
    assert sorted(tuple(r) for r in readers.feature_rows(listed, paged).collect()) == [("document_1", 2, "a"), ("document_1", 2, "b")]
    assert [r.cluster_id for r in readers.clustered(spark.createDataFrame([("1",), ("x",), (None,)], "cluster_id string")).collect()] == [1]


def brute_clusters(ids, vectors, eps, least):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 1 - eps - 1e-12
    core = near.sum(1) >= least
    name = {i: ids[i] for i in np.flatnonzero(core)}
    changed = True
    while changed:
        changed = False
        for i in name:
            low = min(name[j] for j in np.flatnonzero(near[i] & core))
            changed |= low < name[i]
            name[i] = low
    return {ids[i]: (name[i] if core[i] else min((name[j] for j in np.flatnonzero(near[i] & core)), default=None), bool(core[i])) for i in range(len(ids))}


def test_density_clusters(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(160).collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    ids += [10_000 + k for k in range(5)]
    vectors = np.concatenate([vectors, vectors[:1].repeat(3, 0), vectors[1:2], -vectors[2:3]])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "id long, vector array<double>")
    odd = spark.createDataFrame([(-1, [0.0] * 64), (-2, None)], "id long, vector array<double>")
    for eps in (0.02, 0.35, 0.6, 0.8):
        got = {r.id: (r.cluster, r.core) for r in graphs.density_clusters(frame.unionByName(odd), eps, 3, block=40).collect()}
        assert got.pop(-1) == got.pop(-2) == (None, False)
        assert got == brute_clusters(ids, vectors, eps, 3)
    assert graphs.density_clusters(odd, 0.3, 1).where("core").count() == 0


def test_sentences_fall_back(spark):
    assert values(spark, [("...",), ("Hello.World",), ("One. ",), ("a\nb",), ("A b. C!",), (" \n",), ("",)], "a string", tx.sentences(F.col("a"))) == [["..."], ["Hello.World"], ["One."], ["a", "b"], ["A b.", "C!"], [], []]
