import hashlib
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import same
from pyspark.sql import functions as F

from granary.llm import bytesops as B
from granary.llm import chat_format, components, decontaminate, exact_dedup, language_id, near_dedup, packing, quality, registry, suffix_dedup, token_counts, token_files
from granary.llm.scratch import Scratch, join_groups

ROWS = [(1, None), (2, ""), (3, "a"), (4, "A"), (None, "a b c d e f g h i j k l"), (5, "x " * 30_000), (5, "x " * 30_000), (6, "  \n\n "), (7, None), (8, "One two. Three é\n four"), (9, "a b c d e f g h i j k l")]
#: Names that the operators use themselves.
CLASH = ["n", "key", "rid", "bucket", "sig", "items", "recipe", "part", "tid", "pos", "comp", "batch"]


def table(spark, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    return out.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))


def by_id(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, data, duck, name):
    assert same(registry.QUERIES[name](spark, data), duck.execute(registry.ORACLE_SQL[name]))


def operators(spark):
    labels = spark.createDataFrame([(1, 0), (8, 1), (9, None), (None, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    return {
        "near": near_dedup.near_duplicates,
        "exact": exact_dedup.exact_duplicates,
        "suffix": suffix_dedup.strip_repeats,
        "quality": lambda d: quality.score(d, quality.fit(d, labels)),
        "clean": lambda d: decontaminate.contamination(d, bench),
        "language": lambda d: language_id.identify(d, language_id.fit(d.withColumn("lang", F.when(F.col("doc_id") > 3, "en")), F.lit(True))),
        "counts": lambda d: token_counts.token_counts(d, token_files.vocabulary("byte_bpe_50k.json")),
        "pack": lambda d: packing.pack(packing.word_lengths(d)),
    }


@pytest.mark.parametrize("name", ["near", "exact", "suffix", "quality", "clean", "language", "counts", "pack"])
def test_edges(spark, name):
    op = operators(spark)[name]
    assert op(table(spark, ROWS)).count() == len(ROWS)
    assert op(table(spark, ROWS).limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert op(nothing).count() == 1


def test_near_edges(spark):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, ROWS), width=2).collect()}
    assert got[1].n_shingles == 0 and got[2].component_id == 2 and got[7].kept
    assert got[4].component_id == 3 and not got[4].kept and got[None].kept and got[9].kept
    assert got[5].n_shingles == 1


def test_near_brute(spark):
    rng = np.random.default_rng(3)
    docs = []
    for g in range(6):
        base = [f"w{g}_{k}" for k in range(120)]
        for _ in range(25):
            words = list(base)
            for k in rng.choice(120, rng.integers(0, 14), replace=False):
                words[k] = f"z{rng.integers(10**6)}"
            docs.append(" ".join(words))
    docs += docs[:5] + ["solo", "SOLO", "so lo"]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or {tuple(w)}

    sets, parent = [shingles(t) for t in docs], list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in combinations(range(len(docs)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    want = {i: root(i) for i in range(len(docs))}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), width=2).collect()}
    assert got == want


def test_sketch_keeps_small_pairs():
    """Pairs at exactly 0.8, four of five shingles, pass the one-bit hashes."""
    rng = np.random.default_rng(7)
    five = [np.sort(s) for s in rng.integers(0, 2**64, (20_000, 5), dtype=np.uint64)]
    four = [np.delete(s, k) for s, k in zip(five, rng.integers(0, 5, len(five)), strict=True)]

    def sketch(sets):
        lines = [" ".join(f"{v:x}" for v in s) for s in sets]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), pa.array(lines)], ["doc_id", "text"])
        made = pa.Table.from_batches(near_dedup._signed(1, 200)([batch]))
        return np.stack([made[c].to_numpy() for c in near_dedup.SKETCH], 1).view(np.uint64)

    bits = 64 * near_dedup.LONGS
    equal = bits - np.bitwise_count(sketch(five) ^ sketch(four)).sum(1, dtype=int)
    assert equal.min() >= near_dedup.least_matches(bits, bits, 0.9, 1e-9)[0]
    assert abs(equal.mean() / bits - 0.9) < 0.002


def test_exact_edges(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(table(spark, ROWS)).collect()}
    assert got[1].keep_id == 7 and got[1].group_size == 3 and not got[2].kept and got[4].kept and not got[3].kept
    assert got[5].kept and got[5].group_size == 2 and got[9].kept and not got[None].kept
    assert got[3].text_sha256 == hashlib.sha256(b"a").hexdigest()


def test_exact_collision(spark):
    """Chunks said to collide are compared themselves."""
    docs = table(spark, ROWS[:5]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = docs.select("doc_id", "text", exact_dedup.chunks(F.col("text")).alias("chunks"))
    collided = spark.createDataFrame([(hashlib.sha256(b"a").digest(),)], "id binary")
    got = {r.doc_id: r.recipe for r in exact_dedup.resolved(cut, collided).collect()}
    assert [bytes(x) for x in got[3]] == [bytes(33) + b"a"] and [len(x) for x in got[4]] == [32]


def test_chunks_join_to_text(spark):
    text = " ".join(f"word{k} of line\n" for k in range(4000))
    got = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks(F.col("t"))).first()[0]
    assert "".join(got) == text and len(got) > 3


def strip_brute(docs):
    first, out = {}, []
    for i, t in sorted(docs):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in docs:
        b = np.frombuffer(t.encode(), np.uint8)
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50].tobytes()] < i:
                gone[k : k + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(b[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_suffix_brute(spark):
    rng = np.random.default_rng(5)
    shared = ["".join(rng.choice(list("abé \0"), n)) for n in (49, 50, 51, 90, 300)]
    docs = []
    for k in range(40):
        parts = ["".join(rng.choice(list("xyz\n"), rng.integers(0, 80))), shared[k % 5], "".join(rng.choice(list("ab"), rng.integers(0, 60)))]
        docs.append((k * 3 % 41, "".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "q" * 400), (103, "q" * 60), (104, "")]
    rows = suffix_dedup.strip_repeats(spark.createDataFrame(docs, "doc_id long, text string")).drop("kept")
    assert sorted(tuple(r) for r in rows.collect()) == strip_brute(docs)


def test_suffix_query_brute(spark, data):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in suffix_dedup.query(spark, data).collect()) == strip_brute(docs)


def test_suffix_runs(spark, monkeypatch):
    """Long runs of one byte, where every place is an anchor, in several cuts and collections."""
    monkeypatch.setattr(suffix_dedup, "CUT_AT_ONCE", 5000)
    docs = [(1, "x" * 30_000), (2, "y" + "x" * 40_000 + "z" * 60), (3, "ab" * 9000), (4, "z" * 59), (5, "ba" * 9000 + "x" * 49)]
    rows = suffix_dedup.strip_repeats(spark.createDataFrame(docs, "doc_id long, text string")).drop("kept")
    assert sorted(tuple(r) for r in rows.collect()) == strip_brute(docs)


@pytest.mark.parametrize("name", ["near", "exact", "suffix", "quality", "clean", "language", "counts", "pack"])
def test_very_long_texts(spark, name):
    """A text of one word, one of many words, and one of a single line feed's worth of lines, of a megabyte each."""
    rows = [(1, "x" * 1_000_000), (2, "some words " * 90_000), (3, "\n" * 1_000_000), (4, "short"), (5, "x" * 1_000_000)]
    assert operators(spark)[name](table(spark, rows)).count() == 5


def test_collection_bwt():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, width = rng.integers(1, 8), rng.integers(1, 20)
        sizes = rng.integers(0, width + 1, n)
        pieces = (rng.integers(97, 99, (n, width)) * (np.arange(width) < sizes[:, None])).astype(np.uint8)
        _, piece, start, lcp = suffix_dedup.collection_bwt(pieces, sizes)
        want = sorted((bytes(pieces[i, k : sizes[i]]), i, k) for i in range(n) for k in range(sizes[i] + 1))
        assert [(i, k) for _, i, k in want] == list(zip(piece.tolist(), start.tolist(), strict=True))
        common = [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for (a, *_), (b, *_) in zip(want, want[1:], strict=False)]
        assert lcp.tolist() == [0, *common]


def test_quality(spark):
    rows = quality.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_masks_leave_no_window():
    for window in range(1, 11):
        wrong = window // decontaminate.SUBSTITUTED
        for c in combinations(range(window), wrong):
            assert any(not {p + s for p in m} & set(c) for m in decontaminate.masks(window, wrong) for s in range(window - m[-1]))


def test_substitutions(spark):
    words = [f"b{k}" for k in range(30)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "p q r")], "item_id long, text string")
    far = words[:]
    far[3:28:3] = ["no"] * len(far[3:28:3])
    near = words[5:15]
    near[2] = near[6] = "no"
    docs = [(1, " ".join(words)), (2, " ".join(["u", *near, "v"])), (3, " ".join(far)), (4, "P Q  R"), (5, "p q x r"), (6, None)]
    got = {r.doc_id: r["items"] for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [2], 5: [], 6: []}


def test_clean_by_items_without_id(spark):
    bench = spark.createDataFrame([(None, "a b c"), (None, "q r"), (1, "d e f"), (None, None)], "item_id long, text string")
    docs = table(spark, [(1, "x A  b c"), (2, "d e f"), (3, "a c b"), (4, None), (5, "q r")])
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {3, 4}
    assert {r.doc_id: r["items"] for r in decontaminate.contamination(docs, bench).collect()} == {1: [], 2: [1], 3: [], 4: [], 5: []}


def test_contamination_by_blocks(spark, monkeypatch):
    """A benchmark of several blocks gives every row back, those that repeat an id or have none too."""
    bench = spark.createDataFrame([(k, " ".join(f"i{k}w{n}" for n in range(12))) for k in range(8)], "item_id long, text string")
    rows = [(1, "i3w0 i3w1 i3w2 i3w3 i3w4 i3w5 i3w6 i3w7 i3w8 i3w9"), (1, "clean"), (None, " ".join(f"i{k}w{n}" for k in (5, 2) for n in range(12))), (None, None), (2, ""), (2, "")]
    want = by_id(decontaminate.contamination(table(spark, rows), bench))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert by_id(decontaminate.contamination(table(spark, rows), bench)) == want
    assert sorted(r[3] for r in want) == [[], [], [], [], [2, 5], [3]]
    assert decontaminate.clean(table(spark, rows), bench).count() == 4


def test_word_hashes_of_structured_bytes():
    """Thue-Morse words and their complements, which polynomials modulo 2**64 cannot tell apart, differ."""
    for bits in (5, 7, 8, 10, 11, 12):
        one = np.array([97 + bin(k).count("1") % 2 for k in range(1 << bits)], np.uint8)
        data = np.concatenate([one, 195 - one])
        at = np.array([0, len(one)])
        a, b = B.span_hashes(data, at, at + len(one)).tolist()
        assert a != b
        x, y = (B.shingles(d, np.array([0, len(d)]), 2)[0].tolist() for d in (one, 195 - one))
        assert x != y and len(x) == len(y) == 1


def test_shingles_of_few_words():
    """Blocks of fewer words than a shingle has."""
    for n in range(7):
        text = np.frombuffer(" ".join("abcdefg"[:n]).encode(), np.uint8)
        for width in (1, 2, 5):
            assert len(B.shingles(text, np.array([0, len(text)]), width)[0]) == (max(1, n - width + 1) if n else 0)


def test_word_hashes():
    """Equal spans have equal hashes wherever they stand; others differ."""
    rng = np.random.default_rng(6)
    spans = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in rng.integers(0, 300, 4000)]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(x) for x in spans])
    got = B.span_hashes(data, ends - [len(x) for x in spans], ends).tolist()
    assert len(set(got)) == len(set(spans)) == len(set(zip(got, spans, strict=True)))


def test_components(spark, monkeypatch):
    """Contraction over several tasks and levels, with a hub, a path and cliques."""
    rng = np.random.default_rng(8)
    links = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(60)] + [tuple(map(int, x)) for x in rng.integers(200, 260, (45, 2))] + [(7, 7), (None, 3)]
    parent = {k: k for link in links for k in link if k is not None}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {k: root(k) for a, b in links if a is not None and a != b for k in (a, b)}
    frame = spark.createDataFrame(links, "a long, b long")
    for most in (1 << 19, 30, 7):
        monkeypatch.setattr(components, "LINKS", most)
        got = [tuple(r) for r in components.connected_components(frame, Scratch(spark)).collect()]
        assert dict(got) == want and len(got) == len(want)
    assert components.connected_components(frame.limit(0), Scratch(spark)).count() == 0


def test_hot_groups(spark):
    """A group of most rows is dealt to many tasks and joins as any other; keys may be arrays or null-free binaries."""
    rows = spark.range(2000).select("id", F.array(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))).alias("k"))
    groups = Scratch(spark).table(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "groups")
    got = join_groups(rows, groups, "k", "n", "id")
    assert sorted(got.columns) == ["id", "k", "least", "n"] and got.count() == 2000
    assert sorted(tuple(r) for r in got.select("id", "least").collect()) == sorted(tuple(r) for r in rows.join(groups, "k").select("id", "least").collect())
    assert join_groups(rows.limit(0), groups.limit(0), "k", "n", "id").count() == 0


def test_token_files(spark, data):
    from tokenizers import Tokenizer

    path = token_files.vocabulary("word_bpe_49k.json")
    coder, at, want = Tokenizer.from_file(path), 0, []
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    for r in docs:
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.query(spark, data).collect()) == want


def test_token_file_edges(spark, tmp_path):
    root = f"file://{tmp_path}/tokens"
    made = token_files.write_tokens(table(spark, ROWS), root, token_files.vocabulary("word_bpe_49k.json"), end=2)
    assert token_files.open_tokens(root) == made
    rows = token_files.read_tokens(spark, made).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9] and rows[1].n_tokens == 1
    assert token_files.read_tokens(spark, token_files.write_tokens(table(spark, ROWS).limit(0), f"{root}-none", token_files.vocabulary("word_bpe_49k.json"))).count() == 0


TEXTS = ["a\x1cb <|endoftext|>x  y\tz é ", "\n\n a  b\n\n", "ΑΣ ΟΔΟΣ 'S don't", "é ́x", "a\0b c", "  x", "Plain text. Of words, two\nlines", "", "it's, x.. y", "a~b ~ c~ ~~ \u0130I \u00c9t\u00e9. \u212aelvin \u03a3 E\u0301"]


def test_encoders():
    words = token_files.WordEncoder(token_files.vocabulary("word_bpe_49k.json"))
    want = [np.array(e.ids, "<u2").tobytes() for e in words.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    spans = token_counts.SpanEncoder(token_counts.vocabulary("byte_bpe_50k.json"))
    for _ in range(2):
        assert words.encode(TEXTS) == want
        assert all(np.array_equal(a, b) for a, b in zip(spans.spans(TEXTS), spans.whole(TEXTS), strict=True))


def test_attribution():
    spans, ends = np.array([[0, 3], [3, 8], [8, 9], [9, 9]]), np.array([4, 9])
    assert [token_counts.attribute(spans, ends, r)[0].tolist() for r in token_counts.RULES] == [[2, 2], [1, 3], [1, 3]]
    assert token_counts.attribute(spans, ends)[1] == 1


def test_language(spark):
    rows = language_id.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    docs = table(spark, [(1, None), (2, "12 34 !"), (3, "the words of it"), (4, "the of to is and")]).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit(docs, F.lit(True))).collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "en"}


def test_best_edges():
    rng = np.random.default_rng(2)
    for top in (40, 4000):
        for buckets in (1, 2, 3, 4):
            lengths = rng.integers(0, top, 24)
            own, counts = np.unique(lengths, return_counts=True)
            got = packing.best_edges(own.tolist(), counts.tolist(), buckets)

            def padding(edges, lengths=lengths):
                return sum(min(e for e in edges if e >= n) - n for n in lengths)

            best = min(padding((*c, own[-1])) for k in range(buckets) for c in combinations(own.tolist(), k))
            assert padding(got) == best and len(got) <= buckets and set(got) <= set(lengths.tolist())
    assert packing.best_edges([], [], 3) == [] and packing.best_edges([7], [2], 3) == [7]
    # Equal choices: the last bucket begins lowest.
    assert packing.best_edges([1, 2, 3], [1, 1, 1], 2) == [1, 3]


def test_packing_stage_counts_tokens(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    coder = Tokenizer.from_file(token_files.vocabulary("word_bpe_49k.json"))
    rows = [(1, "中文没有空格" * 4000), (2, "x1y2" * 9000), (3, None), (None, "two words"), (4, "中文没有空格" * 4000)]
    got = p.packing_stage(spark, table(spark, rows), "").collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(coder.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    batches = {}
    for r in got:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    assert all(len(b) == 1 or len(b) * b[0].bucket_length <= 16384 for b in batches.values())


def test_pack_brute(spark):
    """Bucket lengths are lengths that occur, and padding is least over all of them; batches keep the budget."""
    rng = np.random.default_rng(4)
    lengths = [int(n) for n in [*rng.integers(1, 4000, 25), 1025, 1025, 5001]]
    rows = spark.createDataFrame([*enumerate(lengths)], "doc_id long, n_tokens long").withColumn("bucket", F.lit(9))

    def padding(edges):
        return sum(min(e for e in edges if e >= n) - n for n in lengths)

    best = min(padding((*c, max(lengths))) for c in combinations(sorted(set(lengths)), 2))
    got = packing.pack(rows, buckets=3, budget=9000).collect()
    assert sum(r.bucket_length - r.n_tokens for r in got) == best
    for r in got:
        own = sorted(x.doc_id for x in got if x.bucket == r.bucket)
        assert r.batch == own.index(r.doc_id) // max(1, 9000 // r.bucket_length)


def test_calls(spark):
    schema = "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, content string, after array<string>"
    rows = [
        (1, 0, "call", "assistant", "a", "f", '{"y": 1.5, "x": "s"}', None, ["b"]),
        (1, 1, "call", "assistant", "b", "f", '{"x": 3, "z": 0}', None, []),
        (1, 2, "result", "tool", "a", None, None, "ok", []),
        (1, 3, "result", "tool", "q", None, None, None, None),
        (2, 0, "call", "assistant", "a", "g", "not json", None, ["b"]),
        (2, 1, "call", "assistant", "b", "f", "{}", None, ["a"]),
        (3, None, "message", None, None, None, None, None, None),
        (None, 0, "call", "assistant", "a", "f", '{"x": "s"}', None, None),
        (4, 0, "call", "assistant", "a", "f", '{"x": "s"}', None, ["a0"]),
        (4, 1, "call", "assistant", "a", "f", '{"x": "s"}', None, None),
    ]
    made = chat_format.format_chat(spark.createDataFrame(rows, schema).select("*", *(F.lit(1).alias(c) for c in ("level", "calls", "results", "cyclic", "call_turn", "status"))), {"f": {"x": ("string", True), "y": ("number", False)}})
    got = {(r.conv_id, r.turn): r for r in made.collect()}
    assert len(got) == len(rows)
    assert got[1, 0].position > got[1, 1].position and got[1, 2].position > got[1, 0].position
    assert got[1, 0].json == '{"arguments":{"x":"s","y":1.5},"id":"a","name":"f","role":"assistant","type":"call"}' and got[1, 0].errors == []
    assert got[1, 1].errors == ["x: not string", "z: unexpected"] and got[1, 1].status == "unanswered" and got[1, 3].status == "orphan"
    assert got[2, 0].status == got[2, 1].status == "cyclic" and got[2, 0].errors == ["arguments: not an object"] and got[2, 1].errors == ["x: missing"]
    assert chat_format.format_chat(spark.createDataFrame([], schema), {}).count() == 0
    assert got[3, None].json == '{"content":null,"role":null,"type":"message"}' and got[None, 0].status == "unanswered" and got[4, 0].status == "repeated"


def test_levels_brute(spark):
    """Random orders, with long chains, loops of several calls, and calls behind them."""
    rng = np.random.default_rng(9)
    rows = [(-1, f"c{k}", k, [f"c{k + 1}"]) for k in range(12)] + [(-2, f"c{k}", 2 * k, [f"c{k - 1}"]) for k in range(40)]
    rows += [(-3, "a", 0, ["a"]), (-3, "b", 1, ["a"]), (-3, "c", 2, ["b", "x"]), (-3, "d", 3, None), (-4, "a", 0, ["c"]), (-4, "b", 5, ["a"]), (-4, "c", 5, ["b"]), (-4, "d", 1, ["e"]), (-4, "e", 1, [])]
    for conv in range(25):
        n = int(rng.integers(2, 8))
        for k in range(n):
            rows.append((conv, f"c{k}", int(rng.integers(0, n)), [f"c{j}" for j in rng.choice(n, rng.integers(0, 3), replace=False)]))
    want = {}
    for conv in {r[0] for r in rows}:
        own = {c: (t, [p for p in a or [] if any(x[0] == conv and x[1] == p for x in rows)]) for i, c, t, a in rows if i == conv}
        level = {}
        for _ in own:
            level |= {c: max([t, *(level[p] + 1 for p in pre)]) for c, (t, pre) in own.items() if c not in level and all(p in level for p in pre)}
        want |= {(conv, c): (level.get(c, own[c][0]), c not in level) for c in own}
    found = chat_format.levels(spark.createDataFrame(rows, "conv_id long, call_id string, call_turn long, after array<string>"), Scratch(spark)).collect()
    assert len(found) == len(want) and {(r.conv_id, r.call_id): (r.level, r.cyclic) for r in found} == want


def test_exact_stage_rows(spark):
    """Dropping is by row: a doc_id may repeat with other texts, or be null."""
    import corpus_pipeline as p

    rows = [(5, "x"), (7, "X"), (5, "unique"), (8, "twice"), (8, "twice"), (8, "Twice"), (None, "x"), (None, "n"), (None, "N"), (3, None), (2, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    out = p.exact_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert by_id(out.select("doc_id", "text")) == sorted([(7, "X"), (5, "unique"), (8, "Twice"), (None, "N"), (3, None)], key=str)


def test_near_stage_rows(spark):
    """A doc_id that repeats names several documents, and rows without one are documents too."""
    import corpus_pipeline as p

    base = [f"w{k}" for k in range(60)]
    near, other = " ".join([*base, "end"]), " ".join(f"v{k}" for k in range(40))
    rows = [(5, " ".join(base)), (7, near), (7, other), (9, other + " tail"), (None, near + " more"), (None, "alone and by itself here"), (8, None), (8, ""), (3, "few words")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, _row string")
    for given in (docs, docs.repartition(3)):
        out = p.near_stage(spark, given, "")
        assert out.columns == docs.columns
        want = [(5, " ".join(base)), (7, other), (None, "alone and by itself here"), (8, None), (8, ""), (3, "few words")]
        assert by_id(out.select("doc_id", "text")) == sorted(want, key=str)
    single = docs.where("doc_id in (5, 3, 9)").unionByName(docs.where("_row is null"))
    assert by_id(p.near_stage(spark, single, "").select("doc_id")) == [(3,), (5,), (9,)]
    assert p.near_stage(spark, docs.limit(0), "").count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    kept = {}
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, data)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id for r in out.collect()}
        assert kept[name] <= set(before)
        if name == "exact":
            assert kept[name] == set({exact: i for i, exact in sorted((i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for i, t in before.items())}.values())
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contamination(spark.createDataFrame(list(before.items()), "doc_id long, text string"), bench).where("contaminated").collect()}
            assert kept[name] == set(before) - bad
    assert p.run(spark, data).count() == len(kept["packing"]) > 0
