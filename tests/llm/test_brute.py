"""Operators and the pipeline against plain versions of what they compute."""

import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import language_id, quality, token_counts, token_files
from granary.llm.bytesops import LOWER

SPACE = b" \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def byte_words(text):
    """Runs of bytes other than space and 0x09-0x0D, A-Z lower-cased."""
    return lower(text).encode().translate(bytes(32 if b in SPACE else b for b in range(256))).split()


def unit(x):
    n = np.linalg.norm(x)
    return x / max(n, 1e-9)


def quality_terms(text):
    raw = (text or "").encode()
    kind = quality._CLASS
    out = np.zeros(quality.DIMS)
    for a, b in zip(raw, raw[1:], strict=False):
        out[kind[a] * quality.CLASSES + kind[b]] += 1
    own, base = byte_words(text), quality.CLASSES**2
    for w in own:
        out[base + min(len(w), quality.LENGTHS) - 1] += 1
    base += quality.LENGTHS
    out[base] = sum(a == b for a, b in zip(own, own[1:], strict=False))
    if own:
        seen = len(own) - len(set(own))
        out[base + 1 + min(math.floor(seen / len(own) * (quality.REPEATS - 1)), quality.REPEATS - 2)] = min(len(own), 255)
    return out


def weighted(counts, df, n):
    return unit(np.log1p(counts) * (np.log((1 + n) / (1 + df)) + 1))


def quality_scores(docs, labels, admit):
    """{row: (score, whether the vote is clear of ties)} of (doc_id, text) rows, all labelled rows learnt from."""
    terms = [quality_terms(t) for _, t in docs]
    df = np.sum([t > 0 for t in terms], 0)
    vectors = [weighted(t, df, len(docs)) for t in terms]
    learnt = sorted((i, y, k) for k, (i, _) in enumerate(docs) for y in labels.get(i, ()) if y in (0, 1) and admit(i))
    x = np.array([vectors[k] for *_, k in learnt])
    axes = np.linalg.svd(x, full_matrices=False)[2][:64].T
    latent = [unit(v @ axes) for v in x]
    out = []
    for v in vectors:
        own = unit(v @ axes)
        cosine = [float(own @ z) for z in latent]
        order = sorted(range(len(cosine)), key=lambda k: (-cosine[k], k))
        clear = len(order) <= 15 or cosine[order[14]] - cosine[order[15]] > 1e-5
        weight = [min(max(cosine[k], 0), 1) ** 8 + 1e-9 for k in order[:15]]
        out.append((sum(w * learnt[k][1] for w, k in zip(weight, order, strict=False)) / sum(weight), clear))
    return out


@pytest.fixture(scope="module")
def rows(spark, data):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def labels(spark, data):
    out = {}
    for r in spark.read.parquet(f"{data}/labels.parquet").collect():
        out.setdefault(r.doc_id, []).append(r.quality)
    return out


def test_quality_brute(spark, data, rows, labels):
    want = quality_scores([(i, t) for i, t, _ in rows], labels, lambda i: zlib.crc32(str(i).encode()) % 5 != 0)
    got = {r.doc_id: r for r in quality.query(spark, data).collect()}
    assert len(got) == len(rows)
    for (i, _, _), (score, clear) in zip(rows, want, strict=True):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert not clear or abs(got[i].score - score) < 2e-3, i
    assert sum(clear for _, clear in want) > 0.9 * len(want)


def trigrams(text):
    own = [b if b >= 128 else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in (text or "").lower().encode()]
    out = np.zeros(language_id.DIMS)
    for a, b, c in zip(own, own[1:], own[2:], strict=False):
        if (a, b) != (32, 32) and (b, c) != (32, 32):
            code = (a * 2654435761 + b * 2246822519 + c * 3266489917) % 2**32
            code = ((code ^ (code >> 15)) * 2146121005) % 2**32
            out[code >> 20] += 1
    return out


def test_language_brute(spark, data, rows):
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    terms = {i: trigrams(t) for i, t, _ in rows}
    learnt = sorted((i, lang) for i, t, lang in rows if not held[i] and lang and t and any(c.isalpha() for c in t))
    df, n = np.sum([terms[i] > 0 for i, _ in learnt], 0), len(learnt)
    centres = []
    for lang in sorted({x for _, x in learnt}):
        own = [weighted(terms[i], df, n) for i, x in learnt if x == lang]
        first = [own[0]]
        while len(first) < min(4, len(own)):
            first.append(min(own, key=lambda v: max(float(v @ c) for c in first)))
        c = [unit(v) for v in first]
        for _ in range(12):
            to = [max(range(len(c)), key=lambda k: float(v @ c[k])) for v in own]
            c = [unit(np.mean([v for v, k in zip(own, to, strict=True) if k == j], 0)) if j in to else c[j] for j in range(len(c))]
        centres += [(x, lang) for x in c]
    got = {r.doc_id: r for r in language_id.query(spark, data).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i].held_out == held[i]
        if not t or not any(c.isalpha() for c in t):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        v = weighted(terms[i], df, n)
        near = sorted(((float(v @ c), lang) for c, lang in centres), reverse=True)
        assert abs(got[i].score - near[0][0]) < 2e-2, i
        assert got[i].lang_pred == near[0][1] or near[0][0] - next(s for s, x in near if x != near[0][1]) < 2e-2, i


def test_language_ignores_what_it_may_not_learn(spark):
    """Rows held out or without a language change nothing in the model."""
    own = [(k, f"some words of row {k} here", "en") for k in range(12)] + [(20 + k, f"worte der zeile {k} dort", "de") for k in range(12)]
    more = [(50 + k, "zzz qqq other text", None) for k in range(9)] + [(80 + k, "secret words", "en") for k in range(9)]
    schema = "doc_id long, text string, lang string"
    models = [language_id.fit(spark.createDataFrame(x, schema), F.col("doc_id") < 80) for x in (own, own + more)]
    assert np.array_equal(models[0].idf, models[1].idf) and np.array_equal(models[0].centres, models[1].centres)


def test_ties_go_to_the_first():
    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0, 0, 0, 0, 0]], np.float32)
    assert [sorted(r) for r in quality.nearest(cosine, 3).tolist()] == [[0, 1, 2], [0, 1, 2]]


def test_samples_are_bounded_by_ids(spark):
    """A doc_id that many rows repeat is learnt from once a label."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "other")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert sorted(model.labels.tolist()) == [0, 1]


def test_token_counts_brute(spark):
    from tokenizers import Tokenizer

    data = "/root/testdata/sf0.01"
    coder = Tokenizer.from_file(token_files.vocabulary("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    got = {r.doc_id: r for r in token_counts.query(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        text = r.text or ""
        lines = text.split("\n") if not text.endswith("\n") else text[:-1].split("\n")
        ends, at = [], 0
        for line in lines if text else []:
            at += len(line) + 1
            ends.append(min(at, len(text)))
        counts, crossing, k = [0] * len(ends), 0, 0
        for start, end in sorted(coder.encode(text, add_special_tokens=False).offsets):
            while k < len(ends) - 1 and ends[k] <= start:
                k += 1
            counts[k] += 1
            crossing += end > ends[k]
        row = got[r.doc_id]
        assert (row.n_tokens, row.n_sections, row.section_tokens, row.n_crossing) == (sum(counts), len(ends), counts, crossing), r.doc_id


def pipeline_brute(rows, labels, bench):
    """Rows of the pipeline's result from (doc_id, text) rows, and the ids kept after each stage."""
    from tokenizers import Tokenizer

    after = {}
    scores = quality_scores(rows, labels, lambda i: True)
    rows = [r for r, (score, _) in zip(rows, scores, strict=True) if score >= 0.3]
    after["quality"] = {i for i, _ in rows}
    last = {lower(t): i for i, t in sorted(rows)}
    rows = [(i, t) for i, t in rows if last[lower(t)] == i]
    after["exact"] = {i for i, _ in rows}
    sets = {}
    for i, t in rows:
        own = byte_words(t)
        sets[i] = {tuple(own[k : k + 5]) for k in range(len(own) - 4)} or ({tuple(own)} if own else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    rows = [(i, t) for i, t in rows if root(i) == i]
    after["near"] = {i for i, _ in rows}
    number = {}

    def ids(text):
        return np.array([number.setdefault(w, len(number)) for w in byte_words(text)], np.int64)

    windows = set()
    for own in map(ids, bench):
        size = min(10, len(own))
        windows |= {tuple(own[k : k + size].tolist()) for k in range(len(own) - size + 1)} if size else set()

    def clean(text):
        own = ids(text)
        for w in windows:
            if len(own) >= len(w):
                same = np.lib.stride_tricks.sliding_window_view(own, len(w)) == np.array(w)
                if (same.sum(1) >= len(w) - len(w) // 5).any():
                    return False
        return True

    rows = [(i, t) for i, t in rows if clean(t)]
    after["decontamination"] = {i for i, _ in rows}
    coder = Tokenizer.from_file(token_files.vocabulary("word_bpe_49k.json"))
    size = {i: len(coder.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    counts = sorted(Counter(size.values()).items())
    least = {0: (0, ())}  # of the first j lengths: padding, edges
    for _ in range(8):
        least = {j: min([x for x in [least.get(j)] if x] + [(least[i][0] + sum(c * (counts[j - 1][0] - n) for n, c in counts[i:j]), (*least[i][1], counts[j - 1][0])) for i in least if i < j]) for j in range(len(counts) + 1) if j in least or any(i < j for i in least)}
    padding, edges = least[len(counts)]
    return after, size, padding, len(edges)


def test_pipeline_brute(spark, data, rows, labels):
    bench = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if r.text is not None]
    after, size, padding, _ = pipeline_brute([(i, t) for i, t, _ in rows], labels, bench)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert {r.doc_id for r in docs.select("doc_id").collect()} == after[name], name
    got = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id: r.n_tokens for r in got} == size and len(got) == len(size)
    assert sum(r.bucket_length - r.n_tokens for r in got) == padding
    for r in got:
        own = sorted(x.doc_id for x in got if x.bucket == r.bucket)
        assert r.bucket_length == max(size[i] for i in own)
        assert r.batch == own.index(r.doc_id) // max(1, 16384 // r.bucket_length)
    assert len(after["quality"]) < len(rows) and len(after["exact"]) < len(after["quality"]) and len(after["decontamination"]) < len(after["near"]) < len(after["exact"])


def test_lower_table():
    assert bytes(LOWER[np.frombuffer(b"AZaz[@", np.uint8)]) == b"azaz[@"
