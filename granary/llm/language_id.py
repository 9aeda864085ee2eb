"""Language identification by the nearest of several centroids of each language.

Texts become TF-IDF vectors of hashed byte trigrams of their lower-cased letters, anything else in ASCII
being a blank and trigrams with two blanks left out. Document frequencies are counted over all rows that may be
learnt from; labelled vectors of a bounded sample of them are clustered by language (spherical k-means), and a text
takes the language of the centroid of the highest cosine. A centroid's distance limit is what all but a
stated share of its own texts keep; farther texts are marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .scratch import documents

DIMS = 4096
BLOCK = 1 << 19
LETTER = r"\p{L}"
UNDETERMINED = "und"


#: Bytes of ASCII letters and of all beyond ASCII stand for themselves.
LETTERS = np.full(256, 32, np.uint32)
LETTERS[128:] = np.arange(128, 256)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte trigrams, a row a text; none reaches over the end of a text."""
    n = len(offsets) - 1
    low = LETTERS[data]
    if len(low) < 3:
        return np.zeros((n, DIMS), np.float32)
    blank = low == 32
    solid = ~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))
    code = low[:-2] * np.uint32(2654435761) + low[1:-1] * np.uint32(2246822519) + low[2:] * np.uint32(3266489917)
    code ^= code >> np.uint32(15)
    code *= np.uint32(2146121005)
    cell = (code >> np.uint32(20)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))[: len(cell)]
    inside = solid & (np.arange(len(cell)) + 3 <= offsets[row + 1])
    return np.bincount((row * DIMS + cell)[inside], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def text_blocks(batch: pa.RecordBatch, column: int, lower: bool = False, most: int = BLOCK, rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j of a batch with their texts' bytes and offsets, so many bytes and rows at a time."""
    data, at = B.buffers(pc.utf8_lower(batch.column(column)) if lower else batch.column(column))
    for i, j in B.blocks(at, most):
        for k in range(i, j, rows):
            m = min(j, k + rows)
            yield k, m, data[at[k] : at[m]], at[k : m + 1] - at[k]


def document_frequencies(docs: DataFrame, counts, dims: int, lower: bool = False) -> tuple[np.ndarray, int]:
    """In how many rows of docs(text) each term occurs, and how many rows there are; summed on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for i, j, data, at in text_blocks(batch, 0, lower):
                total += (counts(data, at) > 0).sum(0)
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.concatenate([[n], total]))], ["term", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(dims + 1, np.int64)
    for r in found:
        out[r.term + 1] = r.n
    return out[1:], int(out[0])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)).astype(np.float32) + 1


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return normalised(np.log1p(counts) * idf)


def sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """The rows of about `most` ids of each label by a hash of doc_id, of all where there are fewer."""
    share = {r[label]: min(1.0, most / r["n"]) for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(0.0)
    for value, part in share.items():
        keep = F.when(F.col(label) == F.lit(value), F.lit(part)).otherwise(keep)
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003)) < keep * 1_000_003)


def vectors(rows: DataFrame, label: str, counts, lower: bool = False) -> tuple[np.ndarray, list]:
    """Term counts and labels of a sample (doc_id, text, label), on the driver, by doc_id; of rows that share
    id and label, one with the least text, so that the driver gets no more than were sampled."""
    rows = rows.groupBy("doc_id", label).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_blocks(batch, 2, lower):
                sparse = [x.astype(np.uint16) for x in np.minimum(counts(data, at), 65535)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).cast(pa.string()), pa.array([x.tobytes() for x in sparse], pa.binary())], ["doc_id", "label", "x"])

    found = rows.select("doc_id", label, "text").mapInArrow(run, "doc_id long, label string, x binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.label, bytes(r.x)))
    return np.array([np.frombuffer(r.x, np.uint16) for r in found]).astype(np.float32), [r.label for r in found]


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart first centres."""
    centres = [x[0]]
    for _ in range(1, min(k, len(x))):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = normalised(np.array(centres))
    for _ in range(rounds):
        to = np.argmax(x @ c.T, axis=1)
        c = normalised(np.array([x[to == i].mean(0) if (to == i).any() else c[i] for i in range(len(c))]))
    return c


@dataclass
class Centroids:
    idf: np.ndarray
    centres: np.ndarray
    names: list[str]
    limits: np.ndarray


def fit(docs: DataFrame, learn: Column, *, per_language: int = 400, per_language_centroids: int = 4, rejected_share: float = 0.005) -> Centroids:
    """Centroids from rows of docs(doc_id, text, lang) that satisfy `learn` and have a language and a letter.

    At most about `per_language` texts of each language, by a hash of doc_id, are clustered; document
    frequencies come from all those rows.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    df, n = document_frequencies(rows, trigram_counts, DIMS, True)
    x, names = vectors(sample(rows, "lang", per_language), "lang", trigram_counts, True)
    idf = weights(df, n)
    if not names:
        return Centroids(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    x = tfidf(x, idf)
    centres, owners, limits = [], [], []
    for name in sorted(set(names)):
        own = x[[k for k, y in enumerate(names) if y == name]]
        c = clusters(own, per_language_centroids)
        near = own @ c.T
        for i in range(len(c)):
            mine = near[np.argmax(near, axis=1) == i, i]
            centres.append(c[i])
            owners.append(name)
            limits.append(float(np.quantile(mine, rejected_share)) if len(mine) else 0.0)
    return Centroids(idf, np.array(centres, np.float32), owners, np.array(limits))


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i, j, data, at in text_blocks(batch, 1, True):
                texts = batch.column(1).slice(i, j - i)
                names, scores, far = [UNDETERMINED] * (j - i), np.zeros(j - i), np.ones(j - i, bool)
                if m.names:
                    near = tfidf(trigram_counts(data, at), m.idf) @ m.centres.T
                    best = np.argmax(near, axis=1)
                    value = near[np.arange(j - i), best].clip(0, 1)
                    for k in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, LETTER), False)).tolist():
                        names[k], scores[k], far[k] = m.names[best[k]], value[k], value[k] < m.limits[best[k]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names), pa.array(scores.astype(float)), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of docs(doc_id, text).

    A null text, or one without a letter, is `und` with score 0 and rejected; so is any text if nothing was
    learnt. The score is the cosine to the nearest centroid. A rejected text keeps the nearest language in
    lang_pred: who wants it undetermined drops it by the mark. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_predicted(shared), "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = identify(docs, fit(docs, ~held))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
