"""Quality by votes of the nearest labelled neighbours in a latent semantic space.

Terms are bigrams of byte classes (letters by case, digits, white space, each punctuation mark, other), word
lengths, and words that repeat the one before or many before. TF-IDF vectors, with document frequencies over
all documents, are projected by a truncated SVD of a bounded labelled sample. The sample's latent vectors
are broadcast; every document's cosines with all of them are computed in blocks, and its nearest neighbours
vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .language_id import document_frequencies, normalised, sample, text_blocks, tfidf, vectors, weights
from .scratch import documents

_CLASS = np.full(256, 1, np.int64)
_CLASS[128:] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[32], _CLASS[10] = 6, 7
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_MARKS] = np.arange(8, 8 + len(_MARKS))
CLASSES = 8 + len(_MARKS)
LENGTHS, REPEATS = 24, 8
DIMS = CLASSES * CLASSES + LENGTHS + REPEATS


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the terms above, a row a text."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMS), np.float32)
    if not len(data):
        return out
    kind = _CLASS[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    same = row[1:] == row[:-1]
    cell = row[:-1] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:]
    out[:, : CLASSES * CLASSES] = np.bincount(cell[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    starts, ends, owner = B.words(data, offsets)
    if not len(starts):
        return out
    size = np.minimum(ends - starts, LENGTHS) - 1
    out[:, CLASSES * CLASSES : CLASSES * CLASSES + LENGTHS] = np.bincount(owner * LENGTHS + size, minlength=n * LENGTHS).reshape(n, -1)
    value = B.span_hashes(B.LOWER[data], starts, ends)
    base = CLASSES * CLASSES + LENGTHS
    again = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
    out[:, base] = np.bincount(owner[1:][again], minlength=n)
    # Words met before in the text, by the share of its words that they are.
    order = np.lexsort((value, owner))
    met = (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    seen, words = np.bincount(owner[order][1:][met], minlength=n), np.bincount(owner, minlength=n)
    band = np.minimum(np.floor(seen / np.maximum(words, 1) * (REPEATS - 1)), REPEATS - 2).astype(int)
    out[np.arange(n), base + 1 + band] = np.minimum(words, 255)
    return out


@dataclass
class Neighbours:
    idf: np.ndarray
    axes: np.ndarray
    latent: np.ndarray
    labels: np.ndarray
    near: int
    sharpness: float


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, *, per_label: int = 1500, axes: int = 64, near: int = 15, sharpness: float = 8.0) -> Neighbours:
    """Neighbours from rows of docs(doc_id, text) that labels(doc_id, quality) marks 0 or 1 and `learn` admits.

    At most about `per_label` rows of each label, by a hash of doc_id, are learnt from. Labels other than 0
    and 1, and null ids, are left out; an id labelled both ways counts once each way. If rows of only one
    label, or none, are there, every score is that label's, or 0.5.
    """
    df, n = document_frequencies(docs, term_counts, DIMS)
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").distinct()
    if learn is not None:
        marked = marked.where(learn)
    some = sample(marked, "quality", per_label)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(some), "doc_id")
    x, y = vectors(rows, "quality", term_counts)
    idf = weights(df, n)
    if not len(y):
        return Neighbours(idf, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), near, sharpness)
    x = tfidf(x, idf)
    values, vecs = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = vecs[:, ::-1][:, : min(axes, x.shape[0])].astype(np.float32)
    return Neighbours(idf, basis, normalised(x @ basis), np.array(y, float), near, sharpness)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k highest of each row; of equal ones the first, which is that of the least doc_id."""
    best = np.argpartition(cosine, -k, axis=1)[:, -k:]
    least = np.take_along_axis(cosine, best, 1).min(1)
    for row in np.flatnonzero((cosine >= least[:, None]).sum(1) > k).tolist():
        best[row] = np.argsort(-cosine[row], kind="stable")[:k]
    return best


def scores(model: Neighbours, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if not len(model.labels):
        return np.full(len(offsets) - 1, 0.5)
    latent = normalised(tfidf(term_counts(data, offsets), model.idf) @ model.axes)
    cosine = latent @ model.latent.T
    best = nearest(cosine, min(model.near, cosine.shape[1]))
    weight = np.clip(np.take_along_axis(cosine, best, 1), 0, 1).astype(float) ** model.sharpness + 1e-9
    return ((weight * model.labels[best]).sum(1) / weight.sum(1)).clip(0, 1)


def _scored(model, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_blocks(batch, column):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores(model.value, data, at))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text), score from 0 to 1, higher for label 1.

    Null and empty texts have a zero vector, as far from every neighbour; as in any tie, those of the least
    doc_ids vote.
    Repeated rows score alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scored(shared, 1), "doc_id long, score double")


def accepted(docs: DataFrame, model: Neighbours, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least `threshold`; nothing is shuffled."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [scores(shared.value, data, where) >= threshold for _, _, data, where in text_blocks(batch, at)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
