"""Token ids as flat unsigned integer files with 64-bit document offsets.

A range partitioning by doc_id gives the order; each task encodes its documents and writes three files:
ids (little-endian uint16 where the vocabulary allows, else uint32), offsets (int64, one more than there are
documents, from 0) and documents (int64 ids, the least value for null). The partitions' sizes go to the
driver, and their prefix sums are the bases to which a partition's offsets count. Files have names that no
other attempt has, and the manifest holds those of the attempt that counted.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, documents, shuffle_partitions

NO_ID = np.iinfo(np.int64).min
#: Words whose ids a worker keeps at most.
KEPT_WORDS = 800_000
#: Marks that a word may end in, taken by themselves after a letter.
TAILS = frozenset(".,")
#: A word that the tokenizer gives one id, put between words that are encoded together.
MARK = "~"
#: Letters whose lower case is left to the tokenizer: all but those up to Latin Extended-A, less dotted I.
BEYOND = re.compile("[^\x00-\u012f\u0131-\u017f]")
_ENCODERS: dict = {}


class Keeper:
    """What a worker keeps of words, bounded: when full, the later half goes, as frequent words come early;
    every eighth time all goes, lest a change of texts leave it stale. `known` is a plain dict, which the
    set operations walk quickly."""

    def __init__(self, keep: int = KEPT_WORDS):
        self.known: dict[str, bytes] = {}
        self.full, self.keep = 0, keep

    def trim(self) -> None:
        if len(self.known) > self.keep:
            self.full += 1
            self.known = {} if self.full % 8 == 0 else dict(islice(self.known.items(), self.keep // 2))


class WordEncoder(Keeper):
    """Ids of texts by a tokenizer whose tokens never cross a space or line feed and do not depend on what
    stands beyond one, that lower-cases, and that takes a mark after a letter by itself. Texts are cut there,
    and the ids of words are kept from one text to the next; new words are encoded together in
    one text."""

    def __init__(self, path: str, keep: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        super().__init__(keep)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    @classmethod
    def of(cls, path: str, keep: int = KEPT_WORDS) -> WordEncoder:
        if (path, keep) not in _ENCODERS:
            _ENCODERS[path, keep] = cls(path, keep)
        return _ENCODERS[path, keep]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        self.trim()
        cut = [(t if BEYOND.search(t) else t.lower()).replace("\n", " ").split(" ") for t in texts]
        new = set().union(*cut).difference(self.known)
        tailed = [w for w in new if w[-1:] in TAILS and w[-2:-1].isalpha()]
        new.difference_update(tailed)
        new.update(x for w in tailed for x in (w[:-1], w[-1]) if x not in self.known)
        marked = [w for w in new if MARK in w] if self.mark else list(new)
        plain = list(new.difference(marked))
        for k in range(0, len(plain), 1 << 14):
            some = plain[k : k + (1 << 14)]
            (coded,) = self.tokenizer.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)
            ids = np.array(coded.ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)) * self.dtype.itemsize
            starts = np.append(0, ends[:-1] + self.dtype.itemsize)
            raw = ids.tobytes()
            self.known.update((w, raw[a:b]) for w, a, b in zip(some, starts.tolist(), ends.tolist(), strict=True))
        for w, coded in zip(marked, self.tokenizer.encode_batch_fast(marked, add_special_tokens=False), strict=True):
            self.known[w] = np.array(coded.ids, self.dtype).tobytes()
        get = self.known.__getitem__
        self.known.update((w, get(w[:-1]) + get(w[-1])) for w in tailed)
        return [b"".join(map(get, words)) for words in cut]


def _slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of some rows at a time, of about `most` bytes."""
    rows = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
    for k in range(0, batch.num_rows, rows):
        some = batch.slice(k, rows)
        yield some.column(0).to_pylist(), [t or "" for t in some.column(1).to_pylist()]


def _written(root: str, path: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        part = TaskContext.get().partitionId()
        name = f"{base}/{part:06d}-{uuid.uuid4().hex}"
        encoder = WordEncoder.of(path)
        last = np.array([] if end is None else [end], encoder.dtype).tobytes()
        sizes, ids = [np.zeros(1, np.int64)], []
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{name}.ids") as out:
            for batch in batches:
                for doc_ids, texts in _slices(batch):
                    coded = [x + last for x in encoder.encode(texts)]
                    out.write(b"".join(coded))
                    sizes.append(np.array([len(x) for x in coded], np.int64) // encoder.dtype.itemsize)
                    ids.append(np.array([NO_ID if x is None else x for x in doc_ids], np.int64))
        offsets = np.cumsum(np.concatenate(sizes))
        for kind, values in (("offsets", offsets), ("docs", np.concatenate([np.zeros(0, np.int64), *ids]))):
            with store.open_output_stream(f"{name}.{kind}") as out:
                out.write(values.astype("<i8").tobytes())
        row = [[part], [os.path.basename(name)], [len(offsets) - 1], [int(offsets[-1])], [encoder.dtype.str]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["part", "file", "n_docs", "n_ids", "dtype"])

    return run


@dataclass
class TokenFiles:
    """A written set: each part's file name, sizes, and the numbers of documents and ids before it."""

    root: str
    dtype: str
    parts: list[dict]


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end: int | None = None) -> TokenFiles:
    """Encode docs(doc_id, text) in ascending doc_id order into files under `root`, a URI all tasks reach.

    Null texts count as empty; a null id comes first; rows that repeat an id stand in the order of a hash of
    their texts. `end` is appended to every document. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # By a hash of the text too, so that rows which repeat an id need not be one task.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "text")
    found = rows.mapInArrow(_written(root, tokenizer, end), "part long, file string, n_docs long, n_ids long, dtype string").collect()
    parts, n_docs, n_ids = [], 0, 0
    for r in sorted(found, key=lambda r: r.part):
        if r.n_docs:
            parts.append({"file": r.file, "n_docs": r.n_docs, "n_ids": r.n_ids, "first_doc": n_docs, "base": n_ids})
            n_docs, n_ids = n_docs + r.n_docs, n_ids + r.n_ids
    out = TokenFiles(root, found[0].dtype if found else "<u4", parts)
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as stream:
        stream.write(json.dumps(asdict(out)).encode())
    return out


def open_tokens(root: str) -> TokenFiles:
    store, base = fs.FileSystem.from_uri(root)
    with store.open_input_stream(f"{base}/manifest.json") as stream:
        return TokenFiles(**json.loads(stream.read()))


@contextmanager
def mapped(root: str, name: str, dtype: str) -> Iterator[Callable[[int, int], np.ndarray]]:
    """A function to the values from one place to another of a file: memory-mapped where the store is a file
    system of this machine, else read from there as they are asked for."""
    store, base = fs.FileSystem.from_uri(root)
    path, size = f"{base}/{name}", np.dtype(dtype).itemsize
    if isinstance(store, fs.LocalFileSystem):
        whole = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        yield lambda a, b: whole[a:b]
    else:
        with store.open_input_file(path) as stream:
            yield lambda a, b: np.frombuffer(stream.read_at((b - a) * size, a * size), dtype)


def _read(root: str, dtype: str, rows: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with mapped(root, f"{name}.docs", "<i8") as docs, mapped(root, f"{name}.offsets", "<i8") as offsets, mapped(root, f"{name}.ids", dtype) as ids:
                    for k in range(0, n, rows):
                        some, at = np.array(docs(k, min(n, k + rows))), np.array(offsets(k, min(n, k + rows) + 1))
                        crc = [zlib.crc32(np.asarray(ids(a, b)).astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some, mask=some == NO_ID), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return run


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: where each document's ids start among all,
    how many there are, and their CRC-32 as little-endian unsigned 32-bit integers."""
    rows = [(p["file"], p["base"], p["n_docs"]) for p in files.parts]
    parts = spark.createDataFrame(rows, "file string, base long, n_docs long").repartition(max(1, len(rows)))
    return parts.mapInArrow(_read(files.root, files.dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark).path("tokens")
    return read_tokens(spark, write_tokens(documents(spark, sf_dir), root, vocabulary("word_bpe_49k.json"), end=2))
