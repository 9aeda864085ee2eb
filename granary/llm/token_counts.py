"""Token counts of sections by the character spans of tokens of whole documents.

A document is encoded once, as a whole. Its tokens' character spans meet the sections' intervals, and a
token goes to the section its span lies in. A token whose span reaches over a boundary is counted as
crossing and goes, by `rule`, to the section of its first character ("first"), of its last ("last"), or to
the one that holds most of its characters, the earlier if even ("most").
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scratch import documents
from .token_files import TAILS, Keeper, _slices, vocabulary

RULES = ("first", "last", "most")
#: What keeps a text from being encoded by pieces: white space other than single blanks and line feeds
#: between other characters.
UNEVEN = re.compile(r"[^\S \n]|\s\s|\A\s|\s\Z")
#: Pieces whose spans a worker keeps at most.
KEPT_PIECES = 1_500_000
_ENCODERS: dict = {}


class SpanEncoder(Keeper):
    """Character spans of the tokens of whole texts, by a byte-level tokenizer.

    Its pattern starts a new match at a single blank between other characters and takes a single line feed
    by itself, so a text with no other white space is encoded piece by piece, and the spans of pieces are
    kept from one text to the next. Any other text is encoded in one go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        super().__init__(KEPT_PIECES)

    @classmethod
    def of(cls, path: str) -> SpanEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.offsets, np.int32).reshape(-1, 2) for e in coded]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        self.trim()
        cut = [t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if t and "\0" not in t and not UNEVEN.search(t) else None for t in texts]
        new = set().union(*filter(None, cut)).difference(self.known)
        tailed = [w for w in new if w[-1] in TAILS and w[-2:-1].isalpha()]
        new.difference_update(tailed)
        new.update(TAILS, (w[:-1] for w in tailed if w[:-1] not in self.known))
        new = list(new)
        for k in range(0, len(new), 1 << 13):
            # As one text, in which each piece begins as it does where it stands.
            some = [w if w[0] in " \n" else "\n" + w for w in new[k : k + (1 << 13)] if w.strip(" \n")]
            spans = self.whole(["".join(some)])[0]
            starts = np.cumsum([0, *map(len, some)])
            begins = starts[:-1] + [w[0] == "\n" for w in some]
            lo, hi = np.searchsorted(spans[:, 0], begins), np.searchsorted(spans[:, 0], starts[1:])
            for w, start, i, j in zip(some, begins.tolist(), lo.tolist(), hi.tolist(), strict=True):
                self.known[w.removeprefix("\n")] = (spans[i:j] - np.int32(start)).tobytes()
        self.known.update((w, s.tobytes()) for w, s in zip(("\n", " "), self.whole(["\n", " "]), strict=True))
        for w in tailed:
            mark = np.frombuffer(self.known[w[-1]], np.int32) + np.int32(len(w) - 1)
            self.known[w] = self.known[w[:-1]] + mark.tobytes()
        get, out = self.known.__getitem__, []
        for text, pieces in zip(texts, cut, strict=True):
            if pieces is None:
                out += self.whole([text])
                continue
            parts = list(map(get, pieces))
            starts = np.cumsum([0, *map(len, pieces)])[:-1]
            counts = np.fromiter(map(len, parts), np.int64, len(parts)) // 8
            out.append(np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2) + np.repeat(starts, counts)[:, None])
        for w in tailed:
            del self.known[w]
        return out


def sections(text: str) -> np.ndarray:
    """Ends of the sections of a text: its lines, each with its line feed; none for an empty text."""
    ends = [m.end() for m in re.finditer("\n", text)]
    return np.array(ends if ends and ends[-1] == len(text) else [*ends, len(text)] if text else [], np.int64)


def attribute(spans: np.ndarray, ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many cross a boundary. Sections cover the text without gaps."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not len(spans) or not len(ends):
        return np.zeros(len(ends), np.int64), 0
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(ends, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right")
    first, last = np.minimum(first, len(ends) - 1), np.minimum(last, len(ends) - 1)
    cross = np.flatnonzero(first != last)
    to = last if rule == "last" else first.copy()
    if rule == "most":
        begins = np.concatenate([[0], ends[:-1]])
        for k in cross:
            some = np.arange(first[k], last[k] + 1)
            held = np.minimum(ends[some], spans[k, 1]) - np.maximum(begins[some], spans[k, 0])
            to[k] = some[np.argmax(held)]
    return np.bincount(to, minlength=len(ends)), len(cross)


def _counted(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpanEncoder.of(path)
        for batch in batches:
            for doc_ids, texts in _slices(batch):
                rows = []
                for doc_id, text, spans in zip(doc_ids, texts, encoder.spans(texts), strict=True):
                    counts, cross = attribute(spans, sections(text), rule)
                    rows.append((doc_id, len(spans), len(counts), counts.tolist(), cross))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64())
                names = ["doc_id", "n_tokens", "n_sections", "section_tokens", "n_crossing"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def token_counts(docs: DataFrame, tokenizer: str, rule: str = "first") -> DataFrame:
    """(doc_id, n_tokens, n_sections, section_tokens, n_crossing) for every row of docs(doc_id, text).

    section_tokens has a count for each line of the text, in order; the counts add up to n_tokens. A null
    text counts as empty and has no section. Repeated rows and null ids are returned as they come; other
    columns are ignored.
    """
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(_counted(tokenizer, rule), "doc_id long, n_tokens long, n_sections int, section_tokens array<int>, n_crossing long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
