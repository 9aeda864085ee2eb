"""Operators that need sequential state within a text: match offsets, chunks, word error rates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Breaks in the order in which they are tried, the least size of a chunk, and how full it must be.
BREAKS = ("\n\n", "\n", ". ", "; ", ", ", " ")
FLOOR, FILL = 1000, 0.6


def match_spans(patterns: list[str], overlapping: bool = False, otherwise: str | None = None):
    """A function of a text column to the matches of patterns, earlier first; invalid patterns are left out.
    Matches do not overlap, or with `overlapping` are all distinct ones; `otherwise` is a pattern for texts in
    which none matches."""
    good = []
    for p in patterns:
        try:
            good.append(re.compile(p, re.M))
        except re.error:
            continue

    def spans(text: str | None) -> list[dict]:
        found = sorted({m.span() for p in good for m in p.finditer(text or "")})
        if not found and otherwise:
            found = [m.span() for m in re.finditer(otherwise, text or "")]
        if overlapping:
            return [{"start": a, "end": b} for a, b in found]
        out, end = [], 0
        for a, b in found:
            if a >= end and b > a:
                out.append({"start": a, "end": b})
                end = b
        return out

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(spans, na_action=None)

    return run


def chunk(text: str, most: int, overlap: float = 0.0) -> list[tuple[int, int]]:
    """Spans of at most `most` characters, but FLOOR at least, unless the text is no longer than `most`. A span
    ends behind the last of the first break of BREAKS whose end fills the span to FILL, and the next begins the
    stated share of `most` before that end, half at most."""
    size = len(text)
    if size <= most:
        return [(0, size)] if size else []
    most = max(FLOOR, most)
    back, least = int(most * min(max(overlap, 0.0), 0.5)), int(most * FILL)
    out, at = [], 0
    while not out or out[-1][1] < size:
        stop = min(size, at + most)
        if stop < size:
            ends = (text.rfind(mark, at, stop) + len(mark) for mark in BREAKS)
            stop = next((end for end in ends if end >= at + least), stop)
        out.append((at, stop))
        at = stop - back if stop - back > at else stop
    return out


def chunks(most: int, overlap: float = 0.0):
    """A function of a text column to its chunks' spans."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"start": a, "end": b} for a, b in chunk(t or "", most, overlap)])

    return run


def word_error_rate(a: Column, b: Column) -> Column:
    """Word edits to get from a to b over the words of a: words become single characters, so the built-in
    edit distance counts words. Characters are taken from U+4E00 on in the basic plane but for surrogates and
    then beyond it, so a pair may have 1,000,000 distinct words."""
    def words(x: Column) -> Column:
        return F.filter(F.split(x, r"\s+"), lambda w: w != "")

    wa, wb = words(a), words(b)
    both = F.array_distinct(F.concat(wa, wb))

    def coded(ws: Column) -> Column:
        def sign(w: Column) -> Column:
            at = F.array_position(both, w) + 0x4DFF
            return F.decode(F.unhex(F.lpad(F.hex(F.when(at < 0xD800, at).otherwise(at + 0x2800)), 8, "0")), "UTF-32")

        return F.array_join(F.transform(ws, sign), "")

    return F.when(F.size(wa) == 0, F.when(F.size(wb) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(coded(wa), coded(wb)) / F.size(wa))
