"""The boundary to models: vectorised functions from providers, what makes their answers safe, and stand-ins.

A provider is loaded once a worker through a factory and answers a batch at a time. Answers are checked by
column expressions, so that a label is one of its candidates and a span lies in its text, whatever a model
says. Stand-ins are deterministic column expressions for tests and offline runs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rubric import typed
from .text import first_digits, first_sentence, loose_json, norm_key, norm_space, span_of, strip, truth

Provider = Callable[..., pd.Series | pd.DataFrame]


def asked(provider: Provider, batch: tuple, attempts: int, wait: float):
    """A provider's answers; a batch that fails is tried again after `wait` seconds, doubled each time."""
    for attempt in range(attempts):
        try:
            return provider(*batch)
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait * 2**attempt)


def model_udf(factory: Callable[[], Provider], returns: str, attempts: int = 3, wait: float = 0.0):
    """A vectorised function of one column from a provider's factory; `returns` may be a struct."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = factory()
        for batch in batches:
            yield asked(provider, (batch,), attempts, wait)

    return run


def keyword_provider(keywords: dict[str, str], default: str = "OTHER") -> Callable[[], Provider]:
    """A stand-in classifier: the label of the first keyword that a text has."""

    def label(text: str | None) -> str:
        low = (text or "").lower()
        return next((name for word, name in keywords.items() if word in low), default)

    return lambda: lambda texts: texts.map(label)


def valid_label(answer: Column, candidates: Column, default: str = "OTHER") -> Column:
    """The candidate that an answer names, be it in other case or signs; the default if it names none."""
    key = norm_key(answer)
    return F.coalesce(F.get(F.filter(candidates, lambda c: norm_key(c) == key), F.lit(0)), F.lit(default))


def likeliest(candidates: Column, default: str = "OTHER") -> Column:
    """A stand-in for classification: of candidates(feature_name, similarity) the most similar, the first by name if several."""
    known = F.filter(candidates, lambda c: c["similarity"].isNotNull())
    best = F.array_sort(F.transform(known, lambda c: F.struct((-c["similarity"]).alias("d"), c["feature_name"].alias("name"))))
    return F.coalesce(F.get(best, F.lit(0))["name"], F.lit(default))


def page_labels(answer: Column, default: str = "OTHER") -> Column:
    """The labels of a page's answer, a JSON list or one a line: not blank, each once, in their order; the
    default alone for a refusal or for nothing."""
    listed = F.try_variant_get(loose_json(answer), "$", "array<string>")
    lines = F.split(F.coalesce(answer, F.lit("")), "\n")
    marks = F.transform(F.coalesce(listed, lines), lambda s: strip(F.regexp_replace(s, r"^\s*(?:[-*]|\d+[.)])\s+", "")))
    found = F.array_distinct(F.filter(marks, lambda s: s != ""))
    refused = F.coalesce(answer.rlike(r"(?i)\b(?:i (?:cannot|can't|am unable)|unable to comply)\b"), F.lit(False))
    return F.when(refused | (F.size(found) == 0), F.array(F.lit(default))).otherwise(found)


def located(text: Column, offset: Column, pieces: Column) -> Column:
    """Pieces(title, text) that a chunk's answer quotes, with their spans in the whole document; what is not in
    the chunk goes."""
    def place(p: Column) -> Column:
        start = span_of(text, p["text"]).cast("long")
        return F.struct(norm_space(p["title"]).alias("title"), (offset + start).alias("start"), (offset + start + F.length(p["text"])).alias("end"))

    return F.filter(F.transform(F.filter(pieces, lambda p: p["text"] != ""), place), lambda p: p["start"].isNotNull())


def plan(lines: Column, like: Callable[[Column], Column], most: int = 5) -> Column:
    """A stand-in for a segmentation plan of a document's first lines: the headings among them, and the rules by
    which such open."""
    heads = F.slice(F.array_distinct(F.filter(F.transform(lines, norm_space), like)), 1, most)
    first = F.transform(heads, lambda h: F.regexp_extract(h, r"^[A-Za-z]+", 0))
    rules = F.transform(F.array_distinct(F.filter(first, lambda w: w != "")), lambda w: F.concat(F.lit("^"), w, F.lit(r"\b")))
    return F.struct(F.lit("section").alias("segment_type"), heads.alias("segment_header_examples"), rules.alias("segment_header_rules"))


def rated(text: Column, attributes: list[str], runs: int = 3) -> Column:
    """A stand-in for ratings from 0 to 100: the mean of the runs for each attribute, from a digest of the text."""
    def one(attribute: str, run: int) -> Column:
        return F.conv(F.left(F.md5(F.concat_ws("|", text, F.lit(attribute), F.lit(str(run)))), F.lit(4)), 16, 10).cast("int") % 101

    return F.struct(*((sum(one(a, k) for k in range(runs)) / runs).alias(a) for a in attributes))


def extracted(text: Column, fields: dict[str, str]) -> Column:
    """A stand-in for field extraction, a struct of typed values: the first number, whether the first word says
    yes, or the first sentence."""
    answers = {"number": first_digits(text), "boolean": truth(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1)).cast("string")}
    return F.struct(*(typed(answers.get(kind, first_sentence(text)), F.lit(kind)).alias(name) for name, kind in fields.items()))


def tournament(rows: DataFrame, by: str, key: str, text: str, better: Callable[[Column, Column], Column], rounds: int = 5, matches: int = 3) -> DataFrame:
    """(by, key, points, score): rows of a group meet in pairs, neighbours in the standing first, `matches` times a
    round; `better` gives the first side's share of a win. score is the points' standard score in the group, null
    where all are equal. Who is left without an opponent keeps half a point."""
    out = rows.select(by, key, text).withColumn("points", F.lit(0.0))
    for k in range(rounds * matches):
        # Within a round the standing is that of its beginning, and pairs shift by one row a match.
        standing = "points" if k % matches == 0 else "_standing"
        if k % matches == 0:
            out = out.withColumn("_standing", F.col("points"))
        w = Window.partitionBy(by).orderBy(F.desc(standing), F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(k // matches)))), key)
        odd = (F.row_number().over(w) + k % matches) % 2 == 1
        other = F.when(odd, F.lead(text).over(w)).otherwise(F.lag(text).over(w))
        out = out.withColumn("points", F.col("points") + F.coalesce(better(F.col(text), other), F.lit(0.5)))
    group = Window.partitionBy(by)
    spread = F.stddev_pop("points").over(group)
    score = F.when(spread > 0, (F.col("points") - F.avg("points").over(group)) / spread)
    return out.select(by, key, "points", score.alias("score"))
