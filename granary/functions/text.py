"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, with the four separators of ASCII.
SPACES = " \n\t\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def norm_space(x: Column) -> Column:
    """Runs of Unicode white space become one blank."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def norm_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def slug(x: Column, default: str = "OTHER") -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(x, "[^a-zA-Z0-9._-]+", "_"), F.lit("_")), F.lit("")), F.lit(default))


def snake(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))


def first_digits(x: Column) -> Column:
    """The first number as it is written."""
    return F.nullif(F.regexp_extract(x, r"[-+]?\d+(?:\.\d+)?", 0), F.lit(""))


def first_number(x: Column) -> Column:
    return first_digits(x).try_cast("double")


def trailing_number(x: Column, otherwise: int) -> Column:
    """The number an identifier ends in, a sentinel if none."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"(\d+)$", 1), F.lit("")).try_cast("long"), F.lit(otherwise).cast("long"))


def document_key(x: Column) -> Column:
    """'12' and 'document_12' name the same document."""
    t = strip(x)
    return F.when(t.rlike(r"^\d+$"), F.concat(F.lit("document_"), t.try_cast("long").cast("string"))).otherwise(t)


def first_sentence(x: Column) -> Column:
    """The first sentence, with a full stop if it has no end mark."""
    head = F.get(F.split(norm_space(x), r"(?<=[.!?])\s+"), F.lit(0))
    return F.when(head.rlike(r"[.!?]$") | (head == ""), head).otherwise(F.concat(head, F.lit(".")))


def truncated(x: Column, most: int, mark: str = " [truncated]") -> Column:
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.left(x, F.lit(most))), F.lit(mark))).otherwise(x)


def first_label(labels: Column, label: Column, default: str = "OTHER") -> Column:
    """The first label of a list that is not blank, else the single label, else the default."""
    listed = F.get(F.filter(F.transform(labels, strip), lambda v: v != ""), F.lit(0))
    return F.coalesce(listed, F.nullif(strip(label), F.lit("")), F.lit(default))


def token_set(x: Column, pattern: str = "([a-z0-9]+)") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def error_rate(a: Column, b: Column) -> Column:
    """Character error rate of b against a: 0 if both are empty, 1 if only a is."""
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


def span_of(text: Column, part: Column) -> Column:
    """The first place of part in text, 0-based; any case if there is none as it stands; else null."""
    exact, any_case = F.instr(text, part), F.instr(F.lower(text), F.lower(part))
    return F.nullif(F.when(exact > 0, exact).otherwise(any_case), F.lit(0)) - 1


def loose_json(x: Column) -> Column:
    """A variant from JSON that may stand in a code fence or among other text."""
    bare = F.regexp_replace(strip(x), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)))


def truth(x: Column) -> Column:
    v = F.lower(strip(x.cast("string")))
    return F.when(v.isin("1", "true", "t", "yes", "y"), True).when(v.isin("0", "false", "f", "no", "n"), False)


def clamp_score(x: Column, low: int = 1, high: int = 5, default: int = 3) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(x.try_cast("int"), F.lit(default))))


def sentences(x: Column) -> Column:
    """Sentences by end marks, then lines if that gives one at most: of a text of one line the text itself."""
    marked = F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"[^.!?\n]+[.!?]+(?:\s+|$)|[^.!?\n]+(?:\n|$)"), F.lit(0)), strip), lambda s: s != "")
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s != "")
    return F.when(F.size(marked) > 1, marked).otherwise(lines)


def split_sentences(x: Column) -> Column:
    """Sentences that end in a mark before white space, or at a blank line; not stripped ones that are blank."""
    parts = F.split(x, r"(?<=[.!?])\s+|\n\s*\n")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def canonical_label(x: Column, labels: list[str], default: str = "OTHER") -> Column:
    """A label as it is spelt in the list: the same but for case, then but for other signs, then the first of
    the list that lies within the text."""
    low, key = F.lower(strip(x)), norm_key(x)
    tests = [lambda c: low == c.lower(), lambda c: key == norm_key(F.lit(c)), lambda c: F.contains(low, F.lit(c.lower()))]
    return F.coalesce(*(F.when(test(c), F.lit(c)) for test in tests for c in labels), F.lit(default))


def display_label(x: Column, most: int = 30) -> Column:
    return F.left(F.regexp_replace(x, r"\s+Clause\b", ""), F.lit(most))


def around(text: Column, start: Column, end: Column, window: int) -> Column:
    """The text from `window` characters before a span to as many after it, within the text."""
    first = F.greatest(F.lit(0), start - window)
    return F.substring(text, first + 1, F.least(F.length(text), end + window) - first)


def prefix_share(x: Column, share: float = 0.1) -> Column:
    return F.substring(x, F.lit(1), F.floor(F.length(x) * share).cast("int"))


def front_matter(x: Column) -> Column:
    """A page's answer as (meta, body): JSON with natural_text, or `---` front matter of `key: value` lines
    before the text, or the plain text with no meta."""
    doc, parts = F.try_parse_json(x), F.split(x, "---", 3)
    pairs = F.filter(F.transform(F.split(F.get(parts, F.lit(1)), "\n"), lambda s: F.split(s, ":", 2)), lambda p: F.size(p) == 2)
    meta = F.map_from_entries(F.transform(pairs, lambda p: F.struct(strip(p[0]), strip(p[1]))))
    body = F.try_variant_get(doc, "$.natural_text", "string")
    none = F.create_map().cast("map<string,string>")
    return (
        F.when(body.isNotNull(), F.struct(F.coalesce(F.map_filter(F.try_variant_get(doc, "$", "map<string,string>"), lambda k, _: k != "natural_text"), none).alias("meta"), body.alias("body")))
        .when(F.size(parts) == 3, F.struct(meta.alias("meta"), strip(F.get(parts, F.lit(2))).alias("body")))
        .otherwise(F.struct(none.alias("meta"), strip(x).alias("body")))
    )


def segment_id(document: Column, number: Column) -> Column:
    return F.concat(document, F.lit("::segment_"), number.cast("string"))


def _first_said(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def shown_label(labels: Column, extractions: Column, default: str = "OTHER") -> Column:
    """The first of the labels, the default if it is blank; where that is the default, what the first
    extraction(label, feature_name, raw_label) names."""
    first = F.coalesce(F.nullif(strip(F.get(labels, F.lit(0))), F.lit("")), F.lit(default))
    named = F.get(extractions, F.lit(0))
    other = strip(_first_said(named["label"], named["feature_name"], named["raw_label"]))
    return F.when(first != default, first).otherwise(F.coalesce(F.nullif(other, F.lit("")), F.lit(default)))


def flat_candidates(candidates: Column) -> Column:
    """Candidates(feature_name, label, raw_label, similarity, tldr, description) by one name each; nameless ones go."""
    def flat(c: Column) -> Column:
        name = strip(F.coalesce(_first_said(c["feature_name"], c["label"], c["raw_label"]), F.lit("")))
        texts = [strip(F.coalesce(c[k], F.lit(""))).alias(k) for k in ("tldr", "description")]
        return F.struct(name.alias("feature_name"), c["similarity"].cast("string").try_cast("double").alias("similarity"), *texts)

    return F.filter(F.transform(F.coalesce(candidates, F.array().cast(candidates_type())), flat), lambda c: c["feature_name"] != "")


def candidates_type() -> str:
    return "array<struct<feature_name:string,label:string,raw_label:string,similarity:string,tldr:string,description:string>>"


def document_of_file(x: Column) -> Column:
    """The document that a file number or name tells: the number, without its fraction, or the first run of digits."""
    t = strip(x.cast("string"))
    digits = F.nullif(F.regexp_extract(t, r"(\d+)", 1), F.lit("")).try_cast("long")
    return F.concat(F.lit("document_"), F.coalesce(t.try_cast("double").cast("long"), digits).cast("string"))


def document_title(employer: Column, union: Column) -> Column:
    names = [F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(d)) for c, d in ((employer, "Employer"), (union, "Union"))]
    return F.concat_ws(" v ", *names)


def number_or(x: Column, kind: str, default: float | int | None = None) -> Column:
    """A whole or other number out of a loosely typed value, else the default."""
    value = strip(x.cast("string")).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return F.coalesce(value.cast(kind), F.lit(default).cast(kind))


def json_scores(x: Column) -> Column:
    """The scores of a JSON list of objects with name, score and reason; nameless ones go, and what is no list is empty."""
    kind = "array<struct<name:string,score:string,reason:string>>"
    listed = F.coalesce(F.from_json(x, kind), F.array().cast(kind))
    named = F.filter(listed, lambda s: F.coalesce(strip(s["name"]), F.lit("")) != "")
    return F.transform(named, lambda s: F.struct(strip(s["name"]).alias("name"), number_or(s["score"], "double").alias("score"), F.coalesce(s["reason"], F.lit("")).alias("reason")))


def keyword_counts(x: Column, aliases: list[str]) -> tuple[Column, Column]:
    """How often each alias occurs as whole words in any case, and how often any does, where aliases that
    overlap count once."""
    low = F.coalesce(x, F.lit(""))
    each = F.array(*(F.regexp_count(low, F.lit(rf"(?i)\b(?:{a})\b")).cast("long") for a in aliases))
    longest = sorted(aliases, key=len, reverse=True)
    return each, F.regexp_count(low, F.lit(rf"(?i)\b(?:{'|'.join(longest)})\b")).cast("long")


def half_even(x: Column, digits: int) -> Column:
    """Rounded with halves to the even digit."""
    return F.bround(x, digits)


def prototype_text(*parts: Column) -> Column:
    """The parts that are not blank, a line each."""
    return F.concat_ws("\n", *(F.nullif(strip(p), F.lit("")) for p in parts))
