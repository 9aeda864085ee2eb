"""Fields that models extract, and the five anchors that scores are given by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import ratio
from .text import first_number, loose_json, strip, truth

#: Other names of field types and of score directions.
FIELD_TYPES = {
    "float": "number", "int": "number", "integer": "number", "numeric": "number", "str": "string", "text": "string", "bool": "boolean",
    "array[string]": "list[string]", "list[str]": "list[string]", "string[]": "list[string]",
    "array[number]": "list[number]", "list[float]": "list[number]", "list[int]": "list[number]", "number[]": "list[number]",
}
KINDS = ("number", "string", "boolean", "list[string]", "list[number]")
LOWER = ("lower", "lower_better", "lower_is_good", "less_is_better", "lower_worker_burden_is_better", "lower_is_better")


def field_type(x: Column) -> Column:
    name = F.replace(F.lower(strip(x)), F.lit(" "), F.lit(""))
    known = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in FIELD_TYPES.items() for v in pair)), name), name)
    return F.when(known.isin(*KINDS), known).otherwise("string")


def score_direction(x: Column) -> Column:
    """`lower_is_better` under any of its names; everything else is `higher_is_better`."""
    return F.when(F.replace(F.lower(strip(x)), F.lit(" "), F.lit("_")).isin(*LOWER), "lower_is_better").otherwise("higher_is_better")


def typed(value: Column, kind: Column) -> Column:
    """A struct (num, str, bool, strs, nums) in which the field of the value's type is set, if it can be.
    A list may be JSON or a single value."""
    t = F.nullif(strip(value), F.lit(""))
    doc = F.when(t.startswith("["), loose_json(t))
    texts = F.filter(F.transform(F.coalesce(F.try_variant_get(doc, "$", "array<string>"), F.array(t)), strip), lambda s: s != "")
    numbers = F.array_compact(F.transform(texts, first_number))
    return F.struct(
        F.when(kind == "number", first_number(t)).alias("num"),
        F.when(kind == "string", t).alias("str"),
        F.when(kind == "boolean", truth(t)).alias("bool"),
        F.when((kind == "list[string]") & t.isNotNull(), texts).alias("strs"),
        F.when((kind == "list[number]") & (F.size(numbers) > 0), numbers).alias("nums"),
    )


def percentile_anchors(p10: Column, p25: Column, p50: Column, p75: Column, p90: Column) -> Column:
    """Five anchors of a numeric field, as text, to three places."""
    return F.array(*(F.round(x.cast("double"), 3).cast("string") for x in (p10, p25, p50, p75, p90)))


def directed(anchors: Column, direction: Column) -> Column:
    """Five anchors, turned round where the numbers of the first and last run against the direction."""
    low, high = first_number(F.get(anchors, F.lit(0))), first_number(F.get(anchors, F.lit(4)))
    against = F.when(score_direction(direction) == "lower_is_better", high > low).otherwise(high < low)
    return F.when(against, F.reverse(anchors)).otherwise(anchors)


def marker_scale(x: Column, low: Column, high: Column, smallest: float = 6.0, largest: float = 18.0) -> Column:
    """x between low and high as a size; the middle size if low is not below high."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x - low, high - low)))
    return F.when(high > low, smallest + (largest - smallest) * share).otherwise((smallest + largest) / 2)


def ratio_text(top: Column, bottom: Column) -> Column:
    """A ratio to four places, or the sign of what it would be over zero."""
    value, status = ratio(top, bottom)
    return F.when(top.isNull() | bottom.isNull(), "n/a").when(status == "finite", F.format_string("%.4f", value)).when(status == "undefined", status).when(top > 0, "+inf").otherwise("-inf")


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
