"""Modality of sentences: what a clause obliges, forbids, permits or grants, and to whom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flags(neg: Column, strict: Column, permissive: Column, modal: Column, active: Column, passive: Column, obliges: Column, constrains: Column, permits: Column, entitles: Column) -> dict[str, Column]:
    """Four flags from the negation, modals, voice and verb classes of a clause."""
    # The formulas by which the flags are defined.
    return {
        "obligation": ~neg & ((strict & active) | (strict & obliges) | (~modal & obliges)),
        "constraint": (neg & modal & active) | (~neg & strict & constrains) | (neg & passive & (entitles | permits)),
        "permission": (~neg & ((permissive & active) | permits)) | (neg & constrains),
        "entitlement": (~neg & entitles) | (neg & obliges),
    }


def sentence_type(f: dict[str, Column]) -> Column:
    return F.when(f["constraint"], "prohibitions").when(f["entitlement"], "rights").when(f["permission"], "permissions").when(f["obligation"], "obligations").otherwise("other")


def agents(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """The agents whose words occur, in the order of the lexicon."""
    found = [F.when(text.rlike(rf"(?iU)\b(?:{'|'.join(words)})\b"), F.lit(name)) for name, words in lexicon.items()]
    return F.array_compact(F.array(*found))


def statements(agents: Column) -> Column:
    """One statement for each agent, `other` if there is none."""
    return F.when(F.size(agents) > 0, agents).otherwise(F.array(F.lit("other")))
