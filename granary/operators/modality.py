"""Clauses of sentences: modal force, negation, voice, verb classes, and what they oblige, forbid, permit or grant.

A clause is a struct (root_verb, root_verb_variants, lemmas, modal_verbs, modal_force, is_negative, voice) of a
parser's, or one that `surface_clause` reads off the words. Everything is a column expression.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import lexicon as lx
from granary.functions.text import norm_space

BE = "am|is|are|was|were|be|been|being"
HAVE_TO = r"(?i)\b(?:has|have|had)\s+to\b"


def with_struct(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a struct that is worked out once a row: a plan would else repeat its expression wherever
    a field of it is used, and again within what is built on that."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def words_of(names: list[str]) -> Column:
    return F.array(*map(F.lit, names))


def modal_force(modals: Column, text: Column) -> tuple[Column, Column]:
    """The sorted distinct modals, with have_to where no other speaks and the text has it, and their force."""
    strict, lax = (F.arrays_overlap(modals, words_of(x)) for x in (lx.RESTRICTIVE_MODALS, lx.PERMISSIVE_MODALS))
    must = ~strict & ~lax & norm_space(text).rlike(HAVE_TO)
    force = F.when(strict & lax, "mixed").when(strict | must, "restrictive").when(lax, "permissive").otherwise("none")
    found = F.array_sort(F.array_distinct(modals))
    return F.when(must, F.array_append(found, F.lit("have_to"))).otherwise(found), force


def surface_clause(text: Column) -> Column:
    """A clause by words alone: modals and negations are words, verbs are known by their forms, the first known
    verb is the root, and a participle behind a form of `be` makes a passive."""
    low = F.lower(norm_space(F.coalesce(text, F.lit(""))))
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    table = F.create_map(*map(F.lit, chain.from_iterable(lx.lemma_table().items())))
    lemmas = F.array_compact(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.when(w.isin(lx.MODALS + lx.NEGATIONS), w))))
    known = F.filter(lemmas, lambda w: ~w.isin(lx.MODALS + lx.NEGATIONS))
    root = F.coalesce(F.get(known, F.lit(0)), F.lit(""))
    first = F.array_position(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.lit(""))), root).cast("int")
    particle = F.when(root != "", F.get(words, first))
    variants = F.when(root == "", F.array().cast("array<string>")).when(particle.isin(lx.PARTICLES), F.array(root, F.concat_ws("_", root, particle))).otherwise(F.array(root))
    participles = "|".join(sorted({lx.forms(v)["participle"] for v in lx.verbs()}))
    passive = low.rlike(rf"\b(?:{BE})(?:\s+(?:{'|'.join(lx.NEGATIONS)}))?\s+(?:{participles})\b")
    modals, force = modal_force(F.filter(words, lambda w: w.isin(lx.MODALS)), low)
    negative = F.arrays_overlap(words, words_of(lx.NEGATIONS)) | low.rlike(r"\b[a-z]+n['’]t\b")
    return F.struct(
        root.alias("root_verb"), variants.alias("root_verb_variants"), lemmas.alias("lemmas"), modals.alias("modal_verbs"),
        force.alias("modal_force"), F.coalesce(negative, F.lit(False)).alias("is_negative"), F.when(passive, "passive").otherwise("active").alias("voice"),
    )


#: What a clause's verbs or phrases make of it, the first that fits.
SPECIAL = {
    "prohibition": (lx.CONSTRAINT_PASSIVE, None),
    "permission": (lx.PERMISSION_PASSIVE, None),
    "rights": (lx.SPECIAL_RIGHTS, r"(?i)\b(?:entitled|eligible)\s+to\b|\bhave\s+the\s+right\s+to\b"),
    "obligation": (lx.OBLIGATION_PASSIVE, rf"{HAVE_TO}|\bought\s+to\b|\b(?:be|is|are|was|were)\s+(?:required|obliged|obligated)\s+to\b"),
}


def special_verb(clause: Column, text: Column) -> Column:
    """prohibition, permission, rights, obligation or none, by the lemmas of the clause and phrases of the text."""
    lemmas = F.array_append(clause["lemmas"], clause["root_verb"])
    out = None
    for name, (verbs, phrase) in SPECIAL.items():
        fits = F.arrays_overlap(lemmas, words_of(verbs))
        if phrase:
            fits = fits | norm_space(text).rlike(phrase)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("none")


def auth_features(clause: Column) -> Column:
    """A struct of what the flags rest on: modals by strength, voice, negation, and classes of the root verb."""
    def clean(names: Column) -> Column:
        return F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v != "")

    root = F.coalesce(F.lower(F.trim(clause["root_verb"])), F.lit(""))
    variants = F.array_sort(F.array_distinct(F.concat(clean(clause["root_verb_variants"]), clean(F.array(root)))))
    modals = F.array_sort(F.array_distinct(clean(clause["modal_verbs"])))
    passive, neg = F.coalesce(clause["voice"] == "passive", F.lit(False)), F.coalesce(clause["is_negative"], F.lit(False))
    md = F.exists(modals, lambda m: m != "have_to")
    strict = md & F.arrays_overlap(modals, words_of(lx.STRICT_MODALS))

    def of(when_passive: list[str], when_active: list[str]) -> Column:
        names = F.when(passive, words_of(when_passive or [""])).otherwise(words_of(when_active or [""]))
        return F.coalesce(F.arrays_overlap(variants, names), F.lit(False))

    classes = {
        "obligation_verb": of(lx.OBLIGATION_PASSIVE, lx.OBLIGATION_ACTIVE),
        "constraint_verb": of(lx.CONSTRAINT_PASSIVE, []),
        "permission_verb": of(lx.PERMISSION_PASSIVE, []),
        "entitlement_verb": of(lx.ENTITLEMENT_PASSIVE, lx.ENTITLEMENT_ACTIVE),
        "promise_verb": of([], lx.PROMISE_ACTIVE),
    }
    special = F.greatest(*classes.values())
    modal = F.coalesce(F.get(F.array_intersect(words_of(lx.MODAL_ORDER), modals), F.lit(0)), F.lit(""))
    found = {"root_verb": root, "root_verb_variants": variants, "modal_verbs": modals, "modal": modal, "md": md, "strict_modal": strict, "permissive_modal": md & ~strict}
    found |= {"passive": passive, "neg": neg, **classes, "special_verb": special, "active_verb": ~passive & ~special}
    return F.struct(*(c.alias(n) for n, c in found.items()))


def auth_evidence(features: Column, flags: dict[str, Column]) -> Column:
    """What was found, as a list of short statements in a fixed order."""
    def said(name: str) -> Column:
        return F.concat(F.lit(f"auth:{name}="), F.initcap(features[name].cast("string")))

    plain = [said(n) for n in ("md", "strict_modal", "permissive_modal", "neg", "passive")]
    root = F.concat(F.lit("auth:root="), F.coalesce(F.nullif(features["root_verb"], F.lit("")), F.lit("none")))
    variants = F.when(F.size(features["root_verb_variants"]) > 0, F.concat(F.lit("auth:root_variants="), F.array_join(features["root_verb_variants"], ",")))
    classes = [F.when(features[n], F.lit(f"auth:{n}")) for n in ("obligation_verb", "constraint_verb", "permission_verb", "entitlement_verb", "promise_verb")]
    labels = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))), ",")
    return F.array_compact(F.array(*plain, root, variants, *classes, F.concat(F.lit("auth:labels="), F.coalesce(F.nullif(labels, F.lit("")), F.lit("none")))))


def subject_agents(phrases: Column, text: Column, agents: dict[str, list[str]] = lx.AGENTS) -> Column:
    """The agents named in the subjects, in the whole text where there is no subject; "workers union" is the
    union alone."""
    subjects = F.filter(F.coalesce(phrases, F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    where = F.array_join(F.when(F.size(subjects) > 0, subjects).otherwise(F.array(F.coalesce(text, F.lit("")))), "\n")
    hit = {name: where.rlike(r"(?i)\b(?:" + "|".join(map(re.escape, names)) + r")\b") for name, names in agents.items()}
    if {"union", "worker"} <= hit.keys():
        hit["worker"] = hit["worker"] & ~(hit["union"] & where.rlike(r"(?i)\bworkers?\s+union\b"))
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in hit.items())))


# Phrases that deny a duty.
DENIED = (
    r"\b(?:may|can|shall|must|will|should)\s+not\s+be\s+(?:required|expected|compelled|obliged|obligated)\b",
    r"\bnot\s+(?:be\s+)?(?:required|expected|compelled|obliged|obligated)\s+to\b",
)


def negated_protection(clause: Column, text: Column) -> Column:
    """Whether a denied duty protects: by such a phrase, or a negated passive obligation under a modal."""
    forced = clause["modal_force"].isin("restrictive", "permissive", "mixed")
    duty = (special_verb(clause, text) == "obligation") & (clause["voice"] == "passive") & forced
    return clause["is_negative"] & (text.rlike("(?i)" + "|".join(DENIED)) | duty)
