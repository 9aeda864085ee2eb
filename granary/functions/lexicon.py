"""Words by which clauses are read, and the forms in which verbs occur."""

from __future__ import annotations

# Results depend on exactly these lists.
RESTRICTIVE_MODALS = ["shall", "must", "will", "should", "ought"]
PERMISSIVE_MODALS = ["may", "can"]
STRICT_MODALS = ["shall", "must", "will"]
MODAL_ORDER = ["shall", "must", "will", "may", "can", "have_to"]
NEGATIONS = ["not", "never", "no"]
OBLIGATION_PASSIVE = ["require", "expect", "compel", "oblige", "obligate"]
OBLIGATION_ACTIVE = ["agree", "promise"]
CONSTRAINT_PASSIVE = ["prohibit", "forbid", "ban", "bar", "restrict", "proscribe"]
PERMISSION_PASSIVE = ["allow", "permit", "authorize"]
ENTITLEMENT_ACTIVE = ["receive", "gain", "earn"]
ENTITLEMENT_PASSIVE = [
    "entitle", "give", "offer", "reimburse", "pay", "grant", "provide", "compensate", "guarantee", "hire", "train", "supply",
    "protect", "cover", "inform", "notify", "grant_off", "select", "allow_off", "award", "give_off", "pay_out", "allow_up",
]
PROMISE_ACTIVE = ["commit", "recognize", "consent", "assent", "affirm", "assure", "guarantee", "insure", "ensure", "stipulate", "undertake", "pledge"]
SPECIAL_RIGHTS = [
    "receive", "gain", "earn", "entitle", "grant", "offer", "provide", "compensate", "guarantee", "reimburse", "pay",
    "protect", "cover", "inform", "notify", "select", "award", "hire", "train", "supply",
]
AGENTS = {
    "worker": ["employee", "employees", "worker", "workers", "staff", "teacher", "nurse", "mechanic", "operator", "steward", "personnel", "individual employee", "bargaining unit member", "member", "members"],
    "firm": ["employer", "company", "board", "hospital", "corporation", "owner", "superintendent", "firm", "commission", "authority", "agency"],
    "union": ["union", "association", "representative", "labor organization", "bargaining representative"],
    "manager": ["manager", "management", "administration", "administrator", "supervisor", "director", "principal", "foreman", "chief", "department head"],
}
SENTENCE_TYPES = ["rights", "permissions", "prohibitions", "obligations", "other"]
# End of fixed values.

MODALS = RESTRICTIVE_MODALS + PERMISSIVE_MODALS
#: Particles that make a variant of a verb, as in "give off".
PARTICLES = ["off", "out", "up"]
#: Forms that the rule below does not make: past and participle.
IRREGULAR = {"forbid": ("forbade", "forbidden"), "give": ("gave", "given"), "pay": ("paid", "paid"), "undertake": ("undertook", "undertaken")}
DOUBLED = ("ban", "bar", "permit", "commit")


def verbs() -> list[str]:
    """All verbs of the lists, without particles, each once."""
    lists = (OBLIGATION_PASSIVE, OBLIGATION_ACTIVE, CONSTRAINT_PASSIVE, PERMISSION_PASSIVE, ENTITLEMENT_ACTIVE, ENTITLEMENT_PASSIVE, PROMISE_ACTIVE, SPECIAL_RIGHTS)
    return list(dict.fromkeys(v for some in lists for v in some if "_" not in v))


def forms(verb: str) -> dict[str, str]:
    """The verb's base, third person, past, participle and -ing form."""
    last = verb[-1] if verb in DOUBLED else ""
    soft = verb.endswith("y") and verb[-2] not in "aeiou"
    stem = verb[:-1] if soft or (verb.endswith("e") and not verb.endswith("ee")) else verb
    third = f"{verb[:-1]}ies" if soft else f"{verb}es" if verb.endswith(("s", "sh", "ch", "x")) else f"{verb}s"
    past = f"{stem}ied" if soft else f"{verb}d" if verb.endswith("e") else f"{verb}{last}ed"
    past, participle = IRREGULAR.get(verb, (past, past))
    return {"base": verb, "third": third, "past": past, "participle": participle, "ing": f"{verb if soft else stem}{last}ing"}


def lemma_table() -> dict[str, str]:
    """Verb by form."""
    return {form: verb for verb in verbs() for form in forms(verb).values()}
