"""Codes of places and industries, and years out of loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_space, strip

#: Numeric state codes and their postal abbreviations.
STATES = {
    1: "AL", 2: "AK", 4: "AZ", 5: "AR", 6: "CA", 8: "CO", 9: "CT", 10: "DE", 11: "DC", 12: "FL", 13: "GA", 15: "HI", 16: "ID", 17: "IL",
    18: "IN", 19: "IA", 20: "KS", 21: "KY", 22: "LA", 23: "ME", 24: "MD", 25: "MA", 26: "MI", 27: "MN", 28: "MS", 29: "MO", 30: "MT", 31: "NE",
    32: "NV", 33: "NH", 34: "NJ", 35: "NM", 36: "NY", 37: "NC", 38: "ND", 39: "OH", 40: "OK", 41: "OR", 42: "PA", 44: "RI", 45: "SC", 46: "SD",
    47: "TN", 48: "TX", 49: "UT", 50: "VT", 51: "VA", 53: "WA", 54: "WV", 55: "WI", 56: "WY", 60: "AS", 66: "GU", 69: "MP", 72: "PR", 78: "VI",
}
#: Names of states by their postal abbreviations.
STATE_NAMES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
#: Two-digit industry sectors.
SECTORS = {
    11: "Agriculture, Forestry, Fishing and Hunting",
    21: "Mining, Quarrying, and Oil and Gas Extraction",
    22: "Utilities",
    23: "Construction",
    31: "Manufacturing",
    32: "Manufacturing",
    33: "Manufacturing",
    42: "Wholesale Trade",
    44: "Retail Trade",
    45: "Retail Trade",
    48: "Transportation and Warehousing",
    49: "Transportation and Warehousing",
    51: "Information",
    52: "Finance and Insurance",
    53: "Real Estate and Rental and Leasing",
    54: "Professional, Scientific, and Technical Services",
    55: "Management of Companies and Enterprises",
    56: "Administrative and Support and Waste Management and Remediation Services",
    61: "Educational Services",
    62: "Health Care and Social Assistance",
    71: "Arts, Entertainment, and Recreation",
    72: "Accommodation and Food Services",
    81: "Other Services (except Public Administration)",
    92: "Public Administration",
}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def state_of(code: Column) -> Column:
    """A state's abbreviation from its number; an unknown number is FIPS_n, none or one below 1 is null, and
    an abbreviation stays."""
    t = F.upper(strip(code.cast("string")))
    n = t.try_cast("double").cast("int")
    return F.when(n > 0, F.coalesce(_lookup(STATES, n), F.concat(F.lit("FIPS_"), n.cast("string")))).when(n.isNull() & t.isin(*STATES.values()), t)


def states(codes: list[Column], location: Column) -> Column:
    """The sorted states of a row: those of its code columns, else the abbreviations in its location, else
    VARIES if it says so, else UNKNOWN."""
    coded = F.array_compact(F.array(*(state_of(c) for c in codes)))
    place = F.upper(strip(location))
    named = F.filter(F.split(place, "[^A-Z]+"), lambda w: w.isin(*STATES.values()))
    text = F.when(place == "VARIES", F.array(F.lit("VARIES"))).when(F.size(named) > 0, named).otherwise(F.array(F.lit("UNKNOWN")))
    return F.array_sort(F.array_distinct(F.when(F.size(coded) > 0, coded).otherwise(text)))


def industry(code: Column, kind: Column) -> Column:
    """The sector of the first run of two to six digits; without one the text of the code in capitals, else
    that of the kind, else UNKNOWN."""
    def words(x: Column) -> Column:
        t = norm_space(x.cast("string"))
        return F.when((t != "") & (F.lower(t) != "nan"), F.upper(t))

    digits = F.left(F.regexp_extract(words(code), r"\d{2,6}", 0), F.lit(2))
    sector = F.concat(digits, F.lit(" - "), F.coalesce(_lookup(SECTORS, digits.try_cast("int")), F.lit("Other/Unknown NAICS Sector")))
    return F.coalesce(F.when(digits != "", sector), words(code), words(kind), F.lit("UNKNOWN"))


def year_of(x: Column) -> Column:
    """A year from 1900 to 2100 out of text: a date or a year as it stands, else a count of days since 1960."""
    t = strip(x.cast("string"))
    dated = F.when(t.rlike(r"^\d{4}(-\d{2}(-\d{2}.*)?)?$"), F.left(t, F.lit(4)).try_cast("int"))
    american = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.right(t, F.lit(4)).try_cast("int"))
    n = F.when(t.rlike(r"^\d{1,5}$"), t.try_cast("int"))
    days = F.when(n <= 80000, F.year(F.date_add(F.to_date(F.lit("1960-01-01")), n)))
    y = F.coalesce(dated, american, days)
    return F.when(y.between(1900, 2100), y)


def state_name(code: Column) -> Column:
    """A state's name from its number of one or two digits; anything else stays as it is."""
    t = strip(code.cast("string"))
    names = {n: STATE_NAMES[a] for n, a in STATES.items() if a in STATE_NAMES}
    return F.coalesce(F.when(t.rlike(r"^\d{1,2}$"), _lookup(names, t.try_cast("int"))), t)


def sector_code(code: Column) -> Column:
    """The first two digits of an industry code, other signs left out; null without two."""
    digits = F.regexp_replace(code.cast("string"), r"\D", "")
    return F.when(F.length(digits) >= 2, F.left(digits, F.lit(2)))
