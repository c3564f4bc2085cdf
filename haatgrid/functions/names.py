"""Normal forms of market and district names, and deletion neighbourhoods of strings."""

from __future__ import annotations

import html
import re
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say only that the place is a regulated market, as token sequences.
GENERIC = (
    "krishi upaj mandi samiti", "krishi upaj mandi", "agri produce mkt committee", "agricultural produce market committee",
    "mandi samiti", "a p m c", "k u m", "apmc", "mkt yard", "market yard",
)
#: Short forms written for a word.
SHORT = {
    "khd": "khurd", "khrd": "khurd", "kln": "kalan", "kal": "kalan", "rd": "road", "bzr": "bazar", "bazaar": "bazar", "mkt": "market", "yd": "yard", "ctrl": "central", "mn": "main",
    "kanda": "onion", "onions": "onion", "anaj": "grain", "grains": "grain", "grn": "grain", "fv": "f v", "subyard": "sub yard",
}
#: Other words for a yard, as token sequences.
PHRASES = {"s y": "sub yard", "m yard": "main yard", "mukhya yard": "main yard", "veg and fruits": "f v", "fruit and veg": "f v", "fruits and vegetables": "f v", "fruit veg": "f v"}
#: Endings of place names that are written in several ways.
ENDINGS = {"gaum": "gaon", "gav": "gaon", "gunj": "ganj", "nagger": "nagar", "gadh": "garh", "kheda": "khera", "kera": "khera", "pura": "pur", "ally": "alli"}
#: Words that tell apart the yards of one town.
QUALIFIER = ("main yard", "sub yard", "onion", "grain", "f v", "khurd", "kalan", "road", "bazar", "new")

_GENERIC = re.compile(r"\b(?:" + "|".join(sorted(GENERIC, key=len, reverse=True)) + r")\b")
_PHRASE = re.compile(r"\b(?:" + "|".join(PHRASES) + r")\b")
_ENDING = re.compile("(?:" + "|".join(ENDINGS) + ")$")
_QUALIFIER = re.compile(r"\b(?:" + "|".join(QUALIFIER) + r")\b")


def words(name: str | None) -> str:
    """Lower case, entities resolved, anything but letters and digits taken as a blank. Null gives an empty string."""
    return " ".join(re.sub(r"[^\w]+|_", " ", html.unescape(name or "").lower()).split())


def split_name(name: str | None) -> tuple[str, str]:
    """The place and the sorted qualifiers of a market name, generic words left out.

    Order of parts, brackets, case and short forms do not count. A name of generic words only keeps them."""
    w = words(name)
    plain = _GENERIC.sub(" ", w)
    plain = " ".join(SHORT.get(t, t) for t in plain.split())
    plain = _PHRASE.sub(lambda m: PHRASES[m.group()], plain)
    found = sorted(_QUALIFIER.findall(plain))
    place = " ".join(_QUALIFIER.sub(" ", plain).split())
    if not place:
        place, found = (plain or w), []
    return place, " ".join(found)


def fold(place: str) -> str:
    """Place without blanks and with letters that are heard alike written alike: long vowels, v and w, doubled letters,
    and endings written in several ways."""
    s = _ENDING.sub(lambda m: ENDINGS[m.group()], place.replace(" ", ""))
    s = s.replace("ee", "i").replace("oo", "u").replace("w", "v").replace("ph", "f")
    return re.sub(r"(.)\1+", r"\1", s)


def deletes(s: str, most: int = 2, head: int = 7) -> list[str]:
    """What is left of the first ``head`` letters when up to ``most`` are deleted. Two strings within ``most`` edits share an entry."""
    s = s[:head]
    out = {s}
    for k in range(1, min(most, max(0, len(s) - 1)) + 1):
        out.update("".join(c for i, c in enumerate(s) if i not in gone) for gone in combinations(range(len(s)), k))
    return sorted(out)


@F.pandas_udf(T.StructType([T.StructField("place", T.StringType()), T.StructField("qualifier", T.StringType()), T.StructField("folded", T.StringType())]))
def name_parts(names: pd.Series) -> pd.DataFrame:
    parts = [split_name(x) for x in names]
    return pd.DataFrame({"place": [p for p, _ in parts], "qualifier": [q for _, q in parts], "folded": [fold(p) for p, _ in parts]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def neighbourhood(folded: pd.Series) -> pd.Series:
    return pd.Series([deletes(x) for x in folded], dtype=object)


@F.pandas_udf(T.StringType())
def folded_name(names: pd.Series) -> pd.Series:
    return pd.Series([fold(words(x)) for x in names])
