"""Country texts as two-letter codes.

Codes and names come from the ISO 3166 tables of the Java runtime that Spark runs on (all countries, in English, French,
German and Spanish), so none is listed here. A wording is compared without the words that only say what kind of state it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: wordings that name a country by other words than its name
OTHER_NAMES = {
    "burma": "mm", "cape verde": "cv", "congo brazzaville": "cg", "congo drc": "cd", "congo kinshasa": "cd", "czech republic": "cz", "democratic people s republic of korea": "kp", "democratic republic of the congo": "cd", "dpr korea": "kp", "dprk": "kp", "dr congo": "cd", "drc": "cd", "east timor": "tl", "french": "fr",
    "great britain": "gb", "holland": "nl", "ivory coast": "ci", "lao": "la", "korea democratic people s republic of": "kp", "korea republic of": "kr", "macedonia": "mk", "north korea": "kp", "palestine": "ps", "republic of china": "tw", "republic of congo": "cg", "republic of korea": "kr", "republic of the congo": "cg",
    "rok": "kr", "russia": "ru", "russian": "ru", "south korea": "kr", "swaziland": "sz", "syrian": "sy", "turkey": "tr", "turkiye": "tr", "uae": "ae", "uk": "gb", "united kingdom of great britain and northern ireland": "gb", "united states of america": "us", "us": "us", "usa": "us", "vatican": "va", "viet nam": "vn",
}
# fixed values: words that say what kind of state it is
_KIND = frozenset("the of and republic rep state states federal federation fed islamic arab democratic people s peoples kingdom bolivarian plurinational socialist cooperative co operative union commonwealth principality grand duchy sultanate hashemite".split())
_WORD = re.compile("[a-z]+")


def plain(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.lower())
    return " ".join(_WORD.findall("".join(c for c in t if not unicodedata.combining(c)).replace("ı", "i")))


def bare(text: str) -> str:
    """The wording without words for kinds of state; in their order, as it stands."""
    return " ".join(w for w in plain(text).split() if w not in _KIND)


def country_table(spark: SparkSession, more: Mapping[str, str] | None = None) -> dict[str, str]:
    """Wordings to codes; ``more`` adds or overrides. A bare wording that two countries share isn't contained."""
    locale = spark._jvm.java.util.Locale
    out: dict[str, str] = {}
    short: dict[str, set[str]] = {}
    for code in locale.getISOCountries():
        c = locale("", code)
        for name in (code, c.getISO3Country(), *(c.getDisplayCountry(locale.forLanguageTag(lang)) for lang in ("en", "fr", "de", "es"))):
            out.setdefault(plain(name), code.lower())
            if len(name) > 3:
                short.setdefault(bare(name), set()).add(code.lower())
    for name, codes in short.items():
        if len(codes) == 1 and name:
            out.setdefault(name, *codes)
    return out | OTHER_NAMES | {plain(k): v.lower() for k, v in (more or {}).items()}


def coded(df: DataFrame, column: str, table: Mapping[str, str]) -> DataFrame:
    """df with the array of texts in ``column`` replaced by the sorted codes of those that are known."""
    names = dict(table)

    def one(text: str | None) -> str | None:
        return names.get(plain(text)) or names.get(bare(text)) if text else None

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str | None, str | None] = {}
        for s in series:
            out = []
            for texts in s:
                got = set()
                for t in texts if texts is not None else ():
                    if t not in seen:
                        if len(seen) > 50_000:
                            seen.clear()
                        seen[t] = one(t)
                    got.add(seen[t])
                out.append(sorted(x for x in got if x))
            yield pd.Series(out, dtype=object)

    return df.withColumn(column, F.pandas_udf(run, "array<string>")(F.col(column)))
