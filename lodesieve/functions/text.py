"""Text functions as Catalyst expressions: cleaning, folding, tokens, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that don't distinguish names
STOP_WORDS = ("the", "of", "and", "co", "ltd", "llc", "company", "limited", "group", "inc", "corp", "al", "el", "bin", "ibn")
# fixed values: letters with one Latin counterpart, and letters with several
_LATIN_FROM = "àáâãäåāăąçćčĉďđèéêëēėęěìíîïīįıłľĺñńňòóôõöøōőŕřśšşșťţțùúûüūůűųýÿžźżğģķļņħĝĥĵŝŭŵŷð"
_LATIN_TO = "aaaaaaaaaccccddeeeeeeeeiiiiiiilllnnnoooooooorrsssstttuuuuuuuuyyzzzggklnhghjsuwyd"
_CYRILLIC_FROM = "абвгдезийклмнопрстуфыэіґ"
_CYRILLIC_TO = "abvgdeziiklmnoprstufyeig"
MANY = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io", "є": "ie", "ї": "yi", "ъ": "", "ь": "'"}
ONE_FROM, ONE_TO = _LATIN_FROM + _CYRILLIC_FROM, _LATIN_TO + _CYRILLIC_TO


def fold(c: Column) -> Column:
    """Lower case in Latin letters; combining marks are dropped. Scripts other than Latin and Cyrillic stay as they are."""
    low = F.lower(c)
    for k, v in MANY.items():
        low = F.replace(low, F.lit(k), F.lit(v))
    return F.regexp_replace(F.translate(low, ONE_FROM, ONE_TO), "[\\u0300-\\u036f]", "")


def fold_sql(c: str) -> str:
    s = f"lower({c})"
    for k, v in MANY.items():
        s = f"replace({s}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace(translate({s}, '{ONE_FROM}', '{ONE_TO}'), '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"


def words(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("[a-z]+"), 0)


def norm(c: Column) -> Column:
    """Words of Latin letters joined by a blank; digits and signs vanish. Null stays null."""
    return F.array_join(words(c), " ")


def tokens(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words but for stop words and single letters; order and repeats stay."""
    stops = F.array(*[F.lit(s) for s in stop])
    return F.filter(words(c), lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))


def norm_id(c: Column) -> Column:
    """Letters and digits of an identifier, upper case."""
    return F.upper(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))


def clean(c: Column, missing: tuple[str, ...] = ("", "-0-")) -> Column:
    """Trimmed text, null for the feed's marks of a missing value."""
    t = F.trim(c)
    return F.when(~t.isin(*missing), t)


def to_int(c: Column) -> Column:
    return clean(c).try_cast("int")


def split_multi(c: Column, sep: str = ";") -> Column:
    """Items of a multi-value cell, trimmed, blanks dropped; an empty array for null."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x) > 0)


def localname(c: Column) -> Column:
    """Name of an XML element without its namespace."""
    return F.regexp_extract(c, r"([^}:]*)$", 1)


def first_text(*cs: Column) -> Column:
    """First text that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cs])


def after_dash(c: Column) -> Column:
    """What follows the first dash, trimmed; the whole text without one."""
    return F.when(F.instr(c, "-") > 0, F.trim(F.regexp_extract(c, r"^[^-]*-(.*)$", 1))).otherwise(F.trim(c))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def contains_any(needle: str, *fields: str) -> Column:
    """Case-insensitive substring over several fields put together."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(needle.lower()))
