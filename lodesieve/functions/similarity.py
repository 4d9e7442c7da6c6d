"""String similarities that Spark lacks, as Arrow-batched pandas UDFs over distinct work per batch.

All scores run from 0 to 100 but ``jaro_winkler`` (0 to 1). A null on either side gives null.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel_ratio(a: str, b: str) -> float:
    """100 x (1 - insertions and deletions / letters)."""
    if not a and not b:
        return 100.0
    return 200.0 * _lcs(a, b) / (len(a) + len(b))


@lru_cache(maxsize=100_000)
def _masks(a: str) -> dict[str, int]:
    """The places of every letter, as bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    return where


def _lcs(a: str, b: str) -> int:
    get = _masks(a).get
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@lru_cache(maxsize=200_000)
def _sorted(a: str) -> tuple[str, frozenset[str], bool]:
    """The words in order, as a set, and whether each stands once."""
    w = a.split()
    return " ".join(sorted(w)), frozenset(w), len(set(w)) == len(w)


def in_common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _lcs(a, b) if a else 0


def token_sort(a: str, b: str) -> float:
    return indel_ratio(_sorted(a)[0], _sorted(b)[0])


def _sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = _sorted(a)[1], _sorted(b)[1]
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, only_a, only_b = _sets(a, b)
    if both and (not only_a or not only_b):
        return 100.0
    whole_a, whole_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    scores = [indel_ratio(whole_a, whole_b)]
    if both:
        scores += [indel_ratio(both, whole_a), indel_ratio(both, whole_b)]
    return max(scores)


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a stretch of its length, or less at the ends, of the longer."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    if s in t:
        return 100.0
    n = len(s)
    where: dict[str, int] = {}
    for i, c in enumerate(s):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << n) - 1
    masks = [where.get(c, 0) for c in t]
    held = [0]  # letters of s before each place of t
    for m in masks:
        held.append(held[-1] + (m > 0))
    # no stretch is better than all its letters in order: the most promising ones first
    spans = [(max(0, i), min(len(t), i + n)) for i in range(1 - n, len(t))]
    best = 0.0
    for bound, i, k in sorted(((200.0 * (held[k] - held[i]) / (n + k - i), i, k) for i, k in spans), reverse=True):
        if bound <= best:
            break
        v = full
        for m in masks[i:k]:
            u = v & m
            v = (v + u | v - u) & full
        best = max(best, 200.0 * (n - v.bit_count()) / (n + k - i))
    return best


def partial_token(a: str, b: str) -> float:
    both, only_a, only_b = _sets(a, b)
    if both:
        return 100.0
    return max(partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial(only_a, only_b) if only_a and only_b else 0.0)


def weighted(a: str, b: str) -> float:
    """The weighted mix: plain ratio, token ratios at .95, and partial ratios where lengths differ much."""
    if not a or not b:
        return 0.0
    base = indel_ratio(a, b)
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        best = max(base, 0.95 * token_sort(a, b))
        (_, x, once_a), (_, y, once_b) = _sorted(a), _sorted(b)
        # without a common word, and each word once, the ratio of the sets is that of the sorted words
        return best if best >= 95 or once_a and once_b and x.isdisjoint(y) else max(best, 0.95 * token_set(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(base, scale * partial(a, b), 0.95 * scale * partial_token(a, b))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro with .1 per common first letter (four at most), above .7."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    n = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        n += 1
    return s + 0.1 * n * (1 - s)


@lru_cache(maxsize=100_000)
def metaphone_of(word: str) -> str:
    """The classic sound key of an English word (1990 rules)."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out: list[str] = []
    n = len(w)
    at = lambda i: w[i] if 0 <= i < n else ""
    vowel, front = set("AEIOU"), set("EIY")
    for i, c in enumerate(w):
        if c == at(i - 1) and c != "C":
            continue
        nxt = at(i + 1)
        if c in vowel:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (i == n - 1 and at(i - 1) == "M"):
                out.append("B")
        elif c == "C":
            if nxt and nxt in front:
                if not at(i - 1) == "S":
                    out.append("X" if w[i + 1 : i + 3] == "IA" else "S")
            elif nxt == "H":
                out.append("K" if at(i - 1) == "S" or i == 0 and at(2) not in vowel else "X")
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if nxt == "G" and at(i + 2) in front and at(i + 2) else "T")
        elif c == "G":
            if nxt == "H" and not (i + 2 >= n or at(i + 2) in vowel):
                continue
            if nxt == "N" and (i + 2 >= n or w[i + 1 :] == "NED"):
                continue
            if at(i - 1) == "D" and nxt and nxt in front:
                continue
            out.append("J" if nxt and nxt in front and at(i - 1) != "G" else "K")
        elif c == "H":
            if at(i - 1) in set("CSPTG") and at(i - 1):
                continue
            if nxt in vowel and nxt:
                out.append("H")
        elif c == "K":
            if at(i - 1) != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if nxt == "H" else "P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            out.append("X" if nxt == "H" or w[i + 1 : i + 3] in ("IO", "IA") else "S")
        elif c == "T":
            if w[i + 1 : i + 3] in ("IO", "IA"):
                out.append("X")
            elif nxt == "H":
                out.append("0")
            elif w[i + 1 : i + 3] != "CH":
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if nxt in vowel and nxt:
                out.append(c)
        elif c == "X":
            out += ["K", "S"]
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
    return "".join(out)


def phonetic_key(token: str) -> str:
    """Sound key, or the first four characters where there is none."""
    return metaphone_of(token) or token[:4]


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            v = memo.get((x, y))
            if v is None:
                v = memo[(x, y)] = f(x, y)
            out.append(v)
        return pd.Series(out, dtype="float64")

    return score


ratio = _pairwise(indel_ratio)
token_sort_ratio = _pairwise(token_sort)
token_set_ratio = _pairwise(token_set)
partial_ratio = _pairwise(partial)
weighted_ratio = _pairwise(weighted)
jaro_winkler = _pairwise(jaro_winkler_of)


@F.pandas_udf(T.StringType())
def phonetic(token: pd.Series) -> pd.Series:
    return token.map(lambda t: None if t is None else phonetic_key(t))
