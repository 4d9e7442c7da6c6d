"""Per-document text statistics, and the decision whether a text is natural prose or a list, a table or junk.

``statistics`` reads every text once, whole, and reduces it to a row of numbers. Besides the reported statistics (word
count, mean word length, symbol ratio, lines ending in punctuation, common words) it holds structural ones: which share
of the text stands in table rows, list entries, log or encoded lines, how repetitive, damaged or scrambled it is.

``classify`` fits gradient-boosted trees on a bounded sample of these rows, labelled weakly: a text of which more than
half clearly stands in units of one kind has that kind; unclear ones are left out. Probabilities are calibrated on the
labels given by hand, which the trees haven't seen. Every row is then classified from its statistics alone.

Defined results: null or blank texts have zero counts, null ratios and the kind ``empty``; repeated rows give repeated
rows (``found`` is distinct); without hand labels the trees stay uncalibrated; without any weak label of a class that
class is never chosen; with fewer than ``least_rows`` of them the structural rule decides; an empty table gives no rows; labels of unknown documents or kinds are ignored; extra columns
aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .boosting import Boosted

KINDS = ("prose", "list", "table", "junk")

# fixed values: frequent words of English, German, French and Spanish
COMMON = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through back where much your way well down should because each just those how too good very own while without toward near once then since until although neither nor whenever via unless suppose meanwhile whose "
        "der die das und den dem des ein eine einen einem einer ist nicht mit auf für von zu im sich auch als an nach wie aus bei er sie es dass war wurde werden hat haben wird sind noch am so oder aber um über vor zur zum durch weil wenn ob nur kein keine "
        "le la les des et un une du en est que qui dans pour pas au aux sur par plus ce cette il elle on ne se sont avec été avait mais ou où son sa ses leur comme après avant sans sous car dont "
        "el los las y una de del al es se no lo por con para su sus más pero fue ha como o este esta era que porque cuando sin sobre tras ya aunque mientras si donde "
    ).split()
)
# fixed values: words that a noun phrase follows, and words that can't begin one; where one of the second follows one of
# the first, the order of the words isn't that of a sentence
OPENERS = frozenset("the a an of in at by from with for into its his their our der den dem ein eine einen einem le une un el los las una du".split())
NO_OPENING = frozenset(
    (
        "the a an of at by with into and or but was were is are had has have been be since because if they we he she it until although so neither nor than not did does do to there why when while that "
        "der den dem ein eine einen und oder aber war wurde ist sind weil wenn nicht le une un du el los las una es et ou mais est sont que qui car y o pero fue porque cuando"
    ).split()
)
# fixed values: pairs of them that do occur
FINE = frozenset(["in the", "in a", "in an", "of the", "of a", "of an", "at the", "at a", "by the", "by a", "by an", "from the", "from a", "with the", "with a", "for the", "for a", "for an", "into the", "into a", "from that", "of that", "in that", "at that", "by that", "with that", "for that", "in der", "in den", "in dem", "in einem", "in einer", "in einen", "by which", "in which", "un es"])
# fixed values: words of site navigation
NAVIGATION = frozenset("home menu login logout share search sitemap imprint contact help print next prev previous top lists back about privacy cookies en de fr es register account subscribe".split())

_LOG = re.compile(r"^\S*\d{4}-\d\d-\d\d[T ]\d\d:\d\d\S* |\b(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b.*=")
_HEX = re.compile(r"^(?:[0-9a-fA-F]{2}[ :]){7,}")
_ROW = re.compile(r"\t|(?:^|\s)[|│](?=\s).*\s[|│](?=\s|$)|^\s*[─━═┌┐└┘├┤┬┴┼│]{3,}\s*$|^\s*([-=+|])\1{3,}\s*$|^\s*\+[-=+]{4,}\+\s*$")
_NOISE = re.compile(r"[A-Za-z0-9+/=_-]{41,}")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|\*\*|(?<!\w)_|_(?!\w)")
_LABEL = re.compile(r"^\s*[^\W\d]\w{0,12}: ")
_TABLE_TAG = re.compile(r"</?(?:table|tr|td|th)\b[^<>]*>")
_ABBREVIATED = re.compile(r"(?:\b[^\W\d_]\.){2,}$")
_DIGIT = re.compile(r"\d")
_CELLS = re.compile(r"\S {2,}\S")
_LEADERS = re.compile(r"\.{4,}|(?:\. ){4,}|…{2,}")
_BULLET = re.compile(r"^\s*(?:[-*+•◦▪▸►→>»·–—]+|--|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z])[.)])\s+")
_FIELD = re.compile(r"^\s*[^\W\d][\w .-]{0,20}: \S")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TERMS = re.compile(r"[^\W_]+")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}|[bcdfghjklmnpqrstvwxzy]{6,}")
_SPOILT = re.compile("Ã.|Â.|â‚.|â€.|�|\x83|[^\\W\\d_][#\\\\{}|<>§¬¦~^_0-9]+[^\\W\\d_]")
_SUSPECT = re.compile("[ÃÂâ�\x83#\\\\{}|<>§¬¦~^_0-9]")  # without one of these characters nothing of _SPOILT can stand in a text
_END = (".", "!", "?", ":", ";", "…", '."', ".)", "?”", ".”", ".“")
UNIT = 300  # characters of a long line judged at a time

FEATURES = (
    "n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share", "digit_ratio", "upper_ratio", "distinct_word_share", "distinct_4gram_share", "navigation_share",
    "long_token_share", "spoilt_share", "misplaced_share", "hard_word_share", "words_per_line", "comma_ratio", "sentence_ratio", "table_share", "entry_share", "prose_share", "junk_share",
)
REPORTED = ("n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share")


def _unit_kind(s: str, words: list[str], letters: int, spoilt: int) -> int:
    """0 prose, 1 list entry, 2 table row, 3 junk, for a line or a part of a long line, without markup."""
    n = len(words)
    bare = s.strip()
    if n and not _no_navigation(words) and 10 * sum(map(_is_navigation, words)) > 7 * n or "=" in s and _LOG.search(s) or s[2:3] in (" ", ":") and _HEX.match(s):
        return 3
    leaders = ("...." in s or ". . . ." in s or "……" in s) and _LEADERS.search(s) is not None
    row = ("\t" in s or "|" in s or "│" in s or bare[:1] in _FRAME) and _ROW.search(s) is not None
    if letters < 0.3 * len(bare) and letters + _digits(bare) < 0.3 * (len(bare) - bare.count(" ")) and not leaders:
        return 2 if row and len(bare.translate(_NO_FRAME)) - letters - _digits(bare) < 0.3 * len(bare) else 3
    if spoilt > max(1, 0.12 * n):
        return 3
    if row:
        return 2
    if leaders:
        return 1
    if len(bare) > 40 and max(map(len, bare.split())) > 40 and any(len(noise) > 0.5 * len(bare) for noise in _NOISE.findall(s)):
        return 3
    tight = bare.count(";") + bare.count(",")
    spaced = bare.count("; ") + bare.count(", ")
    if tight - spaced >= 2 and spaced <= 0.3 * tight and n < 40 * (tight - spaced):
        return 2
    if "  " in bare and _CELLS.search(bare) and not bare.endswith(_END) and len(bare) < 250 and not _BULLET.match(bare):
        return 2
    if not n:
        return 1 if len(bare) < 40 else 3
    common = sum(map(_is_common, words)) / n
    if n >= 6 and common < 0.05 and sum(1 for w in words if _HARD.search(w)) > 0.2 * n:
        return 3
    if n >= 16 and len(set(words)) < 0.6 * n and len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) < 0.3 * (n - 3):
        return 3
    if n > 4 and tight > 0.18 * n and common < 0.2:
        return 1
    sentence = common >= 0.15 and n >= 4 or bare.endswith((".", "!", "?", ":", ";")) and (common >= 0.08 or n < 3) and not _ABBREVIATED.search(bare)
    if _BULLET.match(s) or _FIELD.match(s):
        return 0 if sentence and n > 4 or n > 12 and common >= 0.08 else 1
    if sentence:
        return 0
    return 1 if n <= 9 or common < 0.06 else 0


_NO_FRAME = dict.fromkeys(map(ord, "─━═│|┌┐└┘├┤┬┴┼ +-=\t"))
_FRAME = frozenset("─━═┌┐└┘├┤┬┴┼-=+")
_is_common, _is_navigation, _no_navigation = COMMON.__contains__, NAVIGATION.__contains__, NAVIGATION.isdisjoint


def _digits(s: str) -> int:
    return sum(map(s.count, "0123456789"))


def _uppercase(text: str, lower: str) -> int:
    if len(text) != len(lower):
        return sum(map(str.isupper, text))
    return int((np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) != np.frombuffer(lower.encode("utf-32-le", "replace"), np.uint32)).sum())


def measure(text: str | None) -> tuple[float, ...] | None:
    """The features of one text; None if it is blank."""
    if text is None or not text.strip():
        return None
    lines = [x for x in text.splitlines() if x.strip()]
    mass = [0, 0, 0, 0]
    words: list[str] = []
    prose: list[str] = []
    ended = spoilt = solid = hard = 0
    for line in lines:
        ended += line.rstrip().endswith(_END)
        solid += len(line)
        row = "<" in line and _TABLE_TAG.search(line) is not None
        parts = [line] if len(line) <= 2 * UNIT else [line[i : i + UNIT] for i in range(0, len(line), UNIT)]
        for s in parts:
            if "<" in s or "*" in s or "_" in s:
                s = _MARKUP.sub(" " if row else "", s)
            low = s.lower()
            w = _WORDS.findall(low)
            if row:
                kind = 2
            else:
                letters = sum(map(len, w))
                bad = len(_SPOILT.findall(s)) if _SUSPECT.search(s) else 0
                spoilt += bad
                kind = _unit_kind(s, w, letters, bad)
            mass[kind] += len(s)
            words += w
            if kind == 0:
                if ": " in low:
                    low = _LABEL.sub("", low)
                    prose += _TERMS.findall(low)
                else:
                    prose += _TERMS.findall(low) if _DIGIT.search(low) else w
            else:
                hard += sum(1 for x in w if _HARD.search(x))
    n = len(words)
    tokens = text.split()
    letters, digits, dense = sum(map(len, words)), _digits(text), sum(map(len, tokens))
    openers = misplaced = 0
    for k, a in enumerate(prose[:-1]):
        if a in OPENERS:
            openers += 1
            b = prose[k + 1]
            misplaced += b in NO_OPENING and f"{a} {b}" not in FINE
    grams = max(1, n - 3)
    m = np.array(mass, float) / max(1, sum(mass))
    return (
        float(len(tokens)), dense / max(1, len(tokens)), (dense - letters - digits) / len(text), ended / len(lines), sum(map(_is_common, words)) / max(1, n), digits / len(text),
        _uppercase(text, text.lower()) / max(1, letters), len(set(words)) / max(1, n) ** 0.75, len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) / grams if n > 3 else 1.0, sum(map(_is_navigation, words)) / max(1, n),
        sum(k for k in map(len, tokens) if k > 30) / max(1, solid), spoilt / max(1, n), (misplaced + 0.1) / (openers + 4), hard / max(1, n), n / len(lines), text.count(",") / max(1, n),
        sum(map(text.count, (". ", ".\n", "? ", "?\n", "! ", "!\n"))) / max(1, n) + text.rstrip().endswith((".", "!", "?")) / max(1, n), m[2], m[1], m[0], m[3],
    )


def statistics(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, features array<float>): one row per document; features is null for a blank text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [measure(t) for t in pdf["t"]]
            yield pd.DataFrame({"doc_id": pdf["d"], "features": pd.Series([None if g is None else np.array(g, np.float32) for g in got], dtype=object)})

    d = documents.select(F.col(id_column).cast("bigint").alias("d"), F.col(text_column).alias("t"))
    return d.mapInPandas(run, "doc_id long, features array<float>")


def weak_kind(x: np.ndarray) -> np.ndarray:
    """Kind by structure alone, -1 where it isn't clear. ``x``: rows of features."""
    f = {name: x[:, j] for j, name in enumerate(FEATURES)}
    shares = np.stack([f["prose_share"], f["entry_share"], f["table_share"], f["junk_share"]], axis=1)
    # sentences have capitals or full stops; without both, and with words out of place, it is a heap of words
    flat = (f["upper_ratio"] < 0.004) & (f["sentence_ratio"] < 0.01) & (f["n_words"] >= 12) & (f["prose_share"] > 0.5)
    scrambled = (f["prose_share"] > 0.5) & (f["misplaced_share"] > np.where(flat, 0.0105, 0.08))
    shares[scrambled] = [0, 0, 0, 1]
    shares[flat & ~scrambled] = 0.25
    shares[f["spoilt_share"] > 0.25] = [0, 0, 0, 1]
    shares[(f["distinct_4gram_share"] < 0.3) & (f["table_share"] + f["entry_share"] < 0.5)] = [0, 0, 0, 1]
    kind = shares.argmax(1)
    return np.where(shares.max(1) > 0.55, kind, -1)


@dataclass(frozen=True)
class QualityParams:
    sample_rows: int = 8_000  # weakly labelled rows fitted on, at most
    label_rows: int = 20_000  # hand labels calibrated on, at most
    rounds: int = 30
    least_rows: int = 40  # with fewer clear rows no trees are fitted and the structural rule decides


def fit(stats: DataFrame, labels: DataFrame | None, p: QualityParams) -> Boosted | None:
    """Trees fitted on a bounded sample chosen by a hash of the id; None if there is nothing to fit."""
    usable = stats.where("features is not null")
    n = usable.count()
    if not n:
        return None
    share = min(1.0, p.sample_rows / n)
    h = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    sample = usable.where(h <= share * 1.05).select("features").limit(p.sample_rows).toPandas()
    x = np.array(sample["features"].tolist(), float)
    y = weak_kind(x)
    x, y = x[y >= 0], y[y >= 0]
    if len(y) < p.least_rows:
        return None
    counts = np.bincount(y, minlength=len(KINDS))
    weight = np.sqrt(len(y) / np.maximum(1, counts))[y]
    model = Boosted(len(KINDS), rounds=p.rounds).fit(x, y, weight / weight.mean())
    if labels is not None:
        known = labels.where(F.col("doc_kind").isin(*KINDS)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "doc_kind").distinct()
        # a bounded side: at most label_rows rows
        hand = usable.join(known.orderBy(F.xxhash64("doc_id")).limit(p.label_rows), "doc_id").select("features", "doc_kind").toPandas()
        if len(hand):
            model.calibrate(np.array(hand["features"].tolist(), float), np.array([KINDS.index(k) for k in hand["doc_kind"]]))
    return model


def classify(documents: DataFrame, labels: DataFrame | None, p: QualityParams | None = None) -> DataFrame:
    """(doc_id, reported statistics, doc_kind, confidence) for every document."""
    p = p or QualityParams()
    stats = cut(statistics(documents))
    model = stats.sparkSession.sparkContext.broadcast(fit(stats, labels, p))
    at = [FEATURES.index(c) for c in REPORTED]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blank = pdf["features"].isna().to_numpy()
            kinds, conf = np.full(len(pdf), "empty", dtype=object), np.full(len(pdf), np.nan)
            values = np.full((len(pdf), len(at)), np.nan)
            if (~blank).any():
                x = np.array(pdf.loc[~blank, "features"].tolist(), float)
                values[~blank] = x[:, at]
                if model.value is not None:
                    pr = model.value.probabilities(x)
                    kinds[~blank] = np.array(KINDS, dtype=object)[pr.argmax(1)]
                    conf[~blank] = pr.max(1)
                else:
                    k = weak_kind(x)
                    kinds[~blank] = np.array(KINDS, dtype=object)[np.where(k >= 0, k, 0)]
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": np.nan_to_num(values[:, 0]).astype(np.int64)})
            for k, c in enumerate(REPORTED[1:], 1):
                out[c] = values[:, k]
            yield out.assign(doc_kind=kinds, confidence=conf)

    got = stats.mapInPandas(run, "doc_id long, n_words long, mean_word_length double, symbol_ratio double, punct_line_share double, common_word_share double, doc_kind string, confidence double")
    ratios = [*REPORTED[1:], "confidence"]
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ratios})


def not_prose(classified: DataFrame) -> DataFrame:
    """(doc_id, doc_kind) of texts that aren't mainly prose."""
    return classified.where(F.col("doc_kind").isin("list", "table", "junk") & F.col("doc_id").isNotNull()).select("doc_id", "doc_kind").distinct()
