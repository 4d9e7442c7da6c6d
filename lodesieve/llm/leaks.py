"""Evaluation texts leaking into a corpus: which documents hold passages of which test items.

A leak is a stretch of at least ``min_words`` consecutive words of an item that stands in the document with at most one
word in ``per_change`` changed; words of standard clauses don't count and end a stretch.

Search is MinHash containment with size partitions. The test items are the queries: windows of ``min_words`` words as
sets of word triples. (Two changed words in fifteen leave at least 7 of the 13 triples; sets of longer shingles would
leave too few for a sketch, so the five words of other stages don't fit here.) The domains are stretches of documents.

1. The corpus is read once, whatever the number of items. Broadcast is a bit table of the items' triples, of at most
   ``filter_bits`` bits; a triple that isn't in it is in no item. What is left of a text are regions: runs of words with
   enough known triples (``regions``). A false hit in the table only makes a region longer, it loses nothing.
2. Equal regions are one row from here on, with the documents that have them beside it; so a standard clause that stands
   in a third of all documents is sketched and compared once per wording.
3. Regions are cut into overlapping stretches, so that a window always lies whole within one. A stretch falls into a
   size class by its known triples. For each class the containment threshold becomes a Jaccard threshold from the class's
   upper size, and that decides rows per band and number of bands (``size_classes``): small stretches are looked up by
   three minima at once, large ones by one. Band keys of regions and of item windows meet in a join.
4. Candidates are verified by exact shingle containment along lines of alignment, then word by word.

Standard clauses are found from the same alignments: item words whose five-word shingle stands in several items and in a
share of at least ``clause_share`` of the documents, or in one item and in more documents still (each distinct text
counted once per place, so a leak that was copied often isn't a clause). Both counts are over all items and documents.

Defined results: null and empty texts and items hold nothing; items with fewer than ``min_words`` words can't leak;
repeated documents with the same id give one row; a null doc_id or item_id gives no row; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .wordnorm import plain_words

SHINGLE = 3
STRIDE = 16  # regions are cut into stretches of two strides
MAX_SHIFT = 3  # words inserted or left out within a passage, against its main alignment
GAP = 25  # places without a known triple that end a region: of a passage over such a gap one side is a passage by itself


@dataclass(frozen=True)
class LeakParams:
    min_words: int = 15
    per_change: int = 7
    hashes: int = 256  # of a sketch, at most
    miss: float = 1e-4  # allowed chance that the sketch misses a passage at the threshold
    clause_share: float = 0.006
    clause_min_docs: int = 3
    own_clause_share: float = 0.018  # the same for words that stand in one item only: a leak may be quoted often
    own_clause_min_docs: int = 30
    filter_bits: int = 1 << 28  # bits of the table of item triples, at most: the bound on what is broadcast (32 MB)

    @property
    def window(self) -> int:
        """Triples of a passage of min_words words."""
        return self.min_words - SHINGLE + 1

    @property
    def least(self) -> int:
        """Triples of it that survive in the worst case."""
        return max(1, self.window - SHINGLE * (self.min_words // self.per_change))


def size_classes(p: LeakParams) -> list[tuple[int, int, int]]:
    """(upper size, rows per band, bands): the most selective bands that keep the allowed miss with the allowed hashes."""
    out = []
    t = p.least / p.window
    for upper in (STRIDE // 2, STRIDE, 2 * STRIDE):
        s = min(0.999, t / (upper / p.window + 1 - t))
        bands = {r: math.ceil(math.log(p.miss) / math.log(1 - s**r)) for r in (1, 2, 3, 4)}
        rows = max([r for r, b in bands.items() if r * b <= p.hashes], default=1)
        out.append((upper, rows, bands[rows]))
    return out


class _Codes(dict):
    """64-bit hashes of words, each computed once; emptied when it has grown large."""

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w) >> 1
        return h


def _words(text: str | None, codes: _Codes) -> np.ndarray:
    w = plain_words(text)
    return np.fromiter(map(codes.__getitem__, w), np.int64, len(w))


def _triples(w: np.ndarray) -> np.ndarray:
    """Word triples as 64-bit numbers."""
    if len(w) < SHINGLE:
        return np.zeros(0, np.uint64)
    x = w.astype(np.uint64)
    with np.errstate(over="ignore"):
        y = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:]
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        return y ^ y >> np.uint64(32)


class _Table:
    """A set of numbers as bits: never a miss, sometimes a false hit."""

    def __init__(self, power: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - power), words


    def known(self, codes: np.ndarray) -> np.ndarray:
        slot = codes >> self.shift
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def item_words(items: DataFrame, p: LeakParams) -> DataFrame:
    """(item_id, item, words): one row per text of an item that can leak at all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()
        for pdf in batches:
            pdf["words"] = pd.Series([_words(t, codes) for t in pdf["text"]], dtype=object)
            yield pdf.loc[pdf["words"].map(len) >= p.min_words, ["item_id", "item", "words"]]

    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    return known.withColumn("item", F.xxhash64("item_id", "text")).mapInPandas(run, "item_id long, item long, words array<long>")


def _bit_table(words: DataFrame, p: LeakParams) -> _Table:
    """The items' triples as a table of bits, sixteen to a triple as long as that is within filter_bits. It is put together
    on the executors; the driver gets its filled words, at most filter_bits / 64."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_triples(np.asarray(w)) for w in pdf["words"]]
            yield pd.DataFrame({"code": np.unique(np.concatenate(got)).view(np.int64) if got else np.zeros(0, np.int64)})

    n = words.select(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    power = max(6, min(p.filter_bits.bit_length() - 1, max(16, (16 * n).bit_length())))
    slot = F.shiftrightunsigned("code", 64 - power)
    rows = words.select("words").mapInPandas(run, "code long").groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(code, {64 - power}) & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (power - 6), np.uint64)
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return _Table(power, table)


def regions(documents: DataFrame, table: _Table, p: LeakParams, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, region, words): the runs of words that may hold a passage; ``region`` is the same for equal ones."""
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        t, codes = shared.value, _Codes()
        pad = SHINGLE * (p.min_words // p.per_change)  # words of a passage that may lie beyond its last known triple
        for pdf in batches:
            rows = []
            for doc_id, text_hash, text in zip(pdf["d"], pdf["h"], pdf["t"], strict=True):
                w = _words(text, codes)
                pos = np.flatnonzero(t.known(_triples(w)))
                if len(pos) < p.least:
                    continue
                for run_ in np.split(pos, np.flatnonzero(np.diff(pos) >= GAP) + 1):
                    # somewhere as many known triples lie together as a passage keeps
                    if len(run_) >= p.least and (run_[p.least - 1 :] - run_[: len(run_) - p.least + 1]).min() < p.window + MAX_SHIFT:
                        part = w[max(0, run_[0] - pad) : run_[-1] + SHINGLE + pad]
                        rows.append((doc_id, text_hash, xxhash.xxh64_intdigest(part.tobytes()) >> 1, part))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "region", "words"])

    d = documents.select(F.col(id_column).cast("bigint").alias("d"), F.xxhash64(text_column).alias("h"), F.col(text_column).alias("t"))
    return d.where("d is not null and t is not null and length(t) > 0").mapInPandas(run, "doc_id long, text_hash long, region long, words array<long>")


def _minima(codes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = codes[:, None] ^ salts[None, :]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    return x


def _fold(sig: np.ndarray, rows: int, bands: int, upper: int) -> np.ndarray:
    """Band keys (sets, bands): the minima of ``rows`` hashes, the band and the class, mixed."""
    with np.errstate(over="ignore"):
        key = np.zeros((sig.shape[0], bands), np.uint64) + (np.arange(bands, dtype=np.uint64) + np.uint64(1_000 * upper))[None, :] * np.uint64(0xD6E8FEB86659FD93)
        for r in range(rows):
            key = (key ^ sig[:, r * bands : (r + 1) * bands]) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(32)
    return key


def _salts(p: LeakParams) -> np.ndarray:
    return np.random.default_rng(20_011).integers(1, 2**63, size=p.hashes, dtype=np.uint64)


def item_bands(words: DataFrame, p: LeakParams) -> DataFrame:
    """(band, item): the band keys, in every size class, of all windows of the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salts, classes = _salts(p), size_classes(p)
        for pdf in batches:
            for item, w in zip(pdf["item"], pdf["words"], strict=True):
                h = _minima(_triples(np.asarray(w)), salts)
                sig = np.lib.stride_tricks.sliding_window_view(h, p.window, axis=0).min(axis=2)
                for upper, rows, bands in classes:
                    keys = np.unique(_fold(sig, rows, bands, upper)).view(np.int64)
                    yield pd.DataFrame({"band": keys, "item": np.full(len(keys), item)})

    return words.select("item", "words").mapInPandas(run, "band long, item long")


def region_bands(distinct: DataFrame, table: _Table, p: LeakParams) -> DataFrame:
    """(band, region): the band keys of the stretches of each region, of the class of each stretch only."""
    shared = distinct.sparkSession.sparkContext.broadcast(table)

    def sketch(codes: list[np.ndarray], owners: list[int], salts: np.ndarray, rows: int, bands: int, upper: int) -> pd.DataFrame:
        first = np.cumsum([0, *map(len, codes[:-1])])
        sig = np.minimum.reduceat(_minima(np.concatenate(codes), salts[: rows * bands]), first, axis=0)
        return pd.DataFrame({"band": _fold(sig, rows, bands, upper).view(np.int64).ravel(), "region": np.repeat(np.array(owners, np.int64), bands)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, salts, classes = shared.value, _salts(p), size_classes(p)
        for pdf in batches:
            waiting: list[tuple[list, list]] = [([], []) for _ in classes]
            for region, w in zip(pdf["region"], pdf["words"], strict=True):
                code = _triples(np.asarray(w))
                pos = np.flatnonzero(t.known(code))
                for start in range(0, max(1, pos[-1] // STRIDE if len(pos) else 0), 1) if len(pos) else ():
                    mine = np.unique(code[pos[(pos >= start * STRIDE) & (pos < (start + 2) * STRIDE)]])
                    if len(mine) < p.least:
                        continue
                    k = next(i for i, (upper, _, _) in enumerate(classes) if len(mine) <= upper)
                    waiting[k][0].append(mine)
                    waiting[k][1].append(region)
                    if len(waiting[k][0]) >= 500:
                        upper, rows, bands = classes[k]
                        yield sketch(*waiting[k], salts, rows, bands, upper)
                        waiting[k] = ([], [])
            for (codes, owners), (upper, rows, bands) in zip(waiting, classes, strict=True):
                if codes:
                    yield sketch(codes, owners, salts, rows, bands, upper)

    return distinct.select("region", "words").mapInPandas(run, "band long, region long")


def _aligned(doc: np.ndarray, w: np.ndarray, p: LeakParams) -> list[np.ndarray]:
    """For each place of ``doc`` where the item ``w`` may stand: which of its words are found there, in order. A place is a
    line of alignment that shares enough triples."""
    a, b = _triples(doc), _triples(w)
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = hi - lo
    if n.sum() < p.least:
        return []
    at = np.repeat(np.arange(len(a)), n)
    occ = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    diags, counts = np.unique(at - order[occ], return_counts=True)
    out = []
    used = np.zeros(len(diags), bool)
    for o in np.argsort(-counts, kind="stable"):
        if used[o]:
            continue
        near = np.abs(diags - diags[o]) <= MAX_SHIFT
        used |= near
        if counts[near].sum() < p.least:
            continue
        found = np.zeros(len(w), bool)
        for d in diags[near]:
            lo_, hi_ = max(0, -d), min(len(w), len(doc) - d)
            if lo_ < hi_:
                same = w[lo_:hi_] == doc[lo_ + d : hi_ + d]
                if d != diags[o]:  # on a shifted line only runs of three count, not single common words
                    run = np.convolve(same, np.ones(3), "same") >= 3
                    same = same & (run | np.append(run[1:], False) | np.insert(run[:-1], 0, False))
                found[lo_:hi_] |= same
        out.append(found)
    return out


def has_passage(found: np.ndarray, counted: np.ndarray | None, p: LeakParams) -> bool:
    """A stretch of at least min_words counted words that begins and ends with a found one, of which at most one in
    per_change isn't found."""
    low: list[float] = []  # lowest running score before a found word, so far
    score = 0
    for ok, use in zip(found, counted if counted is not None else np.ones(len(found), bool), strict=True):
        if not use:
            low, score = [], 0
            continue
        before = score if ok else math.inf
        low.append(min(before, low[-1]) if low else before)
        score += 1 if ok else 1 - p.per_change
        if ok and len(low) >= p.min_words and score >= low[len(low) - p.min_words]:
            return True
    return False


def contained(pairs: DataFrame, distinct: DataFrame, words: DataFrame, p: LeakParams, small: int = 2_000_000) -> DataFrame:
    """(region, item, words, item_id, w): candidates that share as many triples as a passage keeps, by exact shingle
    containment. The items are broadcast if they are counted to have at most ``small`` words, else joined."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1)), lambda k: F.xxhash64(F.slice("words", k, SHINGLE))))
    items = words.select("item", "item_id", F.col("words").alias("w"), grams.alias("of_item"))
    if words.select(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] <= small:
        items = F.broadcast(items)
    sides = pairs.join(distinct.select("region", "words", grams.alias("of_region")), "region").join(items, "item")
    return sides.where(F.size(F.array_intersect("of_region", "of_item")) >= p.least).drop("of_region", "of_item")


def alignments(candidates: DataFrame, p: LeakParams) -> DataFrame:
    """(region, item_id, item, found) of the candidates that hold a passage, clauses not yet left aside; ``found`` has a
    character per word of the item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for region, item_id, item, doc, w in zip(pdf["region"], pdf["item_id"], pdf["item"], pdf["words"], pdf["w"], strict=True):
                for found in _aligned(np.asarray(doc), np.asarray(w), p):
                    if has_passage(found, None, p):
                        rows.append((region, item_id, item, "".join("1" if x else "0" for x in found)))
            yield pd.DataFrame(rows, columns=["region", "item_id", "item", "found"])

    return candidates.select("region", "item_id", "item", "words", "w").mapInPandas(run, "region long, item_id long, item long, found string")


def shared_starts(words: DataFrame) -> DataFrame:
    """(item, k): positions (from 1) at which five words start that another item has as well; counted over all items."""
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda k: F.struct(k.alias("k"), F.xxhash64(F.slice("words", k, 5)).alias("gram")))
    each = words.select("item_id", "item", F.inline(grams))
    several = each.select("gram", "item_id").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    return each.join(several, "gram", "left_semi").select("item", "k")


def clause_words(hits: DataFrame, texts: DataFrame, words: DataFrame, n_documents: int, p: LeakParams) -> DataFrame:
    """(item, clause): the word positions of each item that belong to standard clauses. ``texts`` has region and n_texts.
    Regions are weighted with their texts, so nothing is expanded per document."""
    starts = F.filter(F.sequence(F.lit(1), F.length("found") - 4), lambda k: F.substring(F.col("found"), k, F.lit(5)) == "11111")
    at = hits.select("region", "item", F.explode(starts).alias("k")).distinct()
    df = at.join(texts, "region").groupBy("item", "k").agg(F.sum("n_texts").alias("n_texts"))
    df = df.join(shared_starts(words).withColumn("shared", F.lit(True)), ["item", "k"], "left")
    least = F.when(F.col("shared"), max(p.clause_min_docs, math.ceil(p.clause_share * n_documents))).otherwise(max(p.own_clause_min_docs, math.ceil(p.own_clause_share * n_documents)))
    positions = F.flatten(F.collect_list(F.sequence(F.col("k"), F.col("k") + 4)))  # bounded by five times the item's length
    return df.where(F.col("n_texts") >= least).groupBy("item").agg(F.array_sort(F.array_distinct(positions)).alias("clause"))


def leaked_items(documents: DataFrame, items: DataFrame, p: LeakParams | None = None) -> DataFrame:
    """(doc_id, item_id), one row per document and item of which it holds a passage."""
    p = p or LeakParams()
    words = cut(item_words(items, p))
    table = _bit_table(words, p)
    placed = cut(regions(documents, table, p))
    distinct = cut(placed.groupBy("region").agg(F.first("words").alias("words"), F.count_distinct("text_hash").alias("n_texts")))
    # a merge join whatever the statistics say: they know the size of the words, not of the many bands made of them
    pairs = region_bands(distinct, table, p).join(item_bands(words, p).hint("merge"), "band").select("region", "item").distinct()
    hits = cut(alignments(contained(pairs, distinct, words, p), p))
    clauses = clause_words(hits, distinct.select("region", "n_texts"), words, documents.count(), p)
    final = hits.join(clauses, "item", "left").mapInPandas(_final(p), "region long, item_id long").distinct()
    return placed.select("doc_id", "region").join(final, "region").select("doc_id", "item_id").distinct()


def _final(p: LeakParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for found, clause in zip(pdf["found"], pdf["clause"], strict=True):
                f = np.frombuffer(found.encode(), np.uint8) == 49
                use = np.ones(len(f), bool)
                if clause is not None:
                    use[np.asarray(clause, dtype=np.int64) - 1] = False
                keep.append(has_passage(f, use, p))
            yield pdf.loc[np.array(keep, dtype=bool), ["region", "item_id"]]

    return run
