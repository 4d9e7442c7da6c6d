"""Matching records of two sources that share no key, with a confidence for each match.

1. Records become name variants (parsed), years of birth, countries and a kind; nothing else is compared.
2. Candidates come from MinHash signatures in bands, over two sets per variant: the consonant triples of the name's
   rare words, and the ends of these words together with years and countries. Either may agree; no band is capped.
3. Each candidate pair of spellings gets similarity features once; per pair of records the best ones are kept and year,
   country and kind are compared.
4. Gradient-boosted trees are fitted on a bounded sample of weak labels: same name and same year (or, where no year is
   known, same country or, without that too, the very same name) is a match; another name, or a contradicting year, is none; the rest is unlabelled. Probabilities
   are calibrated on pairs with whole dates of birth on both sides, of which neither labels nor trees know day and month;
   ``reliability`` shows the other half of these pairs.

Defined results: records without key or without a name match nothing; records that stand in several deliveries are one
record with all their values; unknown years, countries or kinds neither speak for nor against; with few weak labels, or
none of a class, the rule behind the labels decides; empty tables give no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .boosting import Boosted
from .countries import coded, country_table
from .name_variants import _Present, parsed, surely, with_counts, years
from .names import Vocabulary, compare, from_key, lcs_length, mutated, skeleton

FEATURES = ("strict", "loose", "weakest", "grams", "length_gap", "year", "country", "kind", "firm")


@dataclass(frozen=True)
class MatchParams:
    bands: int = 32
    rows: int = 4
    attribute_bands: int = 16
    attribute_rows: int = 3
    usual_share: float = 0.001
    sample_rows: int = 20_000  # weakly labelled pairs fitted on, and dated pairs calibrated on, at most
    least_rows: int = 40  # with fewer labelled pairs no trees are fitted and the rule behind the labels decides
    least_loose: float = 0.55  # pairs of spellings below it aren't kept
    threshold: float = 0.5
    country_names: Mapping[str, str] | None = None  # wordings of countries besides those of ISO 3166, with their codes


def full_dates(text: Column) -> Column:
    """Whole dates in a text as yyyy-mm-dd, with month and day in either order, since both occur."""
    t = F.coalesce(text, F.lit(""))
    early = F.transform(F.regexp_extract_all(t, F.lit(r"(?<!\d)\d{4}[-./]\d{1,2}[-./]\d{1,2}(?!\d)"), 0), lambda x: F.split(x, "[-./]"))
    late = F.transform(F.regexp_extract_all(t, F.lit(r"(?<!\d)\d{1,2}[-./]\d{1,2}[-./]\d{4}(?!\d)"), 0), lambda x: F.reverse(F.split(x, "[-./]")))
    two = lambda x: F.lpad(x, 2, "0")
    both = lambda p: F.array(F.concat_ws("-", p[0], two(p[1]), two(p[2])), F.concat_ws("-", p[0], two(p[2]), two(p[1])))
    return F.array_distinct(F.flatten(F.transform(F.concat(early, late), both)))


def records(df: DataFrame, key: str, name: str, aliases: str, born: Column, countries: Column, kind: Column, p: MatchParams) -> tuple[DataFrame, DataFrame]:
    """(record, name) spellings, and (record, years, dates, codes, firm) with the values of all deliveries."""
    plain = F.transform(F.coalesce(countries, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    base = df.where(df[key].isNotNull() & (F.trim(df[key]) != "")).select(F.trim(df[key]).alias("record"), df[name].alias("n"), df[aliases].alias("a"), years(born).alias("y"), full_dates(born).alias("d"), plain.alias("c"), kind.alias("firm"))
    spelled = base.select("record", F.explode(F.concat(F.array("n"), F.coalesce("a", F.array().cast("array<string>")))).alias("name")).where("name is not null and trim(name) <> ''").distinct()
    # sets of years, dates, countries of one record: bounded by how many there are
    together = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    facts = base.groupBy("record").agg(together("y").alias("years"), together("d").alias("dates"), together("c").alias("codes"), F.max("firm").alias("firm"))
    return spelled, coded(facts, "codes", country_table(df.sparkSession, p.country_names))


def with_rare(names: DataFrame, usual: float) -> DataFrame:
    """names (key, listed) plus ``rare``: the words that aren't usual, transliterations levelled; all words if there are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, listed in zip(pdf["key"], pdf["listed"], strict=True):
                core = from_key(key).core
                out.append([mutated(w) for w, k in zip(core, listed, strict=False) if k < usual and len(w) > 1] or [mutated(w) for w in core])
            pdf["rare"] = pd.Series(out, dtype=object)
            yield pdf

    return names.select("id", "key", "listed").mapInPandas(run, "id long, key string, listed array<int>, rare array<string>")


def signatures(spelled: DataFrame, usual: float, p: MatchParams) -> DataFrame:
    """(id, band) from (id, key, listed, years, codes): band keys of both sets of a spelling.

    Rare words enter with all triples of their consonants, usual given names and kinds of business only with one element, so
    that names which share no more than those don't become candidates. The second set joins the ends of the rare words
    with the years and countries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        rng = np.random.default_rng(4_101)
        width = max(p.bands * p.rows, p.attribute_bands * p.attribute_rows)
        salts = rng.integers(1, 2**63, size=width, dtype=np.uint64)

        def bands(items: set[str], n: int, rows: int, tag: int) -> np.ndarray:
            x = np.array([xxhash.xxh64_intdigest(i) for i in items], dtype=np.uint64)[:, None] ^ salts[None, : n * rows]
            with np.errstate(over="ignore"):
                x *= np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                low = x.min(axis=0).reshape(n, rows)
                out = np.arange(n, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(tag)
                for r in range(rows):
                    out = (out ^ low[:, r]) * np.uint64(0x94D049BB133111EB)
            return out.view(np.int64)

        for pdf in batches:
            ids, out = [], []
            for i_, key, listed, ys, cs in zip(pdf["id"], pdf["key"], pdf["listed"], pdf["years"], pdf["codes"], strict=True):
                n = from_key(key)
                rare = [skeleton(w) for w, k in zip(n.core, listed, strict=False) if k < usual and len(w) > 1] or [skeleton(w) for w in n.core]
                grams = {w[i : i + 3] for s in rare for w in [f"^{s}$"] for i in range(max(1, len(w) - 2))}
                grams |= {f"u{w[0]}" for w in n.core if skeleton(w) not in rare} | {f"s{w}" for w in n.sector}
                b = [bands(grams, p.bands, p.rows, 7)]
                facts = [*(f"y{y}" for y in (ys if ys is not None else ())), *(f"c{c}" for c in (cs if cs is not None else ()))]
                if facts:
                    b.append(bands({f"{end}{f}" for s in rare for end in (f"^{s[:3]}", f"{s[-3:]}$") for f in facts}, p.attribute_bands, p.attribute_rows, 11))
                got = np.concatenate(b)
                ids += [i_] * len(got)
                out.append(got)
            yield pd.DataFrame({"id": np.array(ids, np.int64), "band": np.concatenate(out) if out else np.zeros(0, np.int64)})

    return spelled.select("id", "key", "listed", "years", "codes").distinct().mapInPandas(run, "id long, band long").distinct()


def near_names(pairs: DataFrame, left: DataFrame, right: DataFrame, usual: float) -> DataFrame:
    """(a, b, k1, l1, k2, l2): the pairs of spellings of which a rare word of one is within a slip's edit distance of a rare
    word of the other, or that are one word against several. All others would get ``strict`` 0 and so be no match; they
    are cut here, in the JVM, before any feature is computed."""

    def side(d: DataFrame, x: str, n: str) -> DataFrame:
        return d.select(F.col("id").alias(x), F.col("key").alias(f"k{n}"), F.col("listed").alias(f"l{n}"), F.col("rare").alias(f"r{n}"))

    slack = lambda x, y: F.when(F.greatest(F.length(x), F.length(y)) >= 8, 3).when(F.greatest(F.length(x), F.length(y)) >= 5, 2).otherwise(1)
    close = lambda x, y: (F.levenshtein(x, y, 3) >= 0) & (F.levenshtein(x, y, 3) <= slack(x, y))
    alone = (F.size("r1") == 1) != (F.size("r2") == 1)
    both = pairs.join(side(left, "a", "1"), "a").join(side(right, "b", "2"), "b")
    return both.where(alone | F.exists("r1", lambda x: F.exists("r2", lambda y: close(x, y)))).drop("r1", "r2")


def spelling_features(pairs: DataFrame, usual: float, p: MatchParams) -> DataFrame:
    """(a, b, strict, loose, weakest, grams, length_gap, firm_a, firm_b) per pair of spellings that is near enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists: dict[str, int] = {}
            types: dict[str, int] = {}
            known = Vocabulary(_Present(lists), types, common=usual, real=1 << 30)
            names = {k: from_key(k) for k in {*pdf["k1"], *pdf["k2"]}}
            for k, l in zip([*pdf["k1"], *pdf["k2"]], [*pdf["l1"], *pdf["l2"]], strict=True):
                for tok, n in zip(names[k].core, l, strict=False):
                    lists[tok] = n
            out = []
            for a, b, k1, k2 in zip(pdf["a"], pdf["b"], pdf["k1"], pdf["k2"], strict=True):
                x, y = names[k1], names[k2]
                # the shorter name's words, each with its best partner
                s, t = (x.core, y.core) if len(x.core) <= len(y.core) else (y.core, x.core)
                best = [max(2 * lcs_length(m, mutated(v)) / (len(m) + len(mutated(v))) if len(m) > 1 and len(v) > 1 else 0.7 * (m[0] == v[0]) for v in t) for m in map(mutated, s)]
                loose = sum(q * len(m) for q, m in zip(best, s, strict=True)) / sum(map(len, s))
                if loose < p.least_loose:
                    continue
                g, h = ({w[i : i + 2] for v in n.core for w in [f"^{skeleton(v)}$"] for i in range(len(w) - 1)} for n in (x, y))
                # names that both lists spell their own way: the comparison may run in either direction
                strict = max(compare(y, x, known), compare(x, y, known))
                out.append((a, b, strict, loose, min(best), len(g & h) / len(g | h), abs(sum(map(len, x.core)) - sum(map(len, y.core))), x.firm, y.firm))
            yield pd.DataFrame(out, columns=["a", "b", "strict", "loose", "weakest", "grams", "length_gap", "firm_a", "firm_b"])

    return pairs.select("a", "b", "k1", "l1", "k2", "l2").mapInPandas(run, "a long, b long, strict double, loose double, weakest double, grams double, length_gap int, firm_a boolean, firm_b boolean")


def _agree(a: str, b: str, tolerance: int) -> Column:
    """1 if the sets meet, -1 if both are known and don't, else 0."""
    near = lambda x, y: F.abs(x - y) <= tolerance if tolerance else x == y
    meets = F.exists(a, lambda x: F.exists(b, lambda y: near(x, y)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(meets, 1.0).otherwise(-1.0)


def weak_match(x: np.ndarray) -> np.ndarray:
    """1, 0, or -1 where nothing is known."""
    f = {n: x[:, j] for j, n in enumerate(FEATURES)}
    same = (f["strict"] >= 0.9) & (f["kind"] >= 0)
    alike = (f["strict"] >= 0.97) & (f["loose"] >= 0.95) & (f["country"] == 0)
    yes = same & ((f["year"] == 1) & (f["country"] >= 0) | (f["year"] == 0) & ((f["country"] == 1) | alike))
    no = (f["strict"] == 0) | (f["year"] == -1) | (f["kind"] == -1)
    return np.where(yes, 1, np.where(no, 0, -1))


def fit(pairs: DataFrame, p: MatchParams) -> Boosted | None:
    """Trees on a bounded sample of weakly labelled pairs, calibrated on pairs of which both records have a whole date of
    birth: whether day and month agree is known neither to the weak labels nor to the trees. Such pairs aren't fitted on.
    Pairs of the same spelling are rare among candidates, so the sample takes them first."""
    order = F.xxhash64("a_record", "b_record", F.lit("fit"))
    half = p.sample_rows // 2
    take = lambda where, n: pairs.where(where).orderBy(order).limit(n).select(*FEATURES, "dated")
    got = take("strict > 0 and dated is null", half).unionByName(take("strict = 0 and dated is null", half)).toPandas()
    if not len(got):
        return None
    x = got[list(FEATURES)].to_numpy(float)
    y = weak_match(x)
    if len(set(y[y >= 0])) < 2 or (y >= 0).sum() < p.least_rows:
        return None
    counts = np.bincount(y[y >= 0], minlength=2)
    weight = np.sqrt(counts.max() / np.maximum(1, counts))[y[y >= 0]]
    model = Boosted(2, rounds=25, depth=3).fit(x[y >= 0], y[y >= 0], weight)
    dated = take("dated is not null and pmod(xxhash64(b_record, 'half'), 2) = 0", p.sample_rows).toPandas()
    return model.calibrate(dated[list(FEATURES)].to_numpy(float), dated["dated"].to_numpy(int))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, share_same_date) over the dated pairs that calibration hasn't seen."""
    held = scored.where("dated is not null and pmod(xxhash64(b_record, 'half'), 2) = 1")
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return held.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("dated").cast("double")).alias("share_same_date"))


def match(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], p: MatchParams | None = None) -> DataFrame:
    """(a_record, b_record, dated, confidence) of all candidate pairs; each side is what ``records`` returns. ``dated``:
    whether whole dates of birth agree, null if one isn't known."""
    p = p or MatchParams()
    sides = []
    for spelled, facts in (left, right):
        sides.append(cut(parsed(spelled, "name").select("record", "key", F.xxhash64("key").alias("id")).distinct().join(facts, "record", "left")))
    a, b = sides
    usual = surely(p.usual_share, a.select("record").distinct().count())
    bc, ac = with_counts(b.select("id", "key").distinct(), a)
    ac, bc = (cut(with_rare(d.select("id", "key").distinct().join(c, "id"), usual)) for d, c in ((a, ac), (b, bc)))
    sketch = lambda d, c: signatures(d.join(c.select("id", "listed"), "id"), usual, p)
    pairs = sketch(a, ac).withColumnRenamed("id", "a").join(sketch(b, bc).withColumnRenamed("id", "b").hint("merge"), "band").select("a", "b").distinct()
    near = cut(spelling_features(near_names(pairs, ac, bc, usual), usual, p))
    side = lambda d, s: d.select(F.col("id").alias(s), F.col("record").alias(f"{s}_record"))
    fact = lambda f, s: f.select(F.col("record").alias(f"{s}_record"), *[F.col(c).alias(f"{s}_{c}") for c in ("years", "dates", "codes", "firm")])
    best = F.max(F.struct("strict", "loose", "weakest", "grams", "length_gap", "firm_a", "firm_b")).alias("s")
    per = near.join(side(a, "a"), "a").join(side(b, "b"), "b").groupBy("a_record", "b_record").agg(best).select("a_record", "b_record", "s.*")
    per = per.join(fact(left[1], "a"), "a_record").join(fact(right[1], "b"), "b_record")
    kind = F.when(F.col("a_firm").isNull() | F.col("b_firm").isNull(), 0.0).when(F.col("a_firm") == F.col("b_firm"), 1.0).otherwise(-1.0)
    dated = F.when((F.size("a_dates") > 0) & (F.size("b_dates") > 0), F.arrays_overlap("a_dates", "b_dates"))
    feats = cut(per.select("a_record", "b_record", "strict", "loose", "weakest", "grams", F.col("length_gap").cast("double").alias("length_gap"), _agree("a_years", "b_years", 1).alias("year"), _agree("a_codes", "b_codes", 0).alias("country"), dated.alias("dated"), kind.alias("kind"), (F.col("firm_a") | F.col("firm_b")).cast("double").alias("firm")))
    model = feats.sparkSession.sparkContext.broadcast(fit(feats, p))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(FEATURES)].to_numpy(float)
            c = model.value.probabilities(x)[:, 1] if model.value is not None else (weak_match(x) == 1).astype(float)
            yield pdf[["a_record", "b_record", "dated"]].assign(confidence=c)

    return feats.mapInPandas(run, "a_record string, b_record string, dated boolean, confidence double")


def match_lists(targets: DataFrame, un: DataFrame, p: MatchParams | None = None) -> DataFrame:
    """(entity_id, un_id, dated, confidence): candidate pairs of the two lists."""
    p = p or MatchParams()
    schema = F.lower(F.coalesce("entity_schema", F.lit("")))
    a = records(targets.where(schema != "cryptowallet"), "entity_id", "name", "aliases", F.col("birth_date"), F.col("countries"), F.when(schema == "person", False).when(schema.isin("company", "organization", "legalentity"), True), p)
    kind = F.lower(F.coalesce("record_type", F.lit("")))
    b = records(un, "un_id", "name", "aliases", F.when(F.col("comments").rlike("(?i)born|birth|dob"), F.col("comments")), F.col("nationalities"), F.when(kind == "individual", False).when(kind == "entity", True), p)
    return match(a, b, p).withColumnsRenamed({"a_record": "entity_id", "b_record": "un_id"})
