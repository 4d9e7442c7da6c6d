"""Variant spellings of names: which listed entities does a typed name denote?

Suffix blocking. Names are parsed once per distinct spelling (``names.parse_name``). For every ordered pair of a name's
tokens (t, u) the index has the suffix of t's consonants together with the first letter of u; rare tokens are indexed by
their first consonants as well, as a slip may stand in the suffix. A key that more than ``common_block`` listed names
share is overly common; it isn't dropped but refined with more of the other fields, each time by two keys of which one
slip leaves one intact (the beginning or the end of u's consonants, then with all of t or all of u; these last keys are
used without any limit). Two whole names written as one word meet under a key of their own. Candidate pairs are cut by
edit distance in the JVM, made distinct, and compared by longest-common-subsequence ratio (``names.compare``).

How usual a token is comes from all listed and all typed names: (token, listed names, typed names) is aggregated and
joined to the names, so no vocabulary is broadcast.

Defined results: null, blank or nameless texts match nothing; repeated rows count once; a typed name that two entities
share gives both, unless years of birth on both sides exclude one; empty tables give no rows. Other columns aren't read.
Of a name of more than ``all_pairs`` words each word is paired with its neighbours and with the words of smallest hash, which
are the same in every spelling that has them; so a text of any length is a name like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .names import SEVERAL, Vocabulary, compare, from_key, mutated, parse_name, skeleton


@dataclass(frozen=True)
class VariantParams:
    suffix: int = 4  # consonants of the suffix; a shorter token counts whole
    common_block: int = 40  # listed names under a key from which on it is refined
    usual_share: float = 0.001  # share of the listed records from which on a token is a usual given or middle name
    real_share: float = 0.0015  # share of the typed names from which on an unlisted token is a name of its own, not a slip
    least_score: float = 0.8
    all_pairs: int = 12  # words up to which all are paired


def surely(share: float, n: int) -> float:
    """The least count c whose lower bound, c less two standard deviations of a Poisson count, reaches a share of n. So few
    occurrences prove nothing in a small table, and the share alone decides in a large one; there is no fixed floor."""
    return (1 + math.sqrt(1 + share * n)) ** 2


def parsed(names: DataFrame, column: str) -> DataFrame:
    """names plus ``key``, the parsed name as text; rows without a name are dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse_name(t) for t in pdf[column]]
            pdf["key"] = pd.Series([n.key if n else None for n in got], dtype=object, index=pdf.index)
            yield pdf[pdf["key"].notna()]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema.fields)
    return names.mapInPandas(run, f"{fields}, key string")


def core_tokens(key: Column) -> Column:
    return F.filter(F.split(F.split(key, r"\|")[1], " "), lambda t: F.length(t) > 0)


def with_counts(typed: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, listed int[], typed int[]) for both sides: per token, the listed records and the typed names that have it.

    ``typed`` has id and key; ``listed`` has id, key and record (what counts once). Names travel as 64-bit ids; should two
    names ever share one, both are compared, so that nothing is lost."""
    lt = listed.select("record", F.explode(core_tokens(F.col("key"))).alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n_listed"))
    tt = typed.select("id", F.explode(F.array_distinct(core_tokens(F.col("key")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n_typed"))
    counts = cut(lt.join(tt, "token", "full").select("token", F.coalesce("n_listed", F.lit(0)).cast("int").alias("l"), F.coalesce("n_typed", F.lit(0)).cast("int").alias("t")))

    def back(keys: DataFrame) -> DataFrame:
        t = keys.select("id", F.posexplode(core_tokens(F.col("key"))).alias("pos", "token")).join(counts, "token")
        g = t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "l", "t"))).alias("c"))
        return g.select("id", F.col("c.l").alias("listed"), F.col("c.t").alias("typed"))

    return back(typed.select("id", "key").distinct()), back(listed.select("id", "key").distinct())


KEYS = ("a", "b1", "b2", "c1", "c2", "c3", "p", "w")


def _variants(toks: list[str]) -> Iterator[list[str]]:
    """The tokens, and with each of those that are short for several names replaced."""
    yield toks
    for i, t in enumerate(toks):
        for full in SEVERAL.get(t, ()):
            yield [*toks[:i], full, *toks[i + 1 :]]


def block_keys(names: DataFrame, usual: float, p: VariantParams) -> DataFrame:
    """From (id, key, listed) for every ordered pair of tokens (t, u), as 64-bit hashes (0: none): the suffix key a; its
    refinements b1, b2, then c1, c2, c3; p by the beginning of a rare t; w for initials. And what stands for the tokens when
    candidates are cut, with the listed names they stand in. A usual token with an initial beside it is no key: it could be
    anybody's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        def h(kind: str, x: str, y: str) -> int:
            return (xxhash.xxh64_intdigest(f"{kind}{x}|{y}") >> 1) or 1

        for pdf in batches:
            ids, keys, ts, us, nt, nu = [], [], [], [], [], []
            for i_, key, listed in zip(pdf["id"], pdf["key"], pdf["listed"], strict=True):
                n = from_key(key)
                m = len(n.core)
                counts = [*(listed if listed is not None else [0] * m), *[1 << 30] * len(n.sector)]
                seen = set()
                for toks in _variants([*n.core, *sorted(n.sector)]):
                    sk = [skeleton(x) for x in toks]
                    mu = [mutated(x) for x in toks]
                    chosen = range(len(toks))
                    if m > p.all_pairs:
                        least = set(sorted({x: i for i, x in enumerate(mu) if len(x) > 1}.items(), key=lambda e: h("m", e[0], ""))[: p.all_pairs // 2])
                        chosen = sorted(i for _, i in least)
                    for i, t in enumerate(toks):
                        if len(t) < 2:
                            continue
                        often = counts[i] >= usual
                        near = chosen if m <= p.all_pairs else {*chosen, *range(max(0, i - 1), min(len(toks), i + 2))}
                        for j in near:
                            u = toks[j]
                            if i != j and (i < m or j < m) and (len(u) > 1 or not often) and (mu[i], mu[j]) not in seen:
                                seen.add((mu[i], mu[j]))
                                begin, end, more = sk[i][:4], sk[i][-p.suffix :], len(u) > 1
                                ids.append(i_)
                                keys.append((
                                    h("a", end, u[0]),
                                    *((h("b", end, sk[j][:2]), h("B", end, sk[j][-2:]), h("c", mu[i], sk[j][:3]), h("C", mu[i], sk[j][-3:]), h("D", begin, mu[j])) if more else (0, 0, 0, 0, 0)),
                                    h("p", begin, u[0]) if not often and i < m else 0,
                                    h("w", mu[i], u[0]) if j < m and not often else 0,
                                ))
                                ts.append(mu[i])
                                us.append(mu[j])
                                nt.append(counts[i])
                                nu.append(counts[j])
                # alone, or several words written as one
                whole = {mutated(n.core[0])} if m == 1 else {mutated("".join(n.core)), mutated("".join(reversed(n.core)))} if m <= 3 else ()
                for joined in whole:
                    k = h("=", joined, "")
                    ids.append(i_)
                    keys.append((k, 0, 0, k, 0, 0, 0, 0))
                    ts.append("")
                    us.append("")
                    nt.append(0)
                    nu.append(0)
            k = np.array(keys, np.int64).reshape(-1, len(KEYS))
            cols = {c: k[:, i] for i, c in enumerate(KEYS)}
            yield pd.DataFrame({"id": np.array(ids, np.int64), **cols, "t": pd.Series(ts, dtype=object), "u": pd.Series(us, dtype=object), "nt": np.array(nt, np.int32), "nu": np.array(nu, np.int32)})

    return names.select("id", "key", "listed").mapInPandas(run, f"id long, {', '.join(f'{c} long' for c in KEYS)}, t string, u string, nt int, nu int")


def _overly_common(listed_keys: DataFrame, columns: list[str], p: VariantParams) -> DataFrame:
    """Keys under which more than ``common_block`` listed names stand. There are at most rows / common_block of them; the
    side is broadcast only if that is checked to be little."""
    keys = listed_keys.select(F.explode(F.array(*columns)).alias("k")).where("k <> 0")
    found = cut(keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.common_block).select("k"))
    return F.broadcast(found) if found.count() <= 50_000 else found


def candidate_pairs(typed: DataFrame, listed: DataFrame, usual: float, p: VariantParams) -> DataFrame:
    """(typed, listed): distinct ids of names that share a block and whose blocked tokens may be the same: a typed token
    that is a listed one must be it, another must be within a few letters."""
    left, right = block_keys(typed, usual, p), cut(block_keys(listed, usual, p))
    checked = ["a", "b1", "b2", "p"]
    common = _overly_common(right, checked, p)

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        r = rows
        for c in checked:
            r = r.join(common.select(F.col("k").alias(c), F.lit(True).alias(f"common_{c}")), c, "left")
        is_common = lambda c: F.col(f"common_{c}").isNotNull()
        fine = [F.when(is_common(b), F.array(c, "c3")).otherwise(F.array(b)) for b, c in (("b1", "c1"), ("b2", "c2"))]
        alone = F.col("b1") == 0  # an initial, or a name written as one word
        keys = F.when(~is_common("a"), F.array("a")).when(alone, F.array("c1", "w")).otherwise(F.concat(*fine, F.array("w")))
        begun = F.when(~is_common("p"), F.array("p")).otherwise(F.array("c3", "w"))
        return r.select(F.explode(F.array_distinct(F.concat(keys, begun))).alias("block"), F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("t", "u", "nt", "nu")]).where("block <> 0")

    def same(x: str) -> Column:
        a, b, na, nb = (F.col(f"{c}{x}_{side}") for c, side in (("", "typed"), ("", "listed"), ("n", "typed"), ("n", "listed")))
        slack = F.when(F.greatest(F.length(a), F.length(b)) >= 8, 3).when(F.greatest(F.length(a), F.length(b)) >= 4, 2).otherwise(1)
        near = F.levenshtein(a, b, 3)
        return (a == b) | (na.cast("long") * Vocabulary.rarer <= nb) & (near >= 0) & (near <= slack)

    initial = (F.length("u_typed") == 1) | (F.length("u_listed") == 1)
    pairs = keyed(left, "typed").join(keyed(right, "listed"), "block").where(same("t") & (initial | same("u")))
    return pairs.select("typed", "listed").distinct()


def compared(pairs: DataFrame, typed: DataFrame, listed: DataFrame, usual: float, real: float, p: VariantParams) -> DataFrame:
    """(typed, listed, score) of the pairs of ids that can be one name. The sides bring key and token counts along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            lists: dict[str, int] = {}
            types: dict[str, int] = {}
            known = Vocabulary(_Present(lists), types, common=usual, real=real)
            names = {k: from_key(k) for k in {*pdf["k1"], *pdf["k2"]}}
            for k, l, t in zip([*pdf["k1"], *pdf["k2"]], [*pdf["l1"], *pdf["l2"]], [*pdf["t1"], *pdf["t2"]], strict=True):
                for tok, a, b in zip(names[k].core, l, t, strict=False):
                    lists[tok], types[tok] = a, b
            for i, j, a, b in zip(pdf["typed"], pdf["listed"], pdf["k1"], pdf["k2"], strict=True):
                s = compare(names[a], names[b], known)
                if s >= p.least_score:
                    out.append((i, j, s))
            yield pd.DataFrame(out, columns=["typed", "listed", "score"])

    t = typed.select(F.col("id").alias("typed"), F.col("key").alias("k1"), F.col("listed").alias("l1"), F.col("typed").alias("t1"))
    r = listed.select(F.col("id").alias("listed"), F.col("key").alias("k2"), F.col("listed").alias("l2"), F.col("typed").alias("t2"))
    return pairs.join(t, "typed").join(r, "listed").mapInPandas(run, "typed long, listed long, score double")


class _Present(dict):
    """Counts in which a token counted zero times isn't contained."""

    def __init__(self, counts: dict[str, int]):
        super().__init__()
        self.counts = counts

    def __contains__(self, k: object) -> bool:
        return self.counts.get(k, 0) > 0  # type: ignore[call-overload]

    def get(self, k: str, default: int = 0) -> int:  # type: ignore[override]
        return self.counts.get(k, default)


def linked_names(typed: DataFrame, listed: DataFrame, p: VariantParams | None = None) -> DataFrame:
    """(name, record, score) from ``typed`` (name) and ``listed`` (name, record): every typed spelling with the records
    one of whose names it can be."""
    p = p or VariantParams()
    name_id = F.xxhash64("key").alias("id")
    t = cut(parsed(typed.where("name is not null and trim(name) <> ''").select("name").distinct(), "name").select("name", "key", name_id))
    r = cut(parsed(listed.where("name is not null and trim(name) <> '' and record is not null").select("name", "record").distinct(), "name").select("record", "key", name_id).distinct())
    usual = surely(p.usual_share, r.select("record").distinct().count())
    names_t, names_r = t.select("id", "key").distinct(), r.select("id", "key").distinct()
    tc, rc = with_counts(names_t, r)
    tc, rc = cut(names_t.join(tc, "id")), cut(names_r.join(rc, "id"))
    real = surely(p.real_share, tc.count())
    hits = compared(candidate_pairs(tc, rc, usual, p), tc, rc, usual, real, p)
    by_record = hits.join(r.select("record", F.col("id").alias("listed")), "listed").groupBy("typed", "record").agg(F.max("score").alias("score"))
    return by_record.join(t.select("name", F.col("id").alias("typed")), "typed").select("name", "record", "score")


def years(text: Column) -> Column:
    """Years in a text; a year that stands for a span or an estimate covers its neighbours."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)((?:19|20)\d\d)(?!\d)"), 1), lambda y: y.cast("int"))
    return F.when(F.lower(text).rlike("circa|approx|about|ca\\."), F.flatten(F.transform(found, lambda y: F.array(y - 1, y, y + 1)))).otherwise(found)


def payments_of_listed(payments: DataFrame, targets: DataFrame, un: DataFrame, p: VariantParams | None = None) -> DataFrame:
    """(list_name, record_key, txn_id): the list records that the beneficiary name of each payment denotes."""
    wallet = F.lower(F.coalesce("entity_schema", F.lit(""))) == "cryptowallet"
    born = F.col("comments").rlike("(?i)born|birth|dob")
    lists = targets.where(~wallet & F.col("entity_id").isNotNull()).select(F.struct(F.lit("opensanctions").alias("list_name"), F.trim("entity_id").alias("record_key")).alias("record"), "name", "aliases", years(F.col("birth_date")).alias("years"))
    lists = lists.unionByName(un.where("un_id is not null").select(F.struct(F.lit("un").alias("list_name"), F.trim("un_id").alias("record_key")).alias("record"), "name", "aliases", years(F.when(born, F.col("comments"))).alias("years")))
    lists = lists.where("record.record_key <> ''")
    listed = lists.select("record", F.explode(F.concat(F.array("name"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))).alias("name"))
    paid = payments.where("bene_name is not null and trim(bene_name) <> '' and txn_id is not null and trim(txn_id) <> ''").select("txn_id", F.col("bene_name").alias("name"), years(F.col("bene_dob")).alias("paid_years"))
    links = linked_names(paid.select("name"), listed, p)
    record_years = lists.select("record", F.explode("years").alias("y")).groupBy("record").agg(F.collect_set("y").alias("years"))  # the years a person may be born in: a few
    links = links.join(record_years, "record", "left")
    clash = (F.size("paid_years") > 0) & (F.size("years") > 0) & ~F.exists("paid_years", lambda a: F.exists("years", lambda b: F.abs(a - b) <= 1))
    hits = paid.join(links, "name").where(~F.coalesce(clash, F.lit(False)))
    return hits.select("record.list_name", "record.record_key", "txn_id").distinct()
