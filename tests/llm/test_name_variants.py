import pytest

from lodesieve.llm.name_variants import linked_names, payments_of_listed
from lodesieve.llm.names import Vocabulary, compare, parse_name, similarity

KNOWN = Vocabulary({"joseph": 50, "rafael": 50, "tomas": 40, "jong": 60, "song": 60, "sung": 40, "peameatberg": 1, "molaz": 1, "levidor": 2, "keripukix": 1}, {})


def same(a, b):
    return compare(parse_name(a), parse_name(b), KNOWN) > 0


@pytest.mark.parametrize(("typed", "listed"), [
    ("PEAMEATBERG, Joseph", "Joseph Peameatberg"), ("Joe Peàmeatberg", "Joseph Peameatberg"), ("mr J. Peameatberg (salary)", "Joseph Peameatberg"), ("Joseph Peameatbreg", "Joseph Peameatberg"), ("JosephPeameatberg", "Joseph Peameatberg"),
    ("Rafael Molaz", "Rafael Tomás Molaz"), ("Rafael T. Molaz", "Rafael Tomás Molaz"), ("Levidor Nat'l Exch. + Mach. Sociedad Anonima", "Levidor National Exchange & Machinery S.A."), ("Рафаэл Молаз", "Rafael Molaz"), ("J0seph Peameatberg REF 55", "Joseph Peameatberg"),
    ("РАФАЭЛ МОЛАЗ", "Rafael Molaz"), ("ЩЕДРИН РАФАЭЛ", "Shchedrin Rafael"), ("Joseqh Peameatberg", "Joseph Peameatberg"), ("PEAMEATBERG Joesph", "Joseph Peameatberg"), ("Jng Molaz", "Jong Molaz"), ("J0ng MO1AZ", "Jong Molaz"), ("SMolaz", "S. Molaz"),
    ("Joseph Peameatberq", "Joseph Peameatberg"), ("Joseph Pearneatberg", "Joseph Peameatberg"), ("Rafael d. Molaz", "Rafael de Tomas Molaz"), ("Harry Peameatberg", "Harold Peameatberg"), ("Pat Peameatberg", "Patrick Peameatberg"), ("Sasha Peameatberg", "Alexandra Peameatberg"), ("Fafomal-Gedelix Gnl Foundation Ltd.", "Fafomal Gedelix General Foundation Limited"), ("Levidor Trade GmbH", "LEVIDOR TRADING GMBH"),
])
def test_variants_are_one_name(typed, listed):
    assert same(typed, listed)


@pytest.mark.parametrize(("typed", "listed"), [
    ("Rafael Peameatberg", "Joseph Peameatberg"), ("Jong Molaz", "Song Molaz"), ("Joseph Peamont", "Joseph Peameatberg"), ("Levidor Shipping S.A.", "Levidor National Exchange S.A."), ("Keripukix Levidor Exchange S.A.", "Levidor Exchange S.A."), ("Joseph", "Joseph Peameatberg"),
    ("Harry Peameatberg", "Theodore Peameatberg"), ("Song Peameatberg", "Sung Peameatberg"), ("Joseph Peamontberk", "Joseph Peameatberg"),
])
def test_other_names_are_not(typed, listed):
    assert not same(typed, listed)


def test_nothing_to_parse():
    for t in (None, "", "  ", "12345", "(salary)", "李明", "-" * 50_000):
        assert parse_name(t) is None
    assert parse_name("Anna " * 50_000 + "Blixtonen") is not None and parse_name("Anna" + "x" * 50_000) is not None
    assert similarity("a", "anna") < 1


def test_links_and_edges(spark):
    typed = spark.createDataFrame([("Joe Peameatberg",), ("Joe Peameatberg",), (None,), ("",), ("Nobody Else",)], "name string")
    listed = spark.createDataFrame([("Joseph Peameatberg", "r1"), ("Joseph Peameatberg", "r1"), ("Joseph Peameatberg", "r2"), (None, "r3"), ("X", None)], "name string, record string")
    assert {(r.name, r.record) for r in linked_names(typed, listed).collect()} == {("Joe Peameatberg", "r1"), ("Joe Peameatberg", "r2")}
    assert linked_names(typed.limit(0), listed).count() == 0 and linked_names(typed, listed.limit(0)).count() == 0


def test_payments(spark):
    pay = spark.createDataFrame([("t1", "PEAMEATBERG Joseph", "1970-01-01", 1), ("t1", "PEAMEATBERG Joseph", "1970-01-01", 1), ("t2", "Joseph Peameatberg", "1950", 1), (None, "Joseph Peameatberg", None, 1), ("t3", "0xw", None, 1)], "txn_id string, bene_name string, bene_dob string, score int")
    tg = spark.createDataFrame([("e1", "Person", "Joseph Peameatberg", ["Joe P."], "1970-05", 1), ("w", "CryptoWallet", "0xw", None, None, 1), (None, "Person", "Joseph Peameatberg", None, None, 1)], "entity_id string, entity_schema string, name string, aliases array<string>, birth_date string, score int")
    un = spark.createDataFrame([("u1", "Peameatberg, Joseph", None, "Birth year between 1949 and 1951.", 1)], "un_id string, name string, aliases array<string>, comments string, score int")
    got = {tuple(r) for r in payments_of_listed(pay, tg, un).collect()}
    assert got == {("opensanctions", "e1", "t1"), ("un", "u1", "t2")}


def test_blocks_miss_little_against_brute_force(spark, sf):
    from lodesieve.session import table

    t = table(spark, sf, "txn_event").where("bene_name <> ''").select("bene_name").distinct().withColumnRenamed("bene_name", "name")
    from pyspark.sql import functions as F

    r = table(spark, sf, "opensanctions_target").where("entity_schema <> 'CryptoWallet' and entity_id is not null").select(F.col("entity_id").alias("record"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).distinct()
    got = {(x.name, x.record) for x in linked_names(t, r).collect()}
    names = [(x.record, parse_name(x.name)) for x in r.collect()]
    names = [(k, n) for k, n in names if n]
    typed = [(x.name, parse_name(x.name)) for x in t.collect()]
    listed: dict[str, set] = {}
    for k, n in names:
        for tok in n.core:
            listed.setdefault(tok, set()).add(k)
    counts: dict[str, int] = {}
    for key in {n.key: n for _, n in typed if n}.values():
        for tok in set(key.core):
            counts[tok] = counts.get(tok, 0) + 1
    known = Vocabulary({k: len(v) for k, v in listed.items()}, counts)
    want = {(a, k) for a, n in typed if n for k, m in names if n.firm == m.firm and compare(n, m, known) >= 0.8}
    assert len(want - got) <= 0.05 * len(want) and not got - want


def test_long_names_are_names(spark):
    """A text of hundreds of words is blocked and compared like any other name; nothing is cut off."""
    words = [f"{a}{b}{c}" for a in ("bel", "dor", "gan", "kir", "lum", "mos") for b in ("ta", "vi", "so", "ne") for c in ("rak", "del", "min", "zor", "pul")]
    typed = [(" ".join(words[:30]),), (" ".join([words[0], *words[60:], *words[1:60]]),), ("Joe Peameatberg",)]
    listed = [(" ".join(words[:30]), "r30"), (" ".join(words), "r120"), ("Joseph Peameatberg", "r")]
    # every word stands in two lists' names; so none is a usual one
    got = linked_names(spark.createDataFrame(typed, "name string"), spark.createDataFrame(listed, "name string, record string"))
    assert sorted((len(r.name.split()), r.record) for r in got.collect()) == [(2, "r"), (30, "r30"), (120, "r120")]


def test_bounds_come_from_shares():
    from lodesieve.llm.name_variants import surely

    assert [round(surely(0.001, 10**k) / 10**k, 4) for k in (5, 6, 7)] == [0.0012, 0.0011, 0.001] and surely(0.001, 0) == 4
    assert all(surely(0.001, 10 * n) > surely(0.001, n) for n in (1, 100, 10_000))
