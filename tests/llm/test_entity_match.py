from lodesieve.llm.entity_match import match_lists, weak_match


def lists(spark, a, b):
    t = spark.createDataFrame(a, "entity_id string, entity_schema string, name string, aliases array<string>, birth_date string, countries array<string>, confidence int")
    u = spark.createDataFrame(b, "un_id string, record_type string, name string, aliases array<string>, nationalities array<string>, comments string, strict int")
    return t, u


def test_match_namesake_and_unknowns(spark):
    t, u = lists(
        spark,
        [("e1", "Person", "Joseph Peameatberg", None, "1970-01-01", ["ru"], 1), ("e1", "Person", " Joseph Peameatberg", ["Joe Peameatberg"], None, None, 1), ("e2", "Person", "Rafael Vullalino", None, "1950", ["ve"], 1), ("e3", "Company", "Levidor Exchange S.A.", None, None, ["ir"], 1), (None, "Person", "Joseph Peameatberg", None, None, None, 1), ("w", "CryptoWallet", "0xq", None, None, None, 1), ("e5", "Person", None, None, None, None, 1)],
        [("u1", "individual", "PEAMEATBERG, Joe", None, ["Russian Federation"], "Born circa 1970.", 1), ("u2", "individual", "Rafael Vullalino", None, ["Mali"], "Birth year between 1971 and 1973.", 1), ("u3", "entity", "Levidor Exch. Sociedad Anonima", None, ["Iran"], None, 1), ("u4", "individual", None, None, None, None, 1), (None, "individual", "Joseph Peameatberg", None, None, None, 1)],
    )
    got = {(r.entity_id, r.un_id) for r in match_lists(t, u).where("confidence >= 0.5").collect()}
    assert got == {("e1", "u1"), ("e3", "u3")}


def test_empty(spark):
    t, u = lists(spark, [], [])
    assert match_lists(t, u).count() == 0


def test_confidence_separates_on_the_tables(spark, sf):
    from lodesieve.llm.queries import p3_found, p3_matches

    m = p3_matches(spark, sf).toPandas()
    assert len(m) and m.confidence.between(0.5, 1).all() and not m.duplicated(["entity_id", "un_id"]).any()
    assert p3_found(spark, sf).columns == ["entity_id", "un_id"]


def test_weak_labels_abstain():
    import numpy as np

    x = np.array([[1, 1, 1, 1, 0, 1, 0, 1, 0], [0.95, 1, 1, 1, 0, 0, 0, 1, 0], [1, 1, 1, 1, 0, -1, 1, 1, 0], [0, 0.7, 0.5, 0.2, 3, 1, 1, 1, 0]], float)
    assert weak_match(x).tolist() == [1, -1, 0, 0]


def test_countries(spark):
    from lodesieve.llm.countries import bare, country_table, plain

    t = country_table(spark, {"Ruritania": "XR"})
    code = lambda x: t.get(plain(x)) or t.get(bare(x))
    assert [code(x) for x in ("Türkiye", "TUR", "tr", "Islamic Republic of Iran", "Democratic People's Republic of Korea", "Republic of Korea", "The Sudan", "UK", "Deutschland", "Russian Federation", "Ruritania", "Nowhere", "Brasil")] == ["tr", "tr", "tr", "ir", "kp", "kr", "sd", "gb", "de", "ru", "xr", None, "br"]
    assert len(set(t.values())) >= 240


def test_whole_dates(spark):
    from pyspark.sql import functions as F

    from lodesieve.llm.entity_match import full_dates

    rows = spark.createDataFrame([("1965-02-03",), ("DOB 3/2/1965; about",), ("1965",), (None,), ("",)], "t string").select(full_dates(F.col("t")).alias("d")).collect()
    assert [set(r.d) for r in rows] == [{"1965-02-03", "1965-03-02"}, {"1965-02-03", "1965-03-02"}, set(), set(), set()]
