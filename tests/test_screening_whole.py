from lodesieve.plans import screening_queries as Q

TARGET = "id long, entity_id string, entity_schema string, name string, aliases array<string>, birth_date string, countries array<string>, identifiers array<string>, sanctions string, created_at long"


def tables(spark, folder, targets, queries):
    spark.createDataFrame([(i, k, "Person", n, a, b, None, None, None, 1) for i, (k, n, a, b) in enumerate(targets)], TARGET).write.parquet(f"{folder}/opensanctions_target.parquet")
    spark.createDataFrame([(i, k, n, c, 1) for i, (k, n, c) in enumerate(queries)], "id long, un_id string, name string, comments string, created_at long").write.parquet(f"{folder}/un_entity.parquet")
    return str(folder)


def test_best_candidate_behind_entities_with_many_aliases(spark, tmp_path):
    crowd = [(f"c{i:02d}", f"Ali Omar Wq{'x' * (i + 3)}", [f"Ali Omar Zk{'v' * (i + 3)}", "Omar Ali Trust Bank Fund"], None) for i in range(40)]
    sf = tables(spark, tmp_path, [*crowd, ("right", "Ali Omar Blixtonen", None, None)], [("q", "Ali Omar Blixtonnen", None)])
    got = Q.fallback_screening(spark, sf).collect()
    assert [(r.query_id, r.entity_id, r.verdict) for r in got] == [("q", "right", "MATCH")]
    for f in (Q.best_variants, Q.pair_features, Q.token_ratios):
        assert f(spark, sf).count() == 41


def test_fallback_reads_births(spark, tmp_path):
    said = {"a": "Born 1941-05-04 according to passport.", "b": "Birth year between 1938 and 1942.", "c": "Born circa 1942.", "d": "Born 1999-01-01.", "e": None, "f": "DOB 04/05/1999;", "g": "Listed in 1999."}
    sf = tables(spark, tmp_path, [("e1", "Joseph Peameatberg", None, "1941-05-04;1950")], [(k, "Joseph Peameatberg", c) for k, c in said.items()])
    got = {r.query_id: r.verdict for r in Q.fallback_screening(spark, sf).collect()}
    assert got == {k: "REVIEW" if k in "df" else "MATCH" for k in said}
