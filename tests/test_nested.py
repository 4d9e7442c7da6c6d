import json

from pyspark.sql import functions as F

from lodesieve.operators import nested as N


def paths(spark, texts, repeated=("items",)):
    df = spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(texts)], "k string, j string, item_path string")
    plan = N.plan_tables(N.schema_graph(df, "j", "j"), "j", repeated)
    return sorted((r.record_key, r.parent_path, r.item_path) for r in N.list_items(N.shred(df, "k", "j", plan, with_fields=False), plan).collect())


def test_paths_parents_nulls_and_quoted_json(spark):
    doc = {"a": {"items": [{"x": 1, "deep": [[{"y": 2}]]}, None, {"items": {"z": 3}}]}}
    assert paths(spark, [json.dumps(doc)]) == [
        ("0", "", "j.a.items[0]"),
        ("0", "", "j.a.items[2]"),
        ("0", "j.a.items[0]", "j.a.items[0].deep[0][0]"),
        ("0", "j.a.items[2]", "j.a.items[2].items[0]"),
    ]
    assert paths(spark, [json.dumps(json.dumps({"a": json.dumps([{"q": 1}])}))]) == [("0", "", "j.a[0]")]


def test_invalid_null_and_empty(spark):
    assert paths(spark, [None, "", "{", '{"items": [{"x": NaN}]}', "5", '"5"', "[]", '{"items": []}', "[" * 100_000]) == []


def test_empty_table(spark):
    assert paths(spark, []) == []


def test_tables_keep_links_and_inline_singletons(spark):
    doc = {"id": "r", "who": {"name": "n", "id": 7}, "items": [{"x": 1, "sub": {"y": 2}}, {"x": None}]}
    df = spark.createDataFrame([("1", json.dumps(doc))], "k string, j string")
    plan = N.plan_tables(N.schema_graph(df, "j", "j"), "j")
    rows = N.shred(df, "k", "j", plan)
    root = N.child_table(rows, "j", plan).collect()[0]
    assert (root.id, root.who_name, root.who_id) == ("r", "n", "7")
    items = {r.item_path: r for r in N.child_table(rows, "items", plan).collect()}
    assert items["j.items[0]"].sub_y == "2" and items["j.items[0]"].parent_path == "j" and items["j.items[1]"].x is None


def test_shared_and_recursive_elements_get_tables(spark):
    doc = {"a": {"who": {"n": 1}}, "b": {"who": {"n": 2}}, "tree": {"v": 1, "tree": {"v": 2}}}
    df = spark.createDataFrame([("1", json.dumps(doc))], "k string, j string")
    plan = N.plan_tables(N.schema_graph(df, "j", "j"), "j")
    assert {"who", "tree"} <= plan.own_table and "a" not in plan.own_table
    rows = N.shred(df, "k", "j", plan)
    assert {(r.item_path, r.parent_path) for r in rows.where("relation = 'tree'").collect()} == {("j.tree", "j"), ("j.tree.tree", "j.tree")}


def test_typed_columns(spark):
    df = spark.createDataFrame([("1", 0)], "k string, z int").select("k", F.array(F.struct(F.lit(1).alias("a"), F.array(F.struct(F.lit(2).alias("b"))).alias("c")), F.lit(None)).alias("p"))
    assert sorted(tuple(r) for r in N.shred_typed(df, "k", "p").collect()) == [("1", "p[0]", ""), ("1", "p[0].c[0]", "p[0]")]


def test_the_schema_graph_decides(spark):
    """An element that is a list in some record gets a table though nobody named it; where it stands alone it is a row of
    that table and no list element. Without a plan there are no tables."""
    texts = [json.dumps({"parts": [{"a": 1}]}), json.dumps({"parts": {"a": 2}, "once": {"b": 1}})]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, j string")
    plan = N.plan_tables(N.schema_graph(df, "j", "j"), "j", ("items",))
    assert plan.repeated == {"parts"} and "once" not in plan.own_table
    rows = N.shred(df, "k", "j", plan)
    assert sorted((r.record_key, r.item_path, r.a) for r in N.child_table(rows, "parts", plan).collect()) == [("0", "j.parts[0]", "1"), ("1", "j.parts", "2")]
    assert [(r.record_key, r.item_path, r.parent_path) for r in N.list_items(rows, plan).collect()] == [("0", "j.parts[0]", "")]
    assert N.list_items(N.shred(df, "k", "j", N.TablePlan()), N.TablePlan()).count() == 0


def test_foreign_keys_lead_to_rows(spark):
    doc = {"a": {"items": [{"x": 1, "who": {"n": 1}, "items": [{"x": 2}]}]}, "b": {"who": {"n": 2}}}
    df = spark.createDataFrame([("1", json.dumps(doc))], "k string, j string")
    plan = N.plan_tables(N.schema_graph(df, "j", "j"), "j")
    rows = N.shred(df, "k", "j", plan).collect()
    paths = {r.item_path for r in rows}
    assert {r.parent_path for r in rows} - {""} <= paths and {r.relation for r in rows} == {"j", "items", "who"}
