from lodesieve.llm.name_variants import linked_names


def coined(i):
    return "".join("bdgklmnprtvz"[i * 7919 // 12**k % 12] + "aeiua"[k] for k in range(5))


def test_same_slip_is_found_however_many_names_are_typed(spark):
    listed = [(f"Kasandra {coined(i)}", f"r{i}") for i in range(20)]
    slips = [(f"Kasamdra {coined(i)}",) for i in range(5)]
    others = [(f"{coined(1000 + 3 * i)} {coined(20_000 + 7 * i)}",) for i in range(4000)]
    got = linked_names(spark.createDataFrame(slips + others, "name string"), spark.createDataFrame(listed, "name string, record string"))
    assert {(r.name, r.record) for r in got.where("name like 'Kasamdra%'").collect()} == {(f"Kasamdra {coined(i)}", f"r{i}") for i in range(5)}
