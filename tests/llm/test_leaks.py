import random

import numpy as np

from lodesieve.llm.leaks import LeakParams, has_passage, leaked_items, size_classes
from lodesieve.llm.wordnorm import plain_words

ITEM = "via some bearer programme ninety one perishable warranties reach quartz archipelago once licences rotate weekly whose exposure least explains a prompt escalation"
CLAUSE = "by opening the attached file the reader agrees to keep its content for no longer than the retention period and to destroy every copy"
FILL = "the desk asked for originals and nothing further was found in the harbour office while the second file was open "


def found(spark, docs, items, p=None):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, item_id long, found string")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    return {tuple(r) for r in leaked_items(d, q, p).collect()}


def test_passages_in_any_writing(spark):
    w = ITEM.split()
    changed = [*w[:5], "other", *w[6:12], "words", *w[13:]]
    docs = [
        (1, FILL + ITEM + FILL), (2, FILL + " ".join(w[:15])), (3, " ".join(w[:14]) + " " + FILL), (4, FILL + " ".join(changed[:15]) + " " + FILL), (5, ITEM.upper().replace(" ", ",\n")), (6, ITEM.replace("a", "а").replace("e", "е")),
        (7, "<p>" + " ".join(f"<b>{x}</b>" for x in w) + "</p>"), (8, " ".join(f"({i}) {x}" if i % 6 == 0 else x for i, x in enumerate(w))), (9, FILL * 300 + ITEM), (10, None), (11, ""), (12, FILL), (13, ITEM), (13, ITEM), (None, ITEM), (14, " ".join(reversed(w))),
    ]
    got = found(spark, docs, [(7, ITEM), (7, ITEM), (8, "too short an item"), (None, ITEM), (9, None)])
    assert got == {(i, 7) for i in (1, 2, 4, 5, 6, 7, 8, 9, 13)}


def test_clauses_are_left_aside_but_copies_of_a_leak_are_not(spark):
    docs = [(i, f"{FILL} {i} {CLAUSE} note {i * 7}") for i in range(40)] + [(100 + i, ITEM) for i in range(30)] + [(200, ITEM + " end")]
    got = found(spark, docs, [(1, CLAUSE + " " + ITEM), (2, CLAUSE)])
    assert got == {(100 + i, 1) for i in range(30)} | {(200, 1)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM)]) == set() and found(spark, [(1, ITEM)], []) == set()


def test_the_size_of_the_table_changes_no_row(spark):
    """The bound on what is broadcast decides work, never results: a table so small that most triples hit it by chance
    gives the rows of the exact one, and clauses are counted over all items."""
    items = [(i, f"{ITEM} number{i} suffix{i} tail{i} last{i} word{i} more{i} any{i} each{i} one{i} two{i} three{i} four{i} five{i} six{i} seven{i}") for i in range(6)]
    items += [(10, f"{CLAUSE} {FILL} ten"), (11, f"{FILL} eleven {CLAUSE}")]
    docs = [(1, items[5][1]), (2, FILL), (3, f"{FILL} three {ITEM}")] + [(20 + i, f"note {i} {CLAUSE} and {i * 3} again") for i in range(40)]
    want = found(spark, docs, items)
    assert {(1, 5), (3, 0), (3, 5)} <= want and not any(d >= 20 for d, _ in want)
    assert found(spark, docs, items, LeakParams(filter_bits=1 << 16)) == want == found(spark, docs, items, LeakParams(filter_bits=1 << 7))


def test_size_classes_differ():
    got = size_classes(LeakParams())
    assert len({rows for _, rows, _ in got}) == 3 and all(r * b <= LeakParams().hashes for _, r, b in got)


def test_against_brute_force(spark):
    """Windows of the items, as written and with up to two words changed, in texts of every length."""
    rng = random.Random(3)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    items = [(i, [rng.choice(words) for _ in range(60)]) for i in range(12)]
    docs, want = [], set()
    for d in range(240):
        i, n = rng.randrange(12), rng.choice([8, 11, 15, 16, 22, 40])
        at = rng.randrange(60 - n)
        part = items[i][1][at : at + n]
        changed = rng.choice([0, 0, 1, 2]) if n >= 15 else 0
        for k in rng.sample(range(1, n - 1), changed):
            part[k] = "other"
        docs.append((d, " ".join([*(rng.choice(words) for _ in range(rng.randrange(30))), *part, *(rng.choice(words) for _ in range(rng.randrange(30)))])))
        if n >= 15:
            want.add((d, i))
    assert found(spark, docs, [(i, " ".join(w)) for i, w in items], LeakParams(clause_share=1, own_clause_share=1)) == want


def test_passage_rule():
    p = LeakParams()
    f = np.ones(20, bool)
    assert has_passage(f, None, p)
    f[[3, 8, 12, 17]] = False
    assert not has_passage(f, None, p)
    use = np.ones(20, bool)
    use[10] = False
    assert not has_passage(np.ones(20, bool), use, p)


def test_words():
    assert plain_words("Стаtes <b>won</b>’t 1,234.5 co-\noperate (3) ﬁne &amp; ok") [-5:] == ["t", "12345", "cooperate", "fine", "ok"]
    assert plain_words(None) == []
