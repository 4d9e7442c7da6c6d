import numpy as np
import pytest

from lodesieve.llm.boosting import Boosted
from lodesieve.llm.quality import FEATURES, KINDS, classify, measure, not_prose, weak_kind

PROSE = "The review team asked the bank for originals, and nothing further was found. They compared the papers with care because the account was new. "


def kind(text):
    m = measure(text)
    return KINDS[weak_kind(np.array([m]))[0]]


@pytest.mark.parametrize(("want", "text"), [
    ("prose", PROSE * 3), ("prose", PROSE.upper() * 2), ("prose", "Q: We asked the bank about timber from the port.\nA: A plausible answer was given in 46 of the files that the desk saw.\n"), ("prose", PROSE),
    ("list", "- Maria Vullalino\n- Levidor Metals S.A.\n- Boris Khuskitoff\n* Anna Roruela\n"), ("list", "Name: Boris K\nStatus: open\nCountry: Mali\nRef: R55\n"), ("list", "Boris Khuskitoff ........ 12\nAnna Roruela ...... 7\n"),
    ("table", "ccy;hops;status;\nUSD;2;open;\nEUR;1;review;\nUSD;3;open;\n"), ("table", "<table>\n<tr><td>USD</td><td>2</td></tr>\n<tr><td>EUR</td><td>1</td></tr>\n</table>"), ("table", "| a | b |\n| 1 | 2 |\n| 3 | 4 |\n"),
    ("junk", "9d 2a 90 bd 03 db 9b 80 dd 91 e2 02\n66 99 00 e8 5d fb 9e 60 d6 ae e1 f9\n"), ("junk", "page not found " * 40), ("junk", "2026-01-16T11:51:32Z WARN worker-4 seq=582803 lag=0.87\n" * 5), ("junk", "Home · Menu · Login · Share · Next · Prev · Top · Help · Print · Search"),
    ("junk", "^&*(#@ !*& ^%$ #@! &*() <>?| {}[] ~` +=_ &*(^ %$#@! " * 3), ("junk", "xqzwv bcdfgh klmnpqr stvwxz bcdkl pqrstv xzcvbnm lkjhgf qwrtp zxcvb mnbvc " * 3),
])
def test_kinds(want, text):
    assert kind(text) == want


def test_statistics_are_what_they_say():
    f = dict(zip(FEATURES, measure("One two three.\nfour five\n"), strict=True))
    assert f["n_words"] == 5 and f["punct_line_share"] == 0.5 and f["mean_word_length"] == pytest.approx(21 / 5 - 0.0, abs=0.5)
    assert measure(None) is None and measure(" \n\t") is None
    assert measure("word " * 400_000)[0] == 400_000 and measure("x" * 300_000) is not None


def test_classify_edges(spark):
    rows = [(1, PROSE * 3, "clash"), (2, "", "x"), (3, None, "x"), (4, "a;b;c;\nd;e;f;\n" * 5, "x"), (4, "a;b;c;\nd;e;f;\n" * 5, "x"), (None, PROSE, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, doc_kind string")
    lab = spark.createDataFrame([(1, "prose", 0), (99, "junk", 0), (4, "table", 0), (1, "nonsense", 0), (None, "list", 0)], "doc_id long, doc_kind string, text int")
    got = {r.doc_id: r for r in classify(d, lab).collect()}
    assert got[1].doc_kind == "prose" and got[4].doc_kind == "table" and got[2].doc_kind == got[3].doc_kind == "empty" and got[2].n_words == 0 and got[2].symbol_ratio is None
    assert [tuple(r) for r in not_prose(classify(d, None)).collect()] == [(4, "table")]
    assert classify(d.limit(0), lab.limit(0)).count() == 0


def test_held_out_labels(spark, sf):
    from lodesieve.session import table

    sf = sf.replace("sf0.001", "sf0.01")
    got = classify(table(spark, sf, "documents"), None).select("doc_id", "doc_kind")
    lab = table(spark, sf, "doc_labels").withColumnRenamed("doc_kind", "by_hand")
    r = got.join(lab, "doc_id").selectExpr("avg(cast(doc_kind = by_hand as double))").first()[0]
    assert r >= 0.85


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    x[::50, 2] = np.nan
    m = Boosted(2, rounds=30, depth=3).fit(x[:600], y[:600]).calibrate(x[600:750], y[600:750])
    p = m.probabilities(x[750:])
    assert (p.argmax(1) == y[750:]).mean() > 0.93 and np.allclose(p.sum(1), 1)
    assert m.probabilities(x[:0]).shape == (0, 2)


NAV = "home menu login share search sitemap contact help print next"


@pytest.mark.parametrize("at", range(14))
def test_navigation_is_seen_wherever_it_stands(at):
    words = (f"orchard {NAV} harbour timber".split() * 2)[at : at + 13]
    f = dict(zip(FEATURES, measure(" ".join(words)), strict=True))
    assert f["junk_share"] == 1


def test_encoded_noise_is_seen_beside_words():
    noise = "".join(chr(97 + i * 7 % 26) + str(i % 10) for i in range(50))
    for text in (noise + " it is on a to of in by at", "it is on a to of in by at " + noise, f"it is on a {noise} to of in by at"):
        f = dict(zip(FEATURES, measure(text), strict=True))
        assert f["junk_share"] == 1, text


def test_damaged_letters_are_counted_however_few():
    clean = "The review team asked the bank for originals and nothing further was found in the papers that were sent to the office by the older clerk "
    f = dict(zip(FEATURES, measure(clean * 2 + "caf\u00c3\u00a9"), strict=True))
    assert f["spoilt_share"] > 0 and dict(zip(FEATURES, measure(clean * 2), strict=True))["spoilt_share"] == 0
