"""Many terms at once, the inverted index of terms, and rebuilt translations."""

import random

from pyspark.sql import functions as F

from noticeloom.functions import terms
from noticeloom.functions import text as X
from noticeloom.operators import rules as R
from noticeloom.operators import translate as L


def test_longest_from_the_left():
    found = lambda text, *ts: [text[a:b] for a, b, _ in terms.occurrences(text, ts)]
    assert found("abcdabx", "ab", "abcd", "bcdab", "cd") == ["abcd", "ab"]
    assert found("aaaa", "aa", "") == ["aa", "aa"] and found("xyz", "q") == [] and found("xyz") == [] and found("", "a") == []


def test_ten_thousand_terms_in_one_pass(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(5, 9))) for _ in range(14_000)})[:10_000]
    entries = [(w, words[(k * 7) % len(words)]) for k, w in enumerate(words)]  # targets hold sources
    texts = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(40)] + ["", None, words[3], words[3] * 3]

    def plain(text):
        by, out, at = dict(entries), "", 0
        while at < len(text):
            size = next((n for n in range(9, 4, -1) if text[at : at + n] in by), 0)
            out, at = out + (f" {by[text[at : at + size]]} " if size else text[at]), at + (size or 1)
        return " ".join(out.split())

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: (r.once, r.any) for r in rows.select("i", L.glossary_fold(F.col("t"), entries, rescan=False).alias("once"), X.any_term(F.col("t"), words).alias("any")).collect()}
    for i, t in enumerate(texts):
        expected = (None, None) if t is None else (plain(t), any(w in t.replace(" ", "") for w in words))
        assert got[i] == expected, t


def test_cascade_of_many_terms_is_that_of_few(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    rules = [(f"v{k % 3}", [word(6) for _ in range(30)]) for k in range(4)]
    rows = spark.createDataFrame([(k, word(rng.randint(0, 120))) for k in range(60)] + [(60, None), (61, "")], "i int, t string")
    many = rows.select("i", R.cascade(F.col("t"), rules, "none").alias("v")).collect()
    monkeypatch.setattr(X, "FEW_TERMS", 1000)
    assert sorted(many) == sorted(rows.select("i", R.cascade(F.col("t"), rules, "none").alias("v")).collect()) and len({r.v for r in many}) > 2


def test_term_index_finds_what_searching_finds(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdeé日🙂") for _ in range(n))
    given = [word(rng.randint(1, 7)) for _ in range(5_000)] + ["A b C", None, "", " ", "abc", "abc"]
    texts = [(k, word(rng.randint(0, 80))) for k in range(50)] + [(50, None), (51, ""), (51, "xabcx"), (51, "xabcx")]
    rows = spark.createDataFrame(texts, "key int, text string")
    table = spark.createDataFrame([(t,) for t in given], "term string")
    norm = lambda t: t.replace(" ", "").lower()
    expected = sorted((k, t) for k, text in texts if text for t in {t for t in given if t and norm(t)} if norm(t) in norm(text))
    found = R.term_hits(rows, "key", "text", table)
    assert sorted(map(tuple, found.collect())) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(R, "BLOCK_TERMS", 700)
    assert sorted(map(tuple, R.term_hits(rows, "key", "text", table).collect())) == expected
    assert R.term_hits(rows, "key", "text", table.limit(0)).count() == 0


SYLLABLES = [("省", "sheng"), ("设", "she"), ("备", "bei"), ("采", "cai"), ("购", "gou"), ("购", "gou")]


def test_leftovers_are_rebuilt_in_place(spark):
    table = spark.createDataFrame(SYLLABLES, "char string, syllable string")
    texts = ["设备采购A设,备备采", "no script\n", "", None, "设备采购A设,备备采", "新设 备", "设" * 5]
    rows = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "i int, t string, at string")
    got = {r.i: (r.romanized, r["at"]) for r in L.romanized(rows, "t", table).collect()}
    assert [got[k] for k in range(7)] == [(t, "kept") for t in ["SheBei CaiGouAShe,BeiBei Cai", "no script\n", "", None, "SheBei CaiGouAShe,BeiBei Cai", "新She Bei", "SheShe SheShe She"]]


def test_regions_and_translations_leave_no_script(spark):
    table = spark.createDataFrame(SYLLABLES, "char string, syllable string")
    rows = spark.createDataFrame([(1, "陕西省设备"), (2, "陕西设备"), (3, "采购"), (4, ""), (5, None)], "i int, t string")
    region = {r.i: r.t_translated for r in L.region_rows(rows, "t", [("陕西", "Shaanxi")], ["省", "市", ""], table).collect()}
    assert region == {1: "ShaanxiSheBei", 2: "ShaanxiSheBei", 3: "CaiGou", 4: "", 5: None}
    done = {r.i: (r.t_translated, r.t_ok) for r in L.translate_rows(rows, "t", [], [("陕西", "Shaanxi"), ("采购", "buying")], table).collect()}
    assert done == {1: ("Shaanxi ShengShe Bei", False), 2: ("Shaanxi SheBei", False), 3: ("buying", True), 4: ("", True), 5: (None, None)}
