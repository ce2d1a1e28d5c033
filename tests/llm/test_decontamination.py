"""Operator 12 against brute force, on rows that hold nulls, empty and odd texts, repeats and clashing columns."""

import hashlib
import random
import re

import pytest

from noticeloom.llm import decontamination

DOCS = "doc_id long, text string, key long, pos int, words string, windows string, copies int"
ITEMS = "item_id long, text string, window string, class int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(A_TO_Z))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                found = windows.get(tuple(w[k : k + m]))
                if found:
                    hit.update(range(k, k + m))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def got(spark, docs, items):
    documents = spark.createDataFrame([(i, t, 1, 2, "w", "x", 3) for i, t in docs], DOCS).repartition(3)
    benchmark = spark.createDataFrame([(i, t, "w", 4) for i, t in items], ITEMS)
    found = decontamination.contamination(documents, benchmark).drop("spans").collect()
    return sorted(repr(tuple(r)) for r in found)


@pytest.mark.parametrize("shortest", [1, 2, 10])
def test_against_brute_force(spark, shortest, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 60)
    rng = random.Random(shortest)
    vocabulary = ["a", "b", "Cé", "ß9", "日本", "the", "x", *(f"w{k}" for k in range(60))]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, prose(rng.randint(10, 30))) for k in range(12)] + [(100 + m, prose(m)) for m in range(shortest, 10)] + [(3, prose(15)), (None, prose(14)), (None, None), (50, ""), (51, "?!")]
    items += [(60, items[0][1]), (61, items[0][1].upper() + " end")]
    docs = [(k, f"{prose(rng.randint(0, 40))}; {rng.choice(items[:20])[1]}\n{prose(rng.randint(0, 20))}") for k in range(30)]
    docs += [(k, prose(80)) for k in range(30, 40)] + [(5, None), (None, ""), (None, items[1][1]), (None, items[2][1]), (7, items[1][1]), (7, items[1][1]), (7, items[2][1]), (8, ".,;"), (9, items[4][1] * 50), (10, "Þ\x00a\x1cb")]
    assert got(spark, docs, items) == brute(docs, items)


def test_hot_windows_and_long_text(spark):
    """One passage in every document and every item, and one text of 60,000 words that holds it 500 times."""
    passage = " ".join(f"p{k}" for k in range(25))
    items = [(k, f"i{k} {passage} j{k}") for k in range(300)]
    docs = [(k, f"{k} {passage} tail {k}") for k in range(400)] + [(1000, f"{' '.join('z' * 95)} {passage} " * 500)]
    assert got(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == []
    assert got(spark, [(1, "a b"), (None, None)], []) == brute([(1, "a b"), (None, None)], [])
    spans = decontamination.contamination(spark.createDataFrame([(1, "say one two")], "doc_id long, text string"), spark.createDataFrame([(1, "One, TWO")], "item_id long, text string")).first().spans
    assert [(s.start, s.end) for s in spans] == [(1, 3)]
