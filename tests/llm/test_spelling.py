"""Operator 13 against brute force."""

import collections
import random
import re
import zlib

import pytest

from noticeloom.llm import spelling

A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    counts = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    out, form = [], {}
    others = {w: [o for o in n if o != w and abs(len(o) - len(w)) < 2 and near(w, o)] for w in n}
    for w in n:
        best = min(others[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return sorted(map(repr, out))


def got(spark, docs):
    frame = spark.createDataFrame([(i, t, "w", 1, "x", 2) for i, t in docs], "doc_id long, text string, word string, n int, form string, block long").repartition(3)
    return sorted(repr(tuple(r)) for r in spelling.spelling_variants(frame).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE_BLOCKS", 5)
    monkeypatch.setattr(spelling, "STEP", 700)
    rng = random.Random(seed)
    stems = ["abcdef", "aabbccdd", "ÀbÉdéfü", "straße×x", "information", "mississippi", "z" * 90, "y" * 63, *("".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(25))]
    words = collections.Counter()
    for s in stems:
        words[s] += rng.choice([5, 30, 200])
        for _ in range(6):
            k, c = rng.randrange(len(s)), rng.choice("abéÿ")
            words[rng.choice([s[:k] + s[k + 1 :], s[:k] + c + s[k:], s[:k] + c + s[k + 1 :], s.upper()])] += rng.choice([1, 5, 6, 40])
    # chains of forms: each word at least five times as frequent as the one before
    for k, w in enumerate(["chainaaaa", "chainbaaa", "chainbbaa", "chainbbba", "chainbbbb"]):
        words[w] += 5**(k + 1)
    bag = [w for w, c in words.items() for _ in range(c)]
    rng.shuffle(bag)
    docs = [(k if k % 7 else None, " ".join(bag[k::40]) + ["", "🙂abcdef1abcdef", " études"][k % 3]) for k in range(40)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (50, None), (None, ""), (51, "12 ,."), (52, "abcdef " * 3000)]
    expected = brute(docs)
    assert got(spark, docs) == expected and sum("None, None" not in r for r in expected) > 5


def test_empty_and_wordless_tables(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "short few")]) == []


def test_filters_hold_every_word():
    """No false negatives, and few false positives, for edits of one length into another."""
    import numpy as np

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(3000)})
    shards = spelling.Shards({7: len(words)})
    lanes = np.zeros((shards.blocks, 8), "uint32")
    hashes = lambda ws: spelling._mixed((spelling._codes(ws, len(ws[0])) * spelling._powers(len(ws[0]))).sum(1, dtype="uint64"))
    mixed = hashes(words)
    for lane in range(8):
        np.bitwise_or.at(lanes[:, lane], shards.block(mixed, 7), (np.uint64(1) << spelling._bits(mixed, lane)).astype("uint32"))

    def held(ws):
        m = hashes(ws)
        return np.all([(lanes[shards.block(m, 7), k] >> spelling._bits(m, k).astype("uint32")) & np.uint32(1) for k in range(8)], axis=0)

    assert held(words).all()
    absent = ["".join(rng.choice("ijklmnop") for _ in range(7)) for _ in range(3000)]
    assert held(absent).sum() < 30
    codes = spelling._codes(["abcabca"], 7)
    edits = {h.tolist()[k]: "abcabca"[: p.tolist()[k]] + (chr(int(c[k])) if c[k] else "") + "abcabca"[p.tolist()[k] + 1 :] for goal, h, w, p, c in spelling._edits(codes, np.array([97, 98, 99], "uint64")) for k in range(len(h))}
    assert all(spelling._mixed(np.array([h], "uint64"))[0] == hashes([e])[0] for h, e in edits.items())
    replaced = sum("abc".index(c) for c in "abcabca")  # by each smaller letter
    assert len(edits) == 7 + replaced
