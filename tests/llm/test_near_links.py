"""Operator 6 against every pair that shares a sketch, in buckets that are too large for a leader and its followers."""

import hashlib
import itertools
import random
from collections import defaultdict

from noticeloom.llm import near_dedup

SCHEMA = "doc_id long, text string"


def classes(spark, rows):
    """The least id of each text's class, from all pairs of texts that share a sketch of the first length."""
    buckets, root = defaultdict(list), {i: i for i, _ in rows}
    for r in near_dedup.sketches(spark.createDataFrame(rows, "node long, text string"), near_dedup.KMERS[0]).collect():
        buckets[r.bucket].append(r.node)
    pairs = sorted({p for b in buckets.values() for p in itertools.combinations(sorted(b), 2)})
    texts = {i: t.lower().split() for i, t in rows}
    for (a, b), ok in zip(pairs, near_dedup.similar([(texts[a], texts[b]) for a, b in pairs])):
        if ok and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root, max(map(len, buckets.values()))


def found(spark, rows):
    return {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def all_pairs(rows):
    """The least id of each text's class, from all pairs."""
    texts, root = {i: t.lower().split() for i, t in rows}, {i: i for i, _ in rows}
    pairs = list(itertools.combinations([i for i, _ in rows], 2))
    for (a, b), ok in zip(pairs, near_dedup.similar([(texts[a], texts[b]) for a, b in pairs])):
        if ok and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def finer(one, other):
    """Whether each class of one lies in a class of the other."""
    return len({(one[i], other[i]) for i in one}) == len(set(one.values()))


def holds(spark, rows):
    """No link of texts that share a sketch is lost, and each link found is one: texts that meet by rare word pairs alone may be joined too."""
    expected, got = classes(spark, rows)[0], found(spark, rows)
    return finer(expected, got) and finer(got, all_pairs(rows))


def variants(rng, n, edits):
    """n texts of 100 words, each with so many scattered edits of its own."""
    base, out = [f"w{rng.randint(0, 10**6)}" for _ in range(100)], []
    for c in range(n):
        copy = list(base)
        for at in rng.sample(range(100), edits):
            copy[at] = f"x{c}y{at}"
        out.append(copy)
    return out


def test_large_families_of_edited_copies(spark):
    """Pairwise similarity about 0.75 to 0.85: most pairs do not agree on longer sketches."""
    rng = random.Random(12)
    rows = [(g * 1000 + c, " ".join(t)) for g, edits in enumerate((11, 12, 13)) for c, t in enumerate(variants(rng, 140, edits))]
    expected, largest = classes(spark, rows)
    assert largest > 2 * near_dedup.SMALL and 4 < len(set(expected.values())) < len(rows)
    assert holds(spark, rows)


def test_blocks_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "MIDDLE", 4)
    rng = random.Random(13)
    rows = [(c, " ".join(t)) for c, t in enumerate(variants(rng, 120, 12))]
    assert holds(spark, rows)


def test_followers_of_different_leaders(spark, monkeypatch):
    """A leads M, B leads X, and only M and X link the two."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "KMERS", (2,))
    rng, rows = random.Random(14), []
    for k in range(60):
        m = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
        x = list(m)
        for at in rng.sample(range(92), 19):
            x[at] = f"s{k}y{at}"
        rows += [(4 * k + n, " ".join(t)) for n, t in enumerate((m[:96] + ["a1", "a2"] + m[98:], x[:94] + ["b1", "b2"] + x[96:], m, x))]
    assert holds(spark, rows)


def test_recall_of_scattered_edits(spark):
    """500 pairs of 100 words with 5 to 20 substitutions each: nine of ten pairs that are similar are found, and no other."""
    rng, rows = random.Random(15), []
    for k in range(500):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
        copy = list(base)
        for at in rng.sample(range(100), 5 + k % 16):
            copy[at] = f"x{k}y{at}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = found(spark, rows)
    assert {got[2 * k] for k in range(500)} == {2 * k for k in range(500)}
    assert sum(got[2 * k + 1] == 2 * k for k in range(500)) >= 450


def test_texts_that_share_an_id_are_classed_each_by_itself(spark):
    """Of one doc_id's texts the copy goes and the other stays; rows without doc_id take part."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c = prose(60), prose(60), prose(60)
    changed = lambda t: t.replace(t.split()[30], "changed", 1)
    rows = [(1, a), (2, changed(a)), (2, b), (None, changed(b)), (None, c), (5, changed(c)), (None, "lone"), (2, b), (7, ""), (None, None)]
    for order in range(3):
        given = random.Random(order).sample(rows, len(rows))
        got = near_dedup.near_duplicates(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
        by = {(r.doc_id, r.text_sha256): (r.class_id, r.class_size, r.kept) for r in got}
        key = lambda i, t: (i, hashlib.sha256((t or "").encode()).hexdigest())
        assert len(got) == len(rows)
        assert by[key(1, a)] == (1, 2, True) and by[key(2, changed(a))] == (1, 2, False)
        assert by[key(2, b)] == (2, 3, True) and by[key(None, changed(b))] == (2, 3, False)
        assert by[key(5, changed(c))] == (5, 2, True) and by[key(None, c)] == (5, 2, False)
        assert by[key(None, "lone")] == (None, 1, True) and by[key(7, "")] == (7, 2, True) and by[key(None, "")] == (7, 2, False)


def test_sketches_recall_by_edit_rate():
    """Of 300 pairs with scattered substitutions nine of ten share a sketch, at any rate of edits up to the rule's and any length."""
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (50, 100, 300):
        for rate in (0.10, 0.12, 0.15, 0.18, 0.20):
            met = 0
            for _ in range(300):
                a = rng.integers(0, 1 << 40, n)
                b = a.copy()
                at = rng.choice(n, int(n * rate), replace=False)
                b[at] = rng.integers(1 << 41, 1 << 42, len(at))
                met += len(np.intersect1d(near_dedup.sketch(a), near_dedup.sketch(b))) > 0
            assert met >= 270, (n, rate, met)
