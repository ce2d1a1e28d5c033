"""Results that don't depend on the order of rows, on block borders or on how often something repeats."""

import random

from noticeloom.llm import mixing, quality, secrets, suffix_family, token_files

DOCS = "doc_id long, text string, lang string, source string"


def test_mixing_of_rows_that_share_an_id(spark):
    rows = [(7, f"{'w ' * k}x{k}", "en", "src1") for k in range(1, 30)] + [(None, f"{'v ' * k}y{k}", "en", "src1") for k in range(1, 30)]
    found = []
    for seed in range(3):
        given = random.Random(seed).sample(rows, len(rows))
        taken = mixing.mixed(spark.createDataFrame(given, DOCS), keep=("text",)).select("doc_id", "kept.text", "taken_tokens").collect()
        found.append(sorted(map(repr, map(tuple, taken))))
    assert found[0] == found[1] == found[2]


def test_words_at_block_borders(monkeypatch):
    text = " ".join(f"word{k}é" for k in range(400)) + " " + "z" * 300 + "\x1cend"
    whole = quality.indicators(text)
    for size in (1, 7, 64):
        monkeypatch.setattr(quality, "BLOCK_CHARS", size)
        assert quality.indicators(text) == whole


def test_fit_is_dual_coordinate_descent():
    """The weights against a plain version that keeps every multiplier and adds the examples up."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, 12) + 30 * (k % 2)) for k in range(60)]
    labels = np.array([k % 2 for k in range(60)])
    ratio, weights, bias, _, _ = quality._fit(rows, labels)
    present = {f: sum(f in r for r in map(set, rows)) for r in rows for f in r}
    share = lambda y: {f: 1 + sum(f in set(r) for r, l in zip(rows, labels) if l == y) for f in range(quality.DIMENSIONS) if f in present}
    good, bad = share(1), share(0)
    totals = [quality.DIMENSIONS + sum(v - 1 for v in c.values()) for c in (bad, good)]
    plain = {f: (np.log(good[f] / totals[1]) - np.log(bad[f] / totals[0])) if present[f] >= quality.LEAST_ROWS else 0.0 for f in present}
    assert all(abs(ratio[f] - plain[f]) < 1e-9 for f in present)
    examples = []
    for r in rows:
        x = {f: plain[f] for f in r.tolist() if plain[f]}
        size = max(1.0, sum(v * v for v in x.values()) ** 0.5)
        examples.append({f: v / size for f, v in x.items()})
    alpha, order = [0.0] * 60, np.random.default_rng(quality.SEED)
    sign = [1.0 if y else -1.0 for y in labels]
    for _ in range(quality.EPOCHS):
        for i in order.permutation(60):
            w = {}
            for a, s, x in zip(alpha, sign, examples):
                for f, v in x.items():
                    w[f] = w.get(f, 0.0) + a * s * v
            b = sum(a * s for a, s in zip(alpha, sign))
            gradient = sign[i] * (sum(w.get(f, 0.0) * v for f, v in examples[i].items()) + b) - 1
            alpha[i] = min(max(alpha[i] - gradient / (sum(v * v for v in examples[i].values()) + 1), 0.0), quality.COST)
    assert abs(sum(a * s for a, s in zip(alpha, sign)) - bias) < 1e-6
    assert all(abs(weights[f] - sum(a * s * x.get(f, 0.0) for a, s, x in zip(alpha, sign, examples))) < 1e-6 for f in present)


def test_secret_samples_count_equal_rows_once(spark):
    rows = [(1, "token=abcdefghijkl1234"), (1, "token=abcdefghijkl1234"), (2, "ordinary identifiers only"), (None, None)]
    found = sorted(map(tuple, secrets.labelled_samples(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == [("abcdefghijkl1234", True), ("identifiers", False), ("ordinary", False)]


def test_token_files_of_repeated_and_missing_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PIECES", 10)
    rows = [(5, "b text"), (5, "a text " * 40), (5, "b text"), (None, "none"), (2, "first")]
    folder = str(tmp_path / "ids")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    got = sorted((r.start, r.doc_id, len(r.ids) // 4) for r in token_files.read_token_files(spark, folder).collect())
    assert [g[1] for g in got] == [None, 2, 5, 5, 5]
    assert [g[0] for g in got] == [0, *(sum(x[2] for x in got[: k + 1]) for k in range(4))]


def test_a_hot_passage(spark):
    """One passage in 10,000 documents and one line in ever new contexts; the line's suffixes are compared over the cluster."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage, line = " ".join(word() for _ in range(12)), "a line that comes with all others: "
    rows = [(k, f"{word()} {passage} {word()} {line}{word()} {word()}") for k in range(10_000)]
    before = suffix_family.TOGETHER
    suffix_family.TOGETHER = 500
    try:
        got = {r.doc_id: r for r in suffix_family.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 8, 1 << 18).collect()}
    finally:
        suffix_family.TOGETHER = before
    first, expected = {}, {}
    for k, t in rows:
        gone = [0] * len(t)
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], k) != k:
                gone[p : p + 50] = [1] * 50
        expected[k] = sum(gone)
    assert {k: r.n_removed for k, r in got.items()} == expected and sum(expected.values()) > 9_000 * len(passage)
