"""Operator 2's models: spans against a plain version, recall on planted strings and false finds in ordinary runs."""

import random
import re

from noticeloom.llm import secrets

SCHEMA = "doc_id long, text string"


def trained(spark, rng, words):
    """Labels as the fixed patterns give them: mostly hexadecimal."""
    samples = [("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 40]))), True) for _ in range(600)] + [(w, False) for w in words]
    return secrets.train(spark.createDataFrame(samples, "value string, random boolean"))


def test_spans_recall_and_precision(spark):
    rng = random.Random(21)
    syllables = ["tion", "ment", "the", "and", "lich", "keit", "ra", "se", "os", "er", "in", "Un"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 9)))
    ratios = trained(spark, rng, [word() for _ in range(4000)])
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts, planted = [], 0
    for k in range(300):
        parts = [word() for _ in range(60)]
        for n in (20, 24, 32):
            parts.insert(rng.randrange(len(parts)), "".join(rng.choice(letters) for _ in range(n)))
            planted += 1
        texts.append((k, " ".join(parts)))
    texts += [(400, "short"), (401, "x" * 12), (402, "é" + "aZ9" * 8 + "🙂" + "Qx7" * 5), (403, None), (404, "/" * 5000)]
    index = {c: i for i, c in enumerate(secrets.ALPHABET)}
    score = lambda v: sum(round(ratios[index[a] * len(index) + index[b]], 5) for a, b in zip(v, v[1:]))
    caught = wrong = ordinary = 0
    for r in secrets.find_secrets(spark.createDataFrame(texts, SCHEMA).repartition(4), ratios).collect():
        text = dict(texts)[r.doc_id] or ""
        runs = list(re.finditer(rf"[A-Za-z0-9+/_-]{{{secrets.MARKOV_LEAST},}}", text))
        plain = [(m.start(), m.end()) for m in runs if score(m[0]) >= secrets.THRESHOLD]
        got = [(s.start, s.end) for s in r.found if s.rank == 3]
        assert got == plain, r.doc_id
        if r.doc_id < 300:
            secret = {m.span() for m in runs if not re.fullmatch("(?:" + "|".join(syllables) + ")+", m[0])}
            caught += len(secret & set(got))
            wrong += len(set(got) - secret)
            ordinary += len(runs) - len(secret)
    assert caught >= 0.97 * planted and wrong <= 0.01 * ordinary and ordinary > 100
