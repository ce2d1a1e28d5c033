"""Operator 2 on texts with very many matches: positions as Python finds them, in time that grows with the text."""

import random
import re
import time

from noticeloom.llm import secrets


def test_many_matches_in_one_text(spark):
    rng = random.Random(33)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    piece = lambda: rng.choice([pick("0123456789abcdef", rng.randint(14, 40)), "Token: '" + pick("xyzXYZ_.=", rng.randint(8, 20)), "AKIA" + pick("QZ79", rng.randint(12, 20)), "é🙂 ſecret=K", pick("abc", 5)])
    texts = [" ".join(piece() for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 9, 2_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    began = time.time()
    got = {r.doc_id: [(s.start, s.rank, s.end, s.value) for s in r.found] for r in secrets.find_secrets(rows, [-1.0] * len(secrets.ALPHABET) ** 2).collect()}
    assert time.time() - began < 60  # 400 matches took 20 s, and the time grew by more than their square
    for k, text in enumerate(texts):
        plain = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(secrets.ASSIGN, text, re.A) if len(m[2]) >= secrets.ASSIGN_LEAST]
        plain += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= secrets.ACCESS_LEAST]
        plain += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(secrets.HEX, text) if len(m[0]) >= secrets.HEX_LEAST]
        assert got[k] == sorted(plain), k
