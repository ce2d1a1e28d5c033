"""Operator 6: what a large group makes of rows, and that nothing is lost by it."""

import random

from pyspark.sql import functions as F
from test_near_links import all_pairs, finer, found, holds, variants

from noticeloom.llm import near_dedup


def rare(spark, rows, labels):
    nodes = spark.createDataFrame(rows, "node long, text string")
    return near_dedup.rare_pairs(nodes, spark.createDataFrame(labels, "node long, label long")).collect()


def test_a_family_that_is_joined_makes_no_rows(spark):
    rng = random.Random(21)
    rows = [(c, " ".join(t)) for c, t in enumerate(variants(rng, 60, 5))]
    assert all(not r.few and not r.many for r in rare(spark, rows, [(c, 0) for c, _ in rows]))


def test_a_text_that_is_like_none_makes_no_rows(spark):
    """Texts that share a passage of 30 words of 100: each has more pairs of its own than its edits can take."""
    rng = random.Random(22)
    passage = [f"p{k}" for k in range(30)]
    rows = [(c, " ".join([f"w{rng.randint(0, 10**9)}" for _ in range(35)] + passage + [f"w{rng.randint(0, 10**9)}" for _ in range(35)])) for c in range(40)]
    assert rare(spark, rows, [(c, c) for c, _ in rows]) == []


def test_pairs_of_many_rows_are_not_dealt_out(spark, monkeypatch):
    """Texts of a large group hang together by a row each: their rows grow with their number, not with their words."""
    monkeypatch.setattr(near_dedup, "MIDDLE", 4)
    rng = random.Random(23)
    rows = [(c, " ".join(t)) for c, t in enumerate(variants(rng, 60, 12))]
    nodes = spark.createDataFrame(rows, "node long, text string")
    pairs = near_dedup.rare_pairs(nodes, spark.createDataFrame([(c, c) for c, _ in rows], "node long, label long"))
    assert pairs.where(F.size("many") > 0).count() == 60
    large = near_dedup._families(pairs.where(F.size("many") > 0)).collect()
    assert len(large) == 60 and len({r.bucket for r in large}) == 1


def test_links_by_few_and_by_many(spark, monkeypatch):
    for middle in (1, 3, 16):
        monkeypatch.setattr(near_dedup, "MIDDLE", middle)
        rng = random.Random(24)
        rows = [(g * 1000 + c, " ".join(t)) for g, edits in enumerate((9, 12)) for c, t in enumerate(variants(rng, 40, edits))]
        assert holds(spark, rows)


def test_families_each_by_itself(spark, monkeypatch):
    """Two groups that a few texts tie together: both ways of comparing find the same."""
    rows = [(k, k, k, [g, 9] if k % 30 == 0 else [g]) for g in (1, 2) for k in range(g * 100, g * 100 + 40)]
    frame = spark.createDataFrame(rows, "node long, n long, label long, many array<long>")
    got = near_dedup._families(frame).collect()
    buckets = {}
    for r in got:
        buckets.setdefault(r.bucket, set()).add(r.node)
    for a in rows:
        for b in rows:
            if a[0] < b[0] and set(a[3]) & set(b[3]):
                assert any({a[0], b[0]} <= x for x in buckets.values())


def test_only_wanted_texts_travel(spark):
    nodes = spark.range(20_000).select(F.col("id").alias("node"), F.lit("x").alias("text"))
    wanted = spark.range(0, 20_000, 10).select(F.col("id").alias("node"))
    got = {r.node for r in near_dedup.marked(nodes, wanted).collect()}
    assert got >= set(range(0, 20_000, 10)) and len(got) < 4_000
    assert near_dedup.marked(nodes, wanted.limit(0)).count() == 0
    assert "Exchange hashpartitioning(node" not in near_dedup.marked(nodes, wanted)._jdf.queryExecution().executedPlan().toString()


def test_finer_than_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    rng = random.Random(25)
    rows = [(c, " ".join(t)) for c, t in enumerate(variants(rng, 30, 11))]
    assert finer(found(spark, rows), all_pairs(rows))
