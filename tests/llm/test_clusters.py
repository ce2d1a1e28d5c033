"""Operator 11 against a plain version in Python's whole numbers."""

import hashlib
import math
import random

import pytest

from noticeloom.llm import drift_clusters

SCHEMA = "vec_id long, embedding array<double>, cluster int, v string, distance int, label int"


def brute(rows):
    kept = [(i, tuple(math.floor(64 * x) for x in e)) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    centroids = [v for _, v in sorted((digest(f"1:{i}"), v) for i, v in kept if i is not None)[:16]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m)), c) for c, m in enumerate(centroids))
    for _ in range(3):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(own[c]) for x in zip(*own[c])) if c in own else m for c, m in enumerate(centroids)]
    last = [(i, *nearest(v)) for i, v in kept]
    of = lambda c: sum(d for _, d, k in last if k == c)
    cap = lambda x: min(x, (1 << 63) - 1)
    total = sum(d for _, d, _ in last)
    return sorted(repr((i, c, cap(d), cap(of(c)), cap(total), digest(",".join(map(str, centroids[c]))))) for i, d, c in last)


def got(spark, rows):
    frame = spark.createDataFrame([(i, e, 1, "v", 2, 3) for i, e in rows], SCHEMA).repartition(3)
    return sorted(repr(tuple(r)) for r in drift_clusters.clusters(frame).drop("scanned").collect())


def vectors(rng, n, spread=0.3, blobs=12):
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(blobs)]
    return [(k, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.5, 2.0])
def test_against_a_plain_version(spark, spread):
    rows = vectors(random.Random(3), 700, spread)
    rows += [(None, rows[5][1]), (3, rows[9][1]), (3, rows[9][1]), (900, None), (901, [0.1] * 63), (902, [0.1] * 65), (903, [None] * 64), (904, [float("nan")] * 64), (905, [float("inf")] * 64), (906, [])]
    assert got(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rng = random.Random(8)
    rows = [(k, [rng.choice([0.0, 1 / 64, 2 / 64]) if j < 3 else 0.0 for j in range(64)]) for k in range(400)]
    assert got(spark, rows) == brute(rows)


def test_sizes_that_doubles_do_not_hold(spark):
    rng = random.Random(9)
    rows = [(k, [rng.choice([1e5, -3.7e9, 1e17, 2.5e30, -0.01]) for _ in range(64)]) for k in range(60)]
    assert got(spark, rows) == brute(rows)


def test_few_or_no_vectors(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, [1.0])]) == []
    few = vectors(random.Random(1), 5)
    assert got(spark, few) == brute(few)
    one = [(7, [0.5] * 64)] * 3
    assert got(spark, one) == brute(one)


def test_bounds_spare_scans_and_are_bounds(spark):
    rng = random.Random(4)
    rows = vectors(rng, 2000, 0.1, 16)
    frame = spark.createDataFrame([(i, e, 1, "v", 2, 3) for i, e in rows], SCHEMA)
    assert drift_clusters.clusters(frame).where("scanned").count() < 400
    for _ in range(200):
        dims = 64
        a, p, q = ([rng.randint(-40, 40) for _ in range(dims)] for _ in range(3))
        radius = rng.uniform(1, 400)
        bound = drift_clusters.loosening([a, p], [a, q], [radius, 0.0])[0]
        assert bound <= math.dist(p, q) * (1 + 1e-6) + 1e-6
        for _ in range(30):
            way = [rng.gauss(0, 1) for _ in range(dims)]
            toward = [y - x for x, y in zip(a, q)]
            way = [w + rng.choice([0, 1, 5]) * t / max(1, math.hypot(*toward)) for w, t in zip(way, toward)]
            size = math.hypot(*way)
            x = [c + radius * w / size for c, w in zip(a, way)]
            assert math.dist(x, p) - math.dist(x, q) <= bound + 1e-6
    # a centroid that moves past a far small sphere costs less than its drift
    a, p, q = [1000] + [0] * 63, [0, -50] + [0] * 62, [0, 50] + [0] * 62
    assert drift_clusters.loosening([a, p], [a, q], [10.0, 0.0])[0] < 2
