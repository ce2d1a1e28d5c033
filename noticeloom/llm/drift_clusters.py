"""Operator 11: centroid clustering (Lloyd's rounds) with geometrically tightened drift.

Every vector carries the exact distance to its own centroid and a lower bound to all others. When centroids move, the
bound is loosened, but by less than the full drift: a cluster's vectors lie in a sphere around their centroid, and how much nearer a
centroid that moves from p to q can come to any point of that sphere is found in the plane of p, q and the sphere's centre. With m
the middle of p and q, a point that m sees at angle t from the direction of the move gains at most |pq| cos t; the
sphere's points lie within asin(radius / distance to m) of its centre's angle. A vector keeps its cluster if its distance stays strictly
below its bound; the ambiguous rest is scanned against every centroid in whole numbers, so bounds spare work and decide nothing.

Vectors stay where they lie: a round is one pass over the table of the round before and one small sum by cluster; the driver sees
centroids only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import discard, materialize, new_path, spread, table

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64

#: Whole numbers up to this size have products and sums over 64 components that doubles hold exactly.
EXACT = 1 << 22
LIMB_BITS = 20
MOST = (1 << 63) - 1
SLACK = 1e-9
STATE = "vec_id long, v array<double>, cluster int, distance long, low double, scanned boolean"

_DISTANCE = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_ROUND = """
a{k} AS MATERIALIZED (SELECT vec_id, v, key % {n} AS c, key // {n} AS d FROM (SELECT vec_id, v, min(CAST({distance} AS HUGEINT) * {n} + c) AS key FROM vs, c{k} GROUP BY vec_id, v)),
s{k} AS MATERIALIZED (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{k}) GROUP BY c, i),
n{k} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{k} GROUP BY c),
c{next} AS MATERIALIZED (SELECT c, coalesce(n{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN n{k} USING (c))"""
ORACLE = f"""
WITH vs AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('1:' || vec_id) AS h FROM vs ORDER BY h LIMIT {CLUSTERS})),
{",".join(_ROUND.format(k=k, next=k + 1, n=CLUSTERS, distance=_DISTANCE) for k in range(ROUNDS))},
last AS (SELECT vec_id, key % {CLUSTERS} AS c, key // {CLUSTERS} AS d FROM (SELECT vec_id, min(CAST({_DISTANCE} AS HUGEINT) * {CLUSTERS} + c) AS key FROM vs, c{ROUNDS} GROUP BY vec_id))
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM last JOIN c{ROUNDS} USING (c)
"""


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the floor of 64 times each component, of the vectors that take part."""
    scaled = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * SCALE).alias("x"))
    kept = scaled.where((F.size("x") == DIMENSIONS) & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    floor = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole
    return kept.select("vec_id", F.transform("x", floor).alias("v"))


def loosening(before: list[list[int]], after: list[list[int]], radii: list[float]) -> list[float]:
    """For each cluster's sphere, the most by which the lower bounds of its vectors fall as the other centroids move."""
    if max(abs(x) for c in (*before, *after) for x in c) > 1e100:
        return [math.inf] * len(before)
    old, new = np.array(before, "float64"), np.array(after, "float64")
    out = []
    for a, radius in enumerate(radii):
        most = 0.0
        for j in range(len(before)):
            drift = float(np.linalg.norm(new[j] - old[j]))
            if j == a or not drift:
                continue
            apart = old[a] - (old[j] + new[j]) / 2
            distance = float(np.linalg.norm(apart))
            gain = drift
            if distance > radius * (1 + SLACK):
                angle = math.acos(min(1.0, max(-1.0, float(apart @ (new[j] - old[j])) / (distance * drift)))) - math.asin(radius / distance)
                gain = drift * max(0.0, math.cos(max(0.0, angle)))
            most = max(most, gain)
        out.append(most + SLACK * (1 + most))
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


def _whole(v: np.ndarray) -> np.ndarray:
    """The same numbers as Python's whole numbers, for sizes at which doubles lose digits."""
    return np.array([[int(x) for x in row] for row in v], dtype=object).reshape(v.shape)


def _assigner(centroids: list[list[int]], loose: list[float]):
    """A function over batches of state: the nearest centroids, exactly, with as few scans as the bounds allow."""
    within = max(abs(x) for c in centroids for x in c) <= EXACT

    def squares(v: np.ndarray) -> np.ndarray:
        if v.dtype == object:
            return np.array([[sum((x - y) ** 2 for x, y in zip(row, c)) for c in centroids] for row in v], dtype=object).reshape(len(v), len(centroids))
        c = np.array(centroids, "float64")
        return (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch)
            exact = within and np.abs(v).max(initial=0) <= EXACT
            known = exact and "cluster" in batch.schema.names
            cluster = batch.column("cluster").to_numpy().copy() if known else np.zeros(len(v), "int32")
            distance, low, scan = np.zeros(len(v), "float64" if exact else object), np.zeros(len(v)), np.ones(len(v), bool)
            if known:
                distance = ((v - np.array(centroids, "float64")[cluster]) ** 2).sum(1)
                low = batch.column("low").to_numpy() - np.array(loose)[cluster]
                scan = ~(np.sqrt(distance) * (1 + SLACK) < low * (1 - SLACK) - SLACK)
            if scan.any():
                all_squares = squares(v[scan] if exact else _whole(v[scan]))
                cluster[scan] = all_squares.argmin(1)
                rows = np.arange(len(all_squares))
                distance[scan] = all_squares[rows, cluster[scan]]
                if exact and len(centroids) > 1:
                    all_squares[rows, cluster[scan]] = np.inf
                    low[scan] = np.sqrt(all_squares.min(1))
                else:
                    low[scan] = np.inf if len(centroids) == 1 else -np.inf
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype("int32")), pa.array([min(int(d), MOST) for d in distance] if not exact else distance.astype("int64")), pa.array(low), pa.array(scan)],
                ["vec_id", "v", "cluster", "distance", "low", "scanned"],
            )

    return assigned


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, at, limb, total, far): a partition's sums of each component (at 64 the number of rows), in limbs that no sum overflows, and its largest distance."""
    sums: dict[int, list[int]] = {}
    far: dict[int, int] = {}
    for batch in batches:
        v, cluster, distance = _matrix(batch), batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
        exact = np.abs(v).max(initial=0) <= EXACT
        for c in np.unique(cluster).tolist():
            own = cluster == c
            add = v[own].astype("int64").sum(0).tolist() if exact else list(_whole(v[own]).sum(0))
            before = sums.get(c, [0] * (DIMENSIONS + 1))
            sums[c] = [x + y for x, y in zip(before, [*add, int(own.sum())])]
            far[c] = max(far.get(c, 0), int(distance[own].max()))
    out = []
    for c, totals in sums.items():
        for at, total in enumerate(totals):
            sign, rest, limb = (1, total, 0) if total >= 0 else (-1, -total, 0)
            while rest or not limb:
                out.append((c, at, limb, sign * (rest & ((1 << LIMB_BITS) - 1)), far[c]))
                rest, limb = rest >> LIMB_BITS, limb + 1
    if out:
        columns = [pa.array(x, pa.int64()) for x in zip(*out)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "at", "limb", "total", "far"])


def moved(state: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], list[float]]:
    """The floors of the means of each cluster, empty ones as they were, and each cluster's radius around its old centroid."""
    found = state.select("v", "cluster", "distance").mapInArrow(_sums, "cluster long, at long, limb long, total long, far long")
    sums: dict[int, dict[int, int]] = {}
    radii = [0.0] * len(centroids)
    for r in found.groupBy("cluster", "at", "limb").agg(F.sum("total").alias("total"), F.max("far").alias("far")).collect():  # some numbers for each component of each centroid
        of = sums.setdefault(r.cluster, {})
        of[r.at] = of.get(r.at, 0) + (r.total << (LIMB_BITS * r.limb))
        radii[r.cluster] = max(radii[r.cluster], math.inf if r.far == MOST else math.sqrt(r.far))
    means = [[sums[c][at] // sums[c][DIMENSIONS] for at in range(DIMENSIONS)] if c in sums else old for c, old in enumerate(centroids)]
    return means, radii


def clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and scanned: whether the last assignment had to look at every centroid.

    Vectors of other than 64 components take no part, nor do those that are null or hold a null or a component that is not finite (64-fold).
    The k first by sha256 of `1:<vec_id>`, ties by content, are the first centroids; rows without vec_id are assigned but never
    start. A vec_id that repeats is a vector for each row. Fewer than k vectors make fewer clusters; none, an empty result. Numbers
    of any size are exact; distances and sums beyond a long count as its end. Other columns play no part.
    """
    spark = embeddings.sparkSession
    vectors = spread(whole_vectors(embeddings))
    first = vectors.where("vec_id is not null").select("v", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy("h", "v").limit(k).collect()
    centroids = [[int(x) for x in r.v] for r in first]
    if not centroids:
        return vectors.where("false").select("vec_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("scanned", "boolean"))))
    state, loose, last = vectors, [math.inf] * len(centroids), None
    for turn in range(rounds + 1):
        path = new_path(spark, f"clusters-{turn}")
        state = materialize(state.mapInArrow(_assigner(centroids, loose), STATE), "clusters", path)
        if last:
            discard(spark, last)
        last = path
        if turn < rounds:
            after, radii = moved(state, centroids)
            loose, centroids = loosening(centroids, after, radii), after
    sums = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(c, min(sums.get(c, 0), MOST), min(sum(sums.values()), MOST), digest(m)) for c, m in enumerate(centroids)]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings")).drop("scanned")
