"""Operator 10: exact top-k by inner product, with a ball tree in each shard.

Candidates are dealt into shards of bounded size; each shard builds a ball tree and answers the queries by branch and
bound, visiting nodes by their upper bound (query times centre plus norm times radius) and leaving when the bound falls
below the query's current kth score. The first shard's answers set that score for all others: a query reaches them with
the kth score it has, so most of their nodes are never opened. Queries and shards meet in groups of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import materialize, table

K = 10
SCALE = 1024
QUERY_EVERY = 100
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
LEAF_ROWS = 64

ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""


class BallTree:
    """Median splits along the widest axis down to leaves; from there up, two neighbours of a level share a parent."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        self.order = np.arange(len(vectors))
        stack = [(0, len(vectors))]
        leaves = []
        while stack:
            a, b = stack.pop()
            rows = self.order[a:b]
            if b - a <= LEAF_ROWS:
                leaves.append((a, b))
                continue
            part = vectors[rows]
            axis = np.argmax(part.max(0) - part.min(0))
            self.order[a:b] = rows[np.argpartition(part[:, axis], (b - a) // 2)]
            stack += [((a + b) // 2, b), (a, (a + b) // 2)]
        self.vectors, self.ids = vectors[self.order], ids[self.order]
        levels = [leaves]
        while len(levels[-1]) > 1:  # neighbouring leaves share a parent
            below = levels[-1]
            levels.append([(below[i][0], below[min(i + 1, len(below) - 1)][1]) for i in range(0, len(below), 2)])
        self.levels = []
        for spans in levels:
            centres = np.array([self.vectors[a:b].mean(0) for a, b in spans])
            radii = np.array([np.sqrt(((self.vectors[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centres)])
            self.levels.append((spans, centres, radii))

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id), without the query's own row; scores below floor may be missing. Ties go to smaller ids."""
        norm = np.sqrt((query**2).sum())
        slack = 1e-9 * (1.0 + norm * max(np.sqrt((c**2).sum(1)).max() for _, c, _ in self.levels[-1:]) + norm * self.levels[-1][2].max())
        alive = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, 0, -1):  # whole subtrees below the floor fall away
            _, centres, radii = self.levels[depth]
            alive = alive[centres[alive] @ query + norm * radii[alive] + slack >= floor]
            alive = np.unique(np.concatenate([alive * 2, np.minimum(alive * 2 + 1, len(self.levels[depth - 1][0]) - 1)]))
        spans, centres, radii = self.levels[0]
        bounds = centres[alive] @ query + norm * radii[alive] + slack
        scores, ids = np.zeros(0), np.zeros(0, "int64")
        for n in np.argsort(-bounds, kind="stable"):
            if bounds[n] < floor:
                break
            a, b = spans[alive[n]]
            found = self.vectors[a:b] @ query
            keep = (found >= floor) & (self.ids[a:b] != own)
            if keep.any():
                scores, ids = np.concatenate([scores, found[keep]]), np.concatenate([ids, self.ids[a:b][keep]])
                if len(scores) >= k:
                    top = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[top], ids[top]
                    floor = max(floor, scores[-1])
        best = sorted(zip(scores, ids), key=lambda x: (-x[0], x[1]))[:k]
        return [(int(s), int(i)) for s, i in best]


def _search(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    rows: list[tuple] = []
    if len(candidates) and len(queries):
        vectors = np.array(candidates["v"].tolist(), "float64")
        wanted = np.array(queries["v"].tolist(), "float64")
        exact = max(1.0, np.abs(vectors).max(initial=0)) * max(1.0, np.abs(wanted).max(initial=0)) * max(1, vectors.shape[1]) < 2.0**53
        ids = candidates["vec_id"].to_numpy("int64")
        tree = BallTree(vectors, ids) if exact and vectors.shape[1] else None
        k = int(queries["k"].iloc[0])
        for query, own, floor in zip(wanted, queries["vec_id"], queries["floor"].fillna(-np.inf)):
            if tree:
                found = tree.search(query, own, k, floor)
            else:  # products beyond the doubles' whole numbers: whole-number arithmetic on every row
                scores = [sum(int(a) * int(b) for a, b in zip(query, v)) for v in vectors]
                found = sorted(((s, int(i)) for s, i in zip(scores, ids) if i != own), key=lambda x: (-x[0], x[1]))[:k]
            rows += [(own, i, min(max(s, -(1 << 63)), (1 << 63) - 1)) for s, i in found]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(embeddings: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by the inner product of floor(1024 x), ties to the smaller vec_id.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without vec_id; vectors meet
    only vectors of their length. Sums beyond a long count as its ends. A vec_id that repeats counts once for each row, but never for a query with that id.
    """
    finite = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(finite & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v")).withColumn("dim", F.size("v"))
    n = rows.count()
    shards, groups = max(2, -(-n // SHARD_ROWS)), max(1, -(-n // (QUERY_EVERY * QUERY_ROWS)))
    place = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    numbers = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = rows.withColumn("shard", place(shards)).select("*", numbers(groups).alias("part"))
    queries = rows.where(is_query(F.col("vec_id"))).withColumn("part", place(groups)).withColumn("k", F.lit(k))
    schema = "query_id long, vec_id long, score long"

    def searched(of: DataFrame, by: DataFrame) -> DataFrame:
        keys = ["dim", "shard", "part"]
        own = by.select(*(F.col(c).alias(c) for c in by.columns))  # both sides come from one table
        return of.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(_search, schema)

    first = materialize(searched(candidates.where("shard = 0"), queries.withColumns({"floor": F.lit(None).cast("double"), "shard": F.lit(0)})), "first-shard")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    informed = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").drop("query_id").select("*", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))).alias("shard"))
    found = first.unionByName(searched(candidates.where("shard > 0"), informed))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % QUERY_EVERY == 0)
