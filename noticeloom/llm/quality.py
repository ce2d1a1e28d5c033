"""Operator 9: a quality classifier with naive Bayes support vectors.

Features are indicators of n-grams: one and two neighbouring words of a text, words standing for themselves and for
their shape (upper and lower letters, digits, marks; a word that repeats its neighbour has a shape of its own). Each
indicator is scaled by the log of its count ratio between the classes, and a linear model with hinge loss is fitted on
the scaled indicators by dual coordinate descent. The fit sees a bounded sample of labelled rows; every row is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import materialize, spread, table, texts

#: Labelled rows that the fit sees, about; beyond that, those with the least hash of their doc_id.
TRAIN_ROWS = 12_000
DIMENSIONS = 1 << 18
#: Rows of the fit that hold an n-gram, for it to count.
LEAST_ROWS = 3
COST = 1.0
EPOCHS = 12
SEED = 7
THRESHOLD = 0.7
#: Characters, up to the next blank, whose words are looked at together, so that a very long text needs no list of all its words.
BLOCK_CHARS = 1 << 20

_RUNS = re.compile("([aA0])\\1+")
_BLANK = re.compile(r"\s")


def _shape_table() -> dict[int, str]:
    kind = lambda c: "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
    return {n: kind(chr(n)) for n in range(0x3000)}


_SHAPES = _shape_table()


def indicators(text: str) -> set[str]:
    """The n-grams of a whole text. An empty text has none."""
    found: set[str] = set()
    before_word, before_shape = "", "^"
    end = 0
    while end < len(text):
        begin = end
        blank = _BLANK.search(text, begin + BLOCK_CHARS)  # a block ends between words
        end = blank.start() if blank else len(text)
        words = text[begin:end].split()
        shapes = _RUNS.sub("\\1", " ".join(words).translate(_SHAPES)).split(" ") if words else []
        shapes = ["=" if w == b else s for s, w, b in zip(shapes, words, [before_word, *words])]
        found.update(words)
        found.update(map(" ".join, set(zip([before_shape, *shapes], shapes))))
        if words:
            before_word, before_shape = words[-1], shapes[-1]
    return found


def hashed(text: str) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(x.encode()) % DIMENSIONS for x in indicators(text)), "int64"))


def _fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Log-count ratios, linear weights and intercept, then slope and offset from margin to score."""
    present = np.zeros(DIMENSIONS, "int64")
    counts = np.ones((2, DIMENSIONS))
    for row, y in zip(rows, labels):
        present[row] += 1
        counts[y, row] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[present < LEAST_ROWS] = 0.0
    data = [r[ratio[r] != 0] for r in rows]
    values = [ratio[r] / max(1.0, np.sqrt((ratio[r] ** 2).sum())) for r in data]
    weights, bias = np.zeros(DIMENSIONS), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([(labels == y).mean() or 1.0 for y in (0, 1)])
    most = COST * 0.5 / share[labels]  # both classes weigh the same
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(SEED)
    norm = np.array([(v**2).sum() + 1.0 for v in values])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (weights[data[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[data[i]] += step * values[i]
                bias += step
                alpha[i] = new
    margin = np.array([weights[d] @ v for d, v in zip(data, values)]) + bias if rows else np.zeros(0)
    slope, offset = 2.0, 0.0
    for _ in range(200 if len(set(labels)) == 2 else 0):  # the scores' logistic curve, weighted as above
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        error = (p - labels) * most
        hessian = most * np.maximum(p * (1 - p), 1e-4)
        a, b, c = (hessian * margin**2).sum() + 1.0, (hessian * margin).sum(), hessian.sum() + 1.0
        g, h = (error * margin).sum() + (slope - 2.0), error.sum() + offset
        slope, offset = slope - (g * c - h * b) / (a * c - b * b), offset - (h * a - g * b) / (a * c - b * b)
    return ratio, weights, bias, slope, offset


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(slot, ratio, weight): the model as a table of at most DIMENSIONS + 1 rows; slot -1 holds the intercept, slope and offset.

    Rows of labels without a doc_id or label don't count, a doc_id with two labels counts with the larger. Without labels
    every score is one half; with a single class, scores lean to it.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known  # about `rows` rows: small enough to broadcast

    @F.pandas_udf("array<long>")
    def features(text: pd.Series) -> pd.Series:
        return text.map(hashed)

    chosen = materialize(texts(documents).join(F.broadcast(sample), "doc_id").select("doc_id", "y", features("text").alias("row")), "training-rows")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        data = pd.concat(parts) if parts else pd.DataFrame({"y": [], "row": []})
        ratio, weights, bias, slope, offset = _fit([np.asarray(r) for r in data["row"]], data["y"].to_numpy("int64"))
        used = np.flatnonzero(ratio)
        yield pd.DataFrame({"slot": [-1, -2, *used], "ratio": [bias, offset, *ratio[used]], "weight": [slope, 0.0, *weights[used]]})

    return chosen.coalesce(1).sortWithinPartitions("doc_id").mapInPandas(fit, "slot long, ratio double, weight double")


def score(text: Column, model: DataFrame) -> Column:
    """Between 0 and 1, higher where label 1 is likelier. Empty and null texts have the score of a text without known n-grams."""
    rows = model.collect()  # at most DIMENSIONS + 2 rows
    ratio, weight = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    head = {r.slot: r for r in rows if r.slot < 0}
    for r in rows:
        if r.slot >= 0:
            ratio[r.slot], weight[r.slot] = r.ratio, r.weight
    bias, slope, offset = head[-1].ratio, head[-1].weight, head[-2].ratio
    shared = SparkSession.active().sparkContext.broadcast((ratio.astype("float32"), (ratio * weight).astype("float32")))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio_, product = shared.value
        for batch in batches:
            out = np.empty(len(batch))
            for i, t in enumerate(batch):
                row = hashed(t or "")
                margin = product[row].sum() / max(1.0, np.sqrt((ratio_[row] ** 2).sum())) + bias
                out[i] = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
            yield pd.Series(out)

    return scores(text)


def held_out(doc_id: Column) -> Column:
    """The fold that no fit sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def rated(documents: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns of keep for each row of documents; the fit takes the labels outside the held-out fold."""
    model = train(documents, labels.where(~held_out(F.col("doc_id"))))
    return spread(documents.select("doc_id", *keep, "text")).select("doc_id", *keep, held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce("text", F.lit("")), model).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
