"""Rows that share an id, or have none, are spread over slices and tasks."""

import random

from pyspark.sql import functions as F

from noticeloom.llm import mixing


def test_mixing_without_ids(spark):
    """One leaf of 4,000 rows without doc_id: the slices of its order hold about the square root of its rows each."""
    rng = random.Random(3)
    rows = [(None, f"{' '.join('w' * rng.randint(1, 9))} {k}", "en", "src1") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("text_md5", F.md5("text"))
    slices = docs.select(F.substring(mixing._order(F.lit(1)), 1, 2).alias("s")).groupBy("s").count().collect()
    assert len(slices) > 200 and max(r["count"] for r in slices) < 60
    taken = mixing.mixed(docs.drop("text_md5")).agg(F.sum("taken_tokens").alias("taken"), F.sum("n_tokens").alias("all")).first()
    assert taken.taken == taken["all"] * mixing.BUDGET_PERCENT // 100
