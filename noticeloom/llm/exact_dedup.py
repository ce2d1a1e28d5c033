"""Operator 8: exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and numbered, so that a number
stands for one block content and no other; neighbouring numbers are paired, the distinct pairs sorted and numbered
again, until each document has a single number. Texts of equal length are equal exactly if their numbers are.

Only documents whose length and 64-bit hash occur twice take part: all others are alone for certain. The hash merely
spares work, it never decides. Copies are met in aggregates and joins that Spark can split, never in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import materialize, partitions, table, texts

BLOCK_CHARS = 16_384

ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""


def _numbered(distinct: DataFrame, name: str, *by: str) -> DataFrame:
    """Sorts distinct rows over the cluster, by hash and then content, and numbers them by place; written at once, so that
    a number never changes. Ranges are drawn by the hash alone: no contents are sampled to the driver."""
    spread = distinct.withColumn("order", F.xxhash64(*by)).repartitionByRange(partitions(distinct.sparkSession), "order")
    return materialize(spread.sortWithinPartitions("order", *by).drop("order").withColumn("name", F.monotonically_increasing_id()), name)


def text_names(texts_: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, h, n, name) for rows (doc_id, h, n, text): rows with the same n have the same name exactly if their texts are equal."""
    cut = F.when(F.col("n") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    blocks = materialize(texts_.select("doc_id", "h", "n", F.posexplode(cut).alias("at", "block")), "blocks")
    names = _numbered(blocks.select("block").distinct(), "block-names", "block")
    nodes = materialize(blocks.join(names, "block").select("doc_id", "h", "n", "at", "name"), "nodes").distinct()
    left = F.greatest(F.ceil(F.col("n") / block_chars), F.lit(1)).cast("long")
    nodes = materialize(nodes.withColumn("left", left), "level")
    done = nodes.where("left = 1")
    most = nodes.agg(F.max("left")).first()[0] or 1
    while most > 1:
        one = lambda parity: F.max(F.when(F.col("at") % 2 == parity, F.col("name")))
        pairs = nodes.where("left > 1").groupBy("doc_id", "h", "n", "left", F.expr("cast(at div 2 as int) AS at")).agg(one(0).alias("a"), F.coalesce(one(1), F.lit(-1)).alias("b"))
        pairs = materialize(pairs, "pairs")
        names = _numbered(pairs.select("a", "b").distinct(), "pair-names", "a", "b")
        nodes = materialize(pairs.join(names, ["a", "b"]).select("doc_id", "h", "n", "at", "name", F.ceil(F.col("left") / 2).cast("long").alias("left")), "level")
        done = done.unionByName(nodes.where("left = 1"))
        most = (most + 1) // 2
    return done.select("doc_id", "h", "n", "name")


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest doc_id stays; null texts equal empty ones; a null doc_id is below all others. Rows that
    repeat both doc_id and text are all returned and counted, and one of them is kept. Without rows the result is empty.
    """
    docs = texts(documents).select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), "text")
    rows = materialize(docs.select("doc_id", "h", "n", F.sha2("text", 256).alias("text_sha256")).groupBy("doc_id", "h", "n", "text_sha256").agg(F.count("*").alias("rows")), "documents")
    twice = materialize(rows.groupBy("h", "n").agg(F.count("*").alias("c")).where("c > 1").select("h", "n"), "twice")
    names = materialize(text_names(docs.join(twice, ["h", "n"], "left_semi")), "names")
    same = names["doc_id"].eqNullSafe(rows["doc_id"]) & (names["h"] == rows["h"]) & (names["n"] == rows["n"])
    members = materialize(rows.join(names, same).select(rows["doc_id"], rows["n"], "name", "rows", "text_sha256"), "members")
    classes = materialize(members.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")), "classes")
    alone = rows.join(twice, ["h", "n"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"), "rows", "text_sha256")
    shared = members.join(classes, ["n", "name"]).select("doc_id", "keep_id", "group_size", "rows", "text_sha256")
    every = alone.unionByName(shared).select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    return every.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
