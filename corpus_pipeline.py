"""The corpus pipeline: quality, exact copies, near copies, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of documents; the last returns the
rows with their sampled pieces. Between stages the rows are a table in the shared folder. Every stage works on all rows
that its predecessor kept; empty tables pass through, and extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm import exact_dedup, mixing, near_dedup, piece_sampling, quality
from noticeloom.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score says label 1; the classifier learns from the labelled rows of docs outside the held-out fold."""
    return quality.rated(docs, table(spark, sf_dir, "labels"), *(c for c in COLUMNS if c != "doc_id")).where("predicted = 1").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; rows that repeat doc_id and text come once, a null doc_id stays if no other row has its text."""
    found = materialize(exact_dedup.exact_duplicates(docs), "exact")
    kept = found.where("kept").select("doc_id")
    chosen = docs.select(*COLUMNS).join(kept.where("doc_id is not null").distinct(), "doc_id", "left_semi")
    nowhere = docs.select(*COLUMNS).where("doc_id is null")
    again = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    once = chosen.join(again, "doc_id", "left_anti")
    hashes = found.where("kept").select("doc_id", F.col("text_sha256").alias("sha")).distinct()
    repeated = chosen.join(again, "doc_id", "left_semi").withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).join(hashes, ["doc_id", "sha"], "left_semi").dropDuplicates(["doc_id", "sha"]).drop("sha")
    lone = nowhere.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).join(found.where("kept and doc_id is null").select(F.col("text_sha256").alias("sha")).distinct(), "sha", "left_semi").dropDuplicates(["sha"]).drop("sha")
    return once.unionByName(repeated).unionByName(lone).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the least doc_id, without doc_id only where no other has one. A document is a text with its
    doc_id: of texts that share a doc_id each stays or goes by itself; rows that repeat both go together."""
    found = near_dedup.near_duplicates(docs)
    dropped = materialize(found.where("not kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct(), "near-copies")
    keyed = docs.select(*COLUMNS).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    return keyed.join(dropped, keyed["doc_id"].eqNullSafe(dropped["id"]) & (keyed["sha"] == dropped["sha"]), "left_anti").drop("sha")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows, each as often as the epochs take it, whole ones; a row of which only a beginning fits comes whole.

    Rows without doc_id and rows that repeat one take part like all others, each with what the mixture took of it.
    """
    rows = mixing.mixed(docs.select(*COLUMNS), keep=("text", "lang", "source", "n_chars")).where("taken_tokens > 0")
    times = F.col("full_epochs") + (F.col("prefix_tokens") > 0).cast("long")
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("doc_id", *(F.col(f"kept.{c}").alias(c) for c in COLUMNS[1:]))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's sampled pieces and whether they decode to its text."""
    encoded = piece_sampling.encode_sampled(docs, keep=("lang", "source", "n_chars"), decoded=True)
    return encoded.select("doc_id", "lang", "source", "n_chars", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), (F.col("decoded") == F.col("text")).alias("lossless"))


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The classifier, the sketches and the sampled pieces have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
