"""Snapshot tables and documents, and scans of landed pages. Paths may be in any store that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; where none is set and all runs in one process (tests), in a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables go to this shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder, read back: what is used several times is worked out once, and lost executors cost no recomputation."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of files as they were fetched; bytes that are no UTF-8 become the replacement character."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), F.call_function("make_valid_utf8", F.col("content").cast("string")).alias("body"))


def write_snapshot(notices: DataFrame, path: str, by: str = "source_code") -> None:
    """Only the sources that have rows are replaced: what a failed source had before stays."""
    notices.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException:  # no such path: an empty snapshot
        return spark.createDataFrame([], schema)


def export_document(notices: DataFrame, path: str, updated_at: str, order: Sequence[str]) -> None:
    """One JSON document {updatedAt, items}; for dashboards, whose snapshots are small: all items meet in one task."""
    place = notices.select(F.struct(*order, F.struct("*").alias("item")).alias("x"))
    items = place.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))
    items.select(F.to_json(F.struct(F.lit(updated_at).alias("updatedAt"), "items")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of a document; a missing or malformed one has none."""
    try:
        lines = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    parsed = lines.select(F.from_json("value", f"struct<updatedAt:string,items:array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in schema.split(','))}>>>").alias("d"))
    return parsed.where("d.items is not null").select(F.explode("d.items").alias("i")).select("i.*")
