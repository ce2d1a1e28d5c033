"""Publishing a snapshot: sorted JSON lines in a folder of their own, and a manifest that is swapped last.

A reader follows the manifest, so it sees the whole old snapshot or the whole new one: a run that ends before the swap changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def write_version(items: DataFrame, path: str, order: Sequence[str]) -> dict:
    """Writes the items as JSON lines in a new version folder, in ranges of the order, and returns what its manifest says; nothing refers to it yet."""
    spark = items.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    counted = Observation()
    placed = items.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(order)), F.to_json(F.struct(*items.columns)).alias("value"))
    placed = placed.orderBy(*(F.col(f"_k{k}").asc_nulls_last() for k in range(len(order)))).observe(counted, F.count("*").alias("n"))
    placed.select("value").write.text(f"{path}/{version}", compression="gzip")
    return {"version": version, "items": counted.get["n"]}


def swap_manifest(spark: SparkSession, path: str, manifest: dict, updated_at: str) -> None:
    """Puts the manifest in place by a rename that replaces the old one in a single step."""
    store, fresh = _path(spark, f"{path}/.{MANIFEST}-{uuid.uuid4().hex}")
    out = store.create(fresh, True)
    out.write(bytearray(json.dumps(manifest | {"updatedAt": updated_at}), "utf-8"))
    out.close()
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    contexts = jvm.org.apache.hadoop.fs.FileContext
    context = contexts.getFileContext(store.getUri(), settings)
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}"), rename)


def publish(items: DataFrame, path: str, updated_at: str, order: Sequence[str], keep: int = 2) -> dict:
    """A new version and the swap; versions beyond the last `keep` are deleted afterwards, so that readers of the one before can end."""
    spark = items.sparkSession
    before = read_manifest(spark, path)
    manifest = write_version(items, path, order)
    manifest["earlier"] = [before["version"], *before.get("earlier", [])][: keep - 1] if before else []
    swap_manifest(spark, path, manifest, updated_at)
    store, folder = _path(spark, path)
    wanted = {manifest["version"], *manifest["earlier"]}
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if before and name.startswith("version-") and name not in wanted:
            store.delete(status.getPath(), True)
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """What is published now; None where nothing is, or where the manifest can't be read."""
    store, found = _path(spark, f"{path}/{MANIFEST}")
    if not store.exists(found):
        return None
    try:
        return json.loads("".join(r.value for r in spark.read.text(f"{path}/{MANIFEST}", wholetext=True).collect()))  # one small file
    except ValueError:
        return None


def read_published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of the version that the manifest names, by their columns; an empty table where nothing is published."""
    manifest = read_manifest(spark, path)
    return spark.read.schema(schema).json(f"{path}/{manifest['version']}") if manifest else spark.createDataFrame([], schema)
