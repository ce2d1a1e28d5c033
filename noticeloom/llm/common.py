"""What the operators of this subpackage share: the table reader, the shared folder, tables that cut lineage and their removal."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named; a null text is an empty one. Other columns play no part."""
    return documents.select("doc_id", *more, F.coalesce(documents["text"], F.lit("")).alias("text"))


#: Tables below this size, by Spark's estimate, often lie in a single row group, which is a single task.
SMALL_BYTES = 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows, those of a small table dealt over all cores; larger ones stay where they lie."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a new one is made if all runs in one process; a cluster has to name one that its executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: operators write their intermediate tables to this shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files behind: what they wrote to the shared folder is all that is read later."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and lost executors cost no recomputation."""
    path = path or new_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what lies at a path of the shared folder, on any store that Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets the driver find out which shuffles nothing reads any more, so that executors delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@dataclass
class Bucketed:
    """A bucketed table in the shared folder: groups and joins by its key need no exchange."""

    spark: SparkSession
    name: str
    path: str

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self, part: str | None = None) -> None:
        """Deletes the table, or the files of one of its partitions."""
        if part is None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, f"{self.path}/{part}" if part else self.path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str, by: str | None = None, spread: bool = True) -> Bucketed:
    """Writes df as a table bucketed by key, with a folder for each value of `by`; spread=False for rows that lie so already, as they come from the groups of another table's buckets."""
    spark = df.sparkSession
    made = Bucketed(spark, f"{name.replace('-', '_')}_{uuid.uuid4().hex}", new_path(spark, name))
    writer = (df.repartition(buckets, key) if spread else df).write.format("parquet").option("compression", "zstd").option("path", made.path).bucketBy(buckets, key).sortBy(key)
    with shuffles_dropped(spark):
        (writer.partitionBy(by) if by else writer).saveAsTable(made.name)
    return made


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
