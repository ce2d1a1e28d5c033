"""Sinks for foreachBatch whose repetition changes nothing: counts with a dead-letter table, and an outbox with a delivery ledger.

Each writes tables `<path>/<table>/batch=<number>`; a batch that runs again, after a lost driver, replaces or skips what is there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from noticeloom.operators import snapshot as S


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def late_split(path: str, ts: str, window: str, late: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """A sink that counts by window of event time and keeps what comes too late.

    The watermark of a batch is the largest time of all batches before it less the allowance; a row whose window ends at or before it is late and
    goes to `late` as it is, every other is counted in `counts` (start, n). So counts and late rows together are the input, and sums over the
    batches of `counts` are the counts that a watermarked aggregate gives. Rows without time are late.
    """

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/marks/batch={number - 1}").first().mark if number else None
        closed = F.col("_span.end") <= F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {late}") if before is not None else F.lit(False)
        batch = batch.persist()
        timed = batch.withColumn("_span", F.window(F.col(ts).cast("timestamp"), window)).withColumn("_late", closed)  # leaves out rows without time
        try:
            counts = timed.where(~F.col("_late")).groupBy("_span").agg(F.count("*").alias("n"))
            counts.select(F.col("_span.start").cast("timestamp_ntz").alias("start"), "n").write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
            timed.where("_late").drop("_span", "_late").unionByName(batch.where(F.col(ts).isNull())).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            mark = F.greatest(F.max(F.col(ts).cast("timestamp")), F.lit(before).cast("timestamp"))
            batch.agg(mark.alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        finally:
            batch.unpersist()

    return split


def outbox(path: str, deliver: Callable[[Row], bool], key: str, order: Sequence[str], cap: int = 20) -> Callable[[DataFrame, int], None]:
    """A sink that delivers the first `cap` new rows of each batch and keeps a ledger (key, place, status) of every new one.

    Status is sent or failed (also where deliver raises); capped for rows beyond the cap, which no later batch sends; unknown where
    a run ended between claim and ledger. Claims are written before anything is sent and a claimed key is never sent again: a batch
    that is repeated sends nothing twice. At most `cap` rows come to the driver.
    """

    def send(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        claims, ledger = f"{path}/claims", f"{path}/ledger/batch={number}"
        if is_written(spark, ledger):
            return
        kind = batch.schema[key].dataType.simpleString()
        if is_written(spark, f"{claims}/batch={number}"):
            left = spark.read.parquet(f"{claims}/batch={number}")
            left.select(key, "place", F.when(F.col("place").isNull(), "capped").otherwise("unknown").alias("status")).write.mode("overwrite").parquet(ledger)
            return
        rows = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        earlier = [f"{claims}/batch={k}" for k in range(number) if is_written(spark, f"{claims}/batch={k}")] if number else []
        known = spark.read.schema(f"{key} {kind}, place int").parquet(*earlier) if earlier else spark.createDataFrame([], f"{key} {kind}, place int")
        fresh = S.new_ids(rows, known, key).persist()
        try:
            head = fresh.orderBy(*order, key).limit(cap).collect()
            places = spark.createDataFrame([(r[key], k + 1) for k, r in enumerate(head)], f"{key} {kind}, place int")
            fresh.select(key).join(F.broadcast(places), key, "left").write.mode("overwrite").parquet(f"{claims}/batch={number}")
        finally:
            fresh.unpersist()
        results = []
        for row in head:
            try:
                results.append((row[key], "sent" if deliver(row) else "failed"))
            except Exception:  # whatever the channel raises, the message has failed and the others go on
                results.append((row[key], "failed"))
        statuses = spark.createDataFrame(results, f"{key} {kind}, status string")
        claimed = spark.read.parquet(f"{claims}/batch={number}")
        claimed.join(F.broadcast(statuses), key, "left").select(key, "place", F.coalesce("status", F.lit("capped")).alias("status")).write.mode("overwrite").parquet(ledger)

    return send


def tally(ledger: DataFrame, *by: str) -> DataFrame:
    """How many messages of each run were sent, failed, were beyond the cap or have an unknown end."""
    return ledger.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("sent", "failed", "capped", "unknown")))
