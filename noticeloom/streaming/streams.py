"""Streaming forms of ingest, first-seen, alerts, trends and lockouts. Each gives what the batch form gives on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noticeloom.operators import access as A


def read_table(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A directory or file of Parquet as a stream of its rows."""
    there = spark.read.parquet(path)
    reader = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files_per_batch)
    parent, _, name = path.rpartition("/")
    if any(f.endswith(f"/{name}") for f in there.inputFiles()):  # a single file: a stream reads its directory
        return reader.option("pathGlobFilter", name).parquet(parent)
    return reader.parquet(path)


def run_to_end(stream: DataFrame, path: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """All that is there now, exactly once, with its progress kept beside the output; a stopped run goes on where it was."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", f"{path}/rows").start()
    query.awaitTermination()


def batch_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch under its number: repeating a batch replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return write


def new_alerts(stream: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key. Without a watermark the keys are kept for good: a notice that returns isn't new."""
    return stream.dropDuplicates(list(keys))


def windowed_counts(stream: DataFrame, ts: str, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, n): tumbling or sliding windows of event time; rows later than the watermark allows are dropped. Times without zone are of the session's."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide) if slide else F.window(ts, window)).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def first_seen(stream: DataFrame, key: str, stamp: Column) -> DataFrame:
    """(key, first_seen): the least stamp of each key so far, in complete mode."""
    return stream.groupBy(key).agg(F.min(stamp).alias("first_seen"))


class FirstSeen(StatefulProcessor):
    """Value state for each key: its stamp. Keys of the snapshot come with theirs, others get the least of the batch that brings them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "stamp timestamp, known boolean, told boolean")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        stamp = pd.Timestamp(initialState["first_seen"].min())
        if not pd.isna(stamp):
            self.seen.update((stamp.to_pydatetime(), True, False))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        stamp, known, told = self.seen.get() if self.seen.exists() else (None, False, False)
        least = min((x for x in (part["stamp"].min() for part in rows) if not pd.isna(x)), default=None)
        if told or (stamp is None and least is None):
            return
        stamp = pd.Timestamp(stamp if stamp is not None else least)
        self.seen.update((stamp.to_pydatetime(), known, True))
        yield pd.DataFrame({"key": [key[0]], "first_seen": [stamp], "known": [known]})

    def close(self) -> None:
        pass


#: Spark's setting for the state store that keyed processors need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_seen_since(stream: DataFrame, key: str, stamp: str, snapshot: DataFrame) -> DataFrame:
    """(key, first_seen, known), once for each key: the stamp of the snapshot (key, first_seen), or of the stream where that is known by none.

    The state begins with the snapshot and has no end: a notice that returns keeps its stamp, over batches and restarts. Rows without key or without any
    stamp are told nowhere. The session's state store has to be STATE_STORE.
    """
    kind = stream.schema[key].dataType.simpleString()
    given = stream.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(stamp).cast("timestamp").alias("stamp"))
    before = snapshot.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("first_seen").cast("timestamp").alias("first_seen"))
    out = f"key {kind}, first_seen timestamp, known boolean"
    return given.groupBy("key").transformWithStateInPandas(FirstSeen(), out, "Append", "None", initialState=before.groupBy("key"))


def lockouts(stream: DataFrame, limit: int = A.LIMIT, lock_minutes: int = A.LOCK_MINUTES) -> DataFrame:
    """As the batch operator, with each key's counter and lock as state; rows (key, ts, outcome, event_id)."""
    lock = pd.Timedelta(minutes=lock_minutes)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, until = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out, count, until = A.fold(zip(rows["ts"], rows["outcome"], rows["event_id"]), limit, lock, count, until)
        state.update((count, until))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "event_id", "ts", "decision", "failures", "locked_until"]).astype({"locked_until": "datetime64[us]", "ts": "datetime64[us]"})

    out = "key long, event_id long, ts timestamp_ntz, decision string, failures long, locked_until timestamp_ntz"
    return stream.groupBy("key").applyInPandasWithState(decide, out, "failures long, locked_until timestamp_ntz", "append", GroupStateTimeout.NoTimeout)
