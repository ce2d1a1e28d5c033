"""Counters that the working plan itself yields, and the run log they are appended to: no second scan counts anything."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUN_LOG = "source_code string, status string, detail string, n long, counters map<string,long>, elapsed_s double, as_of date"
DETAIL_CHARS = 200


class Funnel:
    """The counters of one source's run. A plan is watched at any number of places; the counts are there once its result was written."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.points: list[tuple[Observation, tuple[str, ...]]] = []

    def watch(self, rows: DataFrame, **counters: Column) -> DataFrame:
        """The same rows; counters are aggregates over all of them."""
        point = Observation(f"{self.source}-{len(self.points)}")
        self.points.append((point, tuple(counters)))
        return rows.observe(point, *(F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in counters.items()))

    def verdicts(self, rows: DataFrame, verdict: str, names: tuple[str, ...]) -> DataFrame:
        """Watches how many rows got each verdict."""
        return self.watch(rows, **{name: F.count_if(F.col(verdict) == name) for name in names})

    def counts(self) -> dict[str, int]:
        """All counters; a place that no row reached, as its part of the plan was found empty, counts 0."""
        found: dict[str, int] = {}
        for point, names in self.points:
            got = point.get
            found |= {name: int(got.get(name) or 0) for name in names}
        return found


def append_run(spark: SparkSession, log: str, source: str, status: str, detail: str, n: int, counters: dict[str, int], elapsed_s: float, as_of: str) -> None:
    """One row of the run log: a small file for each source and run."""
    row = spark.createDataFrame([(source, status, detail[:DETAIL_CHARS], n, counters, elapsed_s, None)], RUN_LOG).withColumn("as_of", F.lit(as_of).cast("date"))
    row.coalesce(1).write.mode("append").parquet(log)


def logged_run(spark: SparkSession, source: str, work: Callable[[Funnel], DataFrame], sink: Callable[[DataFrame], None], log: str, as_of: str, result: str = "included") -> str:
    """Writes what `work` plans, in one pass, and appends the run's counters, time and status to the log; returns the status.

    Status is ok, empty (nothing came out; what a sink had before is for the source's fallback to keep) or error with the message's beginning: a
    failing source doesn't stop the others. `result` is the counter that says how many rows came out.
    """
    funnel, began = Funnel(source), time.monotonic()
    try:
        sink(work(funnel))
        counters = funnel.counts()
        n = counters.get(result, 0)
        status, detail = ("ok", f"{n} rows") if n else ("empty", "no rows; earlier rows are kept")
    except Exception as e:  # any failure of one source is a line of its log
        counters, n, status, detail = {}, 0, "error", f"{type(e).__name__}: {e}"
    append_run(spark, log, source, status, detail, n, counters, round(time.monotonic() - began, 3), as_of)
    return status
