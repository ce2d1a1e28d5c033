"""Snapshots: fallback for failed sources, expiry, first-seen times, new ids, and the outbox of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_fallback(fresh: DataFrame, previous: DataFrame, source: str) -> DataFrame:
    """Fresh rows, and the previous rows of every source without any."""
    return fresh.unionByName(previous.join(fresh.select(source).distinct(), source, "left_anti"))


def source_status(registry: DataFrame, fresh: DataFrame, previous: DataFrame, source: str) -> DataFrame:
    """For each registered source: ok with its fresh rows, kept with the previous ones, or empty."""
    count = lambda df, name: df.groupBy(source).agg(F.count("*").alias(name))
    rows = registry.join(count(fresh, "fresh_n"), source, "full").join(count(previous, "prev_n"), source, "full").na.fill(0, ["fresh_n", "prev_n"])
    return rows.withColumn("status", F.when(F.col("fresh_n") > 0, "ok").when(F.col("prev_n") > 0, "kept").otherwise("empty"))


def keep_unexpired(due: Column, as_of: Column, source: Column, exempt: Sequence[str]) -> Column:
    """Exempt sources and unknown due dates always stay."""
    return source.isin(*exempt) | due.isNull() | (due >= as_of)


def first_seen(current: DataFrame, previous: DataFrame, keys: Sequence[str], stamp: str, now: Column, order: str) -> DataFrame:
    """Each row's earlier stamp, else now; of several earlier rows the last by order counts, null stamps are absent."""
    earlier = previous.where(F.col(stamp).isNotNull()).groupBy(*keys).agg(F.max_by(stamp, order).alias("_seen"))
    return current.join(earlier, list(keys), "left").withColumn(stamp, F.coalesce("_seen", now)).drop("_seen")


def new_ids(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows whose id is in no earlier row; rows without id are left out."""
    return after.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).join(before.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def snapshot_order(due: str, *ties: str) -> list[Column]:
    return [F.col(due).asc_nulls_last(), *(F.col(t).asc() for t in ties)]


def message(title: Column, source: Column, org: Column, due: Column, tags: Column, url: Column, untitled: str = "(untitled)") -> Column:
    """Lines of what is present; a missing title has a placeholder."""
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit(untitled))
    return F.concat_ws("\n", named, source, org, due, F.nullif(F.array_join(tags, ", "), F.lit("")), url)
