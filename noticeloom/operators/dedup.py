"""First occurrences, ordered cut-offs and unions of lists. Order is always a column, never the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key; rows with a null or empty key are left out."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def two_key(rows: DataFrame, id_key: str, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each id, and of those the first of each second key: a duplicate spends its id."""
    return first_by(first_by(rows, [id_key], *order), keys, *order)


def take_while(rows: DataFrame, list_key: str, stop: Column, *order: str) -> DataFrame:
    """The rows of each list before the first that stops it, in ascending order of the columns named; a null stop is none.

    The first stop of each list is an aggregate and comes back by a join, so a list of any length is spread over all tasks.
    """
    place = lambda: F.struct(*order)
    first = rows.where(stop).groupBy(F.col(list_key).alias("_list")).agg(F.min(place()).alias("_first"))
    joined = rows.join(first, F.col(list_key).eqNullSafe(F.col("_list")), "left")
    return joined.where(F.col("_first").isNull() | (place() < F.col("_first"))).drop("_list", "_first")


def union_sources(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All sources' rows by name, with the source's rank; fields that a source lacks are null."""
    out = None
    for rank, (_, df) in enumerate(sources):
        part = df.withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def page_ends(pages: DataFrame, list_key: str, page_no: str, n_rows: str, last_page: str, most: int) -> DataFrame:
    """The pages of each list that are read: up to `most`, before the first empty one, and up to the last page that the list itself names on any page read before."""
    capped = pages.where(F.col(page_no) <= most)
    filled = take_while(capped, list_key, F.coalesce(F.col(n_rows) == 0, F.lit(True)), page_no)
    # A page that names itself, or an earlier one, as the last ends the list behind it.
    ends = filled.where(F.col(page_no) >= F.col(last_page)).groupBy(F.col(list_key).alias("_list")).agg(F.min(page_no).alias("_end"))
    joined = filled.join(ends, F.col(list_key).eqNullSafe(F.col("_list")), "left")
    return joined.where(F.col("_end").isNull() | (F.col(page_no) <= F.col("_end"))).drop("_list", "_end")


def across_lists(lists: Sequence[DataFrame], key: str, fetched: Column, *order: str) -> DataFrame:
    """Rows of several lists in turn: of those that are fetched the first of each key, so that a list skips what an earlier one has fetched; a row that isn't fetched spends no key."""
    every = None
    for rank, rows in enumerate(lists):
        part = rows.withColumn("list_rank", F.lit(rank))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    return first_by(every.where(fetched), [key], "list_rank", *order)
