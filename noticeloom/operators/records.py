"""Records out of pages: matches, blocks and label maps as rows that keep their place in the list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import text as X


def regex_records(pages: DataFrame, body: str, pattern: str, fields: Sequence[str], *keep: str) -> DataFrame:
    """One row for each match: pos and the groups under the names of fields. The page is searched once, groups are read from each match, so a pattern may not depend on what stands around it."""
    matches = pages.select(*keep, F.posexplode(X.all_matches(F.col(body), pattern, 0)).alias("pos", "_m"))
    return matches.select(*keep, "pos", *(F.regexp_extract("_m", pattern, i + 1).alias(f) for i, f in enumerate(fields)))


def block_records(pages: DataFrame, body: str, marker: str, fields: dict[str, str], required: str, *keep: str) -> DataFrame:
    """One row for each block behind a marker, with the first match of each field's pattern; blocks without the required field are left out."""
    parts = F.split(F.col(body), marker)
    blocks = pages.select(*keep, F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "_b"))
    return blocks.select(*keep, "pos", *(X.first_match(F.col("_b"), p).alias(f) for f, p in fields.items())).where(F.col(required).isNotNull())


def label_map(text: Column, pattern: str) -> Column:
    """Labels to values; of equal labels the later wins: in the order of label and place it is the one whose neighbour has another label."""
    pairs = F.arrays_zip(X.all_matches(text, pattern, 1).alias("k"), X.all_matches(text, pattern, 2).alias("v"))
    placed = F.array_sort(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), i.alias("at"), x["v"].alias("v"))))
    following = F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1)))
    last = F.zip_with(placed, following, lambda x, y: F.when(y.isNull() | (y["k"] != x["k"]), F.struct(x["k"].alias("k"), x["v"].alias("v"))))
    return F.map_from_entries(F.array_compact(last))


def payload_rows(payloads: DataFrame, body: str, schema: str, *keep: str) -> DataFrame:
    """The parsed payload's fields; malformed payloads are left out."""
    parsed = payloads.select(*keep, F.from_json(F.col(body), schema).alias("_p"))
    return parsed.where(F.col("_p").isNotNull()).select(*keep, "_p.*")


def frontier(keywords: DataFrame, key: str, pages: int, size: int) -> DataFrame:
    """The requests to make: each keyword with its pages 1..n and their offsets."""
    return keywords.select(key, F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page_no")).withColumn("offset", (F.col("page_no") - 1) * size)
