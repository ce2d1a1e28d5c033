"""Connected components of a link table by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.common import materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """(a, b) with a > b. Large: each node hangs its larger neighbours below its least one; small: its smaller neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = both.join(least, "a")
    out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b")
    return materialize(out.distinct(), "stars")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b) other than the roots: the least node of their component. Links of a node to itself and repeats don't matter."""
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        links = _stars(_stars(links, True), False)
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) after further links (a, b): only the links between the components there are take part, each component as one node."""
    label = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    named = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    between = materialize(named.where("a <> b").distinct(), "between")
    if between.isEmpty():
        return roots
    more = components(between)
    further = more.select(F.col("node").alias("root"), F.col("root").alias("above"))
    moved = roots.join(further, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return materialize(moved.unionByName(more), "roots")  # a node of `more` was a root, so it has no row yet


def _mark(links: DataFrame) -> tuple:
    """A number of links and a sum of their hashes: equal exactly if nothing changed, but for chance."""
    return tuple(links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
