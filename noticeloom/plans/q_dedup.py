"""Queries on first occurrences, cut-offs, unions, orders and joins of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import text as X
from noticeloom.operators import dedup as D
from noticeloom.operators import snapshot as S
from noticeloom.plans.catalog import Tables, query


@query("dedup_by_id", "SELECT min(doc_id) AS doc_id, text FROM documents WHERE text <> '' GROUP BY text")
def dedup_by_id(t: Tables) -> DataFrame:
    return D.first_by(t.documents.select("doc_id", "text"), ["text"], "doc_id")


@query("dedup_two_key", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY doc_id) AS r FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lower(replace(text, ' ', '')), lang ORDER BY doc_id) AS r FROM a WHERE r = 1 AND lower(replace(text, ' ', '')) <> '' AND lang <> '')
SELECT doc_id, lang, n_chars FROM b WHERE r = 1""")
def dedup_two_key(t: Tables) -> DataFrame:
    norm = X.normalize_text(F.col("text"))
    rows = t.documents.select("doc_id", "lang", "n_chars", F.when(norm != "", F.sha2(norm, 256)).alias("norm"))  # a digest is shuffled, not the text
    return D.two_key(rows, "doc_id", ["norm", "lang"], "doc_id").select("doc_id", "lang", "n_chars")


@query("dedup_across_lists", "SELECT role, min(conv_id) AS conv_id FROM (SELECT conv_id, role || '-' || turn AS role FROM conversations) GROUP BY role")
def dedup_across_lists(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.concat_ws("-", "role", F.col("turn").cast("string")).alias("role"))
    return D.first_by(rows, ["role"], "conv_id").select("role", "conv_id")


@query("take_while", """SELECT conv_id, turn, role FROM (SELECT *, max(CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s = 0""")
def take_while(t: Tables) -> DataFrame:
    return D.take_while(t.conversations, "conv_id", F.length("text") > 1500, "turn").select("conv_id", "turn", "role")


@query("page_cap", "SELECT conv_id, turn, role FROM conversations WHERE turn <= 2")
def page_cap(t: Tables) -> DataFrame:
    return t.conversations.where("turn <= 2").select("conv_id", "turn", "role")


@query("union_sources", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 0 AS source_rank FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 1 FROM supplier")
def union_sources(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return D.union_sources([("customer", customers), ("supplier", suppliers)])


@query("union_lists", "SELECT DISTINCT id FROM (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def union_lists(t: Tables) -> DataFrame:
    lists = [t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")) for s in ("F", "P")]
    return lists[0].union(lists[1]).distinct()


@query("snapshot_sort", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due, o_orderpriority FROM orders ORDER BY due NULLS LAST, o_orderpriority, o_orderkey")
def snapshot_sort(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("due"), "o_orderpriority")
    return rows.orderBy(*S.snapshot_order("due", "o_orderpriority", "o_orderkey"))


@query("list_detail_join", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def list_detail_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id")


@query("dim_lookup", "SELECT o_orderkey, coalesce(n_name, '?') AS nation, CASE o_orderstatus WHEN 'F' THEN 'Result' WHEN 'O' THEN 'Open' ELSE 'Other' END AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def dim_lookup(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    labels = F.create_map(F.lit("F"), F.lit("Result"), F.lit("O"), F.lit("Open"))
    return rows.select("o_orderkey", F.coalesce("n_name", F.lit("?")).alias("nation"), F.coalesce(labels[F.col("o_orderstatus")], F.lit("Other")).alias("label"))


@query("subscription_match", "SELECT l_orderkey, l_linenumber, l_partkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'SMALL')")
def subscription_match(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([("u1", "PROMO"), ("u1", "SMALL")], "user_id string, keyword string")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.join(wanted, F.col("p_type") == F.col("keyword")).select("l_orderkey", "l_linenumber", "l_partkey", "p_type")


@query("page_ends", """WITH p AS (SELECT conv_id, turn, length(text) % 9 AS n, CASE WHEN conv_id % 3 = 0 THEN 2 + conv_id % 4 END AS last_page FROM conversations WHERE turn <= 5),
a AS (SELECT *, max(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER w AS stop FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, min(CASE WHEN turn >= last_page THEN turn END) OVER (PARTITION BY conv_id) AS last FROM a WHERE stop = 0) SELECT conv_id, turn FROM b WHERE last IS NULL OR turn <= last""")
def page_ends(t: Tables) -> DataFrame:
    """Lists of pages: conversations, whose turns have rows, or none, and some of which name their last page."""
    pages = t.conversations.select("conv_id", "turn", (F.length("text") % 9).alias("n"), F.when(F.col("conv_id") % 3 == 0, 2 + F.col("conv_id") % 4).alias("last_page"))
    return D.page_ends(pages, "conv_id", "turn", "n", "last_page", 5).select("conv_id", "turn")


@query("dedup_over_lists", """WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS list_rank FROM orders WHERE o_orderstatus IN ('F', 'O')),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY list_rank, o_orderkey) AS k FROM l WHERE o_totalprice > 150000) SELECT o_custkey, o_orderkey, list_rank FROM r WHERE k = 1""")
def dedup_over_lists(t: Tables) -> DataFrame:
    """Two lists in turn; rows below the price aren't fetched and leave their customer to later ones."""
    lists = [t.orders.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey", "o_totalprice") for s in ("F", "O")]
    return D.across_lists(lists, "o_custkey", F.col("o_totalprice") > 150000, "o_orderkey").select("o_custkey", "o_orderkey", "list_rank")
