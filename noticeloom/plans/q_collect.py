"""A source's whole run, from pages to notices, over pages that are rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import text as X
from noticeloom.operators import records as C
from noticeloom.operators import rules as R
from noticeloom.operators import translate as L
from noticeloom.plans.catalog import Tables, query
from noticeloom.sources import profiles as P

AS_OF, DAYS = "1998-08-02", 400
_ITEMS, _KINDS = ("etcher", "bolt", "wafer stage", "rental etcher", "wafer demolition"), ("void", "purchase order", "we buy")
_FIELD = "[A-Z][a-z]{1,9}"

SEARCH = P.SourceProfile(
    "SEARCH", "Search", "US",
    P.payload_rows("maxPageNum int, rows array<struct<fdid long, name string, digest string, day string>>", "rows", {"key": "fdid", "title": "name", "digest": "digest", "day": "day"}, "maxPageNum"), "ord",
    posted=lambda: F.col("day"), due_patterns=[r"Deadline：(\d{4})-(\d{2})-(\d{2})"], list_text=lambda: F.concat_ws(" ", "title", "digest"),
    list_stage=lambda t: R.list_relevant(t, ["demolition"], ["etcher", "wafer"], ["rental"]), detail_stage=lambda t: R.purchase_context(t, ["void"], ["purchase order"], ["buy"], ["etcher"]), second_key=True,
    whole_text=lambda: F.concat_ws(" ", "title", "digest", "plain"), categories=[("etch", ["etcher"]), ("wafer", ["wafer"])], lookback_days=DAYS,
    fields={"org": lambda t: X.field_until_label(t, "Buyer", _FIELD), "project_no": lambda t: X.field_until_label(t, "No", _FIELD), "budget_amount": lambda t: X.budget_after_label(t, "Budget")},
)


def _pick(values: tuple[str, ...], by: str) -> str:
    return f"element_at(array({', '.join(f"'{v}'" for v in values)}), cast({by} AS int) + 1)"


def _search_pages(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A payload for each priority and week, newest first, its rows by key; and a detail page for each order but every eleventh."""
    orders = t.orders.withColumn("page_no", F.expr("cast(datediff(date '1999-01-01', cast(o_orderdate AS date)) div 7 AS int)"))
    name = F.expr(f"concat({_pick(_ITEMS, 'o_orderkey % 5')}, ' no ', o_custkey % 7)")
    row = F.struct(F.col("o_orderkey").alias("fdid"), name.alias("name"), F.when(F.col("o_orderkey") % 4 > 0, F.lit("a } b")).alias("digest"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    bodies = orders.groupBy(F.col("o_orderpriority").alias("list_key"), "page_no").agg(F.to_json(F.struct(F.lit(90).alias("maxPageNum"), F.array_sort(F.collect_list(row)).alias("rows"))).alias("body"))
    text = F.expr(f"concat('<p>Buyer：Org', o_custkey, ' Kind：', {_pick(_KINDS, 'o_orderkey % 3')}, ' No：P-', o_orderkey, ' Deadline：', date_format(o_orderdate + INTERVAL 30 DAYS, 'yyyy-MM-dd'), ' Budget：KRW ', format_number(floor(o_totalprice), 0), '</p>')")
    return bodies, t.orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").cast("string").alias("key"), text.alias("body"))


@query("collect_search", f"""WITH l AS (SELECT o_orderkey AS k, o_custkey, o_orderpriority AS list_key, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') // 7 AS page_no, CAST(o_orderdate AS DATE) AS d, floor(o_totalprice) AS price,
  [{', '.join(f"'{x}'" for x in _ITEMS)}][CAST(o_orderkey % 5 AS INTEGER) + 1] AS item, [{', '.join(f"'{x}'" for x in _KINDS)}][CAST(o_orderkey % 3 AS INTEGER) + 1] AS kind FROM orders),
t AS (SELECT *, item || ' no ' || (o_custkey % 7) AS title, max(CASE WHEN d < DATE '{AS_OF}' - {DAYS} THEN 1 ELSE 0 END) OVER (PARTITION BY list_key ORDER BY page_no, k ROWS UNBOUNDED PRECEDING) AS stop FROM l WHERE page_no <= 90),
s AS (SELECT *, row_number() OVER (PARTITION BY title, d ORDER BY list_key, page_no, k) AS r FROM t WHERE stop = 0 AND item IN ('etcher', 'wafer stage'))
SELECT 'ord' || k AS id, title, 'Org' || o_custkey AS org, 'P-' || k AS project_no, d AS posted_date, d + 30 AS due_date, CAST(price AS DECIMAL(20,2)) AS budget_amount, CASE WHEN item = 'etcher' THEN 'etch' ELSE 'wafer' END AS category
FROM s WHERE r = 1 AND k % 11 <> 0 AND (kind = 'purchase order' OR (kind = 'we buy' AND item = 'etcher'))""")
def collect_search(t: Tables) -> DataFrame:
    """Payloads through a profile: list ends, relevance, the same title of a day once, detail pages, whole-text test, fields."""
    lists, details = _search_pages(t)
    notices = P.collect(SEARCH, lists, details, AS_OF)
    return notices.select("id", "title", "org", "project_no", "posted_date", F.col("due_date"), "budget_amount", F.array_join("keywords", "+").alias("category"))


@query("frontier_by_customer", "SELECT c_custkey, CAST(p AS INTEGER) AS page_no, CAST((p - 1) * 20 AS INTEGER) AS offset FROM customer, unnest([1, 2, 3]) x(p)")
def frontier_by_customer(t: Tables) -> DataFrame:
    """The requests to make for every customer as a keyword."""
    return C.frontier(t.customer.select("c_custkey"), "c_custkey", 3, 20)


@query("glossary_by_part", "SELECT p_partkey, s AS suffix, p_name || s AS expanded FROM part, (VALUES (''), (' set'), (' kit')) v(s)")
def glossary_by_part(t: Tables) -> DataFrame:
    """Every part's name with and without suffixes."""
    return L.expand_suffixes(t.part.select("p_partkey", "p_name"), "p_name", ["", " set", " kit"]).select("p_partkey", "suffix", "expanded")
