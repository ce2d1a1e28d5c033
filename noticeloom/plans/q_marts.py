"""Queries on the marts: counts, shares, trends, listings, shortlist, calendar and card fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions import text as X
from noticeloom.operators import marts as M
from noticeloom.operators import snapshot as S
from noticeloom.plans.catalog import Tables, query
from noticeloom.plans.q_classify import _DAYS, _PLACED, AS_OF, placed

NOW = f"TIMESTAMP '{AS_OF} 09:00:00'"


def _due():
    return F.col("o_orderdate").cast("date")


def _as_of():
    return F.lit(AS_OF).cast("date")


def _now():
    return F.lit(f"{AS_OF} 09:00:00").cast("timestamp_ntz")


@query("count_by_source", "SELECT coalesce(event_type, '?') AS source, count(*) AS n FROM events GROUP BY 1")
def count_by_source(t: Tables) -> DataFrame:
    return t.events.groupBy(F.coalesce("event_type", F.lit("?")).alias("source")).agg(F.count("*").alias("n"))


_OPEN = f"(o_orderdate IS NULL OR {_DAYS} >= 0)"
_NEW = f"(o_orderdate > {NOW} - INTERVAL 48 HOUR)"


@query("home_kpis", f"""SELECT count(*) AS valid, count(*) FILTER (r_name = 'AMERICA') AS domestic, count(*) - count(*) FILTER (r_name = 'AMERICA') AS overseas,
count(*) FILTER (o_orderdate >= {NOW} - INTERVAL 168 HOUR) AS new_this_week, count(*) FILTER ({_NEW}) AS new_n, count(*) FILTER ({_NEW} AND o_orderdate >= {NOW} - INTERVAL 24 HOUR) AS new_today, count(*) FILTER ({_DAYS} BETWEEN 0 AND 7) AS due_soon
FROM {_PLACED} WHERE {_OPEN}""")
def home_kpis(t: Tables) -> DataFrame:
    rows = placed(t).where(M.is_open(_due(), _as_of()))
    seen, since = F.col("o_orderdate"), lambda h: F.col("o_orderdate") >= _now() - F.expr(f"INTERVAL {h} HOURS")
    home = F.count_if(F.col("r_name") == "AMERICA")
    new = M.is_new(seen, _now())
    return rows.agg(F.count("*").alias("valid"), home.alias("domestic"), (F.count("*") - home).alias("overseas"), F.count_if(since(168)).alias("new_this_week"), F.count_if(new).alias("new_n"), F.count_if(new & since(24)).alias("new_today"), F.count_if(M.due_soon(_due(), _as_of())).alias("due_soon"))


def _trend_sql(days: int) -> str:
    return f"""SELECT CAST(d AS DATE) AS day, count(event_id) AS n FROM generate_series(DATE '2024-01-15' - {days - 1}, DATE '2024-01-15', INTERVAL 1 DAY) s(d)
LEFT JOIN (SELECT DISTINCT event_id, CAST(ts AS DATE) AS day FROM events WHERE event_type <> 'error') e ON CAST(d AS DATE) = e.day GROUP BY 1"""


def trend(t: Tables, days: int) -> DataFrame:
    counts = t.events.where("event_type <> 'error'").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count_distinct("event_id").alias("n"))
    return M.zero_filled_days(counts, "day", "n", f"2024-01-{16 - days:02d}" if days < 16 else "2023-12-17", "2024-01-15")


@query("daily_trend", _trend_sql(7))
def daily_trend(t: Tables) -> DataFrame:
    return trend(t, 7)


@query("daily_trend_30", _trend_sql(30))
def daily_trend_30(t: Tables) -> DataFrame:
    return trend(t, 30)


_CATS = ["PROMO", "SMALL", "LARGE", "GLASS"]


@query("category_counts", "SELECT c AS category, count(p_partkey) AS n FROM (VALUES ('PROMO'), ('SMALL'), ('LARGE'), ('GLASS')) v(c) LEFT JOIN part ON p_type = c GROUP BY c")
def category_counts(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame([(c,) for c in _CATS], "category string")
    counts = t.part.groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"))
    return dim.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("count_by_type", f"SELECT coalesce(o_orderstatus, 'unknown') AS notice_type, count(*) AS n FROM orders WHERE {_OPEN} GROUP BY 1")
def count_by_type(t: Tables) -> DataFrame:
    return t.orders.where(M.is_open(_due(), _as_of())).groupBy(F.coalesce("o_orderstatus", F.lit("unknown")).alias("notice_type")).agg(F.count("*").alias("n"))


_BY_TYPE = "SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1"


def _by_type(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))


@query("share_pct", f"SELECT k, n, CAST(floor(100 * n / sum(n) OVER () + 0.5) AS BIGINT) AS share_pct FROM ({_BY_TYPE})")
def share_pct(t: Tables) -> DataFrame:
    return M.share_percent(_by_type(t), "n")


@query("ratio_to_max", f"SELECT k, n, CAST(floor(100 * n / greatest(1, max(n) OVER ()) + 0.5) AS BIGINT) AS ratio_pct FROM ({_BY_TYPE})")
def ratio_to_max(t: Tables) -> DataFrame:
    return M.ratio_to_max(_by_type(t), "n")


@query("count_desc", f"SELECT k, n, CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER) AS place FROM ({_BY_TYPE})")
def count_desc(t: Tables) -> DataFrame:
    return _by_type(t).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "k")))


_LISTED = f"""SELECT o_orderpriority AS keyword, o_orderkey, {_DAYS} AS days FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'F' AND {_OPEN}"""


def _listed(t: Tables) -> DataFrame:
    wanted = F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & (F.col("o_orderstatus") != "F")
    return t.orders.where(wanted & M.is_open(_due(), _as_of())).select(F.col("o_orderpriority").alias("keyword"), "o_orderkey", M.days_until(_due(), _as_of()).alias("days"))


@query("grouped_listing", f"SELECT l.*, g.group_n FROM ({_LISTED}) l JOIN (SELECT keyword, count(*) AS group_n FROM ({_LISTED}) GROUP BY 1) g USING (keyword) ORDER BY keyword, days NULLS LAST, o_orderkey")
def grouped_listing(t: Tables) -> DataFrame:
    """Counts are joined back: a group's rows needn't meet in one task."""
    rows = _listed(t)
    counts = rows.groupBy("keyword").agg(F.count("*").alias("group_n")).withColumnRenamed("keyword", "k2")
    return rows.join(counts, F.col("keyword") == F.col("k2")).drop("k2").orderBy("keyword", F.col("days").asc_nulls_last(), "o_orderkey")


@query("group_totals_rollup", f"SELECT keyword, count(*) AS n FROM ({_LISTED}) GROUP BY ROLLUP (keyword)")
def group_totals_rollup(t: Tables) -> DataFrame:
    return _listed(t).rollup("keyword").agg(F.count("*").alias("n"))


@query("new_count_bar", f"SELECT n, CASE WHEN n = 0 THEN 'none' ELSE n || ' available' END AS label FROM (SELECT count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND {_NEW})")
def new_count_bar(t: Tables) -> DataFrame:
    n = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & M.is_new(F.col("o_orderdate"), _now())).agg(F.count("*").alias("n"))
    return n.select("n", F.when(F.col("n") == 0, "none").otherwise(F.concat(F.col("n").cast("string"), F.lit(" available"))).alias("label"))


@query("calendar_due", "SELECT CAST(o_orderdate AS DATE) AS due_date, count(*) AS n, min(o_orderkey) AS first_id FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def calendar_due(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate is not null").groupBy(_due().alias("due_date")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"))


@query("calendar_month", """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(d AS DATE) AS day, CAST(dayofweek(DATE '1998-08-01') AS INTEGER) AS blanks, coalesce(n, 0) AS n, CAST(d AS DATE) = DATE '1998-08-02' AS today,
CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN date_diff('day', DATE '1998-08-02', CAST(d AS DATE)) <= 3 THEN 'urgent' WHEN date_diff('day', DATE '1998-08-02', CAST(d AS DATE)) <= 7 THEN 'soon' ELSE 'normal' END AS urgency
FROM generate_series(DATE '1998-08-01', DATE '1998-08-31', INTERVAL 1 DAY) s(d) LEFT JOIN c ON c.day = CAST(d AS DATE)""")
def calendar_month(t: Tables) -> DataFrame:
    grid = t.spark.range(1).select(M.month_grid(AS_OF).alias("day"))
    counts = t.orders.groupBy(_due().alias("day")).agg(F.count("*").alias("n"))
    rows = grid.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return rows.select("day", (F.dayofweek(F.trunc("day", "MM")) - 1).alias("blanks"), "n", (F.col("day") == _as_of()).alias("today"), M.urgency(M.days_until(F.col("day"), _as_of()), F.col("n")).alias("urgency"))


@query("shortlist_topk", f"""SELECT o_orderkey, CASE WHEN {_NEW} THEN 0 WHEN {_DAYS} BETWEEN 0 AND 3 THEN 1 WHEN {_DAYS} BETWEEN 0 AND 7 THEN 2 ELSE 3 END AS priority, {_DAYS} AS days
FROM orders ORDER BY priority, days NULLS LAST, o_orderkey LIMIT 5""")
def shortlist_topk(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", _due().alias("due"), M.is_new(F.col("o_orderdate"), _now()).alias("new"))
    return M.shortlist(rows, "o_orderkey", "due", F.col("new"), _as_of()).select("o_orderkey", "priority", "days")


@query("days_until", f"SELECT o_orderkey, {_DAYS} AS days FROM orders")
def days_until(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", M.days_until(_due(), _as_of()).alias("days"))


@query("dday_badge", f"SELECT o_orderkey, CASE WHEN {_DAYS} < 0 THEN 'closed' WHEN {_DAYS} = 0 THEN 'D-DAY' ELSE 'D-' || {_DAYS} END AS label, CASE WHEN {_DAYS} < 0 THEN 'none' WHEN {_DAYS} <= 3 THEN 'red' WHEN {_DAYS} <= 7 THEN 'orange' ELSE 'blue' END AS level FROM orders")
def dday_badge(t: Tables) -> DataFrame:
    label, level = M.badge(_due(), _as_of())
    return t.orders.select("o_orderkey", label.alias("label"), level.alias("level"))


@query("card_tags", f"""SELECT o_orderkey, concat_ws('|', coalesce(r_name, 'unknown'), CASE WHEN r_name = 'ASIA' THEN 'asia-site' END, o_orderpriority, CASE WHEN o_orderstatus <> 'O' THEN 'type-' || o_orderstatus END, CASE WHEN {_NEW} THEN 'NEW' END) AS tags FROM {_PLACED}""")
def card_tags(t: Tables) -> DataFrame:
    tags = F.array_compact(F.array(F.coalesce("r_name", F.lit("unknown")), F.when(F.col("r_name") == "ASIA", "asia-site"), F.col("o_orderpriority"), F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("type-"), "o_orderstatus")), F.when(M.is_new(F.col("o_orderdate"), _now()), "NEW")))
    return placed(t).select("o_orderkey", F.array_join(tags, "|").alias("tags"))


@query("card_view", "SELECT d.doc_id, coalesce('q' || l.quality, 'no info') AS budget, coalesce(lang, 'needs check') AS due, coalesce(nullif(text, ''), 'no description') AS description FROM documents d LEFT JOIN labels l USING (doc_id)")
def card_view(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.concat(F.lit("q"), F.col("quality").cast("string")), F.lit("no info")).alias("budget"), F.coalesce("lang", F.lit("needs check")).alias("due"), F.coalesce(F.nullif("text", F.lit("")), F.lit("no description")).alias("description"))


@query("original_text", "SELECT p_partkey, nullif(p_name, replace(p_name, 'red', 'rot')) AS original FROM part")
def original_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.original_if_different(F.col("p_name"), F.replace("p_name", F.lit("red"), F.lit("rot"))).alias("original"))


@query("link_label", "SELECT page_id, CASE WHEN contains(url, 'example.com') THEN 'Example site' ELSE regexp_extract(url, '//([^/]+)', 1) || ' page' END AS label FROM pages")
def link_label(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.when(F.contains("url", F.lit("example.com")), "Example site").otherwise(F.concat(F.regexp_extract("url", "//([^/]+)", 1), F.lit(" page"))).alias("label"))


@query("updated_text", "SELECT event_id, strftime(ts, '%Y.%m.%d %H:%M') AS updated FROM events")
def updated_text(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy.MM.dd HH:mm").alias("updated"))


@query("format_message", "SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_size > 25 THEN '(untitled)' ELSE p_name END, p_brand, CASE WHEN p_size > 10 THEN p_type END, p_type || ', ' || p_brand, 'https://parts.example/' || p_partkey) AS text FROM part")
def format_message(t: Tables) -> DataFrame:
    title = F.when(F.col("p_size") > 25, "").otherwise(F.col("p_name"))
    text = S.message(title, F.col("p_brand"), F.when(F.col("p_size") > 10, F.col("p_type")), F.lit(None).cast("string"), F.array("p_type", "p_brand"), F.concat(F.lit("https://parts.example/"), F.col("p_partkey").cast("string")))
    return t.part.select("p_partkey", text.alias("text"))


@query("thousands_format", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS amount FROM orders")
def thousands_format(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.thousands(F.floor("o_totalprice")).alias("amount"))


@query("safe_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS due FROM orders")
def safe_date(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", raw.alias("raw"), X.safe_date(raw).alias("due"))


@query("region_bar", f"SELECT d AS domestic, n - d AS overseas, p AS domestic_pct, 100 - p AS overseas_pct FROM (SELECT count(*) AS n, count(*) FILTER (r_name = 'AMERICA') AS d, CAST(coalesce(floor(100 * count(*) FILTER (r_name = 'AMERICA') / nullif(count(*), 0) + 0.5), 0) AS BIGINT) AS p FROM {_PLACED} WHERE {_OPEN})")
def region_bar(t: Tables) -> DataFrame:
    return M.region_bar(placed(t).where(M.is_open(_due(), _as_of())), F.col("r_name"), "AMERICA")


@query("calendar_items", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due_date, count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS day_n FROM orders WHERE o_orderdate IS NOT NULL")
def calendar_items(t: Tables) -> DataFrame:
    """The items of every day, not only their number."""
    return M.calendar_items(t.orders.select("o_orderkey", _due().alias("due_date")), "o_orderkey", "due_date")


@query("calendar_page", """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '1998-07-01', DATE '1998-07-31', INTERVAL 1 DAY) s(d))
SELECT day, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN date_diff('day', DATE '1998-07-12', day) <= 3 THEN 'urgent' WHEN date_diff('day', DATE '1998-07-12', day) <= 7 THEN 'soon' ELSE 'normal' END AS urgency,
day = DATE '1998-07-12' AS today, day = DATE '1998-07-20' AS selected, CAST(3 AS INTEGER) AS blanks, DATE '1998-06-01' AS previous_month, DATE '1998-08-01' AS next_month FROM g LEFT JOIN c USING (day)""")
def calendar_page(t: Tables) -> DataFrame:
    """A month with the day of today, a selected day, and the months beside it."""
    counts = t.orders.groupBy(_due().alias("day")).agg(F.count("*").alias("n"))
    return M.calendar_page(t.spark, counts, "1998-07-12", "1998-07-12", "1998-07-20")


_CODE = "CASE o_orderkey % 4 WHEN 0 THEN 'KRW' WHEN 1 THEN 'CNY' WHEN 2 THEN 'USD' ELSE 'EUR' END"
_COMMAS = "format('{:,}', CAST(floor(o_totalprice) AS BIGINT))"


@query("budget_display", f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {_COMMAS} || '원' WHEN 1 THEN {_COMMAS} || '元' WHEN 2 THEN '$' || {_COMMAS} ELSE 'EUR ' || {_COMMAS} END AS budget FROM orders")
def budget_display(t: Tables) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("KRW", "CNY", "USD", "EUR"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", X.budget_display(F.floor("o_totalprice"), code).alias("budget"))
