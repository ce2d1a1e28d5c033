"""Queries on snapshots, run logs and the outbox. Events stand for two snapshots; purchases fail in the later run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.operators import snapshot as S
from noticeloom.plans.catalog import Tables, query
from noticeloom.sources import landing, publish
from noticeloom.sources import snapshots as files
from noticeloom.streaming.streams import run_to_end

_PREV = "prev AS (SELECT event_id, event_type, ts FROM events WHERE ts < TIMESTAMP '2024-01-16')"
_CUR = "cur AS (SELECT event_id, event_type, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type <> 'purchase')"


def _ts(value: str):
    return F.lit(value).cast("timestamp_ntz")


def _prev(t: Tables) -> DataFrame:
    return t.events.where(F.col("ts") < _ts("2024-01-16")).select("event_id", "event_type", "ts")


def _cur(t: Tables) -> DataFrame:
    return t.events.where((F.col("ts") >= _ts("2024-01-10")) & (F.col("event_type") != "purchase")).select("event_id", "event_type", "ts")


@query("source_fallback", f"WITH {_PREV}, {_CUR} SELECT * FROM cur UNION ALL SELECT * FROM prev WHERE event_type NOT IN (SELECT event_type FROM cur)")
def source_fallback(t: Tables) -> DataFrame:
    return S.source_fallback(_cur(t), _prev(t), "event_type").select("event_id", "event_type", "ts")


@query("source_status", f"""WITH {_PREV}, {_CUR}, r AS (SELECT DISTINCT event_type FROM events UNION SELECT 'fax')
SELECT event_type, (SELECT count(*) FROM cur WHERE cur.event_type = r.event_type) AS fresh_n, (SELECT count(*) FROM prev WHERE prev.event_type = r.event_type) AS prev_n,
CASE WHEN (SELECT count(*) FROM cur WHERE cur.event_type = r.event_type) > 0 THEN 'ok' WHEN (SELECT count(*) FROM prev WHERE prev.event_type = r.event_type) > 0 THEN 'kept' ELSE 'empty' END AS status FROM r""")
def source_status(t: Tables) -> DataFrame:
    registry = t.events.select("event_type").distinct().unionByName(t.spark.createDataFrame([("fax",)], "event_type string"))
    return S.source_status(registry, _cur(t), _prev(t), "event_type")


@query("first_seen_merge", f"WITH {_PREV}, {_CUR} SELECT cur.event_id, cur.event_type, coalesce(prev.ts, TIMESTAMP '2024-02-01 07:00:00') AS first_seen FROM cur LEFT JOIN prev USING (event_id)")
def first_seen_merge(t: Tables) -> DataFrame:
    previous = _prev(t).withColumnsRenamed({"ts": "first_seen"}).withColumn("pos", F.col("event_id"))
    return S.first_seen(_cur(t).select("event_id", "event_type"), previous, ["event_id"], "first_seen", _ts("2024-02-01 07:00:00"), "pos").select("event_id", "event_type", "first_seen")


@query("new_ids", f"WITH {_PREV}, {_CUR} SELECT event_id, event_type FROM cur WHERE event_id NOT IN (SELECT event_id FROM prev)")
def new_ids(t: Tables) -> DataFrame:
    return S.new_ids(_cur(t), _prev(t), "event_id").select("event_id", "event_type")


@query("expiry_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderdate IS NULL OR CAST(o_orderdate AS DATE) >= DATE '1998-08-02'")
def expiry_filter(t: Tables) -> DataFrame:
    keep = S.keep_unexpired(F.col("o_orderdate").cast("date"), F.lit("1998-08-02").cast("date"), F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])
    return t.orders.where(keep).select("o_orderkey", "o_orderpriority")


_NOTE = "'Event ' || event_id || chr(10) || event_type || chr(10) || 'user' || user_id"


@query("notify_outbox", f"""WITH {_PREV}, {_CUR}, n AS (SELECT e.event_id, e.ts, {_NOTE} AS text FROM events e JOIN cur USING (event_id) WHERE e.event_id NOT IN (SELECT event_id FROM prev))
SELECT event_id, text, CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS rank FROM n ORDER BY ts, event_id LIMIT 20""".replace("event_type ||", "e.event_type ||"))
def notify_outbox(t: Tables) -> DataFrame:
    fresh = S.new_ids(_cur(t), _prev(t), "event_id").select("event_id")
    rows = t.events.join(fresh, "event_id", "left_semi")
    text = S.message(F.concat(F.lit("Event "), F.col("event_id").cast("string")), F.col("event_type"), F.concat(F.lit("user"), F.col("user_id").cast("string")), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(None).cast("string"))
    capped = rows.select("event_id", "ts", text.alias("text")).orderBy("ts", "event_id").limit(20)
    return capped.withColumn("rank", F.row_number().over(Window.orderBy("ts", "event_id"))).select("event_id", "text", "rank")


@query("run_log", "SELECT event_type AS source_code, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, substring('rows from ' || min(ts) || ' to ' || max(ts), 1, 200) AS detail, count(*) AS n FROM events GROUP BY event_type")
def run_log(t: Tables) -> DataFrame:
    detail = F.substring(F.concat(F.lit("rows from "), F.min("ts").cast("string"), F.lit(" to "), F.max("ts").cast("string")), 1, 200)
    rows = t.events.groupBy(F.col("event_type").alias("source_code")).agg(detail.alias("detail"), F.count("*").alias("n"))
    return rows.select("source_code", F.when(F.col("source_code") == "error", "failed").otherwise("ok").alias("status"), "detail", "n")


@query("snapshot_export", "SELECT o_orderkey AS id, o_orderpriority AS source_code, CAST(o_orderdate AS DATE) AS due_date FROM orders")
def snapshot_export(t: Tables) -> DataFrame:
    """Written as a table by source and read back."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_code"), F.col("o_orderdate").cast("date").alias("due_date"))
    path = files.scratch(t.spark, "snapshot")
    files.write_snapshot(rows, path)
    return files.read_snapshot(t.spark, path, rows.schema)


@query("snapshot_read", "SELECT n_nationkey AS id, n_name AS title FROM nation")
def snapshot_read(t: Tables) -> DataFrame:
    """A JSON document of the snapshot, and a path that isn't there, read as one table."""
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"))
    path = files.scratch(t.spark, "document")
    files.export_document(rows, path, "2024-01-15T00:00:00+00:00", ["id"])
    schema = "id long, title string"
    return files.read_document(t.spark, path, schema).unionByName(files.read_document(t.spark, path + "-missing", schema))


@query("snapshot_publish", "SELECT o_orderkey AS id, o_orderpriority AS source_code, CAST(o_orderdate AS DATE) AS due_date FROM orders WHERE o_orderstatus <> 'P'")
def snapshot_publish(t: Tables) -> DataFrame:
    """Published twice as sorted lines behind a manifest; a version that was written but never swapped in isn't seen."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_code"), F.col("o_orderdate").cast("date").alias("due_date"), "o_orderstatus")
    path = files.scratch(t.spark, "published")
    publish.publish(rows.where("o_orderstatus = 'P'").drop("o_orderstatus"), path, "2024-01-14T07:00:00+09:00", ["due_date", "id"])
    publish.publish(rows.where("o_orderstatus <> 'P'").drop("o_orderstatus"), path, "2024-01-15T07:00:00+09:00", ["due_date", "id"])
    publish.write_version(rows.drop("o_orderstatus"), path, ["id"])
    return publish.read_published(t.spark, path, "id long, source_code string, due_date date")


_LANDED = "SELECT CASE WHEN page_id % 5 = 0 THEN 'list' ELSE 'detail' END AS page_kind, page_id, md5(html) AS body_md5, CASE WHEN page_id % 5 = 0 THEN page_id % 7 END AS page_no FROM pages"


def _landed(t: Tables) -> str:
    is_list = F.col("page_id") % 5 == 0
    pages = t.pages.select(F.lit("SITE").alias("source_code"), F.when(is_list, "list").otherwise("detail").alias("page_kind"), F.when(is_list, F.col("page_id").cast("string")).alias("list_key"), F.when(is_list, F.col("page_id") % 7).alias("page_no"), F.when(~is_list, F.col("page_id").cast("string")).alias("key"), F.col("html").alias("body"))
    root = files.scratch(t.spark, "landing")
    landing.land(pages, root)
    landing.register_landing(t.spark)
    return root


def _read_back(pages: DataFrame) -> DataFrame:
    return pages.select("page_kind", F.coalesce("key", "list_key").cast("long").alias("page_id"), F.md5(F.col("body").cast("binary")).alias("body_md5"), F.col("page_no").cast("long").alias("page_no"))


@query("landing_batch", _LANDED)
def landing_batch(t: Tables) -> DataFrame:
    """Pages as files in a landing folder, read by the data source."""
    return _read_back(t.spark.read.format("landing").option("path", _landed(t)).option("source", "SITE").option("groupBytes", 1 << 20).load())


@query("landing_stream", _LANDED)
def landing_stream(t: Tables) -> DataFrame:
    """The same folder as a stream, run to its end."""
    path = files.scratch(t.spark, "landed")
    stream = t.spark.readStream.format("landing").option("path", _landed(t)).option("groupBytes", 1 << 20).load()
    run_to_end(_read_back(stream), path)
    return t.spark.read.schema("page_kind string, page_id long, body_md5 string, page_no long").parquet(f"{path}/rows")
