"""The landing source, publishing by manifest, and the SQL surface."""

import json
import os

import pytest
from pyspark.sql import functions as F

from noticeloom.functions import sql
from noticeloom.functions import text as X
from noticeloom.operators import marts as M
from noticeloom.operators import rules as R
from noticeloom.sources import landing, profiles, publish
from noticeloom.streaming import streams as S


def put(root, name, body):
    os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
    with open(f"{root}/{name}", "wb") as f:
        f.write(body)


def test_landed_files_in_batches_and_as_a_stream(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    landing.register_landing(spark)
    read = lambda **options: spark.read.format("landing").options(path=root, **options).load()
    assert read().count() == 0
    put(root, "A/list/k-1-2.html", "é\xff".encode("latin1"))
    put(root, "A/detail/77.json", "{}".encode())
    put(root, "B/detail/x.y.html", b"z" * 3000)
    put(root, "B/other/1.html", b"no page")
    put(root, "B/detail/.hidden.html", b"not yet whole")
    fields = lambda rows: sorted((r.source_code, r.page_kind, r.list_key, r.page_no, r.key, len(r.body)) for r in rows)
    first = [("A", "detail", None, None, "77", 2), ("A", "list", "k-1", 2, None, 2), ("B", "detail", None, None, "x.y", 3000)]
    assert fields(read().collect()) == first and fields(read(source="A").collect()) == first[:2]
    assert read(groupBytes="1000").rdd.getNumPartitions() == 2 and read().where("fetched_at is null or url is null").count() == 0

    stream = lambda: S.run_to_end(spark.readStream.format("landing").option("path", root).load(), out)
    stream()
    assert fields(spark.read.parquet(f"{out}/rows").collect()) == first
    put(root, "B/list/q-1.html", b"later")
    stream()
    stream()
    assert fields(spark.read.parquet(f"{out}/rows").collect()) == [*first, ("B", "list", "q", 1, None, 5)]


def test_landed_pages_feed_a_profile(spark, tmp_path):
    root = str(tmp_path / "in")
    row = '<tr><td class="hide">7</td><a href="?cid=31&hcid=38">반도체 장비 구매</a><td class="list_date">2026.07.01</td></tr>'
    pages = [("KANC", "list", "all", 1, None, row), ("KANC", "detail", None, None, "31", "마감 일시 : 2026-07-20"), ("KANC", "detail", None, None, "32", None)]
    landing.land(spark.createDataFrame(pages, "source_code string, page_kind string, list_key string, page_no int, key string, body string"), root)
    landing.register_landing(spark)
    lists, details = landing.split_pages(spark.read.format("landing").option("path", root).option("source", "KANC").load())
    got = profiles.collect(profiles.REGISTRY["KANC"], lists, details, "2026-07-08").collect()
    assert [(r.id, str(r.due_date)) for r in got] == [("cid31", "2026-07-20")]


def test_readers_see_one_version_or_the_other(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path), "id int, due date, name string"
    rows = lambda *ids: spark.createDataFrame([(i, None, f"n{i}") for i in ids], schema).repartition(3)
    seen = lambda: sorted(r.id for r in publish.read_published(spark, path, schema).collect())
    assert seen() == []
    assert publish.publish(rows(1, 2, 3), path, "t1", ["due", "id"])["items"] == 3 and seen() == [1, 2, 3]
    with monkeypatch.context() as m:  # a run that ends between the files and the manifest
        m.setattr(publish, "swap_manifest", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            publish.publish(rows(9), path, "t2", ["id"])
    assert seen() == [1, 2, 3] and publish.read_manifest(spark, path)["updatedAt"] == "t1"
    old = publish.read_published(spark, path, schema)
    publish.publish(rows(5, 4), path, "t3", ["id"])
    assert seen() == [4, 5] and sorted(r.id for r in old.collect()) == [1, 2, 3]  # a reader of the version before can end
    for k in range(3):
        publish.publish(rows(k), path, f"u{k}", ["id"])
    assert seen() == [2] and len([d for d in os.listdir(path) if d.startswith("version-")]) == 2
    publish.publish(rows(), path, "none", ["id"])
    assert seen() == []
    with open(f"{path}/manifest.json", "w") as f:
        f.write("{")
    os.path.exists(f"{path}/.manifest.json.crc") and os.remove(f"{path}/.manifest.json.crc")
    assert seen() == []


def test_lines_are_in_order(spark, tmp_path):
    rows = spark.range(500).select(((F.col("id") * 37) % 500).alias("id"), F.when(F.col("id") % 9 > 0, F.col("id") % 50).alias("due"))
    publish.publish(rows, str(tmp_path), "t", ["due", "id"])
    version = publish.read_manifest(spark, str(tmp_path))["version"]
    files = sorted(f for f in os.listdir(f"{tmp_path}/{version}") if f.startswith("part-"))
    lines = [json.loads(line.value) for f in files for line in spark.read.text(f"{tmp_path}/{version}/{f}").collect()]
    key = [(r.get("due") is None, r.get("due") or 0, r["id"]) for r in lines]
    assert key == sorted(key) and len(key) == 500


def test_sql_functions_are_the_column_forms(spark):
    names = sql.register_functions(spark, "t_")
    assert len(names) == len(sql.FUNCTIONS)
    texts = ["<p>A&nbsp;B &lt;c&gt;<!-- x > y --> it's　x</p>", "2024.1.5", "on 2024-3-04", "1,234", "0", ",", "", None, "Of of", "semi etch"]
    rows = spark.createDataFrame([(k, t, ["2024-01-10", "2024-02-30", None][k % 3]) for k, t in enumerate(texts)], "k int, t string, d string")
    t, hard, strong, low = F.col("t"), ["of"], ["SE MI", "a b"], ["zz"]
    as_of = F.lit("2024-01-08").cast("date")
    columns = rows.select(
        "k", X.normalize_text(t), X.strip_tags(t), X.strip_tags(t, comments=True), X.any_term(t, strong), X.token_term(t, "OF"), R.list_relevant(t, hard, strong, low), R.purchase_context(t, hard, ["x y"], ["etch"], ["semi"]),
        X.dotted_date(t), X.iso_date(t), X.safe_date(F.col("d")), X.positive_amount(t), M.days_until(X.safe_date(F.col("d")), as_of).cast("int"), M.deadline_status(X.safe_date(F.col("d")), as_of),
    )
    rows.createOrReplaceTempView("sql_rows")
    text = spark.sql("""SELECT k, t_normalize_text(t), t_strip_tags(t), t_strip_tags_comments(t), t_any_term(t, array('SE MI', 'a b')), t_token_term(t, 'OF'), t_list_relevant(t, array('of'), array('SE MI', 'a b'), array('zz')),
        t_purchase_context(t, array('of'), array('x y'), array('etch'), array('semi')), t_dotted_date(t), t_iso_date(t), t_safe_date(d), t_positive_amount(t), t_days_until(t_safe_date(d), DATE '2024-01-08'), t_deadline_status(t_safe_date(d), DATE '2024-01-08') FROM sql_rows""")
    assert sorted(map(repr, map(tuple, text.collect()))) == sorted(map(repr, map(tuple, columns.collect())))
    assert "Python" not in text._jdf.queryExecution().executedPlan().toString()
