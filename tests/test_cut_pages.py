"""Pages that are cut off within an entity, or hold rare ones, against SQL."""

import duckdb

import __spark_entry__ as entry

PAGES = ["a &amp; b &amp", "a &lt; b &am", "&quot", "&eacute; &#233; &#xe9; &amp;lt; &amp;amp;", "?a=1&copy=2&lt=3", "&nbsp;|&#39;|&apos;|&middot;|&copy;", "&", "", None]


def test_entities_are_those_of_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = sorted(map(tuple, entry.queries()["unescape_entities"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert found == sorted(con.execute(entry.oracle_sql()["unescape_entities"]).fetchall())
