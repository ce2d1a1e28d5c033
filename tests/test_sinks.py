"""Streams over several files, restarts and repeated batches; scans of a key that holds all rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import access as A
from noticeloom.operators import dedup as D
from noticeloom.operators import metrics as M
from noticeloom.streaming import sinks as K
from noticeloom.streaming import streams as S

DAY = datetime.datetime(2024, 1, 1)
at = lambda hours: DAY + datetime.timedelta(hours=hours)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/landing")
    return S.read_table(spark, f"{folder}/landing", files_per_batch=1000)


def test_snapshot_stamps_survive_batches_and_restarts(spark, tmp_path):
    old = spark.createDataFrame([(1, at(-500)), (2, None), (2, at(-400)), (9, at(-300)), (None, at(-1))], "id long, first_seen timestamp_ntz")
    spark.conf.set(*S.STATE_STORE)
    try:
        for rows in ([(1, at(1)), (3, at(5)), (3, at(2)), (None, at(1))], [(1, at(30)), (2, at(31)), (3, at(0)), (4, None)], [(4, at(50)), (2, at(-600)), (5, at(51))]):
            stream = land(spark, str(tmp_path), rows, "id long, ts timestamp_ntz")
            S.run_to_end(S.first_seen_since(stream, "id", "ts", old), str(tmp_path), sink=S.batch_table(str(tmp_path)))
    finally:
        spark.conf.unset(S.STATE_STORE[0])
    got = sorted((r.key, r.first_seen, r.known) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    assert got == [(1, at(-500), True), (2, at(-400), True), (3, at(2), False), (4, at(50), False), (5, at(51), False)]


def test_late_rows_and_counts_are_the_input(spark, tmp_path):
    folder, given = str(tmp_path), []
    for rows in ([(1, at(1)), (2, at(30))], [(3, at(23)), (4, at(23.5)), (5, at(72))], [(6, at(2)), (7, at(71)), (8, at(100)), (9, None)]):
        given += rows
        S.run_to_end(land(spark, folder, rows, "id long, ts timestamp_ntz"), folder, sink=K.late_split(folder, "ts", "1 day"))
    # the largest time before the second batch is 30 h, before the third 72 h; an hour is allowed
    assert sorted((r.id, r.batch) for r in spark.read.parquet(f"{folder}/late").collect()) == [(3, 1), (4, 1), (6, 2), (9, 2)]
    counts = {(r.start, r.n) for r in spark.read.parquet(f"{folder}/counts").groupBy("start").agg(F.sum("n").alias("n")).collect()}
    assert counts == {(at(0), 1), (at(24), 1), (at(48), 1), (at(72), 1), (at(96), 1)}
    # a batch that runs again replaces what it wrote
    K.late_split(folder, "ts", "1 day")(spark.createDataFrame(rows, "id long, ts timestamp_ntz"), 2)
    assert spark.read.parquet(f"{folder}/late").count() + spark.read.parquet(f"{folder}/counts").agg(F.sum("n")).first()[0] == len(given)


def test_outbox_sends_nothing_twice(spark, tmp_path):
    folder, sent = str(tmp_path), []

    def deliver(row):
        sent.append(row.id)
        if row.id == 3:
            raise OSError("no channel")
        return row.id != 2

    send = K.outbox(folder, deliver, "id", ["rank"], cap=3)
    batch = lambda *ids: spark.createDataFrame([(i, i and i % 7) for i in ids], "id long, rank int")
    send(batch(1, 2, 3, 4, 4, 5, None), 0)
    send(batch(1, 2, 3, 4, 4, 5, None), 0)
    send(batch(5, 1, 6, 8), 1)
    assert sent == [1, 2, 3, 8, 6]
    tally = lambda: {r.batch: (r.sent, r.failed, r.capped, r.unknown) for r in K.tally(spark.read.parquet(f"{folder}/ledger"), "batch").collect()}
    assert tally() == {0: (1, 2, 2, 0), 1: (2, 0, 0, 0)}
    # a run that ends between claim and ledger: the claimed are not sent again
    calls = []

    def ends(row):
        calls.append(row.id)
        raise SystemExit

    with pytest.raises(SystemExit):
        K.outbox(folder, ends, "id", ["rank"], cap=3)(batch(10, 11, 12, 13), 2)
    send(batch(10, 11, 12, 13), 2)
    assert sent == [1, 2, 3, 8, 6] and len(calls) == 1 and tally()[2] == (0, 0, 1, 3)
    send(batch(), 3)
    assert spark.read.parquet(f"{folder}/ledger").count() == 11


def test_one_key_with_all_rows(spark):
    """The scans against plain loops, and spread over the tasks."""
    rng = random.Random(1)
    logins = sorted(at(rng.randint(0, 3000)) for _ in range(60))
    requests = [(k, at(rng.randint(-50, 3100))) for k in range(2000)]
    keyed = lambda rows, schema: spark.createDataFrame([("hot", *r) for r in rows], f"key string, {schema}").repartition(4)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = A.session_valid(keyed(requests, "event_id long, ts timestamp_ntz"), keyed([(x,) for x in logins], "ts timestamp_ntz"), "key", "ts")
        tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) == 4 and max(tasks) < 900
        got = {r.event_id: (r.last_login, r.valid) for r in found.collect()}
        for k, ts in requests:
            last = max((x for x in logins if x <= ts), default=None)
            assert got[k] == (last, last is not None and ts < last + datetime.timedelta(hours=24))
        rows = keyed([(k, rng.random() < 0.0005 or k == 1500) for k in range(2000)], "at int, old boolean").withColumn("at", F.col("at"))
        stop = min(r["at"] for r in rows.where("old").collect())
        taken = D.take_while(rows, "key", F.col("old"), "at")
        assert sorted(r["at"] for r in taken.collect()) == list(range(stop)) and "Window" not in taken._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    odd = spark.createDataFrame([(None, 1, False), (None, 2, True), (None, 3, False), ("a", 1, None), ("a", 2, False), ("b", 1, True)], "key string, at int, old boolean")
    assert sorted(map(repr, map(tuple, D.take_while(odd, "key", F.col("old"), "at").collect()))) == ["('a', 1, None)", "('a', 2, False)", "(None, 1, False)"]


def test_run_log(spark, tmp_path):
    rows = spark.createDataFrame([(k, ["include", "hard", "service"][k % 3]) for k in range(30)], "id int, verdict string")

    def work(funnel):
        seen = funnel.verdicts(funnel.watch(rows, raw=F.count("*")), "verdict", ("include", "hard", "service", "never"))
        return funnel.watch(seen.where("verdict = 'include' and id > 5"), included=F.count("*"), largest=F.max("id"))

    log = str(tmp_path / "log")
    write = lambda name: lambda df: df.write.parquet(str(tmp_path / name))
    assert M.logged_run(spark, "A", work, write("a"), log, "2024-01-01") == "ok"
    assert M.logged_run(spark, "B", lambda f: f.watch(rows.where("id < 0"), included=F.count("*")), write("b"), log, "2024-01-01") == "empty"
    assert M.logged_run(spark, "C", lambda f: f.watch(rows.select(F.raise_error(F.lit("x" * 500))), included=F.count("*")), write("c"), log, "2024-01-01") == "error"
    got = {r.source_code: r for r in spark.read.schema(M.RUN_LOG).parquet(log).collect()}
    assert got["A"].counters == {"raw": 30, "include": 10, "hard": 10, "service": 10, "never": 0, "included": 8, "largest": 27} and got["A"].n == 8
    assert got["B"].counters == {"included": 0} and len(got["C"].detail) == 200 and all(r.elapsed_s > 0 for r in got.values())
