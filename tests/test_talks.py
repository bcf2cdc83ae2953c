import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkboard.operators import audit, convo
from sparkboard.streaming.audit import rate_audit_stream, write_audit


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(
        [("s1", 1, "user", "Hello there. How are you?", None), ("s1", 3, "assistant", "Fine", '{"d": 2}'),
         ("s1", 2, "assistant", "x", '{"d": 1}'), ("s2", 5, "assistant", "first", None),
         ("s2", 6, "user", "  b  ", None), ("s2", 7, "user", "later", None), ("s3", 1, "assistant", "only", None)],
        "session_id string, created_at int, role string, content string, dash string",
    )


@pytest.mark.parametrize("text,title", [
    ("Hello there. How are you?", "Hello there."),
    ("  spaced \n", "spaced"),
    (". starts with a stop", ". starts with a stop"),
    ("a" * 50, "a" * 50),
    ("a" * 51, "a" * 47 + "..."),
    ("a" * 58 + "! " + "b", "a" * 58 + "!"),
    ("a" * 59 + "! b", "a" * 59 + "!"),
    ("a" * 60 + "! b", "a" * 47 + "..."),
    ("no blank after.stop " + "c" * 40, "no blank after.stop " + "c" * 27 + "..."),
    ("What?\nNow", "What?"),
    (" ﻿x　", "x"),
])
def test_title(spark, text, title):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(convo.title_of(F.col("t"))).head()[0] == title


def test_sessions_and_messages(spark, messages):
    sessions = spark.createDataFrame(
        [("u", "s1", "t1", "d", 1, 5), ("u", "s2", "t2", None, 2, 9), ("v", "s3", "t3", None, 3, 7)],
        "owner_uid string, id string, title string, dataset_id string, created_at int, updated_at int",
    )
    assert [r["id"] for r in convo.sessions_of(sessions, "u").collect()] == ["s2", "s1"]
    assert [r["id"] for r in convo.sessions_of(sessions).collect()] == ["s2", "s1", "s3"]
    shown = ("role", "content")
    assert rows(convo.messages_of(messages, "s1", columns=shown))[1] == ("assistant", "x")
    assert [r["session_id"] for r in convo.messages_of(messages, columns=shown).collect()] == \
        ["s1"] * 3 + ["s2"] * 3 + ["s3"]
    saved = convo.save_messages(sessions, messages)
    assert {r["id"]: r["updated_at"] for r in saved.collect()} == {"s1": 5, "s2": 9, "s3": 7}
    gone = spark.createDataFrame([("s2",)], "id string")
    left, kept = convo.delete_sessions(sessions, messages, gone)
    assert {r["id"] for r in left.collect()} == {"s1", "s3"} and kept.count() == 4


def test_rollups(messages):
    assert set(rows(convo.session_rollup(messages))) == {("s1", 3, 3), ("s2", 7, 3), ("s3", 1, 1)}
    assert set(rows(convo.session_titles(messages))) == {("s1", "Hello there."), ("s2", "b")}
    flags = convo.dashboard_flags(messages, F.col("dash").isNotNull())
    assert set(rows(flags)) == {("s1", True), ("s2", False), ("s3", False)}
    nothing = convo.dashboard_flags(messages, F.lit(None).cast("boolean"))
    assert {r["has_dashboard"] for r in nothing.collect()} == {False}
    assert rows(convo.first_dashboards(messages, F.col("dash"))) == [("s1", '{"d": 1}')]


def test_caller(spark):
    df = spark.createDataFrame([("u", "1.2.3.4"), (None, "1.2.3.4")], "u string, a string")
    assert [r[0] for r in df.select(audit.caller(F.col("u"), F.col("a"))).collect()] == ["user:u", "ip:1.2.3.4"]


def test_limit_is_per_calendar_minute(spark):
    start = dt.datetime(2024, 1, 1, 10, 0)
    calls = [(start + dt.timedelta(seconds=s), "a") for s in range(31)]
    calls += [(start + dt.timedelta(seconds=60 + s), "a") for s in range(30)]
    df = spark.createDataFrame(calls, "ts timestamp, u string")
    got = audit.rate_audit(df, "ts", F.col("u"))
    assert rows(got) == [(start, start + dt.timedelta(minutes=1), "a", 31)]


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    calls = [(start + dt.timedelta(minutes=7 * i % 600), f"u{i % 5}") for i in range(600)]
    schema = "ts timestamp_ntz, u string"
    source = str(tmp_path / "in")
    spark.createDataFrame(calls[:300], schema).coalesce(1).write.mode("append").parquet(source)
    paths = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        audited = rate_audit_stream(stream, "ts", F.col("u"), "1 day", 3, "1 hour")
        write_audit(audited, *paths).awaitTermination()
        return spark.read.schema(audited.schema).parquet(paths[0])

    run()
    spark.createDataFrame(calls[300:], schema).coalesce(1).write.mode("append").parquet(source)
    # A late marker moves the watermark past every window.
    spark.createDataFrame([(start + dt.timedelta(days=9), "end")], schema).write.mode("append").parquet(source)
    streamed = run()
    table = spark.createDataFrame(calls, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = audit.rate_audit(table, "ts", F.col("u"), 3, "1 hour")
    assert batch.count() > 0
    assert sorted(rows(streamed)) == sorted(rows(batch))


def test_a_delivery_repeated_across_a_restart_counts_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    calls = [(k, start + dt.timedelta(minutes=7 * k % 600), f"u{k % 5}") for k in range(300)]
    calls += [(None, start + dt.timedelta(minutes=5), "nobody")] * 9  # without an id: all count
    schema = "id long, ts timestamp_ntz, u string"
    source, paths = str(tmp_path / "in"), (str(tmp_path / "out"), str(tmp_path / "state"))
    write = lambda given: spark.createDataFrame(given, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        audited = rate_audit_stream(stream, "ts", F.col("u"), "1 day", 3, "1 hour", event_id="id")
        write_audit(audited, *paths).awaitTermination()
        return spark.read.schema(audited.schema).parquet(paths[0])

    write(calls)
    run()
    write([c for c in calls if c[0] is not None])  # again, to a query which was stopped in between
    write([(-1, start + dt.timedelta(days=9), "end")])
    streamed = run()
    table = spark.createDataFrame(calls + calls[:300], schema).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = audit.rate_audit(audit.delivered_once(table, "id"), "ts", F.col("u"), 3, "1 hour")
    assert sorted(rows(streamed)) == sorted(rows(batch))
    assert [r["requests"] for r in batch.where("caller = 'nobody'").collect()] == [9]
